"""Collate fine topics into major classes and label tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleryloom.operators.keyed import carry_forward, checked_lookup, first_per_key, join_lookup

# The default merge of fine topics into twelve major classes.
DEFAULT_MAJORS = {
    1: [0, 36, 55, 62, 64, 67, 98, 101],
    2: [8, 19, 20, 41, 65, 83, 90, 97, 99],
    3: [6, 10, 28, 59, 96, 100, 103, 107],
    4: [2, 17, 26, 29, 38, 81, 91, 102],
    5: [33, 44, 46, 50, 53, 56, 76, 80, 84],
    6: [35, 48, 71, 72, 85, 89, 92, 94],
    7: [22, 30, 32, 60, 69, 70, 77, 95],
    8: [1, 7, 14, 18, 24, 45, 52, 54, 73],
    9: [3, 11, 13, 57, 82, 86, 104],
    10: [5, 12, 40, 43, 49, 58, 61, 63, 78],
    11: [4, 15, 21, 23, 25, 51, 87, 88, 105],
    12: [9, 31, 37, 39, 42, 68, 74, 75, 79],
}
UNMAPPED = -1

# A heading line of a mapping text, and a line that is only a list of ids.
HEADING = r"^\s*(\d+)\.\s"
ID_LIST = r"^\s*\d+(\s*,\s*\d+)*\s*$"


def mapping_table(spark: SparkSession, majors: dict[int, list[int]] | None = None) -> DataFrame:
    """(major, major_order, smalls) of a mapping given as a dictionary."""
    rows = [(m, i, s) for i, (m, s) in enumerate((majors or DEFAULT_MAJORS).items())]
    return spark.createDataFrame(rows, "major int, major_order int, smalls array<int>")


def invert_mapping(mapping: DataFrame) -> DataFrame:
    """small -> major; of several claims the first major wins, `claimants` lists them all."""
    claims = mapping.select("major", "major_order", F.explode("smalls").alias("small"))
    return claims.groupBy("small").agg(
        F.min_by("major", F.struct("major_order", "major")).alias("major"),
        F.array_sort(F.collect_set("major")).alias("claimants"),
    )


def duplicate_claims(inverted: DataFrame) -> DataFrame:
    return inverted.where(F.size("claimants") > 1).select("small", "claimants")


def parse_mapping_lines(lines: DataFrame, group: list[str], mode: str = "table") -> DataFrame:
    """(group, major, small) from text lines (group, line_no, text).

    A heading `12. name` opens a major. In `table` mode an id list belongs to the latest heading
    above it; in `paragraph` mode only a list on the line right after a heading counts.
    """
    text = F.trim("text")
    number = F.regexp_extract(text, HEADING, 1)
    marked = lines.withColumn("_heading", F.nullif(number, F.lit("")).cast("int"))
    if mode == "table":
        carried = carry_forward(marked, group, "line_no", "_heading", "major")
    elif mode == "paragraph":
        marked = marked.withColumn("_line", F.struct("_heading"))
        carried = carry_forward(marked, group, "line_no", "_line", "_before", inclusive=False)
        carried = carried.withColumn("major", F.col("_before._heading"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return (
        carried.where(text.rlike(ID_LIST) & F.col("_heading").isNull() & F.col("major").isNotNull())
        .select(*group, "major", F.explode(ids).alias("small"))
        .distinct()
    )


def mapping_from_lines(parsed: DataFrame, group: list[str]) -> DataFrame:
    """(group, major, smalls) with sorted distinct ids."""
    return parsed.groupBy(*group, "major").agg(F.array_sort(F.collect_set("small")).alias("smalls"))


def parse_topic_id(value: str | Column) -> Column:
    """First signed integer in a value such as `topic_23`, `23` or `-1`."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.regexp_extract(text, r"-?\d+", 0).try_cast("int")


def topic_columns(columns: list[str]) -> list[str]:
    """Columns named `topic_<int>`; failing that, every column starting with `topic_`."""
    strict = [c for c in columns if re.fullmatch(r"topic_-?\d+", c)]
    return strict or [c for c in columns if c.startswith("topic_")]


def dominant_columns(df: DataFrame) -> tuple[Column, Column]:
    """(topic id, probability): given columns when present, else the first row maximum.

    A given probability that is not a number becomes NULL.
    """
    names = topic_columns([c for c in df.columns if c not in ("dominant_topic", "dominant_prob")])
    if "dominant_topic" not in df.columns and not names:
        raise ValueError("no dominant_topic column and no topic_* columns")
    values = [F.col(n).cast("double") for n in names]
    best = (F.greatest(*values) if len(values) > 1 else values[0]) if values else F.lit(None).cast("double")
    if "dominant_topic" in df.columns:
        topic = parse_topic_id("dominant_topic")
    else:
        ids = F.array(*[F.lit(int(re.search(r"-?\d+", n).group())) for n in names])
        topic = F.get(ids, F.array_position(F.array(*values), best).cast("int") - 1)
    prob = F.col("dominant_prob").try_cast("double") if "dominant_prob" in df.columns else best
    return topic, prob


def map_major_topic(labels: DataFrame, inverted: DataFrame, topic: str = "topic_raw") -> DataFrame:
    """Add new_topic_num: the major of the raw topic, -1 without one."""
    lookup = checked_lookup(inverted.select(F.col("small").alias(topic), "major"), "topic-map")
    mapped = join_lookup(labels, lookup, topic, "left", spread=labels.columns[0])
    return mapped.withColumn("new_topic_num", F.coalesce("major", F.lit(UNMAPPED))).drop("major")


def unmapped_topics(labels: DataFrame) -> DataFrame:
    rows = labels.where((F.col("new_topic_num") == UNMAPPED) & F.col("topic_raw").isNotNull())
    return rows.select("topic_raw").distinct().orderBy("topic_raw")


def drop_unmapped(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("new_topic_num") != UNMAPPED)


def collate_labels(proportions: DataFrame, inverted: DataFrame) -> DataFrame:
    """Topic proportions to (image_name, topic_raw, dominant_topic, dominant_prob, new_topic_num)."""
    topic, prob = dominant_columns(proportions)
    labels = proportions.select(
        "image_name", topic.alias("topic_raw"), topic.alias("dominant_topic"), prob.alias("dominant_prob")
    )
    mapped = map_major_topic(labels, inverted)
    return mapped.select("image_name", "topic_raw", "dominant_topic", "dominant_prob", "new_topic_num")


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str], copies: str | None = None) -> DataFrame:
    return first_per_key(df, keys, order, copies)


def class_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows per class over all splits (split is NULL) and per split and class."""
    cells = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupingSets([[F.col(label)], [F.col(split), F.col(label)]], F.col(split), F.col(label)).agg(
        F.sum("n").alias("n")
    )
