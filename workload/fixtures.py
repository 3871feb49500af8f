"""The given tables shaped as the inputs of the operators; every fixture covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleryloom.functions.annotations import parse_documents
from galleryloom.operators.keyed import place_by_key

TOPICS = 12


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """documents as image descriptions."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("img_"), "doc_id", F.lit(".jpg")).alias("image_name"),
        F.col("text").alias("description"),
        "lang",
    )


def vision_json(spark: SparkSession, sf: str) -> DataFrame:
    """One annotation text per order, in the layouts that occur: doc_key, topic, json.

    Remainder of the key by 11: 0 sentinel text, 1 raw layout, 2 plain strings, 3 no image name,
    4 no scores, 5 cut off in the middle, else normalised layout.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    shape = F.pmod("l_orderkey", F.lit(11))
    score = F.when(shape != 4, F.col("l_discount") * F.lit(10.0).cast("double"))
    items = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.col("p_name").alias("description"), score.alias("score")
    )
    grouped = items.groupBy("l_orderkey").agg(F.collect_list(F.struct("description", "score")).alias("items"))
    name = F.when(shape == 3, "").otherwise(
        F.concat(F.lit('"image_name":"order_'), F.col("l_orderkey").cast("string"), F.lit('",'))
    )
    listed = F.to_json("items")
    body = (
        F.when(shape == 0, '"labels":"No labels detected."')
        .when(shape == 1, F.concat(F.lit('"labelAnnotations":'), listed))
        .when(shape == 2, F.concat(F.lit('"labels":'), F.to_json(F.col("items.description"))))
        .otherwise(F.concat(F.lit('"labels":'), listed))
    )
    json = F.concat(F.lit("{"), name, body, F.when(shape == 5, "").otherwise("}"))
    return grouped.select(
        F.col("l_orderkey").alias("doc_key"),
        (F.pmod("l_orderkey", F.lit(TOPICS)) + 1).cast("int").alias("topic"),
        json.alias("json"),
    )


def vision_docs(spark: SparkSession, sf: str) -> DataFrame:
    return parse_documents(vision_json(spark, sf), "json", ("doc_key", "topic"))


def color_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One colour document per part; even keys normalised layout, odd keys raw layout, some without."""
    part = place_by_key(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    key = F.col("p_partkey")
    color = F.struct(
        F.pmod(key * 37, F.lit(256)).alias("red"),
        F.pmod(key * 91, F.lit(256)).alias("green"),
        F.pmod(F.col("p_size") * 5, F.lit(256)).alias("blue"),
    )
    entries = F.array(F.struct(color.alias("color")))
    processed = F.to_json(F.struct(F.struct(entries.alias("dominant_colors")).alias("image_properties")))
    raw = F.to_json(
        F.struct(
            F.struct(F.struct(entries.alias("colors")).alias("dominantColors")).alias("imagePropertiesAnnotation")
        )
    )
    json = (
        F.when(F.pmod(key, F.lit(17)) == 0, '{"image_properties":"No image properties detected."}')
        .when(F.pmod(key, F.lit(2)) == 0, processed)
        .otherwise(raw)
    )
    texts = part.select(
        F.col("p_partkey").alias("doc_key"),
        (F.pmod(key, F.lit(TOPICS)) + 1).cast("int").alias("topic"),
        json.alias("json"),
    )
    return parse_documents(texts, "json", ("doc_key", "topic"))


def line_responses(spark: SparkSession, sf: str, section: str, item: Column, with_part: bool = False) -> DataFrame:
    """Raw response documents: one per order with `section` listing an item per line.

    `section` may name nested objects (`a.b.c`). Orders divisible by 7 lack the section.
    """
    lines = table(spark, sf, "lineitem")
    if with_part:
        lines = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # The lines are shuffled as they are; items, which may be large, are made beside their order.
    grouped = place_by_key(lines, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(item).alias("_items"))
    return _responses(grouped, "l_orderkey", section, F.col("_items"))


def _responses(df: DataFrame, key: str, section: str, value: Column) -> DataFrame:
    name = F.concat(F.lit("order_"), F.col(key).cast("string"))
    *outer, last = section.split(".")
    for step in [last, *reversed(outer)]:
        value = F.struct(value.alias(step))
    top = section.split(".")[0]
    present = F.when(F.pmod(key, F.lit(7)) != 0, value[top])
    json = F.to_json(F.struct(name.alias("image_name"), present.alias(top)))
    return parse_documents(df, json)


def order_responses(spark: SparkSession, sf: str, section: str, value: Column) -> DataFrame:
    return _responses(table(spark, sf, "orders"), "o_orderkey", section, value)
