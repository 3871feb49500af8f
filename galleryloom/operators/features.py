"""Sparse text features in long form: (key, term, weight) rows.

Fitting scans the texts once and aggregates per term; transforming scans them again. Both passes cut
n-grams on the fly (`grams`): writing the n-grams of a corpus would cost many times the corpus itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from galleryloom.functions.text import char_ngrams, fold_accents, squeeze_blanks, text_or_empty, word_ngrams, word_tokens
from galleryloom.operators import grams
from galleryloom.operators.keyed import checked_lookup, join_lookup, place_by_key, unroll
from galleryloom.session import materialize

# A vocabulary of up to so many terms and bytes is broadcast to the tasks that cut the texts; a larger one is joined.
BROADCAST_TERMS = 1 << 23
TERM_BYTES = 256 << 20
PROJECTION_SIZE = 256
# Weights of a task whose projected cells are added up before they travel.
SUM_ROWS = 1 << 20
SELECTED_FEATURES = 2000


@dataclass(frozen=True)
class Family:
    """One n-gram family: how texts are cut and which terms enter the vocabulary."""

    prefix: str
    unit: str
    shortest: int
    longest: int
    min_df: int
    max_df: float
    max_features: int | None = None


# The settings of the word and character families.
WORDS = Family("w:", "word", 1, 2, min_df=5, max_df=0.9)
CHARS = Family("c:", "char", 3, 5, min_df=5, max_df=0.95)
LIMITED_WORDS = Family("w:", "word", 1, 2, min_df=20, max_df=0.9, max_features=40_000)
LIMITED_CHARS = Family("c:", "char", 3, 5, min_df=20, max_df=0.95, max_features=30_000)


def training_join(texts: DataFrame, labels: DataFrame, split: DataFrame, label: str, key: str = "image_name") -> DataFrame:
    """Texts with label and split by inner joins; rows lacking any of the three are dropped."""
    return (
        texts.join(labels.select(key, label), key)
        .join(split.select(key, "split"), key)
        .dropna(subset=["text", label, "split"])
    )


def with_units(docs: DataFrame, family: Family, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """`keep` columns and `units`, what n-grams are cut from: the list of tokens, or the text itself."""
    if family.unit == "word":
        return docs.select(*keep, word_tokens(fold_accents(F.lower(text_or_empty(text)))).alias("units"))
    return docs.select(*keep, squeeze_blanks(text).alias("units"))


def with_terms(docs: DataFrame, family: Family, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """`keep` columns and `terms`, all n-grams of the text with repeats."""
    cut = word_ngrams if family.unit == "word" else char_ngrams
    units = with_units(docs, family, text, keep)
    return units.select(*keep, cut(F.col("units"), family.shortest, family.longest).alias("terms"))


def by_repeats(docs: DataFrame, text: str, key: str = "key") -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key stands alone, and the rows of repeated or NULL keys (None without any), which count as one document."""
    several = (F.count(F.lit(1)) > 1) | F.col(key).isNull()
    repeated = materialize(docs.groupBy(key).agg(several.alias("_again")).where("_again"), "repeated-keys")
    if repeated.isEmpty():
        return docs, None
    marked = join_lookup(docs, repeated, key, "left", spread=text)
    again = F.col("_again").isNotNull() | F.col(key).isNull()
    return marked.where(~again).drop("_again"), marked.where(again).drop("_again")


def _unrolled_counts(docs: DataFrame, family: Family, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Occurrences per document and term, where a document may be several rows. Texts are shuffled by key, their n-grams are not."""
    placed = place_by_key(docs.select(*keep, text), "key")
    terms = unroll(with_terms(placed, family, text, keep), list(keep), F.col("terms"), "term")
    return terms.groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(docs: DataFrame, family: Family, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """Occurrences per document and term."""
    alone, repeated = by_repeats(docs.select(*keep, text), text)
    units = with_units(place_by_key(alone, "key"), family, text, keep)
    counts = grams.counted_rows(units, list(keep), family.shortest, family.longest)
    return counts if repeated is None else counts.unionByName(_unrolled_counts(repeated, family, text, keep))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def fit_vocabulary(train: DataFrame, family: Family, text: str = "text") -> DataFrame:
    """(term, df, idf) of the terms within the document-frequency bounds, written once.

    With max_features only the terms with the most occurrences stay, ties by term.
    """
    n = train.agg(F.count(F.lit(1))).scalar()
    alone, repeated = (train, None) if family.max_features is None else by_repeats(train.select("key", text), text)
    least = family.min_df if repeated is None else 1
    counted = grams.term_stats(with_units(alone, family, text), family.shortest, family.longest, least=least)
    if repeated is not None:
        more = _unrolled_counts(repeated, family, text, ("key",)).groupBy("term").agg(
            F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")
        )
        counted = counted.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    kept = counted.where((F.col("df") >= family.min_df) & (F.col("df") <= F.lit(family.max_df).cast("double") * n))
    if family.max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(family.max_features)
    return checked_lookup(kept.select("term", "df", smooth_idf(n, F.col("df")).alias("idf")), "vocabulary")


def tfidf(
    docs: DataFrame, vocabulary: DataFrame, family: Family, text: str = "text", keep: tuple[str, ...] = ("key",)
) -> DataFrame:
    """`keep` columns, term, weight: tf x idf with unit length per document.

    Up to BROADCAST_TERMS the vocabulary travels to the texts; a larger one, and documents of several rows, take a join.
    """
    if not fits_tasks(vocabulary):
        return _joined_weights(term_counts(docs, family, text, keep), vocabulary, keep)
    alone, repeated = by_repeats(docs.select(*keep, text), text)
    found = vocabulary.select("term", "idf").toArrow().combine_chunks()
    terms = grams.Vocabulary.of(found, family.unit == "word")
    weights = grams.weighted(with_units(place_by_key(alone, "key"), family, text, keep), list(keep), family.shortest, family.longest, terms)
    if repeated is None:
        return weights
    return weights.unionByName(_joined_weights(_unrolled_counts(repeated, family, text, keep), vocabulary, keep))


def fits_tasks(vocabulary: DataFrame) -> bool:
    """True when the terms stay within the bounds of a broadcast."""
    rows, size = vocabulary.limit(BROADCAST_TERMS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + 12), F.lit(0))).first()
    return rows <= BROADCAST_TERMS and size <= TERM_BYTES


def _joined_weights(counts: DataFrame, vocabulary: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    known = join_lookup(counts, vocabulary, "term", load="df", spread="key")
    raw = known.select(*keep, "term", (F.col("tf") * F.col("idf")).alias("_raw"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy("key")))
    return raw.select(*keep, "term", (F.col("_raw") / length).alias("weight"))


def stack_features(parts: dict[str, DataFrame]) -> DataFrame:
    """Features of several families side by side; the term is prefixed by its family."""
    stacked = [df.withColumn("term", F.concat(F.lit(prefix), "term")) for prefix, df in parts.items()]
    result = stacked[0]
    for more in stacked[1:]:
        result = result.unionByName(more)
    return result


def sparse_projection(
    weights: DataFrame, vocabulary: DataFrame, components: int = PROJECTION_SIZE, seed: int = 42
) -> DataFrame:
    """(key, component, value): very sparse random projection with density 1/sqrt(D).

    The sign of (term, component) comes from a hash, so the matrix needs no random state: its about
    D x components / sqrt(D) non-zero cells are made once per vocabulary term.
    """
    size = vocabulary.agg(F.count(F.lit(1)).cast("double")).scalar()
    half = F.lit(0.5).cast("double") / F.col("_root")
    scale = F.sqrt(F.col("_root") / float(components))

    # The share of a cell is its first eight hex digits over 2^32. Nearly all cells are empty and leave by comparing the digits as text.
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "term", F.col("component").cast("string"))), 1, 8)
    bound = F.ceil(half * 2.0 * float(2**32))
    limit = F.when(bound >= 2**32, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(bound), 8, "0")))
    rooted = vocabulary.select("term", "df", F.sqrt(size).alias("_root")).withColumn("_limit", limit)
    drawn = rooted.select("*", F.explode(F.sequence(F.lit(0), F.lit(components - 1))).alias("component")).withColumn("_digits", digits)
    share = F.conv("_digits", 16, 10).cast("double") / float(2**32)
    cell = F.struct("component", F.when(share < half, -scale).otherwise(scale).alias("r"))
    used = drawn.where(F.col("_digits") < F.col("_limit")).select("term", "df", cell.alias("cell"))
    matrix = checked_lookup(used.groupBy("term").agg(F.first("df").alias("df"), F.collect_list("cell").alias("cells")), "projection")
    placed = join_lookup(weights, matrix, "term", load="df", spread="key").select(
        "key", "weight", F.col("cells.component").alias("components"), F.col("cells.r").alias("signs")
    )
    schema = StructType([weights.schema["key"]]).add("components", ArrayType(IntegerType())).add("sums", ArrayType(DoubleType()))
    # A document's sums travel as one row; they are grouped by its key again only where it came from several tasks or blocks.
    summed = place_by_key(placed.mapInArrow(_summed_cells, schema), "key")
    cells = F.arrays_zip(F.col("components").alias("component"), F.col("sums").alias("sum"))
    return summed.select("key", F.inline(cells)).groupBy("key", "component").agg(F.sum("sum").alias("value"))


def _summed_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, components, sums) of runs of about SUM_ROWS weights: the cells of a document that lie in a run, added up."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SUM_ROWS:
            yield _added_cells(pa.Table.from_batches(held).combine_chunks())
            held, rows = [], 0
    if rows:
        yield _added_cells(pa.Table.from_batches(held).combine_chunks())


def _added_cells(run: pa.Table) -> pa.RecordBatch:
    keys = run["key"].combine_chunks().dictionary_encode("encode")
    lists = [run[name].combine_chunks() for name in ("components", "signs")]
    lengths = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    components, signs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    width = int(components.max(initial=0)) + 1
    owner = np.repeat(keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    codes, place = np.unique(owner * width + components, return_inverse=True)
    sums = np.bincount(place, np.repeat(run["weight"].to_numpy(), lengths) * signs, len(codes))
    owners, components = np.divmod(codes, width)
    found, counts = np.unique(owners, return_counts=True)
    edges = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
    columns = [pa.ListArray.from_arrays(edges, x) for x in (pa.array(components, pa.int32()), pa.array(sums))]
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(found)), *columns], ["key", "components", "sums"])


def dense_rows(projected: DataFrame, components: int = PROJECTION_SIZE) -> DataFrame:
    """(key, values ARRAY<DOUBLE>) with zeros filled in."""
    cells = projected.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("component", "value"))).alias("_m"))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(components - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))
    )
    return cells.select("key", filled.alias("values"))


def chi2_scores(weights: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """(term, chi2) from (key, label, term, weight) rows; `classes` holds one (label, n) row per class.

    With expected value E = share x total, the sum over classes of (O - E)^2 / E equals the sum of
    O^2 / E minus the total, so absent (term, class) cells need not be filled in.
    """
    rows = classes.agg(F.sum("n")).scalar()
    shares = classes.select(label, (F.col("n") / rows).alias("_share"))
    observed = weights.groupBy("term", label).agg(F.sum("weight").alias("_o"))
    return (
        join_lookup(observed, checked_lookup(shares, "class-shares"), label, spread="term")
        .groupBy("term")
        .agg(F.sum("_o").alias("_total"), F.sum(F.col("_o") * F.col("_o") / F.col("_share")).alias("_q"))
        .select("term", (F.col("_q") / F.col("_total") - F.col("_total")).alias("chi2"))
    )


def select_k_best(scores: DataFrame, k: int = SELECTED_FEATURES) -> DataFrame:
    """The k terms with the highest score (to 6 digits), ties by term; all of them when fewer."""
    return scores.orderBy(F.desc(F.round("chi2", 6)), "term").limit(k)


def keep_selected(weights: DataFrame, selected: DataFrame) -> DataFrame:
    """Only the selected terms; at most k of them, so the list is broadcast."""
    return join_lookup(weights, selected.select("term"), "term", "left_semi", spread="key")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, index): classes as text in text order, so "10" comes before "2"."""
    classes = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias(label)).distinct()
    return classes.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("index"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): balanced weights N / (C x n_c). One row per class, to be joined back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").cast("double").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return counts.withColumn(
        "weight", totals.select("rows").scalar() / (totals.select("classes").scalar() * F.col("n"))
    )
