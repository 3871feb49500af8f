"""Reproducible splits: rows are ranked by a hash of seed and id, never by a random generator.

The rank is not computed row by row. `hash_cutoff` finds the hash value at the wanted rank, and rows
are compared with it in place, so the data itself is not shuffled and no class is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.operators.keyed import checked_lookup, first_per_key, hash_cutoff, hash_key, join_lookup

TEST_FRACTION = 0.2
HELD_FRACTION = 0.20
TEST_OF_HELD = 20 / 36
SEED = 42


def _ceil_share(n: Column, fraction: float) -> Column:
    return F.ceil(F.lit(fraction).cast("double") * n)


def class_quotas(df: DataFrame, label: str, fraction: float = TEST_FRACTION) -> DataFrame:
    """(label, n, quota): test rows per class, whole numbers by largest remainder, ties by class.

    The window runs over one row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    n_test = _ceil_share(total, fraction)
    share = n_test * F.col("n") / total
    based = counts.select(label, "n", n_test.alias("_test"), share.alias("_share"), F.floor(share).alias("_base"))
    everything = Window.partitionBy()
    by_remainder = Window.orderBy(F.desc(F.round(F.col("_share") - F.col("_base"), 9)), label)
    left_over = F.col("_test") - F.sum("_base").over(everything)
    extra = F.when(F.row_number().over(by_remainder) <= left_over, 1).otherwise(0)
    return based.select(label, "n", (F.col("_base") + extra).alias("quota"))


def _marked(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", hash_key(key, seed))


def random_split(df: DataFrame, key: str, fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Add `split`: the first ceil(fraction * N) rows by hash are `test`, the rest `train`."""
    marked = _marked(df, key, seed)
    quota = df.agg(_ceil_share(F.count(F.lit(1)), fraction).alias("quota"))
    cutoff = hash_cutoff(marked.select("_h"), "_h", quota, []).scalar()
    return marked.withColumn("split", F.when(F.col("_h") <= cutoff, "test").otherwise("train")).drop("_h")


def stratified_split(
    df: DataFrame, key: str, label: str, fraction: float = TEST_FRACTION, seed: int = SEED
) -> DataFrame:
    """Add `split` with the same share of `test` in every class."""
    marked = _marked(df, key, seed)
    quotas = class_quotas(df, label, fraction).select(label, "quota")
    cutoffs = checked_lookup(hash_cutoff(marked.select(label, "_h"), "_h", quotas, [label]), "cutoffs")
    joined = join_lookup(marked, cutoffs, label, "left", spread=key)
    return joined.withColumn("split", F.when(F.col("_h") <= F.col("cutoff"), "test").otherwise("train")).drop(
        "_h", "cutoff"
    )


def can_stratify(df: DataFrame, label: str, fraction: float = TEST_FRACTION) -> bool:
    """True with at least two classes of two rows each and room for every class on both sides."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, smallest, classes, n_test = counts.agg(
        F.sum("n"), F.min("n"), F.count(F.lit(1)), _ceil_share(F.sum("n"), fraction)
    ).first()
    return bool(total) and smallest >= 2 and classes > 1 and n_test >= classes and total - n_test >= classes


def train_test_split(
    df: DataFrame, key: str, label: str, fraction: float = TEST_FRACTION, seed: int = SEED
) -> DataFrame:
    """Stratified where possible, else random."""
    if can_stratify(df, label, fraction):
        return stratified_split(df, key, label, fraction, seed)
    return random_split(df, key, fraction, seed)


def three_way_split(
    df: DataFrame, key: str, held: float = HELD_FRACTION, test_of_held: float = TEST_OF_HELD, seed: int = SEED
) -> DataFrame:
    """Add `split`: a held-out share, of which a part is `test` and the rest `val`; others `train`.

    Rows are reduced to one per key first, so that repeats do not count in the shares.
    The default fractions give 80 / 8.9 / 11.1 % for train / val / test.
    """
    rest = [c for c in df.columns if c != key]
    df = first_per_key(df, [key], rest) if rest else df.distinct()
    marked = _marked(df, key, seed)
    n_held = _ceil_share(F.count(F.lit(1)), held)
    hashes = marked.select("_h")
    test_cut = hash_cutoff(hashes, "_h", df.agg(_ceil_share(n_held, test_of_held).alias("quota")), []).scalar()
    held_cut = hash_cutoff(hashes, "_h", df.agg(n_held.alias("quota")), []).scalar()
    split = F.when(F.col("_h") <= test_cut, "test").when(F.col("_h") <= held_cut, "val").otherwise("train")
    return marked.withColumn("split", split).drop("_h")


def split_table(df: DataFrame, key: str = "image_name") -> DataFrame:
    """The published split: key and split only, ordered by key."""
    return df.select(key, "split").orderBy(key)


def split_shares(df: DataFrame) -> DataFrame:
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())
