"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys can be hot.
HOT_SHARE = 2000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches, so that a batch of very long texts still fits beside the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def salted_join(left: DataFrame, lookup: DataFrame, key: str, load: str, spread: Column, how: str = "left") -> DataFrame:
    """Shuffle join of a table to a lookup with unique keys; hot keys are spread over SALTS partitions.

    `load` is the lookup's column with the number of left rows per key. Only the list of hot keys, fewer
    than HOT_SHARE, is broadcast: the lookup itself never passes through the driver.
    """
    total = lookup.agg(F.sum(load)).scalar()
    hot = lookup.where(F.col(load) * HOT_SHARE > total).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread_out = lookup.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(spread_out.hint("shuffle_merge"), [key, "_salt"], how).drop("_salt")
