"""Sharding by a two-pass external shuffle: seeded scatter into buckets, then a Fisher-Yates shuffle of each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, partitions, table
from galleryloom.session import scratch_path

SHARDS = 24
SEED = 42
# A bucket is shuffled in the memory of one task.
BUCKET_BYTES = 64 << 20
ROW_OVERHEAD = 8
LAW = "rows"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def _fisher_yates(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Swap each row, from the last on, with a random one at or before it; the draw depends on seed and bucket."""
        order = rows.sort_values(["_order", "_tie"], kind="stable").index.to_numpy().copy()
        rng = np.random.default_rng([seed, int(key[0])])
        picks = rng.integers(0, np.arange(len(order), 0, -1))
        for i, pick in zip(range(len(order) - 1, 0, -1), picks):
            order[i], order[pick] = order[pick], order[i]
        return rows.loc[order].assign(_place=np.arange(len(order), dtype=np.int64))

    return run


def shuffle_to_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> str:
    """Write all rows in random order as Parquet folders `shard=0 …`, and return their path.

    Pass one scatters rows into buckets by a seeded hash of id and text, so that copies and rows without id
    spread as all others do; there are as many buckets as keep a bucket near `bucket_bytes`. Pass two
    shuffles every bucket in one task and writes it. Buckets lie end to end in the global order, which is cut into shards
    whose row counts differ by one at most (the first ones are longer). `slot` counts a shard's rows
    from 0. The order depends on the seed and the rows alone: a task that runs again writes the same. NULL and empty
    texts are rows like others; rows equal in all they hold keep separate slots; an empty table gives
    an empty folder. Columns that are called like the added ones are replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    own = [c for c in docs.columns if c not in ("law", "shard", "slot")]
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_size(F.col(text_col))), F.lit(0))).first()
    count = max(partitions(spark), -(-int(size) // bucket_bytes))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    scattered = docs.select(
        *own, order.alias("_order"), F.xxhash64(F.col(id_col).cast("string"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_tie"),
        F.pmod(F.shiftrightunsigned(order, 11), F.lit(count)).alias("_bucket"),
    )
    # One row per bucket: bounded by the bytes of the table over `bucket_bytes`.
    filled = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(filled.select("_bucket", before.alias("_start")))
    schema = scattered.limit(0).withColumn("_place", F.lit(0).cast("long")).schema
    placed = scattered.repartition(count, "_bucket").groupBy("_bucket").applyInPandas(_fisher_yates(seed), schema)
    position = F.col("_start") + F.col("_place")
    long_rows, short, extra = total // shards + 1, max(total // shards, 1), total % shards
    in_long = position < extra * long_rows
    rest = position - extra * long_rows
    ready = placed.join(starts, "_bucket").select(
        *own, F.lit(LAW).alias("law"),
        F.when(in_long, F.floor(position / long_rows)).otherwise(extra + F.floor(rest / short)).cast("int").alias("shard"),
        F.when(in_long, position % long_rows).otherwise(rest % short).cast("long").alias("slot"),
    )
    path = scratch_path(spark, "shards")
    ready.write.partitionBy("shard").parquet(path)
    return path


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The written rows with shard and slot."""
    own = [f for f in docs.schema.fields if f.name not in ("law", "shard", "slot")]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return docs.sparkSession.read.schema(f"{names}, law string, slot long, shard int").parquet(path)


def op9_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = read_shards(docs, shuffle_to_shards(docs))
    return found.select(
        "doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "law",
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict = {}
