"""Joins, selections and carries that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.session import materialize

# A lookup is broadcast when measured at or below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20
# A key is hot when it holds more than 1/HOT_KEYS of the load, so fewer than HOT_KEYS keys can be hot.
HOT_KEYS = 4096
SALTS = 64
HASH_BUCKET_DIGITS = 4
CARRY_BLOCK = 4096
# Ranks are searched through histograms of so many bins; bins of up to so many rows are sorted.
RANK_BINS = 4096
RANK_ROWS = 10_000
RANK_ROUNDS = 200


def fits_broadcast(lookup: DataFrame) -> bool:
    """True when rows and bytes (as JSON text, an upper estimate) stay within the bounds."""
    width = F.octet_length(F.to_json(F.struct(*lookup.columns)))
    rows, size = (
        lookup.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    )
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def join_lookup(
    left: DataFrame,
    lookup: DataFrame,
    key: str | list[str],
    how: str = "inner",
    load: str | None = None,
    spread: str | None = None,
    all_keys: bool = False,
) -> DataFrame:
    """Join a large table to a lookup with unique keys, whatever the size of the lookup.

    A lookup measured at or below BROADCAST_ROWS and BROADCAST_BYTES is broadcast. Beyond that, when the lookup carries the
    number of left rows per key (`load`), the hot keys are salted by `spread`: fewer than HOT_KEYS keys
    can be hot, so that list is bounded and safe to broadcast. Without `load`, or when left rows may have
    hot keys that the lookup lacks (`all_keys`), the left keys are counted. NULL keys are spread as hot ones are. Pass a
    materialised lookup.
    """
    if fits_broadcast(lookup):
        return left.join(F.broadcast(lookup), key, how)
    if spread is None:
        raise ValueError("a lookup beyond the broadcast bounds needs a column to spread its hot keys by")
    keys = [key] if isinstance(key, str) else list(key)
    if load is None or all_keys:
        counted, load = materialize(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load")), "key-load"), "_load"
    else:
        counted = lookup.select(*keys, load)
    total = counted.agg(F.sum(load)).scalar()
    hot_keys = F.broadcast(counted.where(F.col(load) * HOT_KEYS > total).select(*keys, F.lit(True).alias("_hot")))
    missing = F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)
    salt = F.when(F.coalesce("_hot", missing), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted_left = left.join(hot_keys, keys, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_lookup = lookup.join(hot_keys, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted_left.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], copies: str | None = None) -> DataFrame:
    """One row per key, the one lowest in `order`; a map-side aggregate instead of a window.

    `copies` names an optional column with the number of rows the key had.
    """
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("_copies")
    )
    counted = [F.col("_copies").alias(copies)] if copies else []
    return found.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], *counted)


def hash_key(id_col: str | Column, seed: int = 42) -> Column:
    """A reproducible pseudo-random sort key: md5 of seed and id, then the id itself."""
    as_text = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), as_text)), F.lit("|"), as_text)


def hash_cutoff(df: DataFrame, key: str, quotas: DataFrame, strata: list[str]) -> DataFrame:
    """Per stratum, the hash key of the row whose rank equals the quota (`quota` column).

    The rank is found through a histogram of hash prefixes; only the one prefix that contains the
    quota is sorted, so no stratum, however large, is ever ranked in one task. A quota of 0 gives no row.
    """
    prefix = F.substring(key, 1, HASH_BUCKET_DIGITS)
    histogram = df.groupBy(*strata, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*strata).orderBy("_prefix")
    histogram = histogram.withColumn("_upto", F.sum("_n").over(running))
    cumulative = histogram.join(quotas, strata) if strata else histogram.withColumn("quota", quotas.scalar())
    boundary = cumulative.where(
        (F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota"))
    ).select(*strata, "_prefix", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_rank"))
    rows = df.select(*strata, key, prefix.alias("_prefix"))
    if strata:
        candidates = join_lookup(rows, checked_lookup(boundary, "boundaries"), [*strata, "_prefix"], spread=key)
    else:
        candidates = rows.where(F.col("_prefix") == boundary.select("_prefix").scalar()).withColumn(
            "_rank", boundary.select("_rank").scalar()
        )
    within = Window.partitionBy(*strata, "_prefix").orderBy(key)
    return (
        candidates.withColumn("_position", F.row_number().over(within))
        .where(F.col("_position") == F.col("_rank"))
        .select(*strata, F.col(key).alias("cutoff"))
    )


def _scaled(x: Column) -> Column:
    """A logarithm that keeps the order of all doubles: from the largest negative ones over 0 to the largest."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 800.0))


def quantile_values(
    df: DataFrame, group: str, value: str, quantile: float, spread: str, bins: int = RANK_BINS, few: int = RANK_ROWS
) -> DataFrame:
    """(group, n, limit): rows per group and the smallest value that at least `quantile` of its values do not exceed.

    Exact at any size: a histogram between the least and largest open value of each group gives the bin that holds the wanted rank, whose own
    bounds are opened next. Bins of one value, or of up to `few` rows, end the search; only the latter are sorted. NULL values
    count as rows, not as values.
    """
    v = F.col(value)
    found = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("_m"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    rank = F.greatest(F.ceil(F.lit(float(quantile)) * F.col("_m")), F.lit(1)).cast("long")
    state = materialize(found.withColumn("_rank", rank), "ranks")
    wide = (F.col("_low") < F.col("_high")) & (F.col("_m") > few)
    for _ in range(RANK_ROUNDS):
        opened = state.where(wide)
        if opened.isEmpty():
            break
        bounds = opened.select(F.col(group).alias("_group"), "_low", "_high")
        inside = join_lookup(df.select(F.col(group).alias("_group"), v.alias("_value"), spread), bounds, "_group", spread=spread)
        inside = inside.where(F.col("_value").between(F.col("_low"), F.col("_high")))
        # Equal steps of the logarithm while the bounds are more than a factor apart, else of the value.
        far = _scaled(F.col("_high")) - _scaled(F.col("_low")) > 1
        value_share = (F.col("_value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        scaled_share = (_scaled(F.col("_value")) - _scaled(F.col("_low"))) / (_scaled(F.col("_high")) - _scaled(F.col("_low")))
        share = F.when(far, scaled_share).otherwise(value_share)
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        counted = inside.groupBy("_group", bin_.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_in"), F.min("_value").alias("_from"), F.max("_value").alias("_to")
        )
        upto = counted.withColumn("_upto", F.sum("_in").over(Window.partitionBy("_group").orderBy("_bin")))
        picked = upto.join(F.broadcast(opened) if fits_broadcast(opened) else opened, F.col("_group").eqNullSafe(F.col(group)))
        picked = picked.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_in") < F.col("_rank")))
        narrowed = picked.select(
            group, "n", F.col("_in").alias("_m"), F.col("_from").alias("_low"), F.col("_to").alias("_high"),
            (F.col("_rank") - F.col("_upto") + F.col("_in")).alias("_rank"),
        )
        state = materialize(state.where(~wide | wide.isNull()).unionByName(narrowed), "ranks")
    else:
        raise RuntimeError("ranks did not settle")
    left = state.where(F.col("_low") < F.col("_high"))
    bounds = left.select(F.col(group).alias("_group"), "_low", "_high", "_rank", F.col("n").alias("_n"))
    rows = join_lookup(df.select(F.col(group).alias("_group"), v.alias("_value"), spread), materialize(bounds, "rank-bounds"), "_group", spread=spread)
    rows = rows.where(F.col("_value").between(F.col("_low"), F.col("_high")))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_group").orderBy("_value")))
    sorted_out = placed.where(F.col("_place") == F.col("_rank")).select(F.col("_group").alias(group), F.col("_n").alias("n"), F.col("_value").alias("limit"))
    settled = state.where("_low = _high OR _low IS NULL").select(group, "n", F.col("_low").alias("limit"))
    return settled.unionByName(sorted_out)


def carry_forward(
    df: DataFrame, group: list[str], line: str, value: str, out: str, inclusive: bool = True
) -> DataFrame:
    """Last non-null `value` at or before (`inclusive`), or strictly before, each line of a group.

    Lines are cut into blocks: a block needs only the last value of the blocks before it, so a group
    with very many lines is spread over many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(line) / CARRY_BLOCK))
    tails = blocked.groupBy(*group, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(line))).alias("_tail")
    )
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier)).drop("_tail")
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(line)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    return (
        blocked.join(carries, [*group, "_block"])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_block", "_carry")
    )


def unroll(df: DataFrame, columns: list, items: Column, *names: str, inline: bool = False) -> DataFrame:
    """One row per list item (`inline` for structs), without the rows of empty lists.

    A plain explode makes the optimizer test the list for emptiness below the generator, which
    evaluates an expensive list expression twice and pulls it in front of earlier shuffles. The
    outer form has no such test; its NULL rows are dropped afterwards.
    """
    if inline:
        rows = df.select(*columns, F.inline_outer(items).alias(*names))
    else:
        rows = df.select(*columns, F.explode_outer(items).alias(*names))
    return rows.where(F.col(names[0]).isNotNull())


def place_by_key(df: DataFrame, key: str) -> DataFrame:
    """Shuffle whole records by key before they are unrolled into many rows.

    The count is given explicitly: adaptive coalescing would size the tasks by the small records
    and not by the rows they unroll into.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def checked_lookup(df: DataFrame, label: str) -> DataFrame:
    """Materialise a lookup so that counting it for `join_lookup` does not compute it twice."""
    return materialize(df, label)
