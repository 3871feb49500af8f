"""Target-distribution importance resampling: array-scored weights, then a distributed quickselect of the winners."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.llm.common import table
from galleryloom.operators.keyed import unroll
from galleryloom.session import materialize

BUCKETS = 10_000
LONGEST = 1
SCALE = 1000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
# Pivot keys per round of the selection; each round cuts the open keys to about one in so many.
PIVOTS = 24
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX_BITS = 33


def word_list(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of digits, a-z and everything beyond ASCII; none for NULL.

    The text is cut at all other characters: extracting every match costs several times as much.
    """
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(lowered, BETWEEN_WORDS), lambda w: w != "")


def feature_list(words: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one blank, with repeats."""
    if longest == 1:
        return words
    last = F.size(words)

    def runs(n: int) -> Column:
        starts = F.when(last >= n, F.sequence(F.lit(1), last - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *[runs(n) for n in range(2, longest + 1)])


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def _features(texts: DataFrame, text_col: str, longest: int, *keep: Column) -> DataFrame:
    words = texts.select(*keep, word_list(F.col(text_col)).alias("_llm_words"))
    return words.select(*[k for k in words.columns if k != "_llm_words"], F.size("_llm_words").alias("_llm_n_words"), feature_list(F.col("_llm_words"), longest).alias("_llm_features"))


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the features of all texts; at most `buckets` rows leave a task."""
    features = unroll(_features(texts, text_col, longest), [], F.col("_llm_features"), "_llm_feature")
    return features.groupBy(bucket_of(F.col("_llm_feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Gains:
    """Gain of every bucket: thousandths of the log ratio of its smoothed target and source shares."""

    values: list[int]
    longest: int

    @classmethod
    def learn(
        cls, source: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, target_col: str = "text"
    ) -> Gains:
        """Counts over all texts of both tables; the `buckets` gains, a parameter, are all that reaches the driver."""
        spark = source.sparkSession
        s = bucket_counts(source, text_col, longest, buckets).withColumnRenamed("n", "s")
        t = bucket_counts(target, target_col, longest, buckets).withColumnRenamed("n", "t")
        counts = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
        counts = materialize(counts, "buckets")
        all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
        up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
        down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
        gain = F.floor(SCALE * F.log(up / down))
        rows = counts.select("bucket", gain.alias("gain")).collect()
        return cls([r.gain for r in sorted(rows)], longest)

    def array(self) -> Column:
        """The gains as one literal array."""
        return F.from_json(F.lit(json.dumps(self.values)), "array<bigint>")


def with_weights(docs: DataFrame, gains: Gains, text_col: str = "text", out: str = "weighed") -> DataFrame:
    """The documents with a struct column `out`: n_words, n_features and weight, the floored mean gain of the features (0 for none).

    Every feature of the whole text is looked up in the literal array, repeats included. NULL and wordless texts have no
    features; a column already named `out` is replaced.
    """
    gain, buckets = gains.array(), len(gains.values)
    rest = [F.col(c) for c in docs.columns if c != out]
    features = _features(docs, text_col, gains.longest, *rest)
    total = F.aggregate("_llm_features", F.lit(0).cast("long"), lambda a, f: a + F.get(gain, bucket_of(f, buckets).cast("int")))
    summed = features.select(*rest, "_llm_n_words", F.size("_llm_features").cast("long").alias("_llm_n"), total.alias("_llm_sum"))
    weight = F.when(F.col("_llm_n") == 0, F.lit(0).cast("long")).otherwise(F.expr("(_llm_sum - pmod(_llm_sum, _llm_n)) div _llm_n"))
    return summed.select(
        *rest, F.struct(F.col("_llm_n_words").cast("long").alias("n_words"), F.col("_llm_n").alias("n_features"), weight.alias("weight")).alias(out)
    )


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw from the hash of seed and id, so every run draws alike; a NULL id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-SCALE * F.log(-F.log(uniform)))


def kth_key(rows: DataFrame, k: int, key: list[str], pivots: int = PIVOTS, seed: int = SEED):
    """The k-th smallest (from 1) of the keys, which must be unique and without NULL; `k` is at most the number of rows.

    Each round takes random pivot keys from the open interval, counts the rows below and at each of them exactly, and goes on
    in the one interval that holds the k-th key. One aggregate per round; no row but the pivots reaches the driver.
    """
    kinds, place = dict(rows.dtypes), F.struct(*key)

    def bound(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in key])

    low = high = None
    below, turn = 0, 0
    while True:
        turn += 1
        inside = F.lit(True)
        if low is not None:
            inside = inside & (place > bound(low))
        if high is not None:
            inside = inside & (place < bound(high))
        still_open = rows.select(*key).where(inside)
        drawn = sorted(still_open.orderBy(F.xxhash64(F.lit(seed + turn), *key), *key).limit(pivots).collect(), key=tuple)
        less_than = [F.count_if(place < bound(p)) for p in drawn]
        equal_to = [F.count_if(place == bound(p)) for p in drawn]
        counts = still_open.agg(*less_than, *equal_to).first()
        passed = below
        for pivot, less, same in zip(drawn, counts[: len(drawn)], counts[len(drawn) :]):
            if k <= passed + less:
                high = pivot
                break
            if k <= passed + less + same:
                return pivot
            low, below = pivot, passed + less + same


def ranked(rows: DataFrame, key: list[str], out: str = "rank") -> DataFrame:
    """The rows with their rank from 1 in the order of a unique key: sorted by ranges, and counted on from range to range."""
    index = F.shiftrightunsigned("_llm_place", INDEX_BITS)
    placed = materialize(rows.orderBy(*key).withColumn("_llm_place", F.monotonically_increasing_id()), "winners")
    parted = placed.withColumn("_llm_part", index)
    # One row per sorted partition.
    filled = parted.groupBy("_llm_part").agg(F.count(F.lit(1)).alias("_llm_n"))
    before = F.coalesce(F.sum("_llm_n").over(Window.orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(filled.select("_llm_part", before.alias("_llm_start")))
    inside = F.col("_llm_place").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    counted = parted.join(starts, "_llm_part").withColumn(out, (F.col("_llm_start") + inside + 1).cast("long"))
    return counted.drop("_llm_place", "_llm_part", "_llm_start")


def draw(scored: DataFrame, percent: int, id_col: str, score_col: str, eligible: str, out: str = "rank") -> DataFrame:
    """All rows with `out`: ranks from 1 of the floor(percent x N / 100) highest scores of the N eligible rows, else NULL.

    Equal scores go to the smaller id, rows without id come last.
    """
    own = [c for c in scored.columns if c not in (out, eligible)]
    key = ["_llm_down", "_llm_late", "_llm_id", "_llm_row"]
    kinds = dict(scored.dtypes)
    marked = scored.select(
        *own, F.coalesce(F.col(eligible), F.lit(False)).alias("_llm_eligible"), (-F.col(score_col)).alias("_llm_down"), F.col(id_col).isNull().alias("_llm_late"),
        F.coalesce(F.col(id_col), F.lit("0").cast(kinds[id_col])).alias("_llm_id"), F.monotonically_increasing_id().alias("_llm_row"),
    )
    marked = materialize(marked, "scores")
    k = marked.where("_llm_eligible").count() * percent // 100
    if not k:
        return marked.select(*own, F.lit(None).cast("long").alias(out))
    last = kth_key(marked.where("_llm_eligible"), k, key)
    limit = F.struct(*[F.lit(last[c]).cast(dict(marked.dtypes)[c]).alias(c) for c in key])
    wins = F.col("_llm_eligible") & (F.struct(*key) <= limit)
    winners = ranked(marked.where(wins).select(*own, *key), key, out).select(*own, out)
    return winners.unionByName(marked.where(~wins).select(*own, F.lit(None).cast("long").alias(out)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, keep: list[str] | None = None, text_col: str = "text",
    id_col: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, target_col: str = "text",
) -> DataFrame:
    """The documents (columns `keep`, by default all) with a struct column `resampled`: n_words, n_features, weight, score and rank.

    Weights compare the hashed features of the documents with those of the target texts; score adds a Gumbel draw, so the
    floor(percent x N / 100) highest scores of the N documents with at least `min_words` words are a draw without replacement by
    importance. `rank` numbers the drawn from 1, and is NULL for all others. NULL and wordless texts have no features and
    weight 0; equal scores go to the smaller id, rows without id come last; repeated rows are drawn each; an empty target leaves
    only the smoothing; an empty table stays empty. A column already named `resampled` is replaced.
    """
    gains = Gains.learn(docs, target, text_col, longest, buckets, target_col)
    kept = [c for c in (keep or docs.columns) if c != "resampled"]
    r = F.col("resampled")
    weighed = with_weights(docs, gains, text_col, "resampled")
    scored = weighed.select(*kept, r, (r["weight"] + gumbel(F.col(id_col), seed)).alias("_llm_score"), (r["n_words"] >= min_words).alias("_llm_long"))
    drawn = draw(scored, percent, id_col, "_llm_score", "_llm_long", "_llm_rank")
    fields = [r[c].alias(c) for c in ("n_words", "n_features", "weight")]
    return drawn.select(*kept, F.struct(*fields, F.col("_llm_score").alias("score"), F.col("_llm_rank").alias("rank")).alias("resampled"))


def op12_importance_resampling(spark, sf_dir):
    # The texts are read for the counts and the weights; what is written, selected and ranked holds numbers only.
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "resampled.n_features", "resampled.weight", "resampled.score", "resampled.rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS steps
  FROM (SELECT unnest(range(256)) AS n)),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
coded AS (SELECT word, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT) AS bytes FROM spelt),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM coded, crc),
source AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed ON hashed.word = dw.word GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed ON hashed.word = bw.word GROUP BY bucket),
gains AS (SELECT hashed.word, floor({SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE))) AS gain
  FROM hashed LEFT JOIN source ON source.bucket = hashed.bucket LEFT JOIN target ON target.bucket = hashed.bucket),
summed AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM dw JOIN gains ON gains.word = dw.word GROUP BY r),
scored AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN summed ON summed.r = d.r),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor({PERCENT} * n / 100) THEN place END AS rank
FROM scored LEFT JOIN placed ON placed.r = scored.r"""

QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES = {"op12_importance_resampling": ORACLE}
