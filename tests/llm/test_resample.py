import hashlib
import math
import re
import zlib

from galleryloom.llm import resample as rs
from pyspark.sql import functions as F
from workload.compare import connect, difference

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features_of(text, longest):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features_of(text, longest)[1]:
                counts[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        n, fs = features_of(text, longest)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    pool = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i for i, r in enumerate(pool[: len(pool) * percent // 100], 1)}
    return sorted([(*r[:4], drawn.get(id(r))) for r in rows], key=repr)


def got_of(frame):
    r = F.col("resampled")
    return sorted((tuple(x) for x in frame.select("doc_id", r["n_features"], r["weight"], r["score"], r["rank"]).collect()), key=repr)


def test_query_equals_sql(spark, sf):
    con = connect(sf)
    assert difference(rs.op12_importance_resampling(spark, sf), con, rs.ORACLE) is None


def test_edges_equal_brute_force(spark):
    docs = [(1, None), (2, ""), (3, "A-b é É İ ß a"), (4, "x y z " * 10), (4, "x y z " * 10), (4, "x y z " * 10), (None, "alpha beta " * 15), (7, "gamma " * 19),
            (8, "gamma " * 20), (9, "delta alpha " * 30_000), (10, "--- ..."), (-5, "beta gamma x " * 12)]
    target = ["Alpha beta", None, "", "alpha x"]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, resampled string, _row string")
    b = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least, longest, buckets in ((10, 20, 1, 10_000), (50, 20, 1, 7), (100, 0, 3, 1000), (60, 0, 2, 50)):
        found = rs.resample(d, b, percent, least, longest=longest, buckets=buckets)
        assert found.columns == ["doc_id", "text", "_row", "resampled"]
        assert got_of(found) == brute(docs, target, percent, least, longest, buckets)
    assert got_of(rs.resample(d, b.limit(0), 50, keep=["doc_id"])) == brute(docs, [], 50)
    assert rs.resample(d.limit(0), b).count() == 0


def test_selection_is_exact(spark):
    rows = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(300))).alias("a"), F.col("id").alias("b")).cache()
    want = sorted((r.a, r.b) for r in rows.collect())
    for k in (1, 2, 777, 2500, 4999, 5000):
        assert tuple(rs.kth_key(rows, k, ["a", "b"], pivots=3)) == want[k - 1]
    numbered = rs.ranked(rows.repartition(7), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(numbered, key=lambda r: r["rank"])] == want and {r["rank"] for r in numbered} == set(range(1, 5001))


def test_one_row_many_times(spark):
    d = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words here " * 9).alias("text"))
    found = rs.resample(d, d.limit(3).select("text")).select("resampled.rank").collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 301)) and len(found) == 3000


def test_words_are_cut_not_matched(spark):
    # Extracting every match took several times the work of cutting the text (950 CPU seconds a GB, limit 900).
    texts = [None, "", "  ", "A-b é É İ ß a", "x", "-x-", "1_2 3", "日本 語,Q9"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rs.word_list(F.col("text")).alias("w"))
    assert "regexp_extract_all" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.text, r.w) for r in frame.collect()] == [(t, [w.decode() for w in WORD.findall((t or "").encode().lower())]) for t in texts]
