import re

import numpy as np
import pytest
import xxhash

from galleryloom.llm import simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, fingerprint string, component long"


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    arr = np.array(prints, np.uint64)
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 3):
            a, b = find(i), find(int(j))
            comp[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, f"{p:016x}", least[find(i)]) for i, (doc, p) in enumerate(zip([r[0] for r in rows], prints)))


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in simhash.op6_simhash_dedup(spark, sf).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_edge_rows(spark):
    long = "Alpha beta\tgamma\x0bdelta " * 40_000
    rows = [(5, None), (3, ""), (4, " \n"), (1, "one"), (1, "one"), (9, "ONE"), (7, long), (8, long), (None, "one"), (2, "zwei Wörter Ä")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0"), "component").collect()
    known = [(i, t) for i, t in rows if i is not None]
    assert sorted(tuple(r) for r in got if r[0] is not None) == brute(known)
    assert [r[2] for r in got if r[0] is None] == [1]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 1, 2, 3, 7]


@pytest.mark.parametrize("limit", [4, 64])
def test_large_shards_lose_no_link(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = list(base)
    for _ in range(600):
        p = prints[rng.integers(len(prints))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            p = p ^ (np.uint64(1) << np.uint64(b))
        prints.append(p)
    prints = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64))], "node long, print long")
    edges = simhash.near_links(df, 3, limit)
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    label = np.arange(len(prints))
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    label = simhash._settle(label, a, b)
    assert [got.get(i, i) for i in range(len(prints))] == label.tolist()
