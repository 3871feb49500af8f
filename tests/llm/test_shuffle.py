import zlib
from collections import Counter, defaultdict

from galleryloom.llm import shuffle
from galleryloom.llm.common import table


def check(rows, texts, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(r.grown_shard is None and r.law == "rows" for r in rows)


def test_query(spark, sf):
    texts = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = shuffle.op9_sharding(spark, sf).collect()
    check(rows, texts, shuffle.SHARDS)
    again = shuffle.op9_sharding(spark, sf).collect()
    assert Counter(rows) == Counter(again)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(order, order[1:])) / (len(order) - 1)
    assert 0.35 < rising < 0.65


def test_edges(spark, tmp_path):
    texts = [(1, None), (1, None), (2, ""), (None, "a"), (None, "a"), (None, "b"), (3, "long " * 200_000), (4, "é")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, shard string, _extra string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = shuffle.op9_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 8) for i, t in texts)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, 0) for s in range(8)]
    three = shuffle.read_shards(df, shuffle.shuffle_to_shards(df, 3, bucket_bytes=100)).collect()
    assert sorted(Counter(r.shard for r in three).values()) == [2, 3, 3] and {r._extra for r in three} == {"y"}
    none = df.limit(0)
    assert shuffle.read_shards(none, shuffle.shuffle_to_shards(none)).count() == 0
