import hashlib

from galleryloom.llm import decontaminate as dec
from galleryloom.llm.common import table
from pyspark.sql import functions as F
from workload.compare import connect, difference


def brute(docs, items, window=10):
    grams = []
    for name, text in items:
        words = dec.words_of(text)
        size = min(window, len(words))
        if name is not None and size:
            grams += [(str(name), words[i : i + size]) for i in range(len(words) - size + 1)]
    out = []
    for doc, text in docs:
        words = dec.words_of(text)
        hit, found = set(), set()
        for name, gram in grams:
            for p in range(len(words) - len(gram) + 1):
                if words[p : p + len(gram)] == gram:
                    hit.update(range(p, p + len(gram)))
                    found.add(name)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_query_equals_sql(spark, sf):
    con = connect(sf)
    assert difference(dec.op5_decontaminate(spark, sf), con, dec.ORACLE) is None


def test_edges_and_slices(spark):
    ten = "a b c d e f g h i j"
    items = [(1, ten + " k"), (10, "x y"), (2, "y"), (3, None), (4, "  "), (None, "q"), (5, "a b c d e f g h i z"), (6, "b c d"), (1, "p p p"), (7, "c d")]
    docs = [(1, None), (2, ""), (3, "A B C D E F G H I J K"), (4, "b c d x y x"), (5, "q é"), (6, "a b c d e f g h i J z p p p p"), (6, "y y"), (None, "x-y"),
            (8, "x " * 50_000 + "b c d " + "p p " * 30_000)]
    want = brute(docs, items)
    d = spark.createDataFrame([(i, t, "m", 1) for i, t in docs], "doc_id long, text string, matches string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (dec.SLICE_BYTES, 100):
        m = F.col("matches")
        got = dec.with_matches(d, b, slice_bytes=limit).select(
            "doc_id", m["n_words"], m["n_hit"], F.size(m["items"]), F.sha2(F.array_join(m["items"], ",").cast("binary"), 256), m["n_hit"] > 0
        )
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    none = dec.with_matches(d, b.limit(0)).where("matches.n_hit > 0")
    assert none.count() == 0 and dec.with_matches(d.limit(0), b).count() == 0


def test_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "Keep this: " + item.upper() + " - and this, too; " + "more words " * 20, "x"), (2, item, "x"), (3, "clean", "x"), (4, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _n string")
    got = {r.doc_id: r.text for r in dec.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "Keep this:  - and this, too; " + "more words " * 20, 3: "clean", 4: None}


def test_whole_table_has_no_window_left(spark, sf):
    items = table(spark, sf, "benchmark")
    cleaned = dec.decontaminate(table(spark, sf, "documents"), items)
    assert dec.with_matches(cleaned, items).where("matches.n_hit > 0").count() == 0
