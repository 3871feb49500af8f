"""N-grams of blocks against a plain count."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galleryloom.operators import features as ft
from galleryloom.operators import grams, models, text

TEXTS = ["", "a", "abcabcabc", "né 😀😀 né", "\x00\x00a\x00\x00", "   x  y ", "zz" * 40, None]


def plain(units, shortest, longest, join):
    return Counter(join(units[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(units) - n + 1))


@pytest.mark.parametrize("codes", [grams.CODES, 1 << 9, 1 << 5])
def test_blocks_equal_plain_count(monkeypatch, codes):
    monkeypatch.setattr(grams, "CODES", codes)
    texts = [t or "" for t in TEXTS]
    tokens = [t.split() for t in texts]
    for rows, kind, shortest, longest, join in ((texts, pa.string(), 1, 6, "".join), (texts, pa.string(), 3, 5, "".join), (tokens, pa.list_(pa.string()), 1, 3, " ".join)):
        found = [Counter() for _ in rows]
        for g in grams.cut(pa.array(rows, kind), shortest, longest):
            names = g.names.to_pylist()
            for text, term, n in zip(g.texts, g.terms, g.counts):
                found[text][names[term]] += int(n)
        assert found == [plain(r, shortest, longest, join) for r in rows]
    assert list(grams.cut(pa.array([], pa.string()), 3, 5)) == []


def test_texts_of_a_column_are_joined():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["x", "é😀", "", "b\x00"], kind)
        assert [grams._joined(c) for c in (column, column.slice(1, 2), column.slice(2, 1), column.slice(4))] == ["xé😀b\x00", "é😀", "", ""]
    assert grams._joined(pa.array([], pa.string())) == grams._joined(pa.array(["", ""])) == ""


def test_long_texts_split_into_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", "b" * 50, "", "cc"])], ["units"])
    assert [b.num_rows for b in grams.blocks(batch, "units", 5)] == [1, 1, 2]


def old_weights(docs, vocabulary, family):
    return ft._joined_weights(ft._unrolled_counts(docs, family, "text", ("key", "lang")), vocabulary, ("key", "lang"))


@pytest.mark.parametrize("family", [ft.Family("c:", "char", 3, 5, 2, 0.9), ft.Family("w:", "word", 1, 2, 2, 0.9), ft.Family("w:", "word", 1, 2, 2, 0.9, 5)])
def test_repeated_and_null_keys(spark, family, monkeypatch):
    """Rows of one key are one document; no n-gram of the others becomes a row before it is counted."""
    rows = [(f"k{i}", "x", f"the tree number{i % 3} été  the tree") for i in range(9)]
    rows += [("k1", "y", "again the tree"), ("k1", "x", "the the the"), (None, "x", "the tree"), (None, "x", "the tree été"), ("n", "x", None)]
    docs = spark.createDataFrame(rows, "key string, lang string, text string")
    vocabulary = ft.fit_vocabulary(docs, family)
    if family.max_features:
        counts = ft._unrolled_counts(docs, family, "text", ("key",)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        assert vocabulary.count() == 5 and vocabulary.join(counts, ["term", "df"]).count() == 5
    want = sorted(((r.key, r.lang, r.term, round(r.weight, 9)) for r in old_weights(docs, vocabulary, family).collect()), key=str)
    got = ft.tfidf(docs, vocabulary, family, keep=("key", "lang"))
    assert sorted(((r.key, r.lang, r.term, round(r.weight, 9)) for r in got.collect()), key=str) == want
    monkeypatch.setattr(ft, "BROADCAST_TERMS", 1)
    joined = ft.tfidf(docs, vocabulary, family, keep=("key", "lang"))
    assert sorted(((r.key, r.lang, r.term, round(r.weight, 9)) for r in joined.collect()), key=str) == want


@pytest.mark.parametrize("words", [False, True])
def test_vocabulary_look_up(monkeypatch, words):
    rows = [t.split() for t in ("a b a", "zz a", "", "b é b a")] if words else ["abab", "xay", "", "é😀ba"]
    column = pa.array(rows, pa.list_(pa.string()) if words else pa.string())
    terms = pa.array(["a b", "a", "b é b", "q q"] if words else ["ab", "a", "é😀b", "bab", "qq"])
    for codes in (grams.CODES, 8):
        monkeypatch.setattr(grams, "CODES", codes)
        found = list(zip(*(x.tolist() for x in grams.Vocabulary(terms, words).known(column, 1, 3))))
        join = " ".join if words else "".join
        counts = [plain(r, 1, 3, join) for r in rows]
        assert sorted(found) == sorted((i, j, c[t]) for i, c in enumerate(counts) for j, t in enumerate(terms.to_pylist()) if c[t])
    assert [len(x) for x in grams.Vocabulary(pa.array([], pa.string()), words).known(column, 1, 3)] == [0, 0, 0]


def test_weights_do_not_unroll(spark):
    docs = spark.createDataFrame([(f"k{i}", "abc abd") for i in range(6)], "key string, text string")
    vocabulary = ft.fit_vocabulary(docs, ft.CHARS)
    plan = ft.tfidf(docs, vocabulary, ft.CHARS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_count_vectors(spark):
    docs = spark.createDataFrame([("a", "abab"), ("b", None), ("c", "zzz"), ("a", "bab")], "key string, text string")
    family = ft.Family("c:", "char", 2, 3, 1, 1.0)
    (terms,) = models.fit_counters(docs, (family,))
    assert terms.to_pylist()[:2] == ["ab", "ba"] and set(terms.to_pylist()) == {"ab", "ba", "aba", "bab", "zz", "zzz"}
    rows = models.counted(docs, (family,), [terms]).collect()
    vectors = sorted((r.key, [(terms[int(i)].as_py(), v) for i, v in zip(r._counts0.indices, r._counts0.values)]) for r in rows)
    assert [(k, sorted(v)) for k, v in vectors] == [
        ("a", [("ab", 1.0), ("ba", 1.0), ("bab", 1.0)]), ("a", [("ab", 2.0), ("aba", 1.0), ("ba", 1.0), ("bab", 1.0)]), ("b", []), ("c", [("zz", 2.0), ("zzz", 1.0)]),
    ]


def test_pairs_are_counted_per_block(spark):
    rows = [(["a", "b", "a", "b"],), ([],), (None,), (["x y", "z"],), (["x", "y z"],), (["a"],)]
    docs = spark.createDataFrame(rows, "tokens array<string>")
    counts = text.ngram_counts(docs)
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b): r.n for r in counts.collect()} == {
        ("a", None): 3, ("b", None): 2, ("x y", None): 1, ("z", None): 1, ("x", None): 1, ("y z", None): 1,
        ("a", "b"): 2, ("b", "a"): 1, ("x y", "z"): 1, ("x", "y z"): 1,
    }


def test_packed_counts_equal_plain_ones(spark, monkeypatch):
    """Tasks that merge and send their terms several times; terms of other alphabets, and bounds on the rows of a term."""
    monkeypatch.setattr(grams, "STATS_UNITS", 40)
    monkeypatch.setattr(grams, "MERGE_ROWS", 30)
    monkeypatch.setattr(grams, "MERGE_TERMS", 60)
    monkeypatch.setattr(grams, "HASHED_TERMS", 7)
    texts = [f"grün {'äß'[i % 2]}{i % 9} \U0001f600ok 漢字{i % 4}" for i in range(60)] + ["", "x"]
    plain, rows = Counter(), Counter()
    for t in texts:
        own = Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
        plain.update(own)
        rows.update(own.keys())
    units = spark.createDataFrame([(t,) for t in texts], "units string").repartition(3)
    stats = grams.term_stats(units, 2, 3)
    assert sorted(stats.columns) == ["df", "term", "total"]
    assert {r.term: (r.df, r.total) for r in stats.collect()} == {t: (rows[t], n) for t, n in plain.items()}
    assert {r.term for r in grams.term_stats(units, 2, 3, least=10).collect()} == {t for t in plain if rows[t] >= 10}
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(piece" in plan and "hashpartitioning(term" not in plan


def test_hashes_follow_the_text_alone():
    terms = pa.array(["a", "", "ab", "ba", "grün", "a", "aa"])
    whole, again = grams._term_hashes(terms), grams._term_hashes(terms.slice(2))
    assert (whole[2:] == again).all() and whole[0] == whole[5] and len(set(whole.tolist())) == 6
