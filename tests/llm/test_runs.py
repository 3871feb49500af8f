import hashlib
import re
import zlib

import numpy as np
from galleryloom.llm import runs
from galleryloom.llm.common import table
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_runs(words, min_length=12, min_copies=2):
    """Every period on its own: maximal stretches of equal words at that distance; of equal stretches the smallest period."""
    out, n = {}, len(words)
    for q in range(1, n // min_copies + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if end > i and length >= max(min_length, min_copies * q):
                out.setdefault((i, length), q)
            i = end + 1
    # A stretch whose own smallest period is smaller belongs to a longer or equal run of that period.
    def smallest(i, length):
        return next(q for q in range(1, length + 1) if all(words[k] == words[k + q] for k in range(i, i + length - q)))

    return sorted((i, q, length) for (i, length), q in out.items() if smallest(i, length) == q)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    drop = {k for s, q, length in found for k in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    head = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([(12, 2), (4, 2), (1, 2), (9, 3)]))
@settings(max_examples=400, deadline=None)
def test_runs_equal_brute_force(texts, law):
    codes = np.array([w for t in texts for w in t], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    want, at = [], 0
    for t in texts:
        want += [(at + s, q, length) for s, q, length in brute_runs(t, *law)]
        at += len(t)
    assert runs.runs_of(codes, lengths, *law) == want


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(1, 7)), max_size=8), st.randoms())
@settings(max_examples=200, deadline=None)
def test_repeated_pieces_equal_brute_force(pieces, random):
    words = []
    for kind, size, copies in pieces:
        unit = [random.randint(0, kind) for _ in range(size)]
        words += unit * copies + unit[: random.randint(0, size)]
    assert runs.runs_of(np.array(words, np.int64), np.array([len(words)])) == brute_runs(words)


def test_positions_in_blocks():
    order = np.random.default_rng(3).permutation(5000).tolist()
    kept = runs.Positions(order[0])
    for i, p in enumerate(order[1:], 1):
        below, above = kept.add(p)
        if i % 97 == 0:
            seen = sorted(order[:i])
            assert below == max((x for x in seen if x < p), default=-1) and above == min((x for x in seen if x > p), default=-1)
    assert list(kept) == list(range(5000)) and len(kept.blocks) > 1


def test_query_equals_brute_force(spark, sf):
    rows = [r for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in runs.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    small = [r for r in rows if len(r.text or "") < 6000]
    assert len(small) > 100
    assert [got[r.doc_id] for r in small] == [expected(r.doc_id, r.text) for r in small]


def test_edges(spark, tmp_path):
    long = " ".join(f"w{i % 4001}" for i in range(60_000))
    same = "x " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 6), (4, "a b " * 6), (5, "a b " * 5 + "a"), (6, "é b é b " * 9), (None, "q " * 12),
            (10**9 + 7, same), (8, "s t u v w x y z"), (9, "a b c " * 4 + "q " * 12 + "b c a " * 4)]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, periods string, words int").write.parquet(folder)
    got = sorted((tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    plain = [expected(i, t) for i, t in rows if t != same]
    assert [g for g in got if g[0] != 10**9 + 7] == sorted(plain, key=repr)
    alone = next(g for g in got if g[0] == 10**9 + 7)
    assert alone[1:6] == (1, 0, 30_000, 1, 30_000_000)
    frame = spark.createDataFrame([(long.split(" "), "p"), (None, "p"), ([None, "a"] * 8, "p")], "words array<string>, periods string")
    many, none, nulls = [r.periods for r in runs.with_runs(frame, "words").collect()]
    assert [tuple(r) for r in many.runs] == [(0, 4001, 60_000)] and many.collapsed == " ".join(f"w{i}" for i in range(4001))
    assert none.runs == [] and none.collapsed == ""
    assert [tuple(r) for r in nulls.runs] == [(0, 2, 16)] and nulls.collapsed == " a"
    assert runs.with_runs(frame.limit(0), "words").count() == 0
