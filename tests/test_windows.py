import random

import pytest

from galleryloom.operators import topics as tp
from galleryloom.operators import windows


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    lists = [[draw.choice("abcdefghij") * 2 for _ in range(n)] for n in (0, 1, 3, 8, 9, 12, 13, 40, 41)]
    lists[4][2] = "unseen"
    return spark.createDataFrame([*enumerate(lists), (99, None)], "key long, tokens array<string>")


def weights(spark):
    draw = random.Random(8)
    rows = [(t, w * 2, draw.random() + 0.1) for w in "abcdefghij" for t in (-1, 0, 1, 2) if draw.random() < 0.6]
    return spark.createDataFrame([(t, w, 0.5 + ord(w[0]) % 7, x) for t, w, x in rows], "topic int, term string, idf double, weight double")


def shares(df):
    return {(r.key, r.topic): r.probability for r in df.collect()}


@pytest.mark.parametrize("limit,window,stride", [(0, 8, 4), (150, 3, 2), (1 << 20, 8, 4)])
def test_terms_that_travel_and_terms_that_are_joined(spark, docs, monkeypatch, limit, window, stride):
    """Whatever part of the terms travels, documents get what counting row by row gives; only other terms' places move."""
    topics = weights(spark)
    # Rows of a repeated key are one document and counted row by row.
    by_rows = shares(tp.approx_topic_distribution(docs.unionByName(docs), topics, window, stride))
    moved = []
    places = windows.other_places

    def watched(*args):
        moved.append(places(*args))
        return moved[-1]

    monkeypatch.setattr(windows, "TERM_BYTES", limit)
    monkeypatch.setattr(windows, "other_places", watched)
    assert shares(tp.approx_topic_distribution(docs, topics, window, stride)) == pytest.approx(by_rows)
    assert {k for k, _ in by_rows} >= {3, 4, 8}
    n = moved[0].count()
    assert n == 127 if limit == 0 else n == 1 if limit == 1 << 20 else 1 < n < 127


def test_repeated_and_null_keys_are_one_document(spark, docs):
    topics = weights(spark)
    odd = docs.unionByName(docs.where("key = 8")).unionByName(docs.where("key = 7").selectExpr("CAST(NULL AS BIGINT) AS key", "tokens"))
    alone = shares(tp.approx_topic_distribution(docs, topics))
    assert shares(tp.approx_topic_distribution(odd, topics)) == pytest.approx(alone | {(None, t): p for (k, t), p in alone.items() if k == 7})
