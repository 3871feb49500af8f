import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from galleryloom.operators import features as ft
from galleryloom.operators import models
from galleryloom.operators import topics as tp
from galleryloom.plans import training

TEXTS = ["red fox runs", "red dog runs fast", "blue fox", "Red red sky", "dog fox dog", "sky blue sky"]
SMALL = (ft.Family("w:", "word", 1, 2, 1, 1.0), ft.Family("c:", "char", 3, 4, 1, 1.0))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", t, "even" if i % 2 == 0 else "odd", "train" if i < 5 else "test") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "key string, text string, label string, split string")


def test_long_form_equals_the_vectors(spark, docs):
    train = docs.where("split = 'train'")
    vectoriser = models.fit_text_features(train, SMALL)
    vectors = {r.key: sorted(x for x in r.v if x) for r in vectoriser.transform(docs).select("key", vector_to_array("features").alias("v")).collect()}
    parts = {f.prefix: ft.tfidf(docs, ft.fit_vocabulary(train, f), f) for f in SMALL}
    long = {}
    for r in ft.stack_features(parts).collect():
        long.setdefault(r.key, []).append(r.weight)
    for key, values in long.items():
        assert sorted(values) == pytest.approx(vectors[key])
        assert sum(v * v for v in values) == pytest.approx(2.0)


def test_short_text_has_no_long_char_grams(spark):
    df = spark.createDataFrame([("a", "xy"), ("b", None)], "key string, text string")
    assert ft.term_counts(df, ft.CHARS).count() == 0


def test_chi2_against_the_definition(spark):
    rows = [("d0", "a", "t", 1.0), ("d1", "a", "t", 2.0), ("d2", "b", "t", 1.0), ("d2", "b", "u", 4.0)]
    weights = spark.createDataFrame(rows, "key string, label string, term string, weight double")
    classes = spark.createDataFrame([("a", 2), ("b", 2)], "label string, n bigint")
    got = {r.term: r.chi2 for r in ft.chi2_scores(weights, classes, "label").collect()}

    def score(o, total):
        return sum((x - 0.5 * total) ** 2 / (0.5 * total) for x in o)

    assert got == pytest.approx({"t": score([3, 1], 4), "u": score([0, 4], 4)})


def test_projection_is_reproducible_and_sparse(spark, docs):
    vocabulary = ft.fit_vocabulary(docs, SMALL[1])
    weights = ft.tfidf(docs, vocabulary, SMALL[1])
    first = {(r.key, r.component): r.value for r in ft.sparse_projection(weights, vocabulary, 16).collect()}
    again = {(r.key, r.component): r.value for r in ft.sparse_projection(weights.repartition(5), vocabulary, 16).collect()}
    assert first == pytest.approx(again) and 0 < len(first) < 6 * 16
    dense = ft.dense_rows(ft.sparse_projection(weights, vocabulary, 16), 16).collect()
    assert all(len(r["values"]) == 16 for r in dense)


def coherence(docs, topics, window):
    words = {w for t in topics for w in t}
    wins = []
    for d in docs:
        if words & set(d):
            wins += [set(d[s : s + window]) for s in range(max(len(d) - window, 0) + 1)]
    n, eps = len(wins), 1e-12

    def p(*ws):
        return sum(all(w in x for w in ws) for x in wins) / n

    out = []
    for t in topics:
        v = {a: [math.log((p(a, b) + eps) / (p(a) * p(b))) / -math.log(p(a, b) + eps) for b in t] for a in t}
        whole = [sum(v[a][i] for a in t) for i in range(len(t))]
        norm = lambda x: math.sqrt(sum(y * y for y in x))
        out.append(sum(sum(x * y for x, y in zip(v[a], whole)) / (norm(v[a]) * norm(whole)) for a in t) / len(t))
    return out


def test_coherence_against_brute_force(spark):
    texts = ["a b x a c x x b d", "a x x x x x x x b", "c d e c", "x x x", "", "e a e b e c e d e a", "b"]
    lists = [t.split() for t in texts]
    topics = [["a", "b", "c"], ["c", "d", "e"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "key int, tokens array<string>")
    top = spark.createDataFrame([(t, r, w) for t, ws in enumerate(topics) for r, w in enumerate(ws)], "topic int, rank int, term string")
    got = {r.topic: r.coherence for r in tp.topic_coherence(docs, top, window=4).collect()}
    assert [got[0], got[1]] == pytest.approx(coherence(lists, topics, 4))


def test_keyword_weights(spark):
    docs = spark.createDataFrame([(0, "cat cat dog"), (1, "dog bird"), (-1, "noise")], "topic int, text string")
    weights = {(r.topic, r.term): r.weight for r in tp.ctfidf_weights(docs).collect()}
    assert weights[(0, "cat")] == pytest.approx(2 / 3 * math.log(1 + 2 / 2))
    table = tp.topic_table(docs, tp.ctfidf_keywords(tp.ctfidf_weights(docs))).collect()
    assert [r.topic for r in table] == [0, 1] and table[0].keywords_weights.startswith("cat:0.4621; ")


def test_distribution_sums_to_one(spark):
    docs = spark.createDataFrame(
        [(0, 0, "cat dog cat bird fish tree leaf root stem bark"), (1, 1, "sun moon star sky"), (2, 1, "")], "key int, topic int, text string"
    )
    tokens = docs.select("key", F.filter(F.split("text", " "), lambda x: x != "").alias("tokens"))
    dist = tp.approx_topic_distribution(tokens, tp.ctfidf_weights(docs))
    sums = {r.key: r.s for r in dist.groupBy("key").agg(F.sum("probability").alias("s")).collect()}
    assert sums == pytest.approx({0: 1.0, 1: 1.0})
    wide = tp.with_dominant(tp.proportions_wide(docs.select("key"), dist, [0, 1]), [0, 1])
    assert {r.key: r.dominant_topic for r in wide.collect()} == {0: 0, 1: 1, 2: 0}


def test_first_maximum_wins(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4],)], "p array<double>")
    topic, prob = tp.dominant("p", [7, 8, 9])
    assert tuple(df.select(topic, prob).first()) == (8, 0.4)


@pytest.fixture(scope="module")
def corpus(spark):
    themes = {"10": "boat water sail wave harbour", "2": "road car wheel engine driver"}
    rows = []
    for i in range(60):
        label = "10" if i % 3 else "2"
        words = themes[label].split()
        text = " ".join(words[(i + j) % 5] for j in range(4)) + f" filler{i % 7}"
        rows.append((f"k{i}", text, label, "test" if i % 7 == 0 else "train"))
    return spark.createDataFrame(rows, "key string, text string, label string, split string")


def share(predictions):
    rows = predictions.collect()
    return sum(r.true == r.pred for r in rows) / len(rows), Counter(r.true for r in rows)


def test_linear_svc_beats_the_majority_and_reloads(spark, corpus, tmp_path):
    train, test, vectoriser = training.sparse_vectors(corpus, SMALL)
    model = models.train_linear_svc(train, max_iter=5)
    assert model.classes == ["10", "2"]
    hit, classes = share(model.predict(test))
    assert hit > max(classes.values()) / sum(classes.values())
    vectoriser.save(str(tmp_path / "v"))
    model.save(str(tmp_path / "m"))
    again = models.TextFeatures.load(spark, str(tmp_path / "v")).transform(corpus.where("split = 'test'"))
    loaded = models.TextClassifier.load(str(tmp_path / "m")).predict(again)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, model.predict(test).collect()))


def test_tree_and_network_models(spark, corpus):
    train, test = training.selected_vectors(corpus, k=20)
    hit, classes = share(models.train_random_forest(train, trees=5, depth=4).predict(test))
    assert hit > max(classes.values()) / sum(classes.values())
    hit, _ = share(models.train_boosted_trees(train, rounds=2, depth=2).predict(test))
    assert hit > max(classes.values()) / sum(classes.values())
    train, test = training.projected_vectors(corpus, size=16)
    assert len(models.train_mlp(train, hidden=(8,), max_iter=20, size=16).predict(test).collect()) == 9
