"""What jobs leave on disk and hold in memory."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from galleryloom import session
from galleryloom.operators import features as ft
from galleryloom.operators import linear, models
from galleryloom.operators.cells import of_planes, planes, sparse_cells
from galleryloom.plans import training

SMALL = (ft.Family("w:", "word", 1, 2, 1, 1.0), ft.Family("c:", "char", 3, 4, 1, 1.0))


def shuffle_files(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in top for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
    written = session.materialize(rows, "room")
    assert not shuffle_files(spark) - before
    assert written.agg(F.sum("n")).first()[0] == 5000 and spark.conf.get(name) == setting


def test_planes_return():
    for kind in (np.int32, np.float32):
        values = np.array([0, 1, -5, 70000, 3], kind)
        assert (of_planes(np.frombuffer(planes(values).tobytes(), np.uint8), kind) == values).all()
    assert len(of_planes(np.frombuffer(planes(np.zeros(0, np.int32)).tobytes(), np.uint8), np.int32)) == 0


@pytest.fixture
def corpus(spark):
    words = {"a": "red green blue red", "b": "salt salt pepper", "c": "oak elm ash oak elm"}
    rows = [(f"k{i}", f"{words[k]} filler{i % 5} {k * (i % 4)}", k, "test" if i % 5 == 0 else "train") for i, k in enumerate("abcbacabacbbcaacbbacbcab")]
    return spark.createDataFrame(rows, "key string, text string, label string, split string")


def test_machines_of_counts_equal_machines_of_vectors(spark, corpus, monkeypatch):
    """Nothing but the counts and the blocks is written, and blocks hold whole numbers."""
    written = []
    for module in (training, linear):
        monkeypatch.setattr(module, "materialize", lambda df, label: written.append((label, session.materialize(df, label))) or written[-1][1])
    train, test, vectoriser = training.sparse_vectors(corpus, SMALL)
    assert [label for label, _ in written] == ["counts"]
    by_counts = models.train_linear_svc(train, max_iter=12, vectoriser=vectoriser)
    block = next(linear.Block.of_batch(written[1][1].toArrow().to_batches()[0], 1))
    assert (block.values == np.round(block.values)).all() and block.values.max() > 1
    by_vectors = models.train_linear_svc(train, max_iter=12)
    assert np.allclose(by_counts.classifier.weights, by_vectors.classifier.weights, atol=2e-2)
    got = [sorted(map(tuple, m.predict(test).collect())) for m in (by_counts, by_vectors)]
    assert got[0] == got[1] and len(got[0]) == 5


def test_columns_in_groups_equal_columns_together(spark, monkeypatch):
    """Weights beyond the bound are fitted group by group, and gradients travel in more, smaller rows."""
    rng = np.random.default_rng(5)
    x, label = rng.integers(0, 4, (60, 9)).astype(float), rng.integers(0, 3, 60)
    x[np.arange(60), label] += 3
    masks = np.ones((4, 9), bool)
    masks[1, ::2], masks[2, 3:], masks[3, :2] = False, False, False
    p, v = sparse_cells("features")
    rows = spark.createDataFrame([(Vectors.dense(r), int(k), 1.0) for r, k in zip(x, label)], ["features", "label", "weight"])
    layout = linear.Layout((0, 4, 9), 1 + rng.random(9), masks)
    blocks = linear.make_blocks(rows.select("label", "weight", p.alias("positions"), v.alias("values")), layout)
    whole = linear.fit(blocks, layout, 3, 2.0, 8)
    together = {tuple(r) for r in linear.confusions(blocks, layout, whole).collect()}
    assert linear.setting_groups(layout, 3) == [(0, 1, 2, 3)]
    monkeypatch.setattr(linear, "COLUMN_BYTES", 4 * 10 * 5)
    monkeypatch.setattr(linear, "SLICE_BYTES", 16)
    assert linear.setting_groups(layout, 3) == [(0,), (1,), (2,), (3,)]
    assert np.allclose(linear.fit(blocks, layout, 3, 2.0, 8).weights, whole.weights, atol=1e-5)
    monkeypatch.setattr(linear, "COLUMN_BYTES", 4 * 10 * 7)
    apart = set()
    for chosen in linear.setting_groups(layout, 3):
        assert len(chosen) == 2
        model = linear.fit(blocks, layout, 3, 2.0, 8, chosen)
        assert model.weights.shape == (10, 6)
        apart |= {tuple(r) for r in linear.confusions(blocks, layout, model, chosen).collect()}
    assert apart == together


def test_projected_cells_travel_once_per_document(spark, monkeypatch):
    """Sums of runs that cut documents apart, repeated and NULL keys: equal to plain sums, grouped by one shuffle by key."""
    monkeypatch.setattr(ft, "SUM_ROWS", 7)
    terms = [f"t{i}" for i in range(30)]
    vocabulary = spark.createDataFrame([(t, 3) for t in terms], "term string, df long")
    given = [(None if k == 4 else f"k{k}", terms[(7 * k + 3 * i) % 30], 1.0 + i + k / 8) for k in range(6) for i in range(11)]
    weights = spark.createDataFrame(given, "key string, term string, weight double").repartition(3)
    alone = spark.createDataFrame([(t, t, 1.0) for t in terms], "key string, term string, weight double")
    matrix = {(r.key, r.component): r.value for r in ft.sparse_projection(alone, vocabulary, 8).collect()}
    want = {}
    for key, term, weight in given:
        for c in range(8):
            if (term, c) in matrix:
                want[key, c] = want.get((key, c), 0.0) + weight * matrix[term, c]
    projected = ft.sparse_projection(weights, vocabulary, 8)
    assert {(r.key, r.component): r.value for r in projected.collect()} == pytest.approx(want)
    plan = ft.dense_rows(projected, 8)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "component" not in shuffles[0].split("hashpartitioning(")[1].split(",")[0]


def test_all_topic_numbers_share_their_vectors(spark, monkeypatch):
    written = []
    monkeypatch.setattr(models, "materialize", lambda df, label: written.append(label) or session.materialize(df, label))
    docs = spark.createDataFrame([(f"k{i}", [f"w{(i + j) % 6}" for j in range(3)]) for i in range(24)], "key string, tokens array<string>")
    table, best = models.choose_best_k(docs, [2, 3], passes=1)
    assert [r.k for r in table.collect()] == [2, 3] and best.lda.getK() in (2, 3)
    assert written.count("lda-vectors") == 1


def test_short_boosting_keeps_a_round():
    """Fewer rounds than `patience` cannot show that no tree at all is best."""
    from galleryloom.operators import boosting

    def rounds(losses, patience):
        return len(boosting.boost(boosting.Settings(rounds=len(losses), patience=patience), lambda turn: ([boosting.Tree()], losses[turn]), lambda grown: None)[0])

    assert rounds([0.69, 0.72], 50) == 2 and rounds([0.69, 0.72, 0.71, 0.8], 50) == 2 and rounds([0.69, 0.6, 0.7], 50) == 1
    assert rounds([0.69, 0.72, 0.73, 0.74, 0.75], 3) == 0
