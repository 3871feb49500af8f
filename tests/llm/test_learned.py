"""Language identification and quality: held-out accuracy, brute-force Viterbi, edge rows."""

import numpy as np

from galleryloom.llm import langid, quality
from galleryloom.llm.common import fold, table
from pyspark.sql import functions as F


def test_language_accuracy(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    found = langid.op3_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.93, (right, total)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(5)
    lengths = np.array([0, 1, 3, langid.SEGMENT, 2 * langid.SEGMENT + 5, 0, 700])
    scores = rng.normal(0, 3, (lengths.sum(), 3)).astype(np.float32)
    label = langid.viterbi(scores, lengths, 4.0)
    at = 0
    for n in lengths:
        s = scores[at : at + n].astype(float)
        if n:
            best = s[0].copy()
            for row in s[1:]:
                best = np.maximum(best, best.max() - 4.0) + row
            own = label[at : at + n]
            value = s[np.arange(n), own].sum() - 4.0 * (np.diff(own) != 0).sum()
            assert abs(value - best.max()) < 1e-2
        at += n


def test_language_edges(spark):
    train = [("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr"), ("это кошка и собака", "ru"), (None, "en"), ("x", None)] * 3
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    mixed = "the cat and the dog are here the dog " * 6 + "le chat et le chien sont ici " * 4 + "это собака"
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "the dog"), (4, "the dog"), (None, "собака"), (5, mixed), (6, "le chat " * 60_000)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, language string, score string")
    out = langid.with_language(docs, model)
    got = [(r.doc_id, r.language.lang) for r in out.collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "ru"), (5, "en"), (6, "fr")]
    spans = out.where("doc_id = 5").first().language.spans
    assert [s.lang for s in spans] == ["en", "fr", "ru"] and spans[0].end == 54
    assert langid.keep_identified(docs, model).count() == 5
    assert langid.with_language(docs.limit(0), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.language.lang for r in langid.with_language(docs, nothing).collect()} == {"und"}


def test_quality_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    found = quality.op8_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good = np.array([r.score for r in found if r.quality == 1])
    bad = np.array([r.score for r in found if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert np.mean([r.predicted == r.quality for r in found]) > 0.85


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, quality.FACTORS)))
    slots, weights = quality.features_of("some words, some more words", [3.0])
    raw = 0.3 + machine.linear[slots] @ weights
    for i in range(len(slots)):
        for j in range(i):
            raw += machine.factors[slots[i]] @ machine.factors[slots[j]] * weights[i] * weights[j]
    assert np.isclose(machine.raw(slots, weights, np.array([0]))[0][0], raw)


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, None), (2, "", 0), (3, "word " * 100_000, 500_000), (3, "word " * 100_000, 500_000), (None, "fine text", -5)],
        "doc_id long, text string, n_chars long",
    ).withColumn("quality_score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (2, None), (9, 1)], "doc_id long, quality int")
    got = [r.quality_score for r in quality.with_quality(docs, quality.fit(docs, labels)).orderBy("doc_id").collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for s in got) and got[3] == got[4]
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.with_quality(docs.limit(0), empty).count() == 0
    assert [r.quality_score for r in quality.with_quality(docs, empty).collect()] == [0.5] * 5
    assert quality.with_quality(docs.drop("n_chars"), empty).count() == 5
    assert fold("doc_id", 5) is not None
