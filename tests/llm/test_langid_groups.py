"""Letter groups and training texts per language."""

import tracemalloc

import numpy as np
import pytest

from galleryloom.llm import langid


def test_small_language_keeps_its_groups(spark):
    large = [(" ".join(f"{a}{b}{c}{a}{b}" for c in "abcdefghij"), "en") for a in "abcdefghij" for b in "abcdefghij"]
    docs = spark.createDataFrame([*large * 3, ("ñandú ñoño cañón", "es")], "text string, lang string")
    model = langid.fit(docs, max_grams=300)
    assert len(model.rows) == 300
    assert {g for w in ("ñandú", "ñoño", "cañón") for g in langid.grams_of(w)} <= set(model.rows)


def test_default_number_of_groups():
    assert langid.fit.__defaults__[-1] == langid.MAX_GRAMS == 200_000


def test_small_language_is_learned_from_a_large_table(spark):
    large = [(f"the cat number w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} sleeps here", "en") for i in range(3000)]
    copies = [("one text in many copies", "en")] * 1500
    small = [("el perro duerme en la casa", "es"), ("la casa del perro es grande", "es")]
    docs = spark.createDataFrame(large + copies + small, "text string, lang string")
    taught = langid.training_texts(docs, 100, 50).collect()
    assert sorted(r.text for r in taught if r.lang == "es") == sorted(t for t, _ in small)
    assert len({r.text for r in taught}) == len(taught) and 50 < len(taught) < 200
    model = langid.fit(docs, documents=100)
    found = langid.with_language(spark.createDataFrame([("el perro es grande",)], "text string"), model)
    assert found.first().language.lang == "es"


def test_quotas():
    assert langid.quotas({"a": 5, "b": 1000, "c": 90}, 300, 10) == {"a": 5, "b": 205, "c": 90}
    assert langid.quotas({"a": 5, "b": 1000, "c": 90}, 20, 10) == {"a": 5, "b": 10, "c": 10}
    assert langid.quotas({}, 20, 10) == {}


def test_too_many_languages_are_told(spark):
    docs = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(langid.MAX_LANGUAGES + 1)], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)


def test_keys_are_those_of_the_groups():
    words = ["a", "ab", "abcd", "ñandú", "собака", "x" * 300]
    marked = [f"^{w}$" for w in words]
    keys, counts = langid.gram_keys(marked)
    groups = [langid.grams_of(w) for w in words]
    assert counts.tolist() == [len(g) for g in groups]
    named = {}
    for gram, key in zip((g for gs in groups for g in gs), keys.tolist()):
        assert named.setdefault(gram, key) == key
    assert len(set(named.values())) == len(named)
    alone, sizes = langid.gram_keys(list(named))
    assert alone[np.cumsum(sizes) - 1].tolist() == list(named.values())


def test_word_scores_equal_plain_sums(spark):
    train = [("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr"), ("это кошка и собака", "ru")] * 3
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    words = ["the", "chat", "кошка", "the", "unseenword", "и", "漢字"]
    used, scores = model.scorer().word_scores(words)
    assert used.tolist() == [0, 1, 2]
    for word, row in zip(words, scores):
        plain = sum(model.weights[model.rows.get(g, len(model.rows))].astype(float) for g in langid.grams_of(word))
        allowed = model.scripts.get(langid.script_of(word), np.ones(3, bool))
        assert np.allclose(row[allowed], plain[allowed], atol=1e-3) and np.isneginf(row[~allowed]).all()
    assert model.scorer().word_scores(["the", "chat"])[0].tolist() == [0, 1]


def test_memory_is_linear_in_languages():
    """100 languages and 50,000 words: a cell of 4 + 1 bytes per word and language, and tables of a fixed size, within 150 MB."""
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 2, (50_000, 100)).astype(np.float32)
    lengths = np.array([30_000, 1, 0, 19_999])
    tracemalloc.start()
    label = langid.viterbi(scores, lengths, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    best = np.zeros(100)
    for row in scores[:30_000].astype(float):
        best = np.maximum(best, best.max() - 5.0) + row
    own = label[:30_000]
    assert abs(scores[np.arange(30_000), own].sum(dtype=float) - 5.0 * (np.diff(own) != 0).sum() - best.max()) < 0.5
