import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from galleryloom.functions import text as tx
from galleryloom.operators import keyed
from galleryloom.operators import text as ops
from galleryloom.plans.clean import clean_texts


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def tokens_df(spark, lists):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "key int, tokens array<string>")


def tokens_of(df):
    return {r.key: r.tokens for r in df.collect()}


def test_tokens_keep_accents_and_bounds(spark):
    got = one(spark, tx.tokenize_basic("t"), "Élan vital 2nd _hidden abc12def ab " + "x" * 31)
    assert got == ["élan", "vital", "abc", "def"]
    assert one(spark, tx.tokenize_basic("t", digits=True), "a1b2 xy") == ["a1b2"]


def test_stopwords_keep_order_and_repeats(spark):
    df = tokens_df(spark, [["the", "cat", "and", "cat"]])
    assert df.select(tx.remove_stopwords("tokens").alias("x")).first().x == ["cat", "cat"]


def test_word_ngrams_against_brute_force(spark):
    for words in ([], ["a"], ["a", "b"], ["a", "b", "c", "d"]):
        df = spark.createDataFrame([(words,)], "w array<string>")
        got = df.select(tx.word_ngrams(F.col("w"), 1, 3).alias("x")).first().x
        want = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert sorted(got) == sorted(want)


def test_char_ngrams_against_brute_force(spark):
    for text in ("", "ab", "abc", "añ😀b\nc", "one two"):
        got = one(spark, tx.char_ngrams(F.col("t"), 3, 5), text)
        want = [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
        assert sorted(got) == sorted(want)


def test_only_repeated_blanks_are_squeezed(spark):
    assert one(spark, tx.squeeze_blanks("t"), "A\nb  \t c") == "a\nb c"


def test_accents(spark):
    assert one(spark, tx.fold_accents("t"), "Éàßñø") == "Eaßnø"
    assert one(spark, tx.fold_accents("t", full=True), "ﬁé한") == "fie" + unicodedata.normalize("NFKD", "한")


def test_phrases_merge_greedily(spark):
    docs = tokens_df(spark, [["a", "b", "c"], ["a", "b", "c", "d"], ["x", "a", "b"], ["a"], [], ["a", "b", "b", "c"]])
    phrases = spark.createDataFrame([("a", "b", 9), ("b", "c", 9), ("c", "d", 9)], "a string, b string, n bigint")
    assert tokens_of(ops.apply_phrases(docs, phrases)) == {
        0: ["a_b", "c"], 1: ["a_b", "c_d"], 2: ["x", "a_b"], 3: ["a"], 4: [], 5: ["a_b", "b_c"],
    }


def test_phrases_merge_inside_the_lists(spark, monkeypatch):
    # Every token was shuffled to the phrases when these were too many for a broadcast join.
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    lists = [[rng.choice(["aa", "bb", "cc", "dd", "é", None]) for _ in range(rng.randrange(12))] for _ in range(80)] + [None]
    pairs = [("aa", "bb", 9), ("bb", "aa", 7), ("aa", "aa", 8), ("cc", "é", 6), ("é", "cc", None), ("zz", "aa", 9)]
    phrases = spark.createDataFrame(pairs, "a string, b string, n bigint")
    docs = tokens_df(spark, lists)
    accepted = phrases.select(F.concat_ws(" ", "a", "b").alias("pair"), F.col("n").alias("pair_count"))
    merged = ops.apply_phrases(docs, phrases)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert tokens_of(merged) == tokens_of(ops._apply_by_rows(docs, accepted, "key"))
    assert tokens_of(ops.apply_phrases(docs, phrases.limit(0))) == {i: [t for t in ts or [] if t is not None] for i, ts in enumerate(lists)}
    # Rows of repeated and NULL keys are one document each, as before; a space inside a word leaves the cut of a pair open.
    twice = spark.createDataFrame([(1, ["aa", "bb"]), (1, []), (None, ["bb", "aa"]), (2, ["cc", "é", "cc"])], "key int, tokens array<string>")
    assert tokens_of(ops.apply_phrases(twice, phrases)) == tokens_of(ops._apply_by_rows(twice, accepted, "key"))
    spaced = spark.createDataFrame([("a b", "c", 9)], "a string, b string, n bigint")
    assert tokens_of(ops.apply_phrases(tokens_df(spark, [["a", "b c"], ["a b", "c"]]), spaced)) == {0: ["a_b c"], 1: ["a b_c"]}


def test_phrase_scores(spark):
    docs = tokens_df(spark, [["new", "york"]] * 8 + [[f"w{i}", f"v{i}"] for i in range(60)])
    mined = ops.mine_phrases(docs, 5, 1.0).collect()
    size = 2 + 120 + 1 + 60
    assert [(r.a, r.b, r.n) for r in mined] == [("new", "york", 8)]
    assert abs(mined[0].score - (8 - 5) / 64 * size) < 1e-9


def test_lemma_filter_by_part(spark):
    docs = tokens_df(spark, [["dogs", "run", "big_dogs", "run_run"], ["run"]])
    lexicon = spark.createDataFrame(
        [("dogs", "Dog", "NOUN"), ("big", "big", "ADJ"), ("run", "run", "VERB")], "token string, lemma string, pos string"
    )
    assert tokens_of(ops.lemma_pos_filter(docs, lexicon)) == {0: ["dog", "big_dog"], 1: []}


def test_doc_freq_filter_keeps_emptied_documents(spark):
    docs = tokens_df(spark, [["a1", "common", "common"], ["common"], ["rare", "common"], []])
    kept = tokens_of(ops.doc_freq_filter(docs, 0.5, 0.8))
    assert kept == {0: ["common", "common"], 1: ["common"], 2: ["common"], 3: []}


def test_tagger_sees_each_token_once(spark):
    def tagger(batches):
        for batch in batches:
            yield batch.assign(lemma=batch["token"].str.rstrip("s"), pos="NOUN")

    docs = spark.createDataFrame([(i, "red dogs chase red dogs") for i in range(4)], "id int, text string")
    cleaned = clean_texts(docs, "text", "id", tagger=tagger, min_df=0.1, max_df=1.0).collect()
    assert {r.cleaned_text for r in cleaned} == {"red dog chase red dog"}


def test_duplicates_keep_the_lowest_key(spark):
    rows = [(3, " same text "), (1, "same text"), (2, "abc"), (5, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    assert [tuple(r) for r in ops.short_and_dup_filter(df, "text", "id").select("id", "text").collect()] == [(1, "same text")]


def test_language(spark):
    for text, want in (("plain words", "english"), ("123", "multilingual"), ("", "multilingual"), ("ééé abc", "multilingual")):
        assert one(spark, tx.language_of("t"), text) == want


def test_whitespace_tokens(spark):
    assert one(spark, tx.split_whitespace("t"), "  a b \n c ") == ["a", "b", "c"]


def test_vocabulary_is_closed(spark):
    docs = tokens_df(spark, [list(p) for p in itertools.permutations(["aa", "bb", "cc"])])
    for tokens in tokens_of(ops.doc_freq_filter(docs, 0.0, 1.0)).values():
        assert sorted(tokens) == ["aa", "bb", "cc"]


def test_tokens_are_cut_not_matched(spark):
    # Extracting every match of a pattern took up to three times the work of cutting the text.
    import re

    texts = [None, "", " ", "_", "a", "ab c", "x_1 Éa½ 日本", "don't 3d 42", "😀ab😀"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.word_tokens(F.col("text")).alias("w"), tx.tokenize_basic("text").alias("b"))
    assert "regexp_extract_all" not in frame._jdf.queryExecution().optimizedPlan().toString()
    for row in frame.collect():
        assert row.w == re.findall(r"[^\W]{2,}", (row.text or "").lower())
        runs = re.findall(r"(?:[^\W\d]|½)+", (row.text or "").lower())
        assert row.b == [t for t in runs if 3 <= len(t) <= 30 and not t.startswith("_")]
