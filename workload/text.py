"""Queries for text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryloom.functions.text import (
    ENGLISH_STOPWORDS,
    language_of,
    remove_stopwords,
    split_whitespace,
    text_or_empty,
    tokenize_basic,
)
from galleryloom.operators import text as ops
from galleryloom.operators.keyed import place_by_key
from galleryloom.plans.clean import base_tokens, clean_texts
from galleryloom.session import materialize
from workload import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


BLANKS_SQL = r"[\t-\r\x1c-\x20\x85\p{Z}]"
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOPWORDS) + "]"
TOKENS_SQL = (
    r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}_]+'), "
    "lambda x: length(x) BETWEEN 3 AND 30 AND NOT starts_with(x, '_'))"
)
CONTENT_SQL = f"list_filter({TOKENS_SQL}, lambda x: NOT list_contains({STOP_SQL}, x))"
# toks(k, pos, tok): content tokens in long form.
TOKS = f"""
WITH docs AS (SELECT doc_id AS k, {CONTENT_SQL} AS ts FROM documents),
toks AS (SELECT k, unnest(range(len(ts))) AS pos, unnest(ts) AS tok FROM docs)"""


def phrases_sql(src: str, out: str, min_count: int) -> str:
    return f""",
{out}_adj AS (SELECT k, tok AS a, lead(tok) OVER (PARTITION BY k ORDER BY pos) AS b FROM {src}),
{out}_one AS (SELECT tok, count(*) AS n FROM {src} GROUP BY tok),
{out}_two AS (SELECT a, b, count(*) AS n FROM {out}_adj WHERE b IS NOT NULL GROUP BY a, b),
{out}_size AS (SELECT (SELECT count(*) FROM {out}_one) + (SELECT count(*) FROM {out}_two) AS v),
{out}_all AS (SELECT t.a, t.b, t.n,
    CAST(t.n - {min_count} AS DOUBLE) / (x.n * y.n) * (SELECT v FROM {out}_size) AS score
  FROM {out}_two t JOIN {out}_one x ON x.tok = t.a JOIN {out}_one y ON y.tok = t.b WHERE t.n > {min_count}),
{out} AS (SELECT * FROM {out}_all WHERE score > 10)"""


def merge_sql(src: str, phrases: str, out: str) -> str:
    """Gaps and islands: the place inside a run of accepted pairs decides."""
    return f""",
{out}_next AS (SELECT k, pos, tok, lead(tok) OVER (PARTITION BY k ORDER BY pos) AS nxt FROM {src}),
{out}_hit AS (SELECT s.*, p.a IS NOT NULL AS hit FROM {out}_next s LEFT JOIN {phrases} p ON p.a = s.tok AND p.b = s.nxt),
{out}_grp AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos)
    - row_number() OVER (PARTITION BY k, hit ORDER BY pos) AS island FROM {out}_hit),
{out}_rank AS (SELECT *, hit AND row_number() OVER (PARTITION BY k, hit, island ORDER BY pos) % 2 = 1 AS merge FROM {out}_grp),
{out}_lag AS (SELECT *, coalesce(lag(merge) OVER (PARTITION BY k ORDER BY pos), false) AS taken FROM {out}_rank),
{out} AS (SELECT k, pos, CASE WHEN merge THEN tok || '_' || nxt ELSE tok END AS tok FROM {out}_lag WHERE NOT taken)"""


def lemma_sql(src: str, out: str) -> str:
    return f""",
{out}_parts AS (SELECT k, pos, unnest(range(len(string_split(tok, '_')))) AS i, unnest(string_split(tok, '_')) AS part FROM {src}),
{out} AS (SELECT k, pos, string_agg(CASE WHEN ends_with(part, 's') THEN left(part, length(part) - 1) ELSE part END, '_' ORDER BY i) AS tok
  FROM {out}_parts WHERE part <> '' AND length(part) % 4 < 3 GROUP BY k, pos)"""


def df_filter_sql(src: str, out: str) -> str:
    return rf""",
{out}_words AS (SELECT DISTINCT k, unnest(regexp_extract_all(lower(tok), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w FROM {src}),
{out}_vocab AS (SELECT w FROM {out}_words GROUP BY w
  HAVING count(*) >= CAST(0.015 AS DOUBLE) * (SELECT count(*) FROM docs)
     AND count(*) <= CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM docs)),
{out} AS (SELECT k, pos, tok FROM {src} WHERE tok IN (SELECT w FROM {out}_vocab))"""


def rejoined_sql(src: str) -> str:
    return f"""
SELECT docs.k AS key, coalesce(string_agg(tok, ' ' ORDER BY pos), '') AS cleaned_text
FROM docs LEFT JOIN {src} ON {src}.k = docs.k GROUP BY docs.k"""


def _docs(spark, sf):
    return fx.descriptions(spark, sf)


def content_tokens(spark, sf):
    """Content tokens; the single test file is spread out first, a large table has splits enough."""
    return base_tokens(place_by_key(_docs(spark, sf), "doc_id"), "description", "doc_id")


def _joined(df):
    return df.select("key", F.array_join("tokens", " ").alias("cleaned_text"))


@query(
    "text_null_fill",
    """SELECT documents.doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, length(text) AS n_chars
FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id""",
)
def text_null_fill(spark, sf):
    return (
        fx.table(spark, sf, "documents")
        .join(fx.table(spark, sf, "labels"), "doc_id", "left")
        .select(
            "doc_id",
            text_or_empty("quality").alias("quality"),
            F.length(text_or_empty("text")).cast("bigint").alias("n_chars"),
        )
    )


@query("tokenize_basic", f"SELECT doc_id AS key, array_to_string({TOKENS_SQL}, ' ') AS cleaned_text FROM documents")
def tokenize(spark, sf):
    return _joined(_docs(spark, sf).select(F.col("doc_id").alias("key"), tokenize_basic("description").alias("tokens")))


@query("remove_stopwords", f"SELECT doc_id AS key, array_to_string({CONTENT_SQL}, ' ') AS cleaned_text FROM documents")
def stopwords(spark, sf):
    tokens = _docs(spark, sf).select(F.col("doc_id").alias("key"), tokenize_basic("description").alias("tokens"))
    return _joined(tokens.withColumn("tokens", remove_stopwords("tokens")))


@query("phrase_bigrams", TOKS + phrases_sql("toks", "pairs", 5) + "\nSELECT a, b, n, round(score, 6) AS score FROM pairs")
def phrase_bigrams(spark, sf):
    return ops.mine_phrases(content_tokens(spark, sf), 5, 10.0).withColumn("score", F.round("score", 6))


def _merged(spark, sf):
    return _phrased(materialize(content_tokens(spark, sf), "content-tokens"))


def _phrased(tokens):
    return ops.apply_phrases(tokens, ops.mine_phrases(tokens, 5, 10.0))


@query(
    "phrase_trigrams",
    TOKS
    + phrases_sql("toks", "pairs", 5)
    + merge_sql("toks", "pairs", "merged")
    + phrases_sql("merged", "triples", 3)
    + "\nSELECT a, b, n, round(score, 6) AS score FROM triples",
)
def phrase_trigrams(spark, sf):
    merged = materialize(_merged(spark, sf), "merged-pairs")
    return ops.mine_phrases(merged, 3, 10.0).withColumn("score", F.round("score", 6))


@query("apply_phrases", TOKS + phrases_sql("toks", "pairs", 5) + merge_sql("toks", "pairs", "merged") + rejoined_sql("merged"))
def apply_phrases(spark, sf):
    return _joined(_merged(spark, sf))


def lexicon(tokens):
    """Word class by token length, lemma without a final s; a rule both engines can compute."""
    classes = F.array(*[F.lit(c) for c in ("NOUN", "ADJ", "ADV", "VERB")])
    return ops.token_parts(tokens).select(
        "token",
        F.regexp_replace("token", "s$", "").alias("lemma"),
        F.get(classes, F.length("token") % 4).alias("pos"),
    )


@query(
    "lemma_pos_filter",
    TOKS + phrases_sql("toks", "pairs", 5) + merge_sql("toks", "pairs", "merged") + lemma_sql("merged", "lemmas") + rejoined_sql("lemmas"),
)
def lemma_pos_filter(spark, sf):
    tokens = materialize(content_tokens(spark, sf), "content-tokens")
    return _joined(ops.lemma_pos_filter(_phrased(tokens), lexicon(tokens)))


@query("doc_freq_filter", TOKS + df_filter_sql("toks", "kept") + rejoined_sql("kept"))
def doc_freq_filter(spark, sf):
    return _joined(ops.doc_freq_filter(content_tokens(spark, sf)))


@query(
    "rejoin_text",
    TOKS
    + "\nSELECT k AS key, 'img_' || k || '.jpg' AS image_name, array_to_string(ts, ' ') AS cleaned_text FROM docs",
)
def rejoin_text(spark, sf):
    names = _docs(spark, sf).select(F.col("doc_id").alias("key"), "image_name")
    return ops.rejoin_text(content_tokens(spark, sf), names)


@query(
    "clean_pipeline",
    TOKS
    + phrases_sql("toks", "pairs", 5)
    + merge_sql("toks", "pairs", "merged")
    + phrases_sql("merged", "triples", 3)
    + merge_sql("merged", "triples", "phrased")
    + lemma_sql("phrased", "lemmas")
    + df_filter_sql("lemmas", "kept")
    + rejoined_sql("kept"),
)
def clean_all(spark, sf):
    docs = _docs(spark, sf)
    cleaned = clean_texts(docs, "description", "doc_id", lexicon=lexicon(content_tokens(spark, sf)))
    return cleaned.select("key", "cleaned_text")


@query(
    "split_whitespace",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{BLANKS_SQL}+'), lambda x: x <> '') AS ts FROM documents)
SELECT doc_id, len(ts) AS n, array_to_string(ts, ' ') AS joined FROM t""",
)
def whitespace(spark, sf):
    tokens = _docs(spark, sf).select("doc_id", split_whitespace("description").alias("ts"))
    return tokens.select("doc_id", F.size("ts").cast("bigint").alias("n"), F.array_join("ts", " ").alias("joined"))


@query(
    "short_and_dup_filter",
    f"""WITH t AS (SELECT doc_id, regexp_replace(text, '^{BLANKS_SQL}+|{BLANKS_SQL}+$', '', 'g') AS description FROM documents)
SELECT min(doc_id) AS doc_id, description FROM t WHERE length(description) >= 5 GROUP BY description""",
)
def short_and_dup(spark, sf):
    return ops.short_and_dup_filter(_docs(spark, sf), "description", "doc_id")


_GUESS = r"""CASE WHEN CAST(length(regexp_replace({t}, '[^\x00-\x7F]', '', 'g')) AS DOUBLE) / greatest(length({t}), 1)
  > CAST(0.95 AS DOUBLE) AND regexp_matches({t}, '[A-Za-z]') THEN 'english' ELSE 'multilingual' END"""


@query(
    "language_guess",
    f"""WITH head AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50),
sample AS (SELECT string_agg(text, ' ' ORDER BY doc_id) AS s FROM head)
SELECT 'corpus' AS scope, {_GUESS.format(t="s")} AS language, CAST(1 AS BIGINT) AS n FROM sample
UNION ALL
SELECT lang, {_GUESS.format(t="text")}, count(*) FROM documents GROUP BY ALL""",
)
def language_guess(spark, sf):
    docs = _docs(spark, sf)
    corpus = ops.corpus_language(docs, "description", "doc_id").select(
        F.lit("corpus").alias("scope"), "language", F.lit(1).cast("bigint").alias("n")
    )
    per_doc = docs.groupBy(F.col("lang").alias("scope"), language_of("description").alias("language")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return corpus.unionByName(per_doc)
