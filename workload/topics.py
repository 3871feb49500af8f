"""Queries for topic tables and topic distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryloom.functions.text import word_tokens
from galleryloom.operators import topics as tp
from galleryloom.operators.keyed import place_by_key
from workload import fixtures as fx
from workload.tables import PROBS_SQL, TOPICS, topic_proportions
from workload.text import TOKS, content_tokens

QUERIES: dict = {}
ORACLES: dict = {}
TOPIC_COUNT = 8


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# ---------------------------------------------------------------- dictionary

_DICT = (
    TOKS
    + """,
found AS (SELECT tok AS term, count(DISTINCT k) AS df FROM toks GROUP BY tok),
kept AS (SELECT term, df FROM found WHERE df >= 5 AND df <= CAST(0.5 AS DOUBLE) * (SELECT count(*) FROM docs)
  ORDER BY df DESC, term LIMIT 100000),
dict AS (SELECT term, df, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS term_id FROM kept)"""
)


@query("dictionary_filter", _DICT + " SELECT term, df, term_id FROM dict")
def dictionary_filter(spark, sf):
    return tp.dictionary(content_tokens(spark, sf))


@query(
    "doc_to_bow",
    _DICT + " SELECT k AS key, term_id, term, count(*) AS n FROM toks JOIN dict ON term = tok GROUP BY k, term_id, term",
)
def doc_to_bow(spark, sf):
    tokens = content_tokens(spark, sf)
    return tp.doc_to_bow(tokens, tp.dictionary(tokens))


# ---------------------------------------------------------------- class TF-IDF


def topic_docs(spark, sf):
    """documents with a topic; -1 is the noise topic."""
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), "text", (F.pmod("doc_id", F.lit(9)) - 1).cast("int").alias("topic")
    )
    return place_by_key(docs, "key")


_CTFIDF = r"""WITH tdocs AS (SELECT doc_id AS key, CAST(doc_id % 9 - 1 AS INTEGER) AS topic,
    regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ts FROM documents),
tt AS (SELECT topic, term, count(*) AS n FROM (SELECT topic, unnest(ts) AS term FROM tdocs) GROUP BY ALL),
sizes AS (SELECT topic, sum(n) AS size FROM tt GROUP BY topic),
idfs AS (SELECT term, ln(1 + CAST((SELECT floor(avg(size)) FROM sizes) AS DOUBLE) / sum(n)) AS idf FROM tt GROUP BY term),
weights AS (SELECT tt.topic, tt.term, idf, CAST(n AS DOUBLE) / size * idf AS weight
  FROM tt JOIN sizes ON sizes.topic = tt.topic JOIN idfs ON idfs.term = tt.term),
ranked AS (SELECT topic, term, round(weight, 9) AS weight,
    row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM weights),
words AS (SELECT topic, term, rank, weight FROM ranked WHERE rank <= 10)"""
_KEYS = """,
keywords AS (SELECT topic, string_agg(printf('%s:%.4f', term, weight), '; ' ORDER BY rank) AS keywords_weights FROM words GROUP BY topic)"""


def _weights(spark, sf):
    return tp.ctfidf_weights(topic_docs(spark, sf))


def _top_words(spark, sf):
    return tp.top_terms(_weights(spark, sf).select("topic", "term", F.round("weight", 9).alias("weight")))


@query("topic_top_terms", _CTFIDF + " SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM words")
def topic_top_terms(spark, sf):
    return _top_words(spark, sf).withColumn("weight", F.round("weight", 6))


@query("ctfidf_keywords", _CTFIDF + _KEYS + " SELECT topic, keywords_weights FROM keywords")
def ctfidf_keywords(spark, sf):
    return tp.ctfidf_keywords(_weights(spark, sf))


@query(
    "topic_table",
    _CTFIDF
    + _KEYS
    + """ SELECT tdocs.topic, count(*) AS document_count, any_value(keywords_weights) AS keywords_weights
FROM tdocs JOIN keywords ON keywords.topic = tdocs.topic WHERE tdocs.topic <> -1 GROUP BY tdocs.topic""",
)
def topic_table(spark, sf):
    return tp.topic_table(topic_docs(spark, sf), tp.ctfidf_keywords(_weights(spark, sf)))


@query("list_topic_ids", "SELECT DISTINCT CAST(doc_id % 9 - 1 AS INTEGER) AS topic FROM documents WHERE doc_id % 9 <> 0")
def list_topic_ids(spark, sf):
    return tp.list_topic_ids(topic_docs(spark, sf))


@query(
    "topic_summary",
    PROBS_SQL
    + ", dominant AS (SELECT CASE "
    + " ".join(f"WHEN topic_{i} >= greatest({', '.join(f'topic_{j}' for j in range(TOPICS))}) THEN {i}" for i in range(TOPICS))
    + " END AS topic FROM probs), coverage AS (SELECT t.topic, count(dominant.topic) AS doc_count"
    + " FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS topic) t LEFT JOIN dominant ON dominant.topic = t.topic GROUP BY t.topic), "
    + _CTFIDF.replace("WITH ", "", 1)
    + """
SELECT coverage.topic AS topic_id, doc_count,
  coalesce(string_agg(printf('%s(%.4f)', term, weight), ', ' ORDER BY rank), '') AS top10_terms_with_weights
FROM coverage LEFT JOIN words ON words.topic = coverage.topic GROUP BY coverage.topic, doc_count""",
)
def topic_summary(spark, sf):
    return tp.topic_summary(_coverage(spark, sf), _top_words(spark, sf))


def _dominant(spark, sf):
    topic, prob = tp.dominant("p")
    return topic_proportions(spark, sf).select("image_name", topic.alias("topic"), prob.alias("prob"))


def _coverage(spark, sf):
    return tp.topic_doc_coverage(_dominant(spark, sf), 12)


_PICKED = (
    PROBS_SQL
    + ", picked AS (SELECT image_name, list_position(p, list_max(p)) - 1 AS topic, list_max(p) AS prob FROM (SELECT image_name, ["
    + ", ".join(f"topic_{i}" for i in range(TOPICS))
    + "] AS p FROM probs))"
)


@query(
    "topic_doc_coverage",
    _PICKED
    + """ SELECT t.topic, count(picked.topic) AS doc_count
FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS topic) t LEFT JOIN picked ON picked.topic = t.topic GROUP BY t.topic""",
)
def topic_doc_coverage(spark, sf):
    return _coverage(spark, sf)


@query("dominant_topic", _PICKED + " SELECT image_name, CAST(topic AS INTEGER) AS topic, round(prob, 6) AS prob FROM picked")
def dominant_topic(spark, sf):
    return _dominant(spark, sf).withColumn("prob", F.round("prob", 6))


@query(
    "topic_coherence",
    _CTFIDF
    + """,
toks AS (SELECT key, unnest(range(len(ts))) AS pos, unnest(ts) AS tok, len(ts) AS n FROM tdocs),
hits AS (SELECT * FROM toks WHERE tok IN (SELECT term FROM words)),
wins AS (SELECT DISTINCT key, tok, unnest(range(greatest(pos - 109, 0), least(pos, greatest(n - 110, 0)) + 1)) AS start FROM hits),
total AS (SELECT CAST(sum(greatest(n - 110, 0) + 1) AS DOUBLE) AS t FROM (SELECT DISTINCT key, n FROM hits)),
ones AS (SELECT tok, count(*) AS c FROM wins GROUP BY tok),
together AS (SELECT a.tok AS a, b.tok AS b, count(*) AS c FROM wins a JOIN wins b ON a.key = b.key AND a.start = b.start GROUP BY ALL),
cells AS (SELECT x.topic, x.term AS a, y.term AS b, coalesce(together.c, 0) / t AS p, oa.c / t AS pa, ob.c / t AS pb
  FROM words x JOIN words y ON x.topic = y.topic CROSS JOIN total JOIN ones oa ON oa.tok = x.term JOIN ones ob ON ob.tok = y.term
  LEFT JOIN together ON together.a = x.term AND together.b = y.term),
npmi AS (SELECT topic, a, b, ln((p + CAST(1e-12 AS DOUBLE)) / (pa * pb)) / -ln(p + CAST(1e-12 AS DOUBLE)) AS v FROM cells),
whole AS (SELECT topic, b, sum(v) AS s FROM npmi GROUP BY topic, b),
snorm AS (SELECT topic, sqrt(sum(s * s)) AS sn FROM whole GROUP BY topic),
cosines AS (SELECT npmi.topic, a, sum(v * s) / (sqrt(sum(v * v)) * any_value(sn)) AS c FROM npmi
  JOIN whole ON whole.topic = npmi.topic AND whole.b = npmi.b JOIN snorm ON snorm.topic = npmi.topic GROUP BY npmi.topic, a)
SELECT topic, round(avg(c), 6) AS coherence FROM cosines GROUP BY topic""",
)
def topic_coherence(spark, sf):
    tokens = topic_docs(spark, sf).select("key", word_tokens("text").alias("tokens"))
    return tp.topic_coherence(tokens, _top_words(spark, sf)).withColumn("coherence", F.round("coherence", 6))


_DISTRIBUTION = (
    _CTFIDF
    + """,
norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM weights WHERE topic <> -1 GROUP BY topic),
win AS (SELECT key, w, len(ts) AS n, ts[w * 4 + 1 : w * 4 + 8] AS span FROM (SELECT key, ts,
  unnest(range(CAST(ceil(greatest(len(ts) - 8, 0) / CAST(4 AS DOUBLE)) AS BIGINT) + 1)) AS w FROM tdocs WHERE len(ts) > 0)),
cnt AS (SELECT key, w, n, term, count(*) AS c, len(any_value(span)) AS tokens FROM (SELECT key, w, n, span, unnest(span) AS term FROM win) GROUP BY ALL),
xs AS (SELECT cnt.*, c * idf AS x FROM cnt JOIN idfs ON idfs.term = cnt.term),
lens AS (SELECT key, w, sqrt(sum(x * x)) AS length FROM xs GROUP BY key, w),
sims AS (SELECT xs.key, xs.w, weights.topic, any_value(tokens) AS tokens,
    sum(x * weight / norm) / any_value(length) AS sim
  FROM xs JOIN lens ON lens.key = xs.key AND lens.w = xs.w JOIN weights ON weights.term = xs.term AND weights.topic <> -1
  JOIN norms ON norms.topic = weights.topic GROUP BY xs.key, xs.w, weights.topic),
sums AS (SELECT key, topic, sum(sim * tokens) AS s FROM sims WHERE sim >= CAST(0.1 AS DOUBLE) GROUP BY key, topic),
dist AS (SELECT key, topic, s / sum(s) OVER (PARTITION BY key) AS probability FROM sums)"""
)


def _distribution(spark, sf):
    docs = topic_docs(spark, sf)
    tokens = docs.select("key", word_tokens("text").alias("tokens"))
    return docs, tp.approx_topic_distribution(tokens, tp.ctfidf_weights(docs))


@query("approx_topic_distribution", _DISTRIBUTION + " SELECT key, topic, round(probability, 6) AS probability FROM dist")
def approx_topic_distribution(spark, sf):
    return _distribution(spark, sf)[1].withColumn("probability", F.round("probability", 6))


_WIDE_COLUMNS = ", ".join(
    f"round(coalesce(max(CASE WHEN dist.topic = {i} THEN probability END), 0), 6) AS topic_{i}_prob" for i in range(TOPIC_COUNT)
)


@query(
    "proportions_wide",
    _DISTRIBUTION
    + f" SELECT tdocs.key, tdocs.topic, {_WIDE_COLUMNS} FROM tdocs LEFT JOIN dist ON dist.key = tdocs.key GROUP BY tdocs.key, tdocs.topic",
)
def proportions_wide(spark, sf):
    ids = list(range(TOPIC_COUNT))
    docs, distribution = _distribution(spark, sf)
    wide = tp.proportions_wide(docs.select("key", "topic"), distribution, ids)
    return wide.select("key", "topic", *[F.round(f"topic_{i}_prob", 6).alias(f"topic_{i}_prob") for i in ids])
