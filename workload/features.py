"""Queries for feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryloom.functions.text import fold_accents
from galleryloom.operators import features as ft
from galleryloom.operators import splits
from galleryloom.operators.keyed import place_by_key
from galleryloom.session import materialize
from workload import fixtures as fx
from workload.tables import _RANKED

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def training_set(spark, sf, label="lang"):
    """documents with class and split, written once: key, text, lang, split."""
    docs = fx.descriptions(spark, sf).select(
        F.col("image_name").alias("key"), F.col("description").alias("text"), "lang"
    )
    return place_by_key(splits.stratified_split(docs, "key", label), "key")


_CORPUS = _RANKED + """,
corpus AS (SELECT strat.image_name AS key, strat.lang, strat.split, text FROM strat
  JOIN documents ON 'img_' || doc_id || '.jpg' = strat.image_name),
trained AS (SELECT count(*) AS n FROM corpus WHERE split = 'train')"""


def words_sql(longest: int = 2) -> str:
    grams = [
        "ts" if n == 1 else f"[array_to_string(ts[i:i+{n - 1}], ' ') for i in range(1, len(ts) - {n - 2})]"
        for n in range(1, longest + 1)
    ]
    body = grams[0]
    for g in grams[1:]:
        body = f"list_concat({body}, {g})"
    return rf""",
w_split AS (SELECT key, lang, split, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]{{2,}}') AS ts FROM corpus),
w_terms AS (SELECT key, lang, split, unnest({body}) AS term FROM w_split)"""


def chars_sql(longest: int = 5) -> str:
    parts = " UNION ALL ".join(
        f"SELECT key, lang, split, unnest([substr(t, i, {n}) for i in range(1, length(t) - {n - 2})]) AS term FROM c_split WHERE length(t) >= {n}"
        for n in range(3, longest + 1)
    )
    return rf""",
c_split AS (SELECT key, lang, split, regexp_replace(lower(text), '[\t-\r\x1c-\x20\x85\p{{Z}}]{{2,}}', ' ', 'g') AS t FROM corpus),
c_terms AS ({parts})"""


def tfidf_sql(p: str, min_df: int, max_df: float, max_features: int | None = None) -> str:
    top = f"ORDER BY total DESC, term LIMIT {max_features}" if max_features else ""
    return f""",
{p}_tf AS (SELECT key, lang, split, term, count(*) AS tf FROM {p}_terms GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {p}_tf WHERE split = 'train' GROUP BY term),
{p}_vocab AS (SELECT term, df, ln((1.0 + CAST((SELECT n FROM trained) AS DOUBLE)) / (1.0 + CAST(df AS DOUBLE))) + 1.0 AS idf FROM {p}_df
  WHERE df >= {min_df} AND df <= CAST({max_df} AS DOUBLE) * (SELECT n FROM trained) {top}),
{p}_raw AS (SELECT key, lang, split, {p}_tf.term, tf * idf AS raw FROM {p}_tf JOIN {p}_vocab ON {p}_vocab.term = {p}_tf.term),
{p}_w AS (SELECT key, lang, split, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS weight FROM {p}_raw)"""


_W = words_sql() + tfidf_sql("w", 5, 0.9)
_C = chars_sql() + tfidf_sql("c", 5, 0.95)
_TOTALS = """
SELECT {p}_vocab.term, df, round(idf, 6) AS idf, count(*) AS documents, round(sum(weight), 6) AS total_weight
FROM {p}_w JOIN {p}_vocab ON {p}_vocab.term = {p}_w.term GROUP BY ALL"""


def vectorised(spark, sf, *families):
    """(corpus, {prefix: (family, vocabulary, weights)}) with vocabularies from the train rows."""
    corpus = materialize(training_set(spark, sf), "corpus")
    train = corpus.where(F.col("split") == "train")
    out = {}
    for family in families:
        vocabulary = ft.fit_vocabulary(train, family)
        out[family.prefix] = (vocabulary, ft.tfidf(corpus, vocabulary, family, keep=("key", "lang", "split")))
    return corpus, out


def _totals(vocabulary, weights):
    totals = weights.groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.sum("weight"), 6).alias("total_weight")
    )
    return totals.join(vocabulary, "term").select("term", "df", F.round("idf", 6).alias("idf"), "documents", "total_weight")


@query(
    "training_join",
    _CORPUS
    + """
SELECT key AS image_name, length(text) AS n_chars, quality, split
FROM corpus JOIN labels ON 'img_' || labels.doc_id || '.jpg' = key
WHERE text IS NOT NULL AND quality IS NOT NULL""",
)
def training_join(spark, sf):
    texts = fx.descriptions(spark, sf).select("image_name", F.col("description").alias("text"))
    labels = fx.table(spark, sf, "labels").select(
        F.concat(F.lit("img_"), "doc_id", F.lit(".jpg")).alias("image_name"), "quality"
    )
    split = training_set(spark, sf).select(F.col("key").alias("image_name"), "split")
    joined = ft.training_join(texts, labels, split, "quality")
    return joined.select("image_name", F.length("text").cast("bigint").alias("n_chars"), "quality", "split")


@query("tfidf_word", _CORPUS + _W + "\nSELECT key, split, term, round(weight, 6) AS weight FROM w_w")
def tfidf_word(spark, sf):
    _, parts = vectorised(spark, sf, ft.WORDS)
    return parts["w:"][1].select("key", "split", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_char", _CORPUS + _C + _TOTALS.format(p="c"))
def tfidf_char(spark, sf):
    _, parts = vectorised(spark, sf, ft.CHARS)
    return _totals(*parts["c:"])


@query("fold_accents", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def fold(spark, sf):
    return fx.descriptions(spark, sf).select("doc_id", fold_accents(F.lower("description"), full=True).alias("folded"))


@query(
    "max_features",
    _CORPUS + words_sql() + tfidf_sql("w", 20, 0.9, ft.LIMITED_WORDS.max_features) + _TOTALS.format(p="w"),
)
def max_features(spark, sf):
    _, parts = vectorised(spark, sf, ft.LIMITED_WORDS)
    return _totals(*parts["w:"])


_STACK = """,
stacked AS (SELECT key, lang, split, 'w:' || term AS term, weight FROM w_w
  UNION ALL SELECT key, lang, split, 'c:' || term, weight FROM c_w)"""


def stacked(spark, sf):
    corpus, parts = vectorised(spark, sf, ft.WORDS, ft.CHARS)
    return corpus, ft.stack_features({p: w for p, (_, w) in parts.items()})


@query(
    "stack_features",
    _CORPUS
    + _W
    + _C
    + _STACK
    + """
SELECT key, split, count(*) AS features, round(sum(weight), 6) AS total_weight, round(sum(weight * weight), 6) AS square_sum
FROM stacked GROUP BY key, split""",
)
def stack_features(spark, sf):
    _, rows = stacked(spark, sf)
    return rows.groupBy("key", "split").agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.sum("weight"), 6).alias("total_weight"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("square_sum"),
    )


PROJECTION = """,
size AS (SELECT sqrt(CAST(count(*) AS DOUBLE)) AS root FROM w_vocab),
cells AS (SELECT term, c AS component, CAST(('0x' || substr(md5('42|' || term || '|' || c), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM w_vocab, (SELECT unnest(range(256)) AS c)),
matrix AS (SELECT term, component, CASE WHEN u < CAST(0.5 AS DOUBLE) / root THEN -1 ELSE 1 END * sqrt(root / 256) AS r
  FROM cells, size WHERE u < CAST(1 AS DOUBLE) / root)"""


@query(
    "sparse_projection",
    _CORPUS
    + _W
    + PROJECTION
    + """
SELECT key, CAST(component AS INTEGER) AS component, round(sum(weight * r), 6) + 0 AS value
FROM w_w JOIN matrix ON matrix.term = w_w.term GROUP BY ALL""",
)
def sparse_projection(spark, sf):
    _, parts = vectorised(spark, sf, ft.WORDS)
    vocabulary, weights = parts["w:"]
    projected = ft.sparse_projection(weights, vocabulary)
    return projected.select("key", "component", (F.round("value", 6) + 0.0).alias("value"))


_CHI2 = """,
train_rows AS (SELECT * FROM stacked WHERE split = 'train'),
class_share AS (SELECT lang, count(*) / (SELECT CAST(n AS DOUBLE) FROM trained) AS share FROM corpus WHERE split = 'train' GROUP BY lang),
total AS (SELECT term, sum(weight) AS f FROM train_rows GROUP BY term),
observed AS (SELECT term, lang, sum(weight) AS o FROM train_rows GROUP BY term, lang),
scores AS (SELECT total.term, sum(power(coalesce(o, 0) - share * f, 2) / (share * f)) AS chi2
  FROM total CROSS JOIN class_share LEFT JOIN observed ON observed.term = total.term AND observed.lang = class_share.lang
  GROUP BY total.term)"""


def chi2(spark, sf):
    corpus, rows = stacked(spark, sf)
    train = F.col("split") == "train"
    classes = corpus.where(train).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return rows, ft.chi2_scores(rows.where(train), classes, "lang")


@query("chi2_scores", _CORPUS + _W + _C + _STACK + _CHI2 + "\nSELECT term, round(chi2, 6) AS chi2 FROM scores")
def chi2_scores(spark, sf):
    return chi2(spark, sf)[1].select("term", F.round("chi2", 6).alias("chi2"))


@query(
    "select_k_best",
    _CORPUS
    + _W
    + _C
    + _STACK
    + _CHI2
    + """,
best AS (SELECT term FROM scores ORDER BY round(chi2, 6) DESC, term LIMIT 2000)
SELECT key, split, count(*) AS features, round(sum(weight), 6) AS total_weight
FROM stacked WHERE term IN (SELECT term FROM best) GROUP BY key, split""",
)
def select_k_best(spark, sf):
    rows, scores = chi2(spark, sf)
    selected = materialize(ft.select_k_best(scores), "selected")
    return ft.keep_selected(rows, selected).groupBy("key", "split").agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("weight"), 6).alias("total_weight")
    )


@query(
    "label_index",
    """WITH classes AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS label FROM part)
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS index FROM classes""",
)
def label_index(spark, sf):
    return ft.label_index(fx.table(spark, sf, "part").select(F.col("p_size").alias("label")), "label")


@query(
    "class_weights",
    """SELECT lang, count(*) AS n, round(CAST((SELECT count(*) FROM documents) AS DOUBLE)
  / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang""",
)
def class_weights(spark, sf):
    return ft.class_weights(fx.descriptions(spark, sf), "lang").withColumn("weight", F.round("weight", 6))
