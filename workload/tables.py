"""Queries for label collation, splits and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryloom.operators import collate, evaluate, splits
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


# ---------------------------------------------------------------- collation


@query(
    "invert_mapping",
    """WITH claims AS (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS major, p_size AS small FROM part)
SELECT small, min(major) AS major, string_agg(major, ',' ORDER BY major) AS claimants,
       count(*) > 1 AS duplicate FROM claims GROUP BY small""",
)
def invert_mapping(spark, sf):
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    mapping = (
        fx.table(spark, sf, "part")
        .groupBy(brand.alias("major"))
        .agg(F.collect_set("p_size").alias("smalls"))
        .withColumn("major_order", F.col("major"))
    )
    inverted = collate.invert_mapping(mapping)
    return inverted.select(
        "small", "major", F.array_join("claimants", ",").alias("claimants"), (F.size("claimants") > 1).alias("duplicate")
    )


_LINES = """WITH lines AS (SELECT o_custkey AS doc, o_orderkey AS line_no, CASE
    WHEN o_orderkey % 5 < 2 THEN (o_orderkey % 12 + 1) || '. ' || o_orderpriority
    WHEN o_orderkey % 5 < 4 THEN (o_orderkey % 108) || ', ' || (o_custkey % 108)
    ELSE o_orderstatus END AS text FROM orders),
marked AS (SELECT *, CAST(nullif(regexp_extract(text, '^(\\d+)\\.\\s', 1), '') AS INTEGER) AS heading FROM lines),
carried AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no) AS in_table,
    lag(heading) OVER (PARTITION BY doc ORDER BY line_no) AS in_paragraph FROM marked),
lists AS (SELECT 'table' AS mode, doc, in_table AS major, text FROM carried WHERE heading IS NULL
  UNION ALL SELECT 'paragraph', doc, in_paragraph, text FROM carried WHERE heading IS NULL),
ids AS (SELECT DISTINCT mode, doc, major, CAST(unnest(regexp_extract_all(text, '\\d+')) AS INTEGER) AS small FROM lists
  WHERE major IS NOT NULL AND regexp_matches(text, '^\\d+(\\s*,\\s*\\d+)*$'))
SELECT mode, doc, major, string_agg(small, ',' ORDER BY small) AS smalls FROM ids GROUP BY mode, doc, major"""


@query("parse_mapping_lines", _LINES)
def parse_mapping_lines(spark, sf):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 5 < 2, F.concat((key % 12 + 1).cast("string"), F.lit(". "), "o_orderpriority"))
        .when(key % 5 < 4, F.concat((key % 108).cast("string"), F.lit(", "), (F.col("o_custkey") % 108).cast("string")))
        .otherwise(F.col("o_orderstatus"))
    )
    lines = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), key.alias("line_no"), text.alias("text"))

    def run(mode):
        parsed = collate.mapping_from_lines(collate.parse_mapping_lines(lines, ["doc"], mode), ["doc"])
        return parsed.select(F.lit(mode).alias("mode"), "doc", "major", F.array_join("smalls", ",").alias("smalls"))

    return run("table").unionByName(run("paragraph"))


def raw_topics(spark, sf):
    """embeddings as images with a raw topic written in the forms that occur."""
    number = (F.col("label") + 10 * F.pmod("vec_id", F.lit(11))).cast("string")
    form = F.pmod("vec_id", F.lit(3))
    return fx.table(spark, sf, "embeddings").select(
        F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("image_name"),
        F.when(form == 0, F.concat(F.lit("topic_"), number)).when(form == 1, number).alias("raw"),
    )


_RAW = """WITH raw AS (SELECT 'img_' || vec_id AS image_name, CASE vec_id % 3
    WHEN 0 THEN 'topic_' || (label + 10 * (vec_id % 11)) WHEN 1 THEN CAST(label + 10 * (vec_id % 11) AS VARCHAR) END AS raw,
    CASE WHEN vec_id % 3 < 2 THEN CAST(label + 10 * (vec_id % 11) AS INTEGER) END AS topic_raw FROM embeddings)"""
_MAP = (
    ", map(small, major) AS (VALUES "
    + ", ".join(f"({s}, {m})" for m, smalls in collate.DEFAULT_MAJORS.items() for s in smalls)
    + """),
labelled AS (SELECT image_name, topic_raw, CAST(coalesce(major, -1) AS INTEGER) AS new_topic_num
  FROM raw LEFT JOIN map ON small = topic_raw)
"""
)


def _labelled(spark, sf):
    labels = raw_topics(spark, sf).select("image_name", collate.parse_topic_id("raw").alias("topic_raw"))
    return collate.map_major_topic(labels, collate.invert_mapping(collate.mapping_table(spark)))


@query("parse_topic_id", _RAW + " SELECT image_name, raw, topic_raw FROM raw")
def parse_topic_id(spark, sf):
    return raw_topics(spark, sf).withColumn("topic_raw", collate.parse_topic_id("raw"))


@query("map_major_topic", _RAW + _MAP + "SELECT image_name, topic_raw, new_topic_num FROM labelled")
def map_major_topic(spark, sf):
    return _labelled(spark, sf).select("image_name", "topic_raw", "new_topic_num")


@query(
    "unmapped_topics",
    _RAW + _MAP + "SELECT DISTINCT topic_raw FROM labelled WHERE new_topic_num = -1 AND topic_raw IS NOT NULL",
)
def unmapped_topics(spark, sf):
    return collate.unmapped_topics(_labelled(spark, sf))


@query("drop_unmapped", _RAW + _MAP + "SELECT * FROM labelled WHERE new_topic_num <> -1")
def drop_unmapped(spark, sf):
    return collate.drop_unmapped(_labelled(spark, sf)).select("image_name", "topic_raw", "new_topic_num")


TOPICS = 64  # the components of an embedding


def topic_proportions(spark, sf):
    """embeddings as topic proportions: softmax of all components."""
    raised = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    staged = fx.table(spark, sf, "embeddings").select("vec_id", "label", raised.alias("x"))
    summed = staged.withColumn("total", F.aggregate("x", F.lit(0.0), lambda s, x: s + x))
    shares = summed.select("vec_id", F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("image_name"), "label", F.transform("x", lambda x: x / F.col("total")).alias("p"))
    return shares.select("*", *[F.get("p", i).alias(f"topic_{i}") for i in range(TOPICS)])


PROBS_SQL = (
    "WITH raised AS (SELECT vec_id, label, "
    + ", ".join(f"exp(CAST(embedding[{i + 1}] AS DOUBLE)) AS x{i}" for i in range(TOPICS))
    + " FROM embeddings), summed AS (SELECT *, "
    + " + ".join(f"x{i}" for i in range(TOPICS))
    + " AS total FROM raised), probs AS (SELECT vec_id, 'img_' || vec_id AS image_name, label, "
    + ", ".join(f"x{i} / total AS topic_{i}" for i in range(TOPICS))
    + " FROM summed)"
)
_BEST = "greatest(" + ", ".join(f"topic_{i}" for i in range(TOPICS)) + ")"
ARGMAX_SQL = "CASE " + " ".join(f"WHEN topic_{i} = {_BEST} THEN {i}" for i in range(TOPICS)) + " END"


@query(
    "dominant_prob",
    PROBS_SQL
    + _MAP.replace("FROM raw", "FROM picked").replace(
        "labelled AS",
        f"picked AS (SELECT image_name, {ARGMAX_SQL} AS topic_raw, {_BEST} AS p FROM probs),\nlabelled AS",
    )
    + """SELECT l.image_name, l.topic_raw, l.topic_raw AS dominant_topic, round(p, 6) AS dominant_prob, new_topic_num
FROM labelled l JOIN picked ON picked.image_name = l.image_name""",
)
def dominant_prob(spark, sf):
    proportions = topic_proportions(spark, sf).drop("vec_id", "label", "p")
    labels = collate.collate_labels(proportions, collate.invert_mapping(collate.mapping_table(spark)))
    return labels.withColumn("dominant_prob", F.round("dominant_prob", 6))


@query(
    "dedupe_keep_first",
    """WITH ranked AS (SELECT 'order_' || l_orderkey AS image_name, CAST(l_suppkey % 12 AS INTEGER) AS new_topic_num,
  count(*) OVER (PARTITION BY l_orderkey) AS copies,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT image_name, new_topic_num, copies FROM ranked WHERE rn = 1""",
)
def dedupe_keep_first(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("image_name"),
        (F.col("l_suppkey") % 12).cast("int").alias("new_topic_num"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )
    first = collate.dedupe_keep_first(rows, ["image_name"], ["l_linenumber", "l_partkey", "l_suppkey"], "copies")
    return first.select("image_name", "new_topic_num", "copies")


# ---------------------------------------------------------------- splits

_RANKED = """WITH docs AS (SELECT 'img_' || doc_id || '.jpg' AS image_name, lang FROM documents),
hashed AS (SELECT *, md5('42|' || image_name) || '|' || image_name AS h FROM docs),
sizes AS (SELECT count(*) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_held FROM docs),
cuts AS (SELECT *, CAST(ceil(CAST(20 AS DOUBLE) / 36 * n_held) AS BIGINT) AS n_test FROM sizes),
ranked AS (SELECT *, row_number() OVER (ORDER BY h) AS rk, row_number() OVER (PARTITION BY lang ORDER BY h) AS class_rk FROM hashed),
per_class AS (SELECT lang, count(*) AS c, CAST((SELECT n_held FROM sizes) * count(*) AS DOUBLE) / (SELECT n FROM sizes) AS share
  FROM docs GROUP BY lang),
based AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) AS place FROM per_class),
quotas AS (SELECT lang, base + CASE WHEN place <= (SELECT n_held FROM sizes) - (SELECT sum(base) FROM based) THEN 1 ELSE 0 END AS quota FROM based),
strat AS (SELECT image_name, ranked.lang, CASE WHEN class_rk <= quota THEN 'test' ELSE 'train' END AS split
  FROM ranked JOIN quotas ON quotas.lang = ranked.lang),
rnd AS (SELECT image_name, lang, CASE WHEN rk <= (SELECT n_held FROM sizes) THEN 'test' ELSE 'train' END AS split FROM ranked),
three AS (SELECT image_name, lang, CASE WHEN rk <= (SELECT n_test FROM cuts) THEN 'test'
   WHEN rk <= (SELECT n_held FROM cuts) THEN 'val' ELSE 'train' END AS split FROM ranked)
"""


def labelled_images(spark, sf):
    return fx.descriptions(spark, sf).select("image_name", "lang")


@query(
    "class_counts",
    _RANKED
    + """SELECT split, lang, count(*) AS n FROM strat GROUP BY split, lang
UNION ALL SELECT NULL, lang, count(*) FROM strat GROUP BY lang""",
)
def class_counts(spark, sf):
    split = splits.stratified_split(labelled_images(spark, sf), "image_name", "lang")
    return collate.class_counts(split, "split", "lang")


@query("stratified_split", _RANKED + "SELECT image_name, lang, split FROM strat")
def stratified_split(spark, sf):
    return splits.train_test_split(labelled_images(spark, sf), "image_name", "lang").select("image_name", "lang", "split")


@query("random_split", _RANKED + "SELECT image_name, lang, split FROM rnd")
def random_split(spark, sf):
    return splits.random_split(labelled_images(spark, sf), "image_name")


@query("three_way_split", _RANKED + "SELECT image_name, lang, split FROM three")
def three_way_split(spark, sf):
    return splits.three_way_split(labelled_images(spark, sf), "image_name")


@query("split_table", _RANKED + "SELECT image_name, split FROM strat")
def split_table(spark, sf):
    return splits.split_table(splits.stratified_split(labelled_images(spark, sf), "image_name", "lang"))


@query(
    "split_shares",
    _RANKED
    + """SELECT split, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / (SELECT n FROM sizes), 6) AS percent
FROM three GROUP BY split""",
)
def split_shares(spark, sf):
    shares = splits.split_shares(splits.three_way_split(labelled_images(spark, sf), "image_name"))
    return shares.withColumn("percent", F.round("percent", 6))


# ---------------------------------------------------------------- evaluation

_PRED = """WITH preds AS (SELECT doc_id, lang AS "true",
    CASE WHEN doc_id % 5 = 0 THEN ['en', 'fr', 'xx', 'es'][doc_id % 4 + 1] ELSE lang END AS pred FROM documents),
classes AS (SELECT "true" AS label FROM preds UNION SELECT pred FROM preds),
per_class AS (SELECT label, (SELECT count(*) FROM preds WHERE "true" = label) AS support,
    (SELECT count(*) FROM preds WHERE pred = label) AS predicted,
    (SELECT count(*) FROM preds WHERE pred = label AND "true" = label) AS hits FROM classes),
prf AS (SELECT label, coalesce(hits / nullif(predicted, 0), 0) AS "precision", coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1, support FROM per_class),
overall AS (SELECT avg(CASE WHEN "true" = pred THEN 1 ELSE 0 END) AS accuracy, count(*) AS "rows" FROM preds),
macro AS (SELECT avg("precision") AS "precision", avg(recall) AS recall, avg(f1) AS f1 FROM prf),
weighted AS (SELECT sum("precision" * support) / sum(support) AS "precision", sum(recall * support) / sum(support) AS recall,
    sum(f1 * support) / sum(support) AS f1 FROM prf)
"""
_ROUNDED = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1'


def _counts(spark, sf):
    key = F.col("doc_id")
    other = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "xx", "es")]), (key % 4).cast("int"))
    preds = fx.table(spark, sf, "documents").select(
        F.col("lang").alias("true"), F.when(key % 5 == 0, other).otherwise(F.col("lang")).alias("pred")
    )
    return preds, evaluate.confusion_counts(preds)


def _round(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("accuracy", _PRED + 'SELECT round(accuracy, 6) AS accuracy, "rows" FROM overall')
def accuracy(spark, sf):
    return _round(evaluate.accuracy(_counts(spark, sf)[1]), "accuracy")


@query("prf_per_class", _PRED + f"SELECT label, {_ROUNDED}, support FROM prf")
def prf_per_class(spark, sf):
    return _round(evaluate.prf_per_class(_counts(spark, sf)[1]), *evaluate.METRICS)


@query("prf_macro", _PRED + f"SELECT {_ROUNDED} FROM macro")
def prf_macro(spark, sf):
    return _round(evaluate.prf_macro(evaluate.prf_per_class(_counts(spark, sf)[1])), *evaluate.METRICS)


@query("prf_weighted", _PRED + f"SELECT {_ROUNDED} FROM weighted")
def prf_weighted(spark, sf):
    return _round(evaluate.prf_weighted(evaluate.prf_per_class(_counts(spark, sf)[1])), *evaluate.METRICS)


@query(
    "confusion_matrix",
    _PRED
    + """SELECT a.label AS "true", b.label AS pred, count(preds.doc_id) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN preds ON preds."true" = a.label AND preds.pred = b.label GROUP BY a.label, b.label""",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_counts(spark, sf)[1])


def _unpivot(source, scope, label, metrics):
    return " UNION ALL ".join(
        f"""SELECT '{scope}' AS scope, {label} AS label, '{m}' AS metric, round(CAST("{m}" AS DOUBLE), 4) AS value FROM {source}"""
        for m in metrics
    )


@query(
    "evaluation_report",
    _PRED
    + " UNION ALL ".join(
        [
            _unpivot("overall", "overall", "''", ["accuracy"]),
            _unpivot("macro", "macro", "''", evaluate.METRICS),
            _unpivot("weighted", "weighted", "''", evaluate.METRICS),
            _unpivot("prf", "class", "label", (*evaluate.METRICS, "support")),
        ]
    ),
)
def evaluation_report(spark, sf):
    return evaluate.evaluation_report(_counts(spark, sf)[0])
