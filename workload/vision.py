"""Queries for annotation normalisation, label analytics and colour tones."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryloom.functions.color import HUE_ENDS, TONES
from galleryloom.operators import colors, labels, vision
from galleryloom.plans.vision_report import vision_report
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


def r6(col):
    return F.round(col, 6)


# ---------------------------------------------------------------- label documents

_ITEMS = """
WITH lines AS (
  SELECT l_orderkey AS k, l_orderkey % 11 AS shape, l_orderkey % 12 + 1 AS topic, p_name AS label,
         CASE WHEN l_orderkey % 11 NOT IN (2, 4) THEN l_discount * CAST(10 AS DOUBLE) END AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey),
items AS (
  SELECT CASE WHEN shape <> 3 THEN 'order_' || k END AS image_name, topic, label, score
  FROM lines WHERE shape NOT IN (0, 2, 5)),
"""

_FREQ = """
  count(*) AS "count", count(DISTINCT coalesce(image_name, '∅')) AS image_count,
  round(sum(coalesce(score, 0)) / count(*), 8) AS avg_score,
  round(CASE WHEN count(score) > 0 THEN greatest(max(score), 0) END, 8) AS max_score
"""


@query("extract_labels", _ITEMS.rstrip().rstrip(",") + "\nSELECT image_name, label, round(score, 6) AS score FROM items")
def extract_labels(spark, sf):
    return labels.extract_labels(fx.vision_docs(spark, sf)).withColumn("score", r6("score"))


def _frequency(spark, sf, keys=()):
    return labels.label_frequency(labels.extract_labels(fx.vision_docs(spark, sf), keys=keys), keys=keys)


def _rounded(df, *cols):
    """Means of doubles to 8 digits; ratios of whole numbers are exact in both engines and stay."""
    for c in cols:
        df = df.withColumn(c, F.round(c, 8))
    return df


@query("label_frequency", _ITEMS.rstrip().rstrip(",") + f"\nSELECT label, {_FREQ} FROM items GROUP BY label")
def label_frequency(spark, sf):
    return _rounded(_frequency(spark, sf), "avg_score", "max_score").orderBy(F.desc("count"), "label")


@query(
    "label_topk",
    _ITEMS.rstrip().rstrip(",")
    + f"\nSELECT label, {_FREQ} FROM items GROUP BY label ORDER BY count(*) DESC, label LIMIT 20",
)
def label_topk(spark, sf):
    return _rounded(labels.most_frequent(_frequency(spark, sf), 20), "avg_score", "max_score")


@query(
    "label_cloud_weights",
    _ITEMS
    + """freq AS (SELECT label, count(*) AS n FROM items GROUP BY label)
SELECT label, n AS "count", n / (SELECT max(n) FROM freq) AS weight
FROM freq ORDER BY n DESC, label LIMIT 100""",
)
def label_cloud_weights(spark, sf):
    return labels.cloud_weights(_frequency(spark, sf))


_SETS = """
WITH lines AS (
  SELECT l_orderkey AS k, l_orderkey % 11 AS shape, l_orderkey % 12 + 1 AS topic, p_name AS label,
         CASE WHEN l_orderkey % 11 NOT IN (2, 4) THEN l_discount * CAST(10 AS DOUBLE) ELSE 1 END AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sets AS (
  SELECT DISTINCT k, topic, label FROM lines WHERE shape NOT IN (0, 1, 5) AND score >= {threshold}),
counts AS (SELECT label, count(*) AS images FROM sets GROUP BY label),
"""
_SETS0 = _SETS.format(threshold="0")
_PAIRS = """
pairs AS (
  SELECT a.label AS label_a, b.label AS label_b, count(*) AS co_occurrence
  FROM sets a JOIN sets b ON a.k = b.k AND a.label < b.label GROUP BY a.label, b.label),
"""
_STATS = """
stats AS (
  SELECT label_a, label_b, co_occurrence, co_occurrence / a.images AS p_b_given_a,
         co_occurrence / b.images AS p_a_given_b
  FROM pairs JOIN counts a ON a.label = label_a JOIN counts b ON b.label = label_b)
"""


def _sets(spark, sf, threshold=0.0):
    return labels.label_sets(fx.vision_docs(spark, sf), threshold=threshold, keep=("doc_key", "topic"))


@query(
    "label_sets",
    _SETS.format(threshold="CAST(0.3 AS DOUBLE)").rstrip().rstrip(",")
    + "\nSELECT k AS doc_key, string_agg(label, '|' ORDER BY label) AS labels FROM sets GROUP BY k",
)
def label_sets(spark, sf):
    sets = _sets(spark, sf, 0.3).where(F.size("labels") > 0)
    return sets.select("doc_key", F.array_join("labels", "|").alias("labels"))


@query("label_image_counts", _SETS0.rstrip().rstrip(",") + "\nSELECT label, images FROM counts")
def label_image_counts(spark, sf):
    return labels.label_image_counts(_sets(spark, sf))


@query("label_pairs", _SETS0 + _PAIRS.rstrip().rstrip(",") + "\nSELECT label_a, label_b, co_occurrence FROM pairs")
def label_pairs(spark, sf):
    return labels.label_pairs(_sets(spark, sf))


_MIN_IMAGES = 630


@query(
    "min_support_filter",
    _SETS0.replace("sets AS (", "all_sets AS (").replace("FROM sets GROUP", "FROM all_sets GROUP")
    + f"sets AS (SELECT * FROM all_sets WHERE label IN (SELECT label FROM counts WHERE images >= {_MIN_IMAGES})),"
    + _PAIRS.rstrip().rstrip(",")
    + "\nSELECT label_a, label_b, co_occurrence FROM pairs",
)
def min_support_filter(spark, sf):
    return labels.label_pairs(labels.with_min_support(_sets(spark, sf), "doc_key", _MIN_IMAGES))


def _stats(spark, sf):
    sets = _sets(spark, sf)
    return labels.pair_stats(labels.label_pairs(sets), labels.label_image_counts(sets))


@query("pair_stats", _SETS0 + _PAIRS + _STATS + "SELECT * FROM stats")
def pair_stats(spark, sf):
    return _stats(spark, sf).orderBy(F.desc("co_occurrence"), "label_a", "label_b")


@query(
    "pair_topk",
    _SETS0 + _PAIRS + _STATS + "SELECT * FROM stats ORDER BY co_occurrence DESC, label_a, label_b LIMIT 30",
)
def pair_topk(spark, sf):
    return labels.top_pairs(_stats(spark, sf), 30)


@query(
    "cooccurrence_matrix",
    _SETS0
    + _PAIRS.rstrip().rstrip(",")
    + """,
cells AS (SELECT label_a AS row_label, label_b AS col_label, co_occurrence AS images FROM pairs
UNION ALL SELECT label_b, label_a, co_occurrence FROM pairs
UNION ALL SELECT label, label, images FROM counts)
SELECT a.label AS row_label, b.label AS col_label, coalesce(cells.images, 0) AS images
FROM counts a CROSS JOIN counts b LEFT JOIN cells ON row_label = a.label AND col_label = b.label""",
)
def cooccurrence_matrix(spark, sf):
    """The zero-filled matrix in long form."""
    sets = materialize(_sets(spark, sf), "sets")
    return labels.cooccurrence_filled(labels.label_pairs(sets), labels.label_image_counts(sets))


# ---------------------------------------------------------------- colours

_RGB = """
WITH rgb AS (
  SELECT p_partkey AS doc_key, CAST(p_partkey % 12 + 1 AS INTEGER) AS topic, CAST((p_partkey * 37) % 256 AS INTEGER) AS red,
         CAST((p_partkey * 91) % 256 AS INTEGER) AS green, CAST((p_size * 5) % 256 AS INTEGER) AS blue
  FROM part WHERE p_partkey % 17 <> 0),
"""
_TONE = (
    """
unit AS (SELECT *, CAST(red AS DOUBLE) / 255 AS r, CAST(green AS DOUBLE) / 255 AS g, CAST(blue AS DOUBLE) / 255 AS b FROM rgb),
span AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM unit),
gaps AS (SELECT *, (hi - r) / nullif(hi - lo, 0) AS rc, (hi - g) / nullif(hi - lo, 0) AS gc,
                (hi - b) / nullif(hi - lo, 0) AS bc FROM span),
sixths AS (SELECT *, (CASE WHEN r = hi THEN bc - gc WHEN g = hi THEN 2 + rc - bc ELSE 4 + gc - rc END)
                  / CAST(6 AS DOUBLE) AS h6 FROM gaps),
hsv AS (SELECT *, (h6 - floor(h6)) * 360 AS hue, CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END AS sat FROM sixths),
tones AS (SELECT doc_key, topic, red, green, blue, CASE
    WHEN hi < CAST(0.15 AS DOUBLE) THEN 'Black'
    WHEN sat < CAST(0.12 AS DOUBLE) AND hi > CAST(0.85 AS DOUBLE) THEN 'White'
    WHEN sat < CAST(0.12 AS DOUBLE) THEN 'Gray'
"""
    + "\n".join(f"    WHEN hue < {end} THEN '{tone}'" for tone, end in HUE_ENDS)
    + "\n    ELSE 'Red' END AS tone FROM hsv)\n"
)


def _colors(spark, sf):
    return colors.top_colors(fx.color_docs(spark, sf), keep=("doc_key", "topic"))


@query("top_color", _RGB.rstrip().rstrip(",") + "\nSELECT doc_key, red, green, blue FROM rgb")
def top_color(spark, sf):
    return _colors(spark, sf).drop("topic")


@query("color_tone", _RGB + _TONE + "SELECT doc_key, red, green, blue, tone FROM tones")
def color_tone(spark, sf):
    return colors.with_tone(_colors(spark, sf)).drop("topic")


_DIST = """SELECT tone, count(*) AS "count", count(*) / (SELECT count(*) FROM tones) AS fraction
FROM tones GROUP BY tone"""


def _tones(spark, sf, keys=()):
    return colors.tone_distribution(colors.with_tone(_colors(spark, sf)), keys)


@query("tone_distribution", _RGB + _TONE + _DIST)
def tone_distribution(spark, sf):
    return _tones(spark, sf).orderBy(F.desc("count"), "tone")


_TONE_NAMES = {t: f"{t} tones" for t in TONES if t != "Pink"}


@query(
    "tone_labels",
    _RGB
    + _TONE
    + ", dist AS ("
    + _DIST
    + """)
SELECT tone, "count", fraction, CASE WHEN tone = 'Pink' THEN tone ELSE tone || ' tones' END AS display_name,
       CASE tone WHEN 'Black' THEN '#0d0d0d' WHEN 'White' THEN '#fafafa' WHEN 'Gray' THEN '#999999'
         WHEN 'Red' THEN '#e63333' WHEN 'Orange' THEN '#f2801a' WHEN 'Yellow' THEN '#f7e633'
         WHEN 'Green' THEN '#33b24c' WHEN 'Cyan' THEN '#1ab2cc' WHEN 'Blue' THEN '#334ce6'
         WHEN 'Purple' THEN '#994ccc' WHEN 'Pink' THEN '#f299cc' END AS plot_color
FROM dist""",
)
def tone_labels(spark, sf):
    return colors.with_tone_labels(_tones(spark, sf), _TONE_NAMES)


@query(
    "per_topic_analytics",
    _ITEMS
    + f"""
freq AS (SELECT topic, label, {_FREQ} FROM items GROUP BY topic, label),
sets AS (SELECT DISTINCT k, topic, label FROM lines
         WHERE shape NOT IN (0, 1, 5) AND (shape IN (2, 4) OR score >= 0)),
counts AS (SELECT topic, label, count(*) AS images FROM sets GROUP BY topic, label),
pairs AS (SELECT a.topic, a.label AS label_a, b.label AS label_b, count(*) AS n
          FROM sets a JOIN sets b ON a.k = b.k AND a.label < b.label GROUP BY a.topic, a.label, b.label),
"""
    + _RGB.replace("WITH", "", 1)
    + _TONE
    + """
SELECT topic, 'label' AS kind, label AS name, '' AS other, "count" AS n, avg_score AS value FROM freq
UNION ALL
SELECT pairs.topic, 'pair', label_a, label_b, n, n / images
FROM pairs JOIN counts ON counts.topic = pairs.topic AND counts.label = label_a
UNION ALL
SELECT topic, 'tone', tone, '', count(*), count(*) / sum(count(*)) OVER (PARTITION BY topic)
FROM tones GROUP BY topic, tone""",
)
def per_topic_analytics(spark, sf):
    docs = fx.vision_docs(spark, sf).unionByName(fx.color_docs(spark, sf))
    report = vision_report(docs, "doc_key", ("topic",))
    freq, stats, tones = report["labels"], report["pairs"], report["tones"]

    def shaped(df, kind, name, other, n, value):
        return df.select(
            F.col("topic").cast("bigint").alias("topic"), F.lit(kind).alias("kind"), name.alias("name"),
            other.alias("other"), n.alias("n"), value.alias("value"),
        )

    return (
        shaped(freq, "label", F.col("label"), F.lit(""), F.col("count"), F.round("avg_score", 8))
        .unionByName(
            shaped(stats, "pair", F.col("label_a"), F.col("label_b"), F.col("co_occurrence"), F.col("p_b_given_a"))
        )
        .unionByName(shaped(tones, "tone", F.col("tone"), F.lit(""), F.col("count"), F.col("fraction")))
    )


# ---------------------------------------------------------------- response sections

def _point(x, y, x_name="x", y_name="y"):
    return F.struct(x.alias(x_name), y.alias(y_name))


def _poly(*points, name="vertices"):
    return F.struct(F.array(*points).alias(name))


_PRESENT = "l_orderkey % 7 <> 0"
_NAME = "'order_' || l_orderkey AS image_name"


def _exploded(spark, sf, section, response_key, item, with_part=False):
    docs = fx.line_responses(spark, sf, response_key, item, with_part)
    normalized = vision.normalize_annotations(docs, [section])
    return vision.section_items(normalized, section)


@query(
    "vision_text",
    f"""SELECT {_NAME}, l_returnflag || l_linenumber AS description, CAST(2 AS INTEGER) AS vertices,
       l_linenumber AS x1, CAST(l_suppkey AS INTEGER) AS y1,
       round(CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE 0 END, 6) AS score
FROM lineitem WHERE {_PRESENT}""",
)
def vision_text(spark, sf):
    line = F.col("l_linenumber")
    item = F.struct(
        F.concat("l_returnflag", line.cast("string")).alias("description"),
        _poly(_point(line, F.col("l_suppkey")), _point(F.lit(0), F.lit(0))).alias("bounding_poly"),
        F.when(line % 2 == 0, F.col("l_tax")).alias("score"),
    )
    rows = _exploded(spark, sf, "text_annotations", "text_annotations", item)
    return rows.select(
        "image_name",
        "e.description",
        F.size("e.bounding_poly.vertices").alias("vertices"),
        F.col("e.bounding_poly.vertices")[0]["x"].alias("x1"),
        F.col("e.bounding_poly.vertices")[0]["y"].alias("y1"),
        r6("e.score").alias("score"),
    )


@query(
    "vision_document",
    f"""SELECT {_NAME}, count(*) AS pages, CAST(sum(l_linenumber % 2 + 1) AS BIGINT) AS blocks,
       CAST(sum((l_linenumber % 2 + 1) * len(string_split(p_name, ' '))) AS BIGINT) AS words,
       CAST(sum((l_linenumber % 2 + 1) * length(replace(p_name, ' ', ''))) AS BIGINT) AS symbols,
       round(avg(l_discount), 6) AS confidence, max('TABLE') AS block_type
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_PRESENT} GROUP BY l_orderkey""",
)
def vision_document(spark, sf):
    def text_node(*more):
        return F.struct(
            F.struct(F.array(F.struct(F.lit("en").alias("language_code"))).alias("detected_languages")).alias("property"),
            F.col("l_discount").alias("confidence"),
            *more,
        )

    symbols = lambda w: F.transform(F.split(w, ""), lambda s: F.struct(s.alias("text")))
    words = F.transform(F.split("p_name", " "), lambda w: text_node(symbols(w).alias("symbols")))
    block = text_node(F.lit(2).alias("block_type"), F.array(text_node(words.alias("words"))).alias("paragraphs"))
    blocks = F.array_repeat(block, (F.col("l_linenumber") % 2 + 1).cast("int"))
    page = F.struct(F.col("l_linenumber").alias("width"), F.col("l_suppkey").alias("height"), blocks.alias("blocks"))
    docs = fx.line_responses(spark, sf, "full_text_annotation.pages", page, with_part=True)
    normalized = vision.normalize_annotations(docs, ["document_text_annotation"])
    words = vision.document_words(normalized)
    per_page = words.groupBy("image_name", "page_no").agg(
        F.count_distinct("block_no").alias("blocks"),
        F.count(F.lit(1)).alias("words"),
        F.sum("symbols").alias("symbols"),
        F.max("confidence").alias("confidence"),
        F.max("block_type").alias("block_type"),
    )
    return per_page.groupBy("image_name").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("blocks").alias("blocks"),
        F.sum("words").alias("words"),
        F.sum("symbols").alias("symbols"),
        r6(F.avg("confidence")).alias("confidence"),
        F.max("block_type").alias("block_type"),
    )


@query(
    "vision_landmarks",
    f"""SELECT {_NAME}, l_returnflag AS description, round(l_tax, 6) AS score, round(l_quantity, 6) AS latitude,
       round(-l_discount, 6) + 0 AS longitude, CAST(1 AS INTEGER) AS locations, l_linenumber AS x1
FROM lineitem WHERE {_PRESENT}""",
)
def vision_landmarks(spark, sf):
    place = F.struct(
        F.struct(F.col("l_quantity").alias("latitude"), (F.lit(0.0) - F.col("l_discount")).alias("longitude")).alias("lat_lng")
    )
    item = F.struct(
        F.col("l_returnflag").alias("description"),
        F.col("l_tax").alias("score"),
        F.array(place).alias("locations"),
        _poly(_point(F.col("l_linenumber"), F.lit(1))).alias("bounding_poly"),
    )
    rows = _exploded(spark, sf, "landmarks", "landmark_annotations", item)
    return rows.select(
        "image_name", "e.description", r6("e.score").alias("score"),
        r6(F.col("e.locations")[0]["latitude"]).alias("latitude"),
        (r6(F.col("e.locations")[0]["longitude"]) + 0).alias("longitude"),
        F.size("e.locations").alias("locations"),
        F.col("e.bounding_poly")[0]["x"].alias("x1"),
    )


@query(
    "vision_logos",
    f"""SELECT {_NAME}, l_linestatus AS description, round(l_discount, 6) AS score,
       CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS vertices
FROM lineitem WHERE {_PRESENT}""",
)
def vision_logos(spark, sf):
    line = F.col("l_linenumber")
    item = F.struct(
        F.col("l_linestatus").alias("description"),
        F.col("l_discount").alias("score"),
        F.when(line % 2 == 0, _poly(_point(line, line))).alias("bounding_poly"),
    )
    rows = _exploded(spark, sf, "logos", "logo_annotations", item)
    return rows.select(
        "image_name", "e.description", r6("e.score").alias("score"), F.size("e.bounding_poly").alias("vertices")
    )


@query(
    "vision_labels",
    f"""SELECT {_NAME}, p_name AS description, round(l_discount, 6) AS score
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_PRESENT}""",
)
def vision_labels(spark, sf):
    item = F.struct(F.col("p_name").alias("description"), F.col("l_discount").alias("score"))
    rows = _exploded(spark, sf, "labels", "label_annotations", item, with_part=True)
    return rows.select("image_name", "e.description", r6("e.score").alias("score"))


@query(
    "vision_colors",
    f"""SELECT {_NAME}, CAST(l_partkey % 256 AS DOUBLE) AS red, CAST(l_suppkey % 256 AS DOUBLE) AS green,
       CAST(0 AS DOUBLE) AS blue, round(CASE WHEN l_linenumber % 3 = 0 THEN l_tax END, 6) AS alpha,
       round(l_discount, 6) AS score, round(l_tax, 6) AS pixel_fraction
FROM lineitem WHERE {_PRESENT}""",
)
def vision_colors(spark, sf):
    line = F.col("l_linenumber")
    color = F.struct(
        (F.col("l_partkey") % 256).alias("red"),
        (F.col("l_suppkey") % 256).alias("green"),
        F.when(line % 3 == 0, F.struct(F.col("l_tax").alias("value"))).alias("alpha"),
    )
    item = F.struct(color.alias("color"), F.col("l_discount").alias("score"), F.col("l_tax").alias("pixel_fraction"))
    docs = fx.line_responses(spark, sf, "image_properties_annotation.dominant_colors.colors", item)
    rows = vision.section_items(vision.normalize_annotations(docs, ["image_properties"]), "image_properties.dominant_colors")
    return rows.select(
        "image_name", "e.color.red", "e.color.green", "e.color.blue", r6("e.color.alpha").alias("alpha"),
        r6("e.score").alias("score"), r6("e.pixel_fraction").alias("pixel_fraction"),
    )


@query(
    "vision_objects",
    f"""SELECT {_NAME}, l_returnflag AS name, round(l_tax, 6) AS score, round(l_discount, 6) AS x1,
       CAST(1 AS INTEGER) AS vertices FROM lineitem WHERE {_PRESENT}""",
)
def vision_objects(spark, sf):
    item = F.struct(
        F.col("l_returnflag").alias("name"),
        F.col("l_tax").alias("score"),
        _poly(_point(F.col("l_discount"), F.lit(0.5)), name="normalized_vertices").alias("bounding_poly"),
    )
    rows = _exploded(spark, sf, "object_localizations", "localized_object_annotations", item)
    corners = F.col("e.bounding_poly.normalized_vertices")
    return rows.select(
        "image_name", "e.name", r6("e.score").alias("score"), r6(corners[0]["x"]).alias("x1"), F.size(corners).alias("vertices")
    )


@query(
    "vision_crops",
    f"""SELECT {_NAME}, l_linenumber AS x1, CAST(l_suppkey AS INTEGER) AS y1, round(l_discount, 6) AS confidence
FROM lineitem WHERE {_PRESENT}""",
)
def vision_crops(spark, sf):
    item = F.struct(
        _poly(_point(F.col("l_linenumber"), F.col("l_suppkey"))).alias("bounding_poly"), F.col("l_discount").alias("confidence")
    )
    rows = _exploded(spark, sf, "crop_hints", "crop_hints_annotation.crop_hints", item)
    corner = F.col("e.bounding_poly.vertices")[0]
    return rows.select("image_name", corner["x"].alias("x1"), corner["y"].alias("y1"), r6("e.confidence").alias("confidence"))


@query(
    "vision_web",
    """SELECT 'order_' || o_orderkey AS image_name,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS INTEGER) AS entities,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS INTEGER) AS full_matches,
       CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS INTEGER) AS similar_images,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS entity,
       CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS best_guess
FROM orders WHERE o_orderkey % 7 <> 0
  AND (o_orderkey % 2 = 0 OR o_orderkey % 3 IN (0, 1) OR o_orderkey % 5 = 0)""",
)
def vision_web(spark, sf):
    key = F.col("o_orderkey")
    url = F.struct(F.concat(F.lit("http://images.example/"), key.cast("string")).alias("url"))
    none = F.array().cast("array<struct<url:string>>")
    value = F.struct(
        F.when(key % 2 == 0, F.array(F.struct(F.col("o_orderpriority").alias("description"), F.lit(0.5).alias("score"))))
        .alias("web_entities"),
        F.when(key % 3 == 0, F.array(url, url)).otherwise(none).alias("full_matching_images"),
        F.when(key % 5 == 0, F.array(url)).alias("visually_similar_images"),
        F.when(key % 3 == 1, F.array(F.struct(F.col("o_orderstatus").alias("label"), F.lit("en").alias("language_code"))))
        .alias("best_guess_labels"),
    )
    docs = fx.order_responses(spark, sf, "web_detection", value)
    web = F.col("web_detection")
    filled = lambda c: F.when(c.isNotNull(), F.size(c))
    return (
        vision.normalize_annotations(docs, ["web_detection"])
        .where(web.isNotNull())
        .select(
            "image_name",
            filled(web["web_entities"]).alias("entities"),
            filled(web["full_matching_images"]).alias("full_matches"),
            filled(web["visually_similar_images"]).alias("similar_images"),
            web["web_entities"][0]["description"].alias("entity"),
            web["best_guess_labels"][0]["label"].alias("best_guess"),
        )
    )


_LIKELY = "['UNKNOWN','VERY_UNLIKELY','UNLIKELY','POSSIBLE','LIKELY','VERY_LIKELY']"


@query(
    "vision_safe_search",
    f"""SELECT 'order_' || o_orderkey AS image_name, {_LIKELY}[o_orderkey % 6 + 1] AS adult,
       {_LIKELY}[o_custkey % 6 + 1] AS spoof, 'POSSIBLE' AS medical, 'LIKELY' AS violence,
       {_LIKELY}[(o_orderkey + o_custkey) % 6 + 1] AS racy
FROM orders WHERE o_orderkey % 7 <> 0""",
)
def vision_safe_search(spark, sf):
    value = F.struct(
        (F.col("o_orderkey") % 6).alias("adult"),
        (F.col("o_custkey") % 6).alias("spoof"),
        F.lit(3).alias("medical"),
        F.lit("LIKELY").alias("violence"),
        ((F.col("o_orderkey") + F.col("o_custkey")) % 6).alias("racy"),
    )
    docs = fx.order_responses(spark, sf, "safe_search_annotation", value)
    rows = vision.normalize_annotations(docs, ["safe_search_properties"])
    return rows.where(F.col("safe_search_properties").isNotNull()).select("image_name", "safe_search_properties.*")


@query(
    "vision_faces",
    f"""SELECT {_NAME}, round(l_discount, 6) AS detection_confidence, {_LIKELY}[l_linenumber % 6 + 1] AS joy_likelihood,
       'UNLIKELY' AS headwear_likelihood,
       CASE WHEN l_linenumber % 3 = 2 THEN NULL WHEN l_linenumber % 3 = 0 THEN l_linenumber
            ELSE CAST(l_suppkey AS INTEGER) END AS x1,
       CASE WHEN l_linenumber % 2 = 0 THEN 'NOSE_TIP' END AS landmark,
       round(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END, 6) AS z
FROM lineitem WHERE {_PRESENT}""",
)
def vision_faces(spark, sf):
    line = F.col("l_linenumber")
    no_corners = F.struct(F.array().cast("array<struct<x:int,y:int>>").alias("vertices"))
    tight = F.when(line % 3 == 0, _poly(_point(line, line))).otherwise(no_corners)
    wide = F.when(line % 3 < 2, _poly(_point(F.col("l_suppkey").cast("int"), line)))
    position = F.struct(F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.col("l_tax").alias("z"))
    item = F.struct(
        F.col("l_discount").alias("detection_confidence"),
        (line % 6).alias("joy_likelihood"),
        F.lit("UNLIKELY").alias("headwear_likelihood"),
        tight.alias("fd_bounding_poly"),
        wide.alias("bounding_poly"),
        F.when(line % 2 == 0, F.array(F.struct(F.lit(8).alias("type"), position.alias("position")))).alias("landmarks"),
    )
    rows = _exploded(spark, sf, "faces", "face_annotations", item)
    first = lambda c: F.get(c, F.lit(0))
    return rows.select(
        "image_name",
        r6("e.detection_confidence").alias("detection_confidence"),
        "e.joy_likelihood",
        "e.headwear_likelihood",
        first(F.col("e.detection_bounding_box"))["x"].alias("x1"),
        first(F.col("e.landmarks"))["type"].alias("landmark"),
        r6(first(F.col("e.landmarks"))["position"]["z"]).alias("z"),
    )
