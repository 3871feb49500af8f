"""Queries for sources, sinks and incremental ingestion, over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryloom.operators.labels import extract_labels, label_frequency
from galleryloom.session import scratch_path
from galleryloom.sources import annotate, documents, images, tables
from galleryloom.streaming.ingest import ingest_labels, ingested_labels
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


# ---------------------------------------------------------------- tables

_DESC = "SELECT 'img_' || doc_id || '.jpg' AS image_name, md5(text) AS digest, length(text) AS n_chars FROM documents"


def _digest(df):
    return df.select("image_name", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query("csv_scan", _DESC)
def csv_scan(spark, sf):
    path = scratch_path(spark, "descriptions-csv")
    source = fx.descriptions(spark, sf).select(F.col("image_name").alias("Image Name"), "description")
    tables.csv_sink(source, path)
    return _digest(tables.with_text_and_name(tables.csv_scan(spark, path, "`Image Name` string, description string", multi_line=True)))


@query("csv_sink", """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS components,
  round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 6) + 0 AS total FROM embeddings""")
def csv_sink(spark, sf):
    path = scratch_path(spark, "embeddings-csv")
    values = fx.table(spark, sf, "embeddings").select("vec_id", "label", F.to_json("embedding").alias("embedding"))
    tables.csv_sink(values, path)
    read = tables.csv_scan(spark, path, "vec_id bigint, label int, embedding string")
    vector = F.from_json("embedding", "array<float>")
    total = F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return read.select("vec_id", "label", F.size(vector).alias("components"), (F.round(total, 6) + 0.0).alias("total"))


_NUMERALS = "零一二三四五六七八九"


@query(
    "csv_scan_encodings",
    f"""SELECT p_partkey AS id, translate(CAST(p_partkey AS VARCHAR), '0123456789', '{_NUMERALS}') || ' ' || p_name AS text
FROM part""",
)
def csv_scan_encodings(spark, sf):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch_path(spark, "encodings-csv")
    numeral = F.translate(F.col("p_partkey").cast("string"), "0123456789", _NUMERALS)
    rows = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(numeral, F.lit(" "), "p_name").alias("text"), "p_size"
    )
    tables.csv_sink(rows.where("p_size <= 25").drop("p_size"), f"{path}/traditional", encoding="x-windows-950")
    tables.csv_sink(rows.where("p_size > 25").drop("p_size"), f"{path}/unicode")
    return tables.csv_scan_encodings(spark, f"{path}/*", "id bigint, text string")


@query(
    "union_batches",
    """SELECT doc_id AS id, text, NULL AS role FROM documents UNION ALL SELECT conv_id, text, role FROM conversations""",
)
def union_batches(spark, sf):
    first = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    second = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return tables.union_batches(first, second)


# ---------------------------------------------------------------- document folders


def _page_files(spark, sf, label):
    """One file per page: labels from its address; some texts hold no object or are cut off."""
    host = F.regexp_extract("url", r"://([^/]+)/", 1)
    items = F.transform(F.split(host, r"\."), lambda x: F.struct(x.alias("description"), F.lit(0.5).alias("score")))
    name = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    json = F.to_json(F.struct(name.alias("image_name"), items.alias("labels")), {"pretty": "true"})
    kind = F.pmod("page_id", F.lit(10))
    text = (
        F.when(kind == 3, F.concat(F.lit("["), json, F.lit("]")))
        .when(kind == 6, F.substring(json, 1, 25))
        .when(kind == 9, F.concat(json, F.lit(" trailing")))
        .otherwise(json)
    )
    path = scratch_path(spark, label)
    pages = fx.table(spark, sf, "pages").select(text.alias("value"))
    pages.write.option("maxRecordsPerFile", 1).text(path)
    return path


_PAGE_LABELS = """WITH good AS (SELECT page_id, string_split(regexp_extract(url, '://([^/]+)/', 1), '.') AS hosts FROM pages
  WHERE page_id % 10 NOT IN (3, 6, 9)),
labels AS (SELECT 'page_' || page_id AS image_name, unnest(hosts) AS label FROM good)"""
_PAGE_FREQ = (
    _PAGE_LABELS
    + """ SELECT label, count(*) AS "count", count(DISTINCT image_name) AS image_count,
  CAST(0.5 AS DOUBLE) AS avg_score, CAST(0.5 AS DOUBLE) AS max_score FROM labels WHERE label <> '' GROUP BY label"""
)


@query("json_dir_scan", _PAGE_FREQ)
def json_dir_scan(spark, sf):
    docs = documents.json_dir_scan(spark, _page_files(spark, sf, "pages-json"), glob="*.txt")
    return label_frequency(extract_labels(documents.readable(docs)))


@query(
    "json_dir_scan_flat",
    """SELECT count(*) FILTER (WHERE page_id % 10 NOT IN (3, 6, 9)) AS read,
  count(*) FILTER (WHERE page_id % 10 IN (3, 6, 9)) AS skipped FROM pages""",
)
def json_dir_scan_flat(spark, sf):
    path = _page_files(spark, sf, "pages-json")
    return documents.skipped_count(documents.json_dir_scan(spark, path, recursive=False, glob="*.txt"))


@query("incremental_ingest", _PAGE_FREQ)
def incremental_ingest(spark, sf):
    """Stream twice over the same folder: the second run finds nothing new."""
    path = _page_files(spark, sf, "pages-json")
    table, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint")
    for _ in range(2):
        ingest_labels(spark, path, table, checkpoint, glob="*.txt")
    return label_frequency(ingested_labels(spark, table))


# ---------------------------------------------------------------- images

_PATHS = """WITH paths AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1)
  || ['.JPG', '.png', '.webp', '.tiff', '.txt', '/', '.bin'][page_id % 7 + 1] AS path FROM pages),
named AS (SELECT *, regexp_extract(path, '([^/\\\\]+)[/\\\\]*$', 1) AS image_name FROM paths),
typed AS (SELECT *, lower(regexp_extract(image_name, '[^.]\\.([^.]+)$', 1)) AS suffix FROM named)"""


def image_paths(spark, sf):
    """pages as image paths with mixed suffixes."""
    ends = F.array(*[F.lit(x) for x in (".JPG", ".png", ".webp", ".tiff", ".txt", "/", ".bin")])
    address = F.regexp_replace("url", r"[?#].*$", "")
    return fx.table(spark, sf, "pages").select(
        "page_id", F.concat(address, F.get(ends, (F.col("page_id") % 7).cast("int"))).alias("path")
    )


@query(
    "image_listing",
    _PATHS
    + " SELECT page_id, path, image_name, suffix <> 'tiff' AS annotated FROM typed WHERE suffix IN ('png','jpg','jpeg','gif','bmp','webp','tiff')",
)
def image_listing(spark, sf):
    listed = images.supported_images(image_paths(spark, sf))
    return listed.withColumn("annotated", images.suffix("path").isin(*images.ANNOTATE_SUFFIXES))


@query(
    "mime_type",
    _PATHS
    + """ SELECT page_id, CASE suffix WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp'
  WHEN 'tiff' THEN 'image/tiff' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html'
  ELSE 'application/octet-stream' END AS mime FROM typed""",
)
def mime_type(spark, sf):
    return image_paths(spark, sf).select("page_id", images.mime_type("path").alias("mime"))


@query("image_basename", _PATHS + " SELECT page_id, image_name FROM named")
def image_basename(spark, sf):
    return image_paths(spark, sf).select("page_id", images.base_name("path").alias("image_name"))


@query(
    "write_by_topic",
    """SELECT CAST(doc_id % 12 + 1 AS VARCHAR) AS new_topic_num,
  count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS found,
  count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing
FROM documents GROUP BY doc_id % 12""",
)
def write_by_topic(spark, sf):
    """Route documents to topics; the images present are those with a quality label."""
    name = F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    labels = fx.table(spark, sf, "documents").select(
        F.concat(F.lit(" "), name).alias("image_name"), (F.col("doc_id") % 12 + 1).alias("new_topic_num")
    )
    present = fx.table(spark, sf, "labels").select(name.alias("image_name"), F.concat(F.lit("images/"), name).alias("path"))
    routed = images.route_by_topic(labels, present)
    path = scratch_path(spark, "routed")
    images.write_by_topic(routed, path)
    written = spark.read.schema("image_name string, path string, new_topic_num string").parquet(path)
    absent = routed.where(F.col("path").isNull())
    return images.routing_counts(written.unionByName(absent.select("image_name", "path", "new_topic_num")))


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf):
    name = F.concat(F.lit("img_"), F.col("doc_id").cast("string"))
    todo = fx.table(spark, sf, "documents").select("doc_id", F.concat(name, F.lit(".jpg")).alias("image_name"))
    done = fx.table(spark, sf, "labels").select(F.concat(name, F.lit("_vision_results.json")).alias("result_name"))
    return images.resume_pending(todo, done).select("doc_id")


def _describe(name: str, content: bytes, mime: str) -> str:
    if mime == "application/octet-stream":
        raise ValueError("unsupported type")
    return f" {mime} of {len(content)} bytes "


@query(
    "batch_describe",
    _PATHS
    + """ SELECT image_name, CASE WHEN suffix IN ('jpg','png','webp','tiff','txt','html') THEN
    CASE suffix WHEN 'jpg' THEN 'image/jpeg' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' ELSE 'image/' || suffix END
    || ' of ' || strlen(html) || ' bytes' ELSE '' END AS description,
  suffix NOT IN ('jpg','png','webp','tiff','txt','html') AS failed
FROM typed JOIN pages ON pages.page_id = typed.page_id""",
)
def batch_describe(spark, sf):
    contents = fx.table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    inputs = image_paths(spark, sf).join(contents, "page_id").select(images.base_name("path").alias("image_name"), "content")
    described = annotate.batch_annotate(inputs, _describe)
    return described.select("image_name", "description", F.col("error").isNotNull().alias("failed"))


class _Flaky:
    """Fails with a transient error once per image, twice for odd sizes, and for good on empty types."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, name: str, content: bytes, mime: str) -> str:
        self.seen[name] = self.seen.get(name, 0) + 1
        if self.seen[name] <= 1 + len(content) % 4:
            raise annotate.TransientError("busy")
        return str(len(content))


@query(
    "batch_annotate_retry",
    """SELECT 'page_' || page_id AS image_name, CASE WHEN strlen(html) % 4 <= 1 THEN CAST(strlen(html) AS VARCHAR) ELSE '' END AS description,
  CAST(least(2 + strlen(html) % 4, 3) AS INTEGER) AS attempts, CASE WHEN strlen(html) % 4 > 1 THEN 'transient: busy' END AS error
FROM pages""",
)
def batch_annotate_retry(spark, sf):
    inputs = fx.table(spark, sf, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("image_name"), F.col("html").cast("binary").alias("content")
    )
    return annotate.batch_annotate(inputs, _Flaky(), retries=2, pause=0.0).select(
        "image_name", "description", "attempts", "error"
    )
