"""Image listings: names, types, what is still to do, routing by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported suffixes of the description job and of the annotation job.
DESCRIBE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff")
ANNOTATE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
# MIME type by suffix.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif",
    "bmp": "image/bmp", "webp": "image/webp", "tiff": "image/tiff", "tif": "image/tiff", "svg": "image/svg+xml",
    "ico": "image/vnd.microsoft.icon", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif",
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv",
    "json": "application/json", "pdf": "application/pdf", "zip": "application/zip", "mp4": "video/mp4",
}
UNKNOWN_MIME = "application/octet-stream"
RESULT_SUFFIX = "_vision_results"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: str | Column) -> Column:
    """Last component of a path with either separator; trailing separators are ignored."""
    return F.regexp_extract(_col(path), r"([^/\\]+)[/\\]*$", 1)


def suffix(path: str | Column) -> Column:
    """Lower-cased suffix without the dot; empty for names without one or starting with it."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1))


def mime_type(path: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in MIME_TYPES.items() for x in item])
    return F.coalesce(F.element_at(table, suffix(path)), F.lit(UNKNOWN_MIME))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """File paths, sizes and times; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", "length", "modificationTime")


def supported_images(files: DataFrame, suffixes: tuple[str, ...] = DESCRIBE_SUFFIXES, path: str = "path") -> DataFrame:
    """Files with a supported suffix, ordered by lower-cased name."""
    named = files.withColumn("image_name", base_name(path))
    return named.where(suffix(path).isin(*suffixes)).orderBy(F.lower("image_name"), path)


def stem(name: str | Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?<=[^.])\.[^.]*$", "")


def resume_pending(images: DataFrame, results: DataFrame, name: str = "image_name", result: str = "result_name") -> DataFrame:
    """Images without a result `<stem>_vision_results.json`."""
    done = results.select(F.regexp_replace(stem(result), RESULT_SUFFIX + "$", "").alias("_stem")).distinct()
    return images.withColumn("_stem", stem(name)).join(done, "_stem", "left_anti").drop("_stem")


def route_by_topic(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels with trimmed name and topic, each joined to its image path (NULL when missing)."""
    cleaned = labels.select(
        F.trim(F.col("image_name").cast("string")).alias("image_name"),
        F.trim(F.col("new_topic_num").cast("string")).alias("new_topic_num"),
    )
    return cleaned.join(images.select("image_name", "path"), "image_name", "left")


def routing_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("new_topic_num").agg(
        F.count("path").alias("found"), F.count_if(F.col("path").isNull()).alias("missing")
    )


def write_by_topic(routed: DataFrame, path: str) -> None:
    """Manifest of the found images, one folder per topic; a second run replaces only its own topics."""
    found = routed.where(F.col("path").isNotNull())
    writer = found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("new_topic_num").parquet(path)
