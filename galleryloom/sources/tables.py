"""CSV and Parquet tables: column resolution, encodings, union, sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names accepted for the text and for the image name, in order of preference.
TEXT_COLUMNS = ("cleaned_text", "text", "desc", "description")
NAME_COLUMNS = ("Image Name", "Image", "ImageName", "image_name", "Filename", "filename", "File", "Name")
# Encodings tried in order (decoder name, Spark reader name).
ENCODINGS = (("utf-8-sig", "UTF-8"), ("utf-8", "UTF-8"), ("cp950", "x-windows-950"), ("big5", "Big5"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df


def first_present(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def csv_scan(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    required: tuple[str, ...] = (),
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header. Without a schema every column is text; nothing is inferred.

    Files are split over tasks. Quoted line breaks need `multi_line`, which reads each file in one task:
    keep the files of such a table moderate.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("encoding", encoding)
    reader = reader.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return require_columns(reader.csv(path), list(required))


def with_text_and_name(df: DataFrame) -> DataFrame:
    """(image_name, text) from whichever accepted column names are present.

    Without an image name it is derived from `image_path`.
    """
    text = first_present(df, TEXT_COLUMNS)
    name = first_present(df, NAME_COLUMNS)
    if text is None:
        raise ValueError(f"none of {TEXT_COLUMNS} in {df.columns}")
    if name is None and "image_path" not in df.columns:
        raise ValueError(f"neither an image name nor image_path in {df.columns}")
    from galleryloom.sources.images import base_name

    image = F.col(f"`{name}`") if name else base_name("image_path")
    return df.select(image.cast("string").alias("image_name"), F.col(text).alias("text"))


def csv_sink(df: DataFrame, path: str, mode: str = "errorifexists", encoding: str = "UTF-8") -> None:
    """CSV with a header and quotes doubled inside fields, as spreadsheet tools write it."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", encoding)
    writer.option("quoteAll", True).csv(path)


def union_batches(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all batches; columns missing in one are NULL there."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def _decodes(encoding: str):
    def check(lines: pd.Series) -> pd.Series:
        def ok(raw) -> bool:
            try:
                bytes(raw).decode(encoding)
                return True
            except UnicodeDecodeError:
                return False

        return lines.map(ok)

    return F.pandas_udf(check, "boolean")


def file_encodings(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, encoding): the first encoding that decodes every line of the file, NULL if none does.

    Lines are taken as raw bytes, so large files are checked in splits; in all encodings tried a line
    feed byte is only ever a line feed.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")
    )
    names = [decoder for decoder, _ in ENCODINGS[1:]]
    checked = raw.select("file", *[_decodes(n)("line").alias(n) for n in names])
    per_file = checked.groupBy("file").agg(*[F.bool_and(n).alias(n) for n in names])
    choice = F.coalesce(*[F.when(F.col(d), reader) for d, reader in ENCODINGS[1:]])
    return per_file.select("file", choice.alias("encoding"))


def csv_scan_encodings(
    spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.csv", multi_line: bool = True
) -> DataFrame:
    """CSV files of unknown encodings: each file is read with the first encoding that decodes it.

    Only file names come to the driver, grouped by encoding.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    files: dict[str | None, list[str]] = {}
    for row in file_encodings(spark, path, glob).toLocalIterator():
        files.setdefault(row["encoding"], []).append(row["file"])
    if None in files:
        raise ValueError(f"no known encoding decodes {files[None][:5]}")
    parts = [csv_scan(spark, names, schema, encoding=e, multi_line=multi_line) for e, names in sorted(files.items())]
    if not parts:
        raise FileNotFoundError(f"no {glob} below {path}")
    return union_batches(*parts)
