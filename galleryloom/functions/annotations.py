"""Column expressions over annotation JSON kept as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_documents(df: DataFrame, json: str | Column, keep: tuple[str, ...] = (), out: str = "document") -> DataFrame:
    """JSON text to a VARIANT holding `[document]`, or NULL when the text is not exactly one object.

    The parser ignores text after a complete value, so the text is wrapped in brackets: anything
    after the object then either fails to parse or shows up as a second element. In steps, so that
    each text is made and parsed once; only a filter that the optimizer moves below them undoes this.
    """
    text = F.col("_text")
    texts = df.select(*keep, (F.col(json) if isinstance(json, str) else json).alias("_text"))
    parsed = texts.select(
        *keep,
        text.rlike(r"^[ \t\r\n]*\{").alias("_is_object"),
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).alias("_parsed"),
    )
    single = F.try_variant_get("_parsed", "$[1]", "variant").isNull()
    return parsed.select(*keep, F.when(F.col("_is_object") & single, F.col("_parsed")).alias(out))


def field(document: str | Column, path: str, data_type: str) -> Column:
    """Value at `path` below the document root cast to `data_type`; NULL for absent or wrong types."""
    doc = F.col(document) if isinstance(document, str) else document
    suffix = f".{path}" if path else ""
    return F.try_variant_get(doc, f"$[0]{suffix}", data_type)


def member(item: Column, path: str, data_type: str) -> Column:
    return F.try_variant_get(item, f"$.{path}" if path else "$", data_type)


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def label_items(document: str | Column) -> Column:
    """ARRAY<STRUCT<label, score>> from `labels` then `labelAnnotations`; sentinels give nothing."""
    item_type = "array<struct<description:string,score:double>>"
    none = F.array().cast(item_type)
    both = F.concat(
        F.coalesce(field(document, "labels", item_type), none),
        F.coalesce(field(document, "labelAnnotations", item_type), none),
    )
    kept = F.filter(both, lambda x: x["description"] != "")
    return F.transform(kept, lambda x: F.struct(x["description"].alias("label"), x["score"].alias("score")))


def label_set(document: str | Column, threshold: float = 0.0) -> Column:
    """Sorted distinct labels of `labels`, whose items are strings or objects, at or above a score."""

    def name(x: Column) -> Column:
        parts = [F.nullif(member(x, p, "string"), F.lit("")) for p in ("description", "label", "name")]
        plain = F.when(F.schema_of_variant(x) == "STRING", member(x, "", "string"))
        return trim_blanks(F.coalesce(*parts, plain))

    raw = F.coalesce(field(document, "labels", "array<variant>"), F.array().cast("array<variant>"))
    passing = F.filter(raw, lambda x: F.coalesce(member(x, "score", "double"), F.lit(1.0)) >= threshold)
    names = F.transform(passing, name)
    return F.sort_array(F.array_distinct(F.filter(names, lambda s: s.isNotNull() & (s != ""))))


BLANKS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def trim_blanks(text: str | Column) -> Column:
    """Strip Unicode white space at both ends."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(col, rf"^{BLANKS}+|{BLANKS}+$", "")
