"""Dominant colour statistics over annotation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.functions.annotations import field, is_object, member
from galleryloom.functions.color import (
    BLACK_BELOW_VALUE,
    GREY_BELOW_SATURATION,
    HUE_ENDS,
    TONE_COLORS,
    WHITE_ABOVE_VALUE,
)
from galleryloom.operators.keyed import unroll

# Where the first dominant colour is found, normalised layout before raw layout.
COLOR_PATHS = ("image_properties.dominant_colors[0]", "imagePropertiesAnnotation.dominantColors.colors[0]")


def _first_entries(docs: DataFrame, document: str, columns: list[str]) -> DataFrame:
    """`columns` and `_entry`, the first usable colour entry of a document or NULL."""
    entries = docs.select(
        *columns, *[field(document, p, "variant").alias(f"_e{i}") for i, p in enumerate(COLOR_PATHS)]
    )

    def usable(entry: str):
        color = member(F.col(entry), "color", "variant")
        return is_object(F.col(entry)) & (color.isNull() | F.schema_of_variant(color).rlike("^(OBJECT|VOID)"))

    first = F.when(usable("_e0"), F.col("_e0")).when(usable("_e1"), F.col("_e1"))
    return entries.select(*columns, first.alias("_entry"))


def _channels() -> list:
    return [
        F.coalesce(member(F.col("_entry"), f"color.{name}", "double"), F.lit(0.0)).cast("int").alias(name)
        for name in ("red", "green", "blue")
    ]


def top_colors(docs: DataFrame, document: str = "document", keep: tuple[str, ...] = ()) -> DataFrame:
    """First dominant colour per document; documents without one are left out.

    An entry without `color`, or with missing channels, counts as zero; other shapes are skipped.
    Done in steps so that each VARIANT access is evaluated once.
    """
    # Unrolled from a list of at most one: the optimizer would move a filter below the parsing and repeat all of it.
    entries = _first_entries(docs, document, list(keep))
    found = unroll(entries, list(keep), F.filter(F.array("_entry"), lambda e: e.isNotNull()), "_entry")
    return found.select(*keep, *_channels())


def with_top_color(docs: DataFrame, document: str = "document") -> DataFrame:
    """All documents with `rgb`, NULL without a colour."""
    entries = _first_entries(docs, document, docs.columns)
    return entries.select(*docs.columns, F.when(F.col("_entry").isNotNull(), F.struct(*_channels())).alias("rgb"))


def with_tone(colors: DataFrame) -> DataFrame:
    """Tone name by value, saturation and hue.

    The hue keeps the operation order of the usual HSV routine (distances to the maximum, sixths of
    the circle, modulo one): the shorter textbook form rounds differently at tone borders. One step
    per intermediate keeps the generated code small.
    """
    kept = colors.columns
    zero = F.lit(0.0)
    r, g, b, high, low = (F.col(c) for c in ("_r", "_g", "_b", "_high", "_low"))
    span = F.nullif(high - low, zero)
    sixth = (
        F.when(r == high, F.col("_to_b") - F.col("_to_g"))
        .when(g == high, F.lit(2.0) + F.col("_to_r") - F.col("_to_b"))
        .otherwise(F.lit(4.0) + F.col("_to_g") - F.col("_to_r"))
    )
    tone = (
        F.when(high < BLACK_BELOW_VALUE, "Black")
        .when((F.col("_saturation") < GREY_BELOW_SATURATION) & (high > WHITE_ABOVE_VALUE), "White")
        .when(F.col("_saturation") < GREY_BELOW_SATURATION, "Gray")
    )
    for name, end in HUE_ENDS:
        tone = tone.when(F.col("_hue") < end, name)
    return (
        colors.select("*", *[(F.col(c).cast("double") / 255.0).alias(f"_{c[0]}") for c in ("red", "green", "blue")])
        .select("*", F.greatest(r, g, b).alias("_high"), F.least(r, g, b).alias("_low"))
        .select("*", *[((high - F.col(f"_{c}")) / span).alias(f"_to_{c}") for c in "rgb"])
        .select(
            "*",
            F.when(high > 0, (high - low) / F.nullif(high, zero)).otherwise(zero).alias("_saturation"),
            (F.pmod(sixth / 6.0, F.lit(1.0)) * 360.0).alias("_hue"),
        )
        .select(*kept, tone.otherwise("Red").alias("tone"))
    )


def tone_distribution(tones: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Images per tone and their share of the coloured images (of the group, when grouped)."""
    counts = tones.groupBy(*keys, "tone").agg(F.count(F.lit(1)).alias("count"))
    if not keys:
        # A window over the few tones: a second aggregate could read the documents again.
        return counts.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy()))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total"))
    return (
        counts.join(totals, list(keys))
        .withColumn("fraction", F.col("count") / F.col("_total"))
        .drop("_total")
    )


def with_tone_labels(tones: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Display name and plot colour (hex) per tone; unknown tones show themselves in light grey."""

    def lookup(values: dict[str, str]):
        pairs = [F.lit(x) for item in values.items() for x in item]
        return F.element_at(F.create_map(*pairs), F.col("tone")) if pairs else F.lit(None).cast("string")

    hexes = {t: "#" + "".join(f"{round(c * 255):02x}" for c in rgb) for t, rgb in TONE_COLORS.items()}
    return tones.withColumn("display_name", F.coalesce(lookup(names or {}), F.col("tone"))).withColumn(
        "plot_color", F.coalesce(lookup(hexes), F.lit("#cccccc"))
    )
