"""Label, co-occurrence and colour statistics of a document collection in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleryloom.functions.annotations import field, label_items, label_set
from galleryloom.operators import colors, labels
from galleryloom.session import materialize


def vision_report(docs: DataFrame, doc_key: str, keys: tuple[str, ...] = (), threshold: float = 0.0) -> dict:
    """`labels`, `pairs` and `tones` statistics, per group of `keys`.

    The documents are parsed once; the small typed projection is written and feeds all three.
    """
    facts = materialize(
        colors.with_top_color(docs).select(
            doc_key,
            *keys,
            field("document", "image_name", "string").alias("image_name"),
            label_items("document").alias("items"),
            label_set("document", threshold).alias("labels"),
            "rgb",
        ),
        "label-facts",
    )
    occurrences = facts.select(*keys, "image_name", F.inline("items"))
    sets = facts.select(doc_key, *keys, "labels")
    colored = facts.where(F.col("rgb").isNotNull()).select(*keys, "rgb.red", "rgb.green", "rgb.blue")
    tones = colors.with_tone(colored)
    return {
        "labels": labels.label_frequency(occurrences, keys),
        "pairs": labels.pair_stats(labels.label_pairs(sets, keys), labels.label_image_counts(sets, keys), keys),
        "tones": colors.tone_distribution(tones, keys),
    }
