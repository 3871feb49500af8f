"""Batch jobs around an external per-image service, given as a plain callable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from galleryloom.sources.images import mime_type

Annotator = Callable[[str, bytes, str], str]
FIRST_PAUSE = 5.0
LONGEST_PAUSE = 300.0


class TransientError(Exception):
    """Raised by an annotator for failures worth repeating."""


def _call(annotator: Annotator, image: tuple, retries: int, pause: float, sleep) -> tuple[str, str | None, int]:
    """(text, error, attempts); the pause doubles up to LONGEST_PAUSE."""
    for attempt in range(1, retries + 2):
        try:
            return (annotator(*image) or "").strip(), None, attempt
        except TransientError as exc:
            error = f"transient: {exc}"
            if attempt <= retries:
                sleep(min(pause * 2 ** (attempt - 1), LONGEST_PAUSE))
        except Exception as exc:  # noqa: BLE001 - one image must not end the job
            return "", f"{type(exc).__name__}: {exc}", attempt
    return "", error, retries + 1


def batch_annotate(
    images: DataFrame, annotator: Annotator, retries: int = 0, pause: float = FIRST_PAUSE, sleep=time.sleep
) -> DataFrame:
    """(image_name, description, error, attempts), one row per image; failures give an empty text.

    `images` has image_name, path and content. Transient errors are repeated a bounded number of
    times: waiting without end inside a task would hang its stage. Images stream through in Arrow
    batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (name, *_call(annotator, (name, content, mime), retries, pause, sleep))
                for name, content, mime in zip(batch["image_name"], batch["content"], batch["mime"])
            ]
            yield pd.DataFrame(rows, columns=["image_name", "description", "error", "attempts"])

    typed = images.select("image_name", "content", mime_type("image_name").alias("mime"))
    return typed.mapInPandas(run, "image_name string, description string, error string, attempts int")
