"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, fold, table

WORD_SLOTS = 1 << 14
FACTORS = 8
# The machine is fitted on at most about this many labelled documents, gathered as sparse features in one task.
TRAIN_DOCUMENTS = 12_000
EPOCHS = 8
BATCH = 128
RATE = 0.08
DECAY = 1e-4
SEED = 11
THRESHOLD = 0.3
BINS = 12
# Fixed order of the structure statistics; each is cut into BINS indicator features.
STATISTICS = (
    "letters", "digits", "capitals", "spaces", "symbols", "symbol_words", "word_length", "distinct_words", "top_word", "repeated_pairs",
    "same_next", "lines", "line_length", "repeated_lines", "words",
)
METADATA = ("n_chars",)
WORD = re.compile(r"\w+")
SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]+")
DIGIT, CAPITAL, LETTER = re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]+")
SLOTS = WORD_SLOTS + (len(STATISTICS) + len(METADATA)) * BINS
FEATURES = "slots array<int>, weights array<float>"


def _share(part: float, whole: float) -> int:
    """Bin of a share: 0 has its own bin, the others are equally wide."""
    return 0 if part <= 0 or whole <= 0 else 1 + min(BINS - 2, int(part / whole * (BINS - 1)))


def _size(value: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(0.0, value))))


def structure_of(text: str, words: list[str], counts: Counter) -> list[int]:
    """The bin of each statistic of a text."""
    size, total = len(text), len(words)
    letters = sum(map(len, LETTER.findall(text)))
    pieces = text.split()
    symbols = SYMBOL.findall(text)
    spaced = sum(map(len, pieces))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        _share(letters, size),
        _share(len(DIGIT.findall(text)), size),
        _share(len(CAPITAL.findall(text)), letters),
        _share(size - spaced, size),
        _share(sum(map(len, symbols)), size),
        _share(min(len(symbols), len(pieces)), len(pieces)),
        _size(spaced / max(1, len(pieces))) if pieces else 0,
        _share(len(counts), total),
        _share(max(counts.values(), default=0), total),
        _share(max(0, total - 1 - pairs), total - 1),
        _share(sum(map(str.__eq__, words, words[1:])), total - 1),
        _size(len(lines)),
        _size(size / max(1, len(lines)) / 8),
        _share(len(lines) - len(set(lines)), len(lines)),
        _size(total),
    ]


def features_of(text: str | None, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: hashed words of unit length together, one indicator per statistic and known metadata value."""
    text = text or ""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    hashed: dict[int, float] = {}
    for word, times in counts.items():
        slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
        hashed[slot] = hashed.get(slot, 0.0) + 1 + math.log(times)
    values = np.fromiter(hashed.values(), np.float32, len(hashed))
    bins = structure_of(text, words, counts)
    bins += [None if v is None or v != v else _size(v) for v in metadata]
    extra = [WORD_SLOTS + i * BINS + b for i, b in enumerate(bins) if b is not None]
    slots = np.r_[np.fromiter(hashed, np.int64, len(hashed)), np.array(extra, np.int64)]
    norm = float(np.sqrt((values**2).sum())) or 1.0
    return slots, np.r_[values / norm, np.full(len(extra), 0.5, np.float32)].astype(np.float32)


class Machine:
    """Bias, linear weights and factors; scores sum pairs through the sum-of-squares identity."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def raw(self, slots: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic of rows laid end to end (none empty), and the factor sums."""
        scaled = self.factors[slots] * weights[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[slots] * weights, starts) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(s) for s, _ in rows])
        raw, _ = self.raw(
            np.concatenate([s for s, _ in rows]), np.concatenate([w for _, w in rows]), np.r_[0, np.cumsum(sizes)[:-1]]
        )
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss by sparse adaptive gradient steps over seeded shuffles of the rows."""
    rng = np.random.default_rng(SEED)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    machine = Machine(
        math.log(share / (1 - share)), np.zeros(SLOTS, np.float32), rng.normal(0, 0.05, (SLOTS, FACTORS)).astype(np.float32)
    )
    if not len(labels) or labels.min() == labels.max():
        machine.factors[:] = 0
        return machine
    seen_linear, seen_factors, seen_bias = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in picked])
            slots = np.concatenate([rows[i][0] for i in picked])
            weights = np.concatenate([rows[i][1] for i in picked])
            raw, sums = machine.raw(slots, weights, np.r_[0, np.cumsum(sizes)[:-1]])
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[picked]).astype(np.float32) / len(picked)
            row = np.repeat(np.arange(len(picked)), sizes)
            used, place = np.unique(slots, return_inverse=True)
            step = error[row] * weights
            linear = np.bincount(place, step, len(used)) + DECAY * machine.linear[used]
            own = machine.factors[slots]
            pull = step[:, None] * (sums[row] - own * weights[:, None])
            factors = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(FACTORS)], axis=1)
            factors += DECAY * machine.factors[used]
            seen_linear[used] += linear**2
            seen_factors[used] += factors**2
            seen_bias += float(error.sum()) ** 2
            machine.linear[used] -= (RATE * linear / np.sqrt(seen_linear[used])).astype(np.float32)
            machine.factors[used] -= (RATE * factors / np.sqrt(seen_factors[used])).astype(np.float32)
            machine.bias -= RATE * float(error.sum()) / math.sqrt(seen_bias)
    return machine


def _metadata(docs: DataFrame, metadata: tuple[str, ...]) -> list[Column]:
    """Metadata columns as doubles; a column the table lacks is missing everywhere."""
    have = set(docs.columns)
    return [(F.col(c) if c in have else F.lit(None)).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)]


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    metadata: tuple[str, ...] = METADATA, documents: int = TRAIN_DOCUMENTS,
) -> Machine:
    """Fit on at most about `documents` labelled texts, picked by a hash of the id.

    Features are computed where the texts are; only the sparse features of the bounded sample meet in one
    task. Unlabelled rows and NULL ids teach nothing; a document labelled twice teaches twice.
    """
    arrow_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("float").alias("label")).where(
        "_id IS NOT NULL AND label IS NOT NULL"
    )
    total = marked.count()
    if total > documents:
        marked = marked.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * documents / total))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *_metadata(docs, metadata))
    sample = texts.join(F.broadcast(marked), "_id")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features_of(t, list(m)) for t, *m in zip(batch["text"], *[batch[f"_m{i}"] for i in range(len(metadata))])]
            yield pd.DataFrame(
                {"_id": batch["_id"], "label": batch["label"], "slots": [s.astype(np.int32) for s, _ in found], "weights": [w for _, w in found]}
            )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts, ignore_index=True).sort_values("_id", kind="stable") if parts else None
        pairs = [] if rows is None else [(np.asarray(s, np.int64), np.asarray(w, np.float32)) for s, w in zip(rows["slots"], rows["weights"])]
        machine = train(pairs, np.zeros(0, np.float32) if rows is None else rows["label"].to_numpy(np.float32))
        yield pd.DataFrame({"bias": [machine.bias], "linear": [machine.linear], "factors": [machine.factors.ravel()]})

    id_type = dict(marked.dtypes)["_id"]
    found = sample.mapInPandas(featurise, f"_id {id_type}, label float, {FEATURES}").repartition(1)
    learned = found.mapInPandas(learn, "bias double, linear array<float>, factors array<float>").first()
    return Machine(learned.bias, np.array(learned.linear, np.float32), np.array(learned.factors, np.float32).reshape(SLOTS, FACTORS))


def with_quality(
    docs: DataFrame, machine: Machine, out: str = "quality_score", text_col: str = "text", metadata: tuple[str, ...] = METADATA
) -> DataFrame:
    """The documents with a score column `out` from 0 to 1: how likely label 1 is.

    NULL and empty texts are scored by their statistics alone, NULL metadata gives no feature, texts of any
    length are read whole, equal rows get equal scores. A column already named `out` is replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, *values in batches:
            rows = [features_of(t, list(m)) for t, *m in zip(texts, *values)]
            yield pd.Series(shared.value.scores(rows), dtype="float64")

    return docs.withColumn(out, run(F.col(text_col), *_metadata(docs, metadata)))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    machine = fit(docs.where(fold("doc_id", 5) != 0), labels)
    found = with_quality(docs.select("doc_id", "text", "n_chars"), machine, "score")
    return found.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict = {}
