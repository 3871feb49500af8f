"""Token windows compared with topics, counted inside the token lists of a block of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from galleryloom.operators import grams

# Terms of up to so many bytes travel to the documents, the most frequent (of lowest idf) first.
TERM_BYTES = 64 << 20
# Cells (token and topic) of a block; a longer document is a block of its own.
BLOCK_CELLS = 1 << 22


@dataclass(frozen=True)
class Law:
    """How windows are laid and judged; `topics` in order with the lengths of their term vectors."""

    window: int
    stride: int
    min_similarity: float
    topics: list
    norms: list[float]


def step() -> Column:
    """Terms are taken by whole steps of the idf, frequent ones highest: equal terms stay together and the steps are few."""
    return -F.floor(F.col("idf") * 100)


def frequent_from(stored: DataFrame, limit: int | None = None) -> int:
    """The lowest step whose terms, with all of higher steps, stay within the bytes."""
    size = F.sum(F.octet_length("term") + 20 + 12 * F.size("topics"))
    taken, lowest = 0, 1 << 62
    for r in stored.groupBy(step().alias("step")).agg(size.alias("bytes")).orderBy(F.desc("step")).collect():
        taken += r.bytes
        if taken > (TERM_BYTES if limit is None else limit):
            break
        lowest = r.step
    return lowest


def _unit_cells(topics: pa.Array, law: Law) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells per list of (topic, weight), and their topic numbers and shares of the topic's vector."""
    flat = topics.flatten()
    place = pc.index_in(flat.field("topic"), value_set=pa.array(law.topics, flat.type.field("topic").type)).to_numpy(zero_copy_only=False).astype(np.int32)
    norms = np.array(law.norms)[place] if len(place) else np.zeros(0)
    share = np.divide(flat.field("weight").to_numpy(zero_copy_only=False), norms, out=np.zeros(len(place)), where=norms > 0)
    return topics.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), place, share


class Terms:
    """Terms with idf and topic shares, broadcast once."""

    def __init__(self, spark: SparkSession, table: pa.Table, law: Law):
        table = table.combine_chunks()
        column = lambda name: pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], table[name].type)
        counts, place, share = _unit_cells(column("topics"), law)
        idf = column("idf").to_numpy(zero_copy_only=False)
        self.law, self.shared = law, spark.sparkContext.broadcast((column("term").cast(pa.string()), idf, np.r_[0, np.cumsum(counts)], place, share))

    def places(self, names: pa.Array) -> np.ndarray:
        """The numbers of tokens here, -1 for others."""
        found = pc.index_in(names.cast(pa.string()), value_set=self.shared.value[0])
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Tokens of the lists as numbers of their distinct values (NULL: -1), these values, and tokens per list."""
    coded = tokens.flatten().dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batch: pa.RecordBatch, law: Law) -> Iterator[pa.RecordBatch]:
    lists = pc.fill_null(batch.column("tokens"), pa.scalar([], batch.column("tokens").type))
    batch = batch.set_column(batch.schema.get_field_index("tokens"), "tokens", lists)
    yield from grams.blocks(batch, "tokens", max(BLOCK_CELLS // max(len(law.topics), law.window, 1), 1))


def other_places(docs: DataFrame, key: str, terms: Terms) -> DataFrame:
    """(key, pos, term): tokens that did not travel to the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, terms.law):
                codes, names, sizes = _coded(block.column("tokens"))
                other = np.append(terms.places(names) < 0, False)
                at = np.flatnonzero(other[codes])
                doc = np.repeat(np.arange(len(sizes)), sizes)[at]
                pos = at - (np.cumsum(sizes) - sizes)[doc]
                for i in range(0, len(at), grams.BATCH_ROWS):
                    part = slice(i, i + grams.BATCH_ROWS)
                    columns = [block.column(key).take(pa.array(doc[part])), pa.array(pos[part], pa.int32()), names.take(pa.array(codes[at[part]])).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [key, "pos", "term"])

    schema = StructType([docs.schema[key]]).add("pos", "integer").add("term", "string")
    return docs.select(key, "tokens").mapInArrow(run, schema)


def _vectors(block: pa.RecordBatch, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of a block: number of the term, idf (0 of unknown ones), row of topic shares; and tokens per document."""
    codes, names, sizes = _coded(block.column("tokens"))
    _, idfs, edges, topics, shares = terms.shared.value
    width = len(terms.law.topics)
    place = np.append(terms.places(names), -1)[codes]
    held = np.flatnonzero(place >= 0)
    place = place[held]
    counts = np.diff(edges)[place]
    cells = np.repeat(edges[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    idf = np.zeros(len(codes))
    idf[held] = idfs[place]
    slots, value = np.repeat(held, counts) * width + topics[cells], shares[cells]
    others = block.column("others")
    if others.null_count < len(others):
        flat = others.flatten()
        owner = np.repeat(np.arange(len(sizes)), others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = (np.cumsum(sizes) - sizes)[owner] + flat.field("pos").to_numpy(zero_copy_only=False)
        idf[at] = flat.field("idf").to_numpy(zero_copy_only=False)
        counts, place, share = _unit_cells(flat.field("topics"), terms.law)
        slots, value = np.r_[slots, np.repeat(at, counts) * width + place], np.r_[value, share]
    return codes, idf, np.bincount(slots, value, len(codes) * width).reshape(len(codes), width), sizes


def _topic_sums(block: pa.RecordBatch, terms: Terms) -> np.ndarray:
    """Per document and topic, the similarities of all windows times their tokens."""
    law = terms.law
    codes, idf, units, sizes = _vectors(block, terms)
    units = units * idf[:, None]
    per_doc = np.where(sizes > 0, -(-np.maximum(sizes - law.window, 0) // law.stride) + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), per_doc)
    begin = (np.arange(len(doc)) - (np.cumsum(per_doc) - per_doc)[doc]) * law.stride
    held = np.minimum(law.window, sizes[doc] - begin)
    begin += (np.cumsum(sizes) - sizes)[doc]
    dot, square = np.zeros((len(doc), units.shape[1])), np.zeros(len(doc))
    for i in range(law.window):
        inside = np.flatnonzero(held > i)
        at = begin[inside] + i
        dot[inside] += units[at]
        own = idf[at]
        # A term that stands c times in a window has c * c pairs of places.
        pairs = np.ones(len(at))
        for back in range(1, i + 1):
            pairs += 2 * (codes[at] == codes[at - back])
        square[inside] += own * own * pairs
    length = np.sqrt(square)[:, None]
    similarity = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
    similarity[similarity < law.min_similarity] = 0
    similarity *= held[:, None]
    out = np.zeros((len(sizes), units.shape[1]))
    some = np.flatnonzero(per_doc)
    if len(some):
        out[some] = np.add.reduceat(similarity, (np.cumsum(per_doc) - per_doc)[some])
    return out


def distribution(docs: DataFrame, key: str, terms: Terms, key_field: StructField, topic_field: StructField) -> DataFrame:
    """(key, topic, probability) of documents with `tokens` and `others`, the joined terms; topics without any share are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(terms.law.topics, to_arrow_type(topic_field.dataType))
        for batch in batches:
            for block in _blocks(batch, terms.law):
                sums = _topic_sums(block, terms)
                doc, topic = np.nonzero(sums)
                share = sums[doc, topic] / sums.sum(axis=1)[doc]
                for i in range(0, len(doc), grams.BATCH_ROWS):
                    part = slice(i, i + grams.BATCH_ROWS)
                    columns = [block.column(key).take(pa.array(doc[part])), names.take(pa.array(topic[part])), pa.array(share[part])]
                    yield pa.RecordBatch.from_arrays(columns, [key, topic_field.name, "probability"])

    schema = StructType([key_field, topic_field]).add("probability", "double")
    return docs.select(key, "tokens", "others").mapInArrow(run, schema)
