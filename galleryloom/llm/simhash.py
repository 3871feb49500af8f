"""SimHash near-duplicates: fingerprints, BK-trees over pigeonhole shards, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, partitions, salted_join, table
from galleryloom.llm.components import components
from galleryloom.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
# Fingerprints per shard tree, at least; a shard above the limit is cut by more of its bits.
SHARD_LIMIT = 4096
# At most this many shards can be above the limit, so their list may be broadcast.
LARGE_SHARDS = 50_000
ROWS_PER_TASK = 1_000_000
CHUNK_SHINGLES = 1 << 16
FRONTIER = 4_000_000


def fingerprint_of(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text as a signed number; 0 when it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < words_per_shingle:
        words = [b" ".join(words)]
        size = 1
    else:
        size = words_per_shingle
    total = len(words) - size + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, CHUNK_SHINGLES):
        part = words[start : start + CHUNK_SHINGLES + size - 1]
        grams = zip(*[part[i:] for i in range(size)]) if size > 1 else [(w,) for w in part]
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * votes > total).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def simhash(text: Column, words_per_shingle: int = SHINGLE_WORDS) -> Column:
    """Fingerprint column of a text column, computed in Arrow batches."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, words_per_shingle) for t in texts], dtype="int64")

    return run(text)


# ---------------------------------------------------------------- BK-trees of many shards at once


def build_trees(shard: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree per shard over distinct prints; rows are sorted by shard.

    Returns each row's root and the edges as sorted keys (parent * 65 + distance) with their children.
    All trees grow one level at a time: rows below a parent at the same distance follow its first row.
    """
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    root = np.repeat(first, np.diff(np.r_[first, len(shard)]))
    pending = np.setdiff1d(np.arange(len(shard)), first, assume_unique=True)
    above = root[pending]
    keys, children = [], []
    while len(pending):
        key = above * 65 + np.bitwise_count(prints[pending] ^ prints[above])
        edge, where, back = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edge)
        children.append(pending[where])
        above = pending[where][back]
        rest = above != pending
        pending, above = pending[rest], above[rest]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def search_trees(
    query: np.ndarray, root: np.ndarray, prints: np.ndarray, edge: np.ndarray, child: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows within `radius` bits of each query row in its own tree, following only edges within the radius."""
    near, found = [], []
    node = root[query]
    while len(query):
        apart = np.bitwise_count(prints[query] ^ prints[node]).astype(np.int64)
        hit = (apart <= radius) & (node < query)
        near.append(query[hit])
        found.append(node[hit])
        low = np.searchsorted(edge, node * 65 + np.maximum(apart - radius, 0), "left")
        high = np.searchsorted(edge, node * 65 + np.minimum(apart + radius, 64), "right")
        width = high - low
        take = np.repeat(low - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        query, node = np.repeat(query, width), child[take]
    return np.concatenate(near) if near else query, np.concatenate(found) if found else query


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a and b: the least row of each class."""
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]


def shard_classes(shard: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by shard, the least row that each row is linked to within its shard."""
    root, edge, child = build_trees(shard, prints)
    label = np.arange(len(shard))
    load = np.cumsum(np.bincount(root, minlength=len(shard))[root]) if len(shard) else np.zeros(0)
    cuts = np.searchsorted(load, np.arange(FRONTIER, load[-1] if len(load) else 0, FRONTIER))
    for query in np.split(np.arange(len(shard)), cuts):
        a, b = search_trees(query, root, prints, edge, child, radius)
        label = _settle(label, a, b)
    return label


def _shard_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    parts = [p for p in batches if len(p)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values(["shard", "node"], kind="stable")
    shard, prints = rows["shard"].to_numpy(), rows["print"].to_numpy().view(np.uint64)
    node = rows["node"].to_numpy()
    label = shard_classes(shard, prints, radius)
    linked = label != np.arange(len(label))
    yield pd.DataFrame({"a": node[linked], "b": node[label[linked]]})


def _cut(rows: DataFrame, width: int, pieces: int) -> DataFrame:
    """Each row once per piece of its remaining bits: prints within the radius agree in a whole piece."""
    size = width // pieces
    rest = F.col("rest")
    variants = []
    for i in range(pieces):
        bits = width - i * size if i == pieces - 1 else size
        value = F.shiftrightunsigned(rest, i * size).bitwiseAND(F.lit((1 << bits) - 1))
        low = rest.bitwiseAND(F.lit((1 << (i * size)) - 1))
        high = F.lit(0).cast("long") if i == pieces - 1 else F.shiftrightunsigned(rest, (i + 1) * size)
        remaining = F.shiftleft(high, i * size).bitwiseOR(low)
        shard = (F.col("shard") * pieces + i) * (1 << size) + value
        variants.append(F.struct(shard.alias("shard"), remaining.alias("rest")))
    return rows.select("node", "print", F.inline(F.array(*variants)))


def near_links(prints: DataFrame, radius: int = MAX_BITS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct prints within `radius` bits, as stars per shard.

    `prints` has one row per distinct fingerprint: node (long), print (long). Bits are cut into
    radius + 1 pieces, of which two near prints share one; a shard holds the prints with one value of
    one piece. Shards above the limit are cut again by the bits left over, three times at most; what is
    then still large is compared in pairs of chunks. A shard's tree and its queries meet in one task by
    shuffle: the trees grow with the corpus, so no tree of it is broadcast whole.
    """
    spark = prints.sparkSession
    pieces = radius + 1
    rows = prints.select("node", "print", F.lit(0).cast("long").alias("shard"), F.col("print").alias("rest"))
    width, links = 64, None

    def searched(ready: DataFrame, count: int) -> DataFrame:
        tasks = max(partitions(spark), -(-count // ROWS_PER_TASK))
        return ready.repartition(tasks, "shard").mapInPandas(lambda b: _shard_links(b, radius), "a long, b long")

    while rows is not None:
        cut = materialize(_cut(rows, width, pieces), "shards").select("node", "print", "shard", "rest")
        width -= width // pieces
        total = cut.count()
        limit = max(shard_limit, -(-total // LARGE_SHARDS))
        large = materialize(cut.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "large")
        listed = F.broadcast(large.select("shard"))
        found = searched(cut.join(listed, "shard", "left_anti").select("node", "print", "shard"), total)
        links = found if links is None else links.union(found)
        if not large.limit(1).count():
            return links
        rest = cut.join(listed, "shard", "left_semi")
        if width >= 36:
            rows = rest
            continue
        chunks = F.ceil(F.col("n") / limit).cast("int")
        own = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        paired = (
            rest.join(F.broadcast(large), "shard").withColumn("chunks", chunks).withColumn("own", own)
            .withColumn("other", other)
            .select("node", "print", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"))
        )
        return links.union(searched(paired, total))
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS, radius: int = MAX_BITS
) -> DataFrame:
    """One row per document: id, `print` (long) and `component` (least id reachable, itself included).

    Equal fingerprints form one class, classes are linked through their least ids, so copies are never
    paired. A NULL or wordless text has fingerprint 0. Rows without an id link others no further: they get
    the component of their fingerprint (NULL when no other row has it). Repeated rows come back as often
    as they occur; an empty table gives an empty result. Texts of any length are hashed in chunks.
    """
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    printed = materialize(plain.select("node", simhash(F.col("text"), words_per_shingle).alias("print")), "prints")
    classes = materialize(
        printed.groupBy("print").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    found = components(near_links(classes.where("node IS NOT NULL").select("node", "print"), radius))
    joined = classes.join(found.hint("shuffle_merge"), "node", "left")
    labelled = materialize(joined.select("print", "copies", F.coalesce("component", "node").alias("component")), "labelled")
    joined = salted_join(printed, labelled, "print", "copies", F.col("node"))
    return joined.select(F.col("node").alias(id_col), "print", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the one with the least id stays.

    Rows that share an id are one document and stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col).where(F.col(id_col) != F.col("component")).select(id_col).distinct()
    return docs.join(gone.hint("shuffle_merge"), id_col, "left_anti").select(*docs.columns)


def op6_simhash_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
ORACLES: dict = {}
