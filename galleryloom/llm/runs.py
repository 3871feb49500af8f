"""Periodic runs of words: suffix classes united by falling common prefix, over ordered position sets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, table

MIN_LENGTH = 12
MIN_COPIES = 2
# Texts are taken together up to about this many words, so that the tables of a task stay small.
GROUP_WORDS = 300_000
BLOCK = 512
WORDS = r"[^\x20\x09-\x0D]+"
RESULT = "struct<runs:array<struct<start:long,period:long,length:long>>,collapsed:string>"


class Positions:
    """An ordered set of positions in blocks, so that adding one moves few others, however large the set."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int, int]:
        """Put a new position in its place; its neighbours below and above, -1 where there is none."""
        at = max(bisect_right(self.firsts, position) - 1, 0)
        block = self.blocks[at]
        place = bisect_left(block, position)
        below = block[place - 1] if place else -1  # only the first block can be entered at its front
        if place < len(block):
            above = block[place]
        else:
            above = self.firsts[at + 1] if at + 1 < len(self.firsts) else -1
        block.insert(place, position)
        self.firsts[at] = block[0]
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[at : at + 1] = [block[0], block[BLOCK]]
        self.size += 1
        return below, above


def suffix_order(codes: np.ndarray, text: np.ndarray, ends: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share at least a power-of-two prefix of up to `common` words with another one of their text.

    Returns their positions in suffix order, and whether each has that prefix in common with the one before.
    Prefixes are doubled; only suffixes that still equal another are sorted again. `ends` holds, per
    position, the end of its text.
    """
    _, key = np.unique(codes, return_inverse=True)
    _, inverse, counts = np.unique(text * np.int64(int(key.max()) + 1) + key, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    active = np.flatnonzero(counts[inverse] > 1)
    width, wanted, group = 1, None, None
    while True:
        if wanted is None and 2 * width > common:
            wanted, group = active, rank[active]
        if not len(active):
            break
        following = active + width
        inside = following < ends[active]
        second = np.where(inside, rank[np.where(inside, following, 0)], -1)
        order = np.lexsort((second, rank[active]))
        active, first, second = active[order], rank[active][order], second[order]
        old = np.r_[True, first[1:] != first[:-1]]
        new = old | np.r_[True, second[1:] != second[:-1]]
        numbers = np.arange(len(active))
        rank[active] = first + np.maximum.accumulate(np.where(new, numbers, 0)) - np.maximum.accumulate(np.where(old, numbers, 0))
        active = active[~(new & np.r_[new[1:], True])]
        width *= 2
    if wanted is None:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(rank[wanted], kind="stable")
    return wanted[order], np.r_[False, group[order][1:] == group[order][:-1]] if len(order) else np.zeros(0, bool)


def common_prefixes(codes: list[int], ends: np.ndarray, order: np.ndarray, joined: np.ndarray, common: int) -> list[tuple[int, int, int]]:
    """(common prefix, position, position) of neighbours in suffix order that share at least `common` words."""
    before = np.full(len(order), -1)
    before[joined] = order[np.flatnonzero(joined) - 1]
    by_place = np.argsort(order, kind="stable")
    out, last, shared = [], -2, 0
    for here, there, end in zip(order[by_place].tolist(), before[by_place].tolist(), ends[order[by_place]].tolist()):
        # The suffix behind shares all but one word of what its forerunner shared.
        shared = shared - 1 if here == last + 1 and shared > common else 0
        if there >= 0:
            limit = end - max(here, there)
            while shared < limit and codes[here + shared] == codes[there + shared]:
                shared += 1
            if shared >= common:
                out.append((shared, here, there))
        else:
            shared = 0
        last = here
    return out


def runs_of(codes: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs of texts laid end to end, by start and period.

    Suffixes are united in the order of falling common prefix. Two positions that become neighbours in a class have no
    position of the class between them, so their distance is the smallest period of what they cover; when the
    common prefix holds the wanted copies, and the words in front of them differ, they open a run.
    """
    total = len(codes)
    if not total:
        return []
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = set((np.cumsum(lengths) - lengths).tolist())
    common = max(1, -(-min_length * (min_copies - 1) // min_copies))
    order, joined = suffix_order(codes, text, ends, common)
    if not joined.any():
        return []
    words = codes.tolist()
    links = sorted(common_prefixes(words, ends, order, joined, common), key=lambda link: -link[0])
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}
    found: list[tuple[int, int, int]] = []

    def root(position: int) -> int:
        while (up := parent.setdefault(position, position)) != position:
            parent[position] = position = parent[up]
        return position

    def seed(low: int, high: int, shared: int) -> None:
        period = high - low
        if period * (min_copies - 1) <= shared and period + shared >= min_length and (low in starts or words[low - 1] != words[high - 1]):
            found.append((low, period, period + shared))

    for shared, here, there in links:
        large, small = root(here), root(there)
        into, added = members.pop(large, None) or Positions(large), members.pop(small, None) or Positions(small)
        if into.size < added.size:
            large, small, into, added = small, large, added, into
        parent[small], members[large] = large, into
        moved, last = list(added), -1
        for position, after in zip(moved, [*moved[1:], total]):
            below, above = into.add(position)
            if below >= 0 and below != last:
                seed(below, position, shared)
            if 0 <= above < after:
                seed(position, above, shared)
            last = position
    return sorted(found)


def _periods(lists: pa.ListArray, min_length: int, min_copies: int) -> pa.StructArray:
    """Runs and the collapsed text of every word list of an Arrow array."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.fill_null(lists.flatten().cast(pa.large_string()), "")
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    found = runs_of(codes.astype(np.int64), lengths, min_length, min_copies)
    start, period, length = np.array(found, np.int64).reshape(-1, 3).T
    begin = np.cumsum(lengths) - lengths
    owner = np.searchsorted(np.cumsum(lengths), start, side="right")
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.r_[0, np.cumsum(keep)]
    collapsed = pc.binary_join(
        pa.LargeListArray.from_arrays(pa.array(kept[np.r_[begin, len(words)]], pa.int64()), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string())
    )
    cells = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begin[owner], period, length)], ["start", "period", "length"])
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(lengths)))], pa.int32()), cells)
    return pa.StructArray.from_arrays([runs, collapsed.cast(pa.string())], ["runs", "collapsed"])


def _groups(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of the array with about GROUP_WORDS words each; a longer text is a slice of its own."""
    sizes = lists.value_lengths().fill_null(0).to_pylist()
    begin, filled = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and filled + size > GROUP_WORDS:
            yield lists.slice(begin, i - begin)
            begin, filled = i, 0
        filled += size
    yield lists.slice(begin)


def with_runs(docs: DataFrame, words_col: str, out: str = "periods", min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> DataFrame:
    """The documents with a struct column `out` for a column of word lists: runs and collapsed.

    A run is a stretch of consecutive words with smallest period q, at least `min_length` words and `min_copies` x q words long, that no
    neighbouring word extends. `runs` holds (start, period, length) by start and period; `collapsed` is the text
    without the words that a run contains after its first q, joined by blanks. A NULL or empty list has no run and
    an empty text; NULL words count as empty ones; repeated rows are judged each; an empty table stays
    empty. Texts of any length are read whole, and never compared with others. A column already named `out` is replaced.
    """
    if min_copies < 2:
        raise ValueError("a run holds its period at least twice")
    arrow_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.concat_arrays([_periods(part, min_length, min_copies) for part in _groups(lists)])

    return docs.withColumn(out, run(F.col(words_col)))


def repeated_tail(docs: DataFrame, id_col: str, words_col: str) -> DataFrame:
    """The word lists of the contract: of every tenth document by hash, the words from a place on repeat with a period."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    n = F.size(words_col)
    drawn = docs.withColumn("_g", F.when((fold % 10 == 0) & (n > 0), F.floor(fold / 10)))
    placed = drawn.withColumn("_a", (F.col("_g") % n).cast("int"))
    sized = placed.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    a, p, words = F.col("_a"), F.col("_p"), F.col(words_col)
    tail = F.transform(words, lambda w, i: F.when(i >= a, F.get(words, a + (i - a) % p)).otherwise(w))
    return sized.withColumn(words_col, F.when(F.col("_g").isNotNull(), tail).otherwise(words)).drop("_g", "_a", "_p")


def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0)).alias("words"))
    found = with_runs(repeated_tail(words, "doc_id", "words"), "words").select("doc_id", "periods.runs", "periods.collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    listed = found.withColumn("best", best)
    return listed.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict = {}
