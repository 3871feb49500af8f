"""N-grams counted in blocks of texts: integers that are sorted, instead of one row per n-gram.

Spark places and aggregates; a task cuts a block of its texts at a time. Every character or token of a block is a number,
an n-gram the number of its units in base of the alphabet, and one sort per length counts the n-grams of every text.
Terms become text once per block, if at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Characters or tokens of a block; a longer text is a block of its own.
BLOCK_UNITS = 1 << 20
STATS_UNITS = 1 << 21
BATCH_ROWS = 1 << 18
# Codes stay below this.
CODES = 1 << 62
# Term counts are merged within a task once so many are new, and leave it once it holds MERGE_TERMS different terms.
MERGE_ROWS = 1 << 20
MERGE_TERMS = 1 << 21
# Pieces that terms are shuffled by, per shuffle partition and at most; a piece is merged at once.
PIECES = 16
MOST_PIECES = 4096
HASHED_TERMS = 1 << 18
HASH_BASE = 6364136223846793005


@dataclass
class Grams:
    """The n-grams of one length in a block: per text and term a row (text number, term number, count)."""

    texts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    alphabet: object

    @property
    def names(self) -> pa.Array:
        return _names(self.units, self.alphabet)


def _names(units: np.ndarray, alphabet) -> pa.Array:
    """The terms of rows of units: characters are joined as they are, tokens by a space."""
    n = units.shape[1]
    if isinstance(alphabet, np.ndarray):
        text = alphabet[units].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string())
    columns = [alphabet.take(pa.array(units[:, i])) for i in range(n)]
    return columns[0] if n == 1 else pc.binary_join_element_wise(*columns, " ")


def _joined(column: pa.Array) -> str:
    """All texts of a column as one, without a Python string for each."""
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, "<i8" if pa.types.is_large_string(column.type) else "<i4")[column.offset :]
    return str(memoryview(data)[edges[0] : edges[len(column)]], "utf-8") if len(column) and data is not None else ""


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, object]:
    """Units of texts (characters) or token lists as numbers of an alphabet, and the units per row."""
    if pa.types.is_list(column.type):
        coded = column.flatten().dictionary_encode()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths, coded.dictionary
    points = np.frombuffer(_joined(column).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(points.max(initial=0)) + 1, np.int64)
    seen[points] = 1
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = np.arange(len(alphabet))
    return seen[points], pc.utf8_length(column).to_numpy(zero_copy_only=False), alphabet


def cut(column: pa.Array, shortest: int, longest: int) -> Iterator[Grams]:
    """All n-grams inside the rows of a block, length by length."""
    units, lengths, alphabet = _units(column)
    lengths = lengths.astype(np.int64)
    base, bound, code = max(len(alphabet), 1), max(len(alphabet), 1), units
    texts = np.repeat(np.arange(len(lengths)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(units))
    tables: dict[int, np.ndarray] = {}

    def spelled(codes: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(codes), n), np.int64)
        for k in range(n - 1, 0, -1):
            codes, out[:, k] = np.divmod(codes, base)
            codes = tables[k][codes] if k in tables else codes
        out[:, 0] = codes
        return out

    for n in range(1, longest + 1):
        if len(units) < n:
            return
        if n > 1:
            if bound * base >= CODES:
                tables[n - 1], code = np.unique(code, return_inverse=True)
                bound = len(tables[n - 1])
            code = code[:-1] * base + units[n - 1 :]
            bound *= base
        if n < shortest:
            continue
        at = np.flatnonzero(room[: len(code)] >= n)
        own, size, table = code[at], bound, None
        if size * len(lengths) >= CODES:
            table, own = np.unique(own, return_inverse=True)
            size = max(len(table), 1)
        keys = texts[at] * size + own
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(keys)])
        owner, found = np.divmod(keys[first], size)
        distinct, terms = np.unique(found, return_inverse=True)
        yield Grams(owner, terms, counts, spelled(distinct if table is None else table[distinct], n), alphabet)


def blocks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in groups of about `limit` units."""
    items = batch.column(column)
    sizes = items.value_lengths() if pa.types.is_list(items.type) else pc.utf8_length(items)
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def term_stats(units: DataFrame, shortest: int, longest: int, column: str = "units", least: int = 1) -> DataFrame:
    """(term, df, total): rows that hold each n-gram and its occurrences, of terms in at least `least` rows.

    A task adds up the counts of its blocks and sends the terms sorted and packed, by pieces that a hash of the term chooses: a row
    per term would take several times the room.
    """
    pieces = min(PIECES * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, fresh, rows = None, [], 0
        for batch in batches:
            for block in blocks(batch, column, STATS_UNITS):
                for g in cut(block.column(column), shortest, longest):
                    df = np.bincount(g.terms, minlength=len(g.units))
                    total = np.bincount(g.terms, g.counts, len(g.units)).astype(np.int64)
                    fresh.append(pa.table({"term": g.names.cast(pa.string()), "df": pa.array(df, pa.int64()), "total": pa.array(total, pa.int64())}))
                    rows += len(df)
                if rows >= max(MERGE_ROWS, main.num_rows if main else 0):
                    main, fresh, rows = _merged_stats([*([main] if main else []), *fresh]), [], 0
                    if main.num_rows >= MERGE_TERMS:
                        yield from _packed(main, pieces)
                        main = None
        if fresh or main:
            yield from _packed(_merged_stats([*([main] if main else []), *fresh]), pieces)

    def merge(packed: pa.Table) -> pa.Table:
        found = _merged_stats([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed["terms"]])
        return found.filter(pc.greater_equal(found["df"], least))

    return units.select(column).mapInArrow(run, "piece int, terms binary").groupBy("piece").applyInArrow(merge, "term string, df long, total long")


def _merged_stats(tables: list[pa.Table]) -> pa.Table:
    """(term, df, total) with every term once."""
    found = pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
    return pa.table({"term": found["term"].combine_chunks(), "df": found["df_sum"], "total": found["total_sum"]}).combine_chunks()


def _term_hashes(terms: pa.Array) -> np.ndarray:
    """A number per text from its bytes alone: sums of byte times power of HASH_BASE modulo 2^64, taken from running sums."""
    parts = [np.zeros(0, np.uint64)]
    for begin in range(0, len(terms), HASHED_TERMS):
        part = terms.slice(begin, HASHED_TERMS)
        edges = np.frombuffer(part.buffers()[1], "<i4")[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = part.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].astype(np.uint64) + np.uint64(1) if data is not None else np.zeros(0, np.uint64)
        edges -= edges[0]
        powers, inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(raw), x, np.uint64)]) for x in (HASH_BASE, pow(HASH_BASE, -1, 1 << 64)))
        upto = np.r_[np.uint64(0), np.add.accumulate(raw * powers[:-1])]
        parts.append((upto[edges[1:]] - upto[edges[:-1]]) * inverse[edges[:-1]])
    return np.concatenate(parts)


def _packed(stats: pa.Table, pieces: int) -> Iterator[pa.RecordBatch]:
    """Rows (piece, terms): the terms of a piece in their order, as compressed Arrow data."""
    piece = pa.array((_term_hashes(stats["term"].combine_chunks()) >> np.uint64(33)) % np.uint64(pieces), pa.int32())
    ordered = stats.append_column("piece", piece).sort_by([("piece", "ascending"), ("term", "ascending")])
    numbers = ordered["piece"].to_numpy()
    ordered = ordered.drop_columns("piece")
    starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, int)
    for a, b in zip(starts, np.r_[starts[1:], len(numbers)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ordered.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(ordered.slice(a, b - a).combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([numbers[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece", "terms"])


def pair_counts(units: DataFrame, column: str = "units") -> DataFrame:
    """(a, b, n): tokens (b is NULL) and adjacent pairs of token lists with their occurrences in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, column, STATS_UNITS):
                for g in cut(block.column(column), 1, 2):
                    total = pa.array(np.bincount(g.terms, g.counts, len(g.units)).astype(np.int64))
                    a, *b = (g.alphabet.take(pa.array(u)) for u in g.units.T)
                    yield pa.RecordBatch.from_arrays([a, b[0] if b else pa.nulls(len(a), a.type), total], ["a", "b", "n"])

    return units.select(column).mapInArrow(run, "a string, b string, n long")


def _spelling(terms: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray, object]:
    """Units of terms as numbers of an alphabet, units per term, and the alphabet."""
    return _units(pc.split_pattern(terms, " ") if words else terms)


class Vocabulary:
    """Terms with their idf, of a size that may be broadcast.

    A term is known by the number of its units in base of the vocabulary's alphabet; a sorted list of these per length is
    searched. Terms whose numbers would exceed CODES are looked up as text.
    """

    def __init__(self, terms: pa.Array, words: bool, idf: np.ndarray | None = None):
        self.terms, self.words, self.idf = terms, words, idf
        units, lengths, alphabet = _spelling(terms, words)
        starts = np.cumsum(lengths) - lengths
        self.base, self.alphabet = max(len(alphabet), 1), alphabet
        self.codes: dict[int, tuple[np.ndarray, np.ndarray]] | None = {}
        for n in map(int, np.unique(lengths)):
            if self.base**n >= CODES:
                self.codes = None
                break
            places = np.flatnonzero(lengths == n)
            code = self._numbers(units[starts[places][:, None] + np.arange(n)])
            order = np.argsort(code)
            self.codes[n] = code[order], places[order].astype(np.int32)

    @staticmethod
    def of(table: pa.Table, words: bool) -> Vocabulary:
        """A table of terms with their idf."""
        return Vocabulary(table["term"].combine_chunks(), words, table["idf"].combine_chunks().to_numpy(zero_copy_only=False))

    def _numbers(self, units: np.ndarray) -> np.ndarray:
        code = np.zeros(len(units), np.int64)
        for k in range(units.shape[1]):
            code = code * self.base + units[:, k]
        return code

    def _translated(self, alphabet) -> np.ndarray:
        """The numbers of another alphabet's units here, -1 for unknown ones."""
        if isinstance(alphabet, np.ndarray):
            place = np.minimum(np.searchsorted(self.alphabet, alphabet), len(self.alphabet) - 1)
            return np.where(self.alphabet[place] == alphabet, place, -1)
        return pc.index_in(alphabet.cast(pa.string()), value_set=self.alphabet.cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _places(self, g: Grams) -> np.ndarray:
        """The numbers of a block's terms here, -1 for unknown ones."""
        if self.codes is None:
            found = pc.index_in(_names(g.units, g.alphabet).cast(self.terms.type), value_set=self.terms)
            return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = g.units.shape[1]
        if n not in self.codes or not len(g.units):
            return np.full(len(g.units), -1)
        codes, places = self.codes[n]
        units = self._translated(g.alphabet)[g.units]
        wanted = self._numbers(units)
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return np.where((units >= 0).all(axis=1) & (codes[at] == wanted), places[at], -1)

    def adjacent(self, codes: np.ndarray, names: pa.Array) -> np.ndarray:
        """For numbers of names (-1: none), whether each one and the next are a term of two units here."""
        found = np.zeros(len(codes), bool)
        if not len(self.terms) or len(codes) < 2:
            return found
        place = np.append(self._translated(names), -1)[codes]
        at = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
        wanted = place[at] * self.base + place[at + 1]
        pairs = self.codes[2][0]
        found[at] = pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted
        return found

    def known(self, block: pa.Array, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of all known n-grams of a block."""
        parts = [(np.zeros(0, np.int64),) * 3]
        for g in cut(block, shortest, longest) if len(self.terms) else ():
            place = self._places(g)[g.terms]
            held = place >= 0
            parts.append((g.texts[held], place[held], g.counts[held]))
        return tuple(np.concatenate(x) for x in zip(*parts))


def weighted(units: DataFrame, keep: list[str], shortest: int, longest: int, vocabulary: Vocabulary, column: str = "units") -> DataFrame:
    """`keep` columns, term, weight: count x idf with unit length per row."""
    shared = units.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for block in blocks(batch, column, BLOCK_UNITS):
                texts, terms, counts = own.known(block.column(column), shortest, longest)
                raw = counts * own.idf[terms]
                weight = raw / np.sqrt(np.bincount(texts, raw * raw, block.num_rows))[texts]
                for i in range(0, len(texts), BATCH_ROWS):
                    part = slice(i, i + BATCH_ROWS)
                    at = pa.array(texts[part])
                    columns = [block.column(c).take(at) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, own.terms.take(pa.array(terms[part])), pa.array(weight[part])], [*keep, "term", "weight"])

    schema = StructType([units.schema[c] for c in keep]).add("term", "string").add("weight", "double")
    return units.select(*keep, column).mapInArrow(run, schema)


def counted_rows(units: DataFrame, keep: list[str], shortest: int, longest: int, column: str = "units") -> DataFrame:
    """`keep` columns, term, tf: the n-grams of every row with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, column, BLOCK_UNITS):
                for g in cut(block.column(column), shortest, longest):
                    names = g.names
                    for i in range(0, len(g.texts), BATCH_ROWS):
                        part = slice(i, i + BATCH_ROWS)
                        at = pa.array(g.texts[part])
                        columns = [block.column(c).take(at) for c in keep]
                        yield pa.RecordBatch.from_arrays([*columns, names.take(pa.array(g.terms[part])), pa.array(g.counts[part], pa.int64())], [*keep, "term", "tf"])

    schema = StructType([units.schema[c] for c in keep]).add("term", "string").add("tf", "long")
    return units.select(*keep, column).mapInArrow(run, schema)


def vector_counter(spark: SparkSession, vocabulary: Vocabulary, shortest: int, longest: int) -> Callable:
    """A function from units to a sparse vector of the counts of all known n-grams."""
    shared = spark.sparkContext.broadcast(vocabulary)
    fields = [pa.field("type", pa.int8()), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.int32())), pa.field("values", pa.list_(pa.float64()))]

    @F.arrow_udf(VectorUDT())
    def run(column: pa.Array) -> pa.Array:
        own, size = shared.value, len(shared.value.terms)
        parts = []
        for block in blocks(pa.RecordBatch.from_arrays([column], ["units"]), "units", BLOCK_UNITS):
            texts, terms, counts = own.known(block.column("units"), shortest, longest)
            order = np.argsort(texts * size + terms)
            edges = pa.array(np.r_[0, np.cumsum(np.bincount(texts, minlength=block.num_rows))], pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x[order], kind)) for x, kind in ((terms, pa.int32()), (counts, pa.float64()))]
            whole = [pa.array(np.full(block.num_rows, x), kind) for x, kind in ((0, pa.int8()), (size, pa.int32()))]
            parts.append(pa.StructArray.from_arrays([*whole, *lists], fields=fields))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    return run


def _phrased(tokens: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """Token lists with known adjacent pairs merged to `a_b`, greedily from the left; NULL tokens leave."""
    coded = tokens.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.string())
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    hit = vocabulary.adjacent(codes, names)
    hit[ends[ends > 0] - 1] = False
    # The last token of a list is never hit, so that a run starts anew in every list.
    place = np.arange(len(codes))
    merge = hit & ((place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1)
    kept = codes >= 0
    kept[1:] &= ~merge[:-1]
    at = np.flatnonzero(merge)
    joined = pc.binary_join_element_wise(names.take(pa.array(codes[at])), names.take(pa.array(codes[at + 1])), "_")
    codes[at] = len(names) + np.arange(len(at))
    edges = np.r_[0, np.cumsum(kept)][np.r_[0, ends]]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.concat_arrays([names, joined]).take(pa.array(codes[kept])))


def merged_pairs(docs: DataFrame, key: str, vocabulary: Vocabulary, column: str = "tokens") -> DataFrame:
    """(key, tokens): adjacent pairs of the vocabulary merged inside the token lists of a block; NULL lists are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, column, BLOCK_UNITS):
                yield pa.RecordBatch.from_arrays([block.column(key), _phrased(block.column(column), shared.value)], [key, "tokens"])

    schema = StructType([docs.schema[key]]).add("tokens", ArrayType(StringType()))
    lists = F.coalesce(column, F.array().cast("array<string>")).alias(column)
    return docs.select(key, lists).mapInArrow(run, schema)
