"""Benchmark decontamination: a generalised suffix automaton over the words of all test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, table
from galleryloom.session import materialize

WINDOW = 10
# Items go to the tasks as one automaton per slice of at most this many bytes of text.
SLICE_BYTES = 16 << 20
# A document with at least this share of its words in matched spans is dropped; below, the spans are cut out.
MAX_COVERAGE = 0.5
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long,longest:long>>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of digits, a-z and everything beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Suffix automaton of many word sequences: every path from the root is a run of words of some item.

    `steps[s]` maps a word number to the next state, `link[s]` is the longest proper suffix state and
    `length[s]` the longest run that ends in state s. `owners[s]` lists the windows that end in s, as
    (words, item numbers).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        owned: dict[int, dict[int, set[int]]] = {}
        for number, sequence in enumerate(sequences):
            size = min(window, len(sequence))
            for place, (state, _) in enumerate(self.walk(sequence)):
                if size and place + 1 >= size:
                    owned.setdefault(self._suffix(state, size), {}).setdefault(size, set()).add(number)
        self.shortest = min((min(window, len(s)) for s in sequences if s), default=0)
        # A window that ends in a suffix state also ends wherever that state's longer runs end.
        self.owners: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple((size, frozenset(who)) for size, who in owned.get(state, {}).items())
            self.owners[state] = self.owners[self.link[state]] + own

    def _new(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.steps.append(steps)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of `target` for the runs that end with the longest run of `state` and `word`."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.steps[target]))
        self.link[target] = copy
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.steps[last].get(word)
        if target is not None:  # an earlier item has this run already
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        fresh = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.steps[last]:
            self.steps[last][word] = fresh
            last = self.link[last]
        if last >= 0:
            target = self.steps[last][word]
            self.link[fresh] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return fresh

    def _suffix(self, state: int, size: int) -> int:
        """The state that holds the last `size` words of the runs of `state`."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def walk(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """Per word, the state and length of the longest run of some item that ends there."""
        state, matched = 0, 0
        for word in sequence:
            while state and word not in self.steps[state]:
                state = self.link[state]
                matched = self.length[state]
            following = self.steps[state].get(word)
            state, matched = (0, 0) if following is None else (following, matched + 1)
            yield state, matched

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[int]]:
        """Spans [start, end) of words inside occurrences of windows, with the longest run in each, and the items."""
        if not self.shortest:
            return [], set()
        numbers = list(map(self.vocabulary.get, words))
        spans: list[list[int]] = []
        found: set[int] = set()
        place, total = 0, len(numbers)
        while place < total:
            if numbers[place] is None:
                place += 1
                continue
            end = place
            while end < total and numbers[end] is not None:
                end += 1
            if end - place >= self.shortest:
                for at, (state, matched) in enumerate(self.walk(numbers[place:end]), place + 1):
                    longest = 0
                    if matched >= self.shortest:
                        for size, who in self.owners[state]:
                            if size <= matched:
                                found |= who
                                longest = max(longest, size)
                    if longest:
                        if spans and at - longest <= spans[-1][1]:
                            # a wider window may reach behind the start of the last span, or spans before it
                            start = at - longest
                            while len(spans) > 1 and start <= spans[-2][1]:
                                last = spans.pop()
                                spans[-1][2] = max(spans[-1][2], last[2])
                            spans[-1][0] = min(spans[-1][0], start)
                            spans[-1][1], spans[-1][2] = at, max(spans[-1][2], matched)
                        else:
                            spans.append([at - longest, at, matched])
            place = end
        return [tuple(s) for s in spans], found


def _found(automaton: Automaton, text: str | None) -> tuple[int, int, list[str], list[dict]]:
    """(words, words hit, items, spans) of a text."""
    words = words_of(text)
    spans, found = automaton.scan(words)
    names = sorted({automaton.names[i] for i in found})
    return len(words), sum(e - s for s, e, _ in spans), names, [{"start": s, "end": e, "longest": n} for s, e, n in spans]


def _matches(text: Column, items: list[tuple[str, str]], window: int) -> Column:
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([(name, words_of(t)) for name, t in items], window)
        for texts in batches:
            yield pd.DataFrame([_found(automaton, text) for text in texts], columns=["n_words", "n_hit", "items", "spans"])

    return run(text)


def item_slices(items: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = SLICE_BYTES) -> list:
    """Test items in slices of about `limit` bytes, each small enough for one automaton in a task.

    Returns functions that read a slice, so that only one at a time is on the driver. Items without id or words
    are left out.
    """
    named = items.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    count = max(1, -(-int(size) // limit))
    marked = named.withColumn("slice", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
    marked = materialize(marked, "items") if count > 1 else marked
    return [lambda i=i: [(r.name, r.text) for r in marked.where(F.col("slice") == i).select("name", "text").collect()] for i in range(count)]


def _combine(columns: list[Column]) -> Column:
    """Results of several slices as one: spans are merged where they touch."""
    if len(columns) == 1:
        return columns[0]
    spans = F.array_sort(F.flatten(F.array(*[c["spans"] for c in columns])))
    kind = "array<struct<start:long,end:long,longest:long>>"

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
            F.greatest(last["longest"], span["longest"]).alias("longest"),
        )
        apart = (F.size(done) == 0) | (span["start"] > F.try_element_at(done, F.lit(-1))["end"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        )

    merged = F.aggregate(spans, F.array().cast(kind), add)
    hit = F.aggregate(merged, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[c["items"] for c in columns]))))
    return F.struct(columns[0]["n_words"].alias("n_words"), hit.alias("n_hit"), items.alias("items"), merged.alias("spans"))


def with_matches(
    docs: DataFrame, items: DataFrame, out: str = "matches", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The documents with a struct column `out`: n_words, n_hit, items (ids as text) and spans.

    A window is `window` consecutive words of an item, or the whole of a shorter item that has words. A
    span is a maximal run of touching or overlapping window occurrences, in word positions; `longest` is the longest
    run of item words that ends in it. NULL and wordless texts have no words and no hits; tied items are all
    named; repeated rows are matched each; with no items nothing is hit. A column already named `out` is replaced.
    """
    arrow_batches(docs.sparkSession)
    slices = item_slices(items, item_col, "text", slice_bytes)
    if len(slices) == 1:
        return docs.withColumn(out, _matches(F.col(text_col), slices[0](), window))
    # One slice after the other: its automata are gone before those of the next are built.
    names = [f"_llm_slice_{i}" for i in range(len(slices))]
    found = docs
    for name, read in zip(names, slices):
        found = materialize(found.withColumn(name, _matches(F.col(text_col), read(), window)), "slice-matches")
    return found.withColumn(out, _combine([F.col(n) for n in names])).drop(*names)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    keep, at = [], 0
    for start, end in spans:
        keep.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE
) -> DataFrame:
    """The documents without test material.

    Spans of at least `window` matched words (or whole shorter items) are cut out of the text; a document with a share of
    hit words of `max_coverage` or more is dropped. Documents without a hit are returned as they are.
    """
    arrow_batches(docs.sparkSession)
    slices = item_slices(items)
    if len(slices) > 1:
        found = with_matches(docs, items, "_llm_matches", text_col, window=window)

        @F.pandas_udf("string")
        def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([cut_spans(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(texts, spans)], dtype=object)

        hit, words = F.col("_llm_matches.n_hit"), F.col("_llm_matches.n_words")
        cleaned = found.where((hit == 0) | (hit < max_coverage * words)).withColumn("_llm_cut", cut(F.coalesce(F.col(text_col), F.lit("")), "_llm_matches.spans"))
        return cleaned.withColumn(text_col, F.when(hit > 0, F.col("_llm_cut")).otherwise(F.col(text_col))).select(*docs.columns)
    listed = slices[0]()

    @F.pandas_udf("struct<kept:boolean,cut:string>")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([(name, words_of(t)) for name, t in listed], window)
        for texts in batches:
            out = []
            for text in texts:
                words, hit, _, spans = _found(automaton, text)
                kept = hit == 0 or hit < max_coverage * words
                out.append((kept, cut_spans(text, [(s["start"], s["end"]) for s in spans]) if kept and hit else None))
            yield pd.DataFrame(out, columns=["kept", "cut"])

    # Not deterministic in name only: the optimizer would else run the function once for the filter and once for the text.
    found = docs.withColumn("_llm_clean", clean.asNondeterministic()(F.col(text_col))).where("_llm_clean.kept")
    return found.withColumn(text_col, F.coalesce(F.col("_llm_clean.cut"), F.col(text_col))).select(*docs.columns)


def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark"))
    m = F.col("matches")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ",").cast("binary"), 256).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT item, least({WINDOW}, len(w)) AS size, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, size, array_to_string(w[p:p + size - 1], ' ') AS gram FROM windows),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, places.size, p, item FROM places JOIN grams ON grams.size = places.size
  AND gram = array_to_string(w[p:p + places.size - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {"op5_decontaminate": ORACLE}
