"""Language identification: script ranges, per-word scores and Viterbi spans with a switching penalty."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, fold, table
from galleryloom.session import materialize

# The model is fitted on about this many labelled texts, shared among the languages, but on about LANGUAGE_TEXTS of each
# language at least (all where it has fewer), and keeps this many letter groups.
TRAIN_DOCUMENTS = 8192
LANGUAGE_TEXTS = 512
MAX_GRAMS = 200_000
MAX_LANGUAGES = 200
GRAM = 3
# Cost, in log units, of changing the language between two words.
SWITCH_PENALTY = 12.0
# A language is a candidate for a script when the script holds at least this share of its words.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
SEGMENT = 128
# Texts are labelled in groups of about this many characters, with tables of at most about this many cells.
GROUP_CHARS = 1_000_000
SCORE_CELLS = 2_000_000
# Letter groups are turned into keys so many at a time.
KEY_GROUPS = 20_000
UNDETERMINED = "und"

# First and last code point of the blocks that letters of a script come from.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<lang:string,score:double,spans:array<struct<lang:string,start:long,end:long,letters:long>>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def script_of(word: str) -> str:
    point = ord(word[0])
    return next((name for name, low, high in SCRIPT_RANGES if low <= point <= high), "other")


def grams_of(word: str) -> list[str]:
    """Overlapping letter groups of the word between boundary marks, and the word itself."""
    marked = f"^{word}$"
    return [marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))] + [marked]


_LOW = np.array([low for _, low, _ in SCRIPT_RANGES])
_HIGH = np.array([high for _, _, high in SCRIPT_RANGES])
_SCRIPTS = sorted({name for name, _, _ in SCRIPT_RANGES}) + ["other"]
_SCRIPT_OF_RANGE = np.array([_SCRIPTS.index(name) for name, _, _ in SCRIPT_RANGES])


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of every number, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the letter groups of words between marks, word after word, and the number of each word's groups.

    Three letters fill 63 bits as they are; a whole word of more is a hash with the top bit set.
    """
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    inside = (np.arange(len(letters)) - np.repeat(begin, sizes)).astype(np.uint64)
    triple = np.zeros(len(letters), np.uint64)
    triple[:-2] = (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]
    spread = _mixed(letters + (inside + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    whole = _mixed(np.add.reduceat(spread, begin)) | np.uint64(1 << 63)
    whole = np.where(sizes == GRAM, triple[begin], whole)
    counts = sizes - GRAM + 2  # the groups of three, and the word
    out = np.empty(int(counts.sum()), np.uint64)
    last = np.cumsum(counts) - 1
    threes = np.ones(len(out), bool)
    threes[last] = False
    out[threes] = triple[(inside + np.uint64(GRAM)).astype(np.int64) <= np.repeat(sizes, sizes)]
    out[last] = whole
    return out, counts


@dataclass
class Scorer:
    """What a worker needs of a model: sorted 64-bit keys of the letter groups, and their log probabilities per language.

    Nothing is remembered from one group of texts to the next, so a worker's memory does not grow with the corpus.
    """

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(languages that are candidates of any word, their scores per word).

        The script of a word narrows its candidates; a language that does not write it scores minus infinity.
        """
        places, different = pd.factorize(np.array(words, object))
        first = np.fromiter((ord(w[0]) for w in different), np.int64, len(different))
        span = np.searchsorted(_LOW, first, side="right") - 1
        script = np.where((span >= 0) & (first <= _HIGH[span]), _SCRIPT_OF_RANGE[span], len(_SCRIPTS) - 1)
        used = np.flatnonzero(self.allowed[np.unique(script)].any(axis=0))
        weights = self.weights[:, used] if len(used) < len(self.languages) else self.weights
        scores = np.empty((len(different), len(used)), np.float32)
        step = max(1, SCORE_CELLS // (8 * len(used)))
        for at in range(0, len(different), step):
            keys, counts = gram_keys([f"^{w}$" for w in different[at : at + step]])
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1) if len(self.keys) else np.zeros(len(keys), np.int64)
            rows = np.where(self.keys[found] == keys, found, len(self.keys)) if len(self.keys) else found
            scores[at : at + step] = np.add.reduceat(weights[rows], np.cumsum(counts) - counts, axis=0)
        scores[~self.allowed[script][:, used]] = -np.inf
        return used, scores[places]


@dataclass
class Model:
    """Letter groups, as an Arrow array, with a row of log probabilities per language; the last row is that of an unseen group."""

    languages: list[str]
    groups: pa.Array
    weights: np.ndarray
    scripts: dict[str, np.ndarray]

    @property
    def rows(self) -> dict[str, int]:
        """The row of every letter group."""
        return {group: i for i, group in enumerate(self.groups.to_pylist())}

    def scorer(self) -> Scorer:
        """The packed form that is sent to the workers."""
        keys = [np.zeros(0, np.uint64)]
        for at in range(0, len(self.groups), KEY_GROUPS):
            found, counts = gram_keys(self.groups.slice(at, KEY_GROUPS).to_pylist())
            keys.append(found[np.cumsum(counts) - 1])
        joined = np.concatenate(keys)
        order = np.argsort(joined)
        every = np.ones(len(self.languages), bool)
        allowed = np.array([self.scripts.get(name, every) for name in _SCRIPTS])
        return Scorer(self.languages, joined[order], np.vstack([self.weights[order], self.weights[-1:]]), allowed)


def _entries(scores: np.ndarray, begin: np.ndarray, order: np.ndarray, penalty: np.float32) -> np.ndarray:
    """Per segment, the value of the best path that ends before it, for every language, less the best of them.

    The best ways through a segment are found for every language it may be entered with, a bounded number of
    segments side by side; the segments of a text are then chained.
    """
    width = scores.shape[1]
    entry = np.zeros((len(begin), width), np.float32)
    inner = np.flatnonzero(np.r_[order[1:] > 0, False])
    step = max(1, SCORE_CELLS // width**2)
    for at in range(0, len(inner), step):
        own = inner[at : at + step]
        best = np.full((len(own), width, width), -np.inf, np.float32)
        best[:, np.arange(width), np.arange(width)] = 0
        for t in range(SEGMENT):
            np.maximum(best, best.max(axis=2, keepdims=True) - penalty, out=best)
            best += scores[begin[own] + t][:, None, :]
        for i, ways in zip(own.tolist(), best):
            reach = (entry[i][:, None] + ways).max(axis=0)
            entry[i + 1] = reach - reach.max()
    return entry


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word for texts laid end to end: word scores minus `penalty` per change, ties stay.

    Texts are cut into segments whose entry values are known from `_entries`; all segments then step side by side, so
    long texts cost no more steps than short ones. Memory is one cell per word and language.
    """
    count, width = scores.shape
    pieces = -(-lengths // SEGMENT)
    total = int(pieces.sum())
    if not total:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(lengths)), pieces)
    order = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + order * SEGMENT
    size = np.minimum(SEGMENT, lengths[text] - order * SEGMENT)
    penalty = np.float32(penalty)
    reach = _entries(scores, begin, order, penalty)
    came = np.zeros((count, width), np.uint8)
    every = np.arange(width, dtype=np.uint8)
    by_size = np.argsort(-size, kind="stable")
    open_at = np.searchsorted(-size[by_size], -np.arange(int(size.max())), side="left")  # segments with more than t words
    for t, live in enumerate(by_size[:n] for n in open_at):
        now = reach[live]
        top = now.argmax(axis=1)
        jump = now[np.arange(len(live)), top][:, None] - penalty
        stay = now >= jump
        came[begin[live] + t] = np.where(stay, every, top[:, None].astype(np.uint8))
        reach[live] = np.where(stay, now, jump) + scores[begin[live] + t]
    # The language in front of a segment, for every language it may end with.
    origin = np.tile(every, (total, 1))
    for t in range(len(open_at) - 1, -1, -1):
        live = by_size[: open_at[t]]
        origin[live] = np.take_along_axis(came[begin[live] + t], origin[live], 1)
    last = np.r_[order[1:] == 0, True]
    final = reach.argmax(axis=1).tolist()
    left, state = np.zeros(total, np.uint8), 0
    for i in range(total - 1, -1, -1):
        state = final[i] if last[i] else state
        left[i] = state
        state = int(origin[i, state])
    label = np.zeros(count, np.int64)
    for t in range(len(open_at) - 1, -1, -1):
        live = by_size[: open_at[t]]
        label[begin[live] + t] = left[live]
        left[live] = came[begin[live] + t, left[live]]
    return label


def text_groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[list[str | None]]:
    """Texts in groups of about `limit` characters, so that the path tables of a batch stay small."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def label_texts(model: Scorer, texts: list[str | None], penalty: float) -> list[tuple]:
    """(language, score, spans) per text; spans are (language, first word, word behind the last, letters)."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    if not flat:
        return [(UNDETERMINED, 0.0, [])] * len(texts)
    used, scores = model.word_scores(flat)
    label = used[viterbi(scores, lengths, penalty)]
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    out, at = [], 0
    for n in lengths:
        if not n:
            out.append((UNDETERMINED, 0.0, []))
            continue
        own, weight = label[at : at + n], letters[at : at + n]
        share = np.bincount(own, weight, len(model.languages))
        cuts = np.flatnonzero(np.diff(own)) + 1
        edges = np.r_[0, cuts, n]
        sums = np.add.reduceat(weight, edges[:-1])
        spans = [
            {"lang": model.languages[own[a]], "start": int(a), "end": int(b), "letters": int(s)}
            for a, b, s in zip(edges[:-1], edges[1:], sums)
        ]
        out.append((model.languages[int(share.argmax())], float(share.max() / share.sum()), spans))
        at += n
    return out


def quotas(sizes: dict[str, int], documents: int, least: int) -> dict[str, int]:
    """Texts to take per language: what small languages leave of `documents` goes to the larger ones; never under `least`."""
    left, out = documents, {}
    for i, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(size, max(least, left // (len(sizes) - i)))
        left = max(0, left - out[lang])
    return out


def training_texts(labelled: DataFrame, documents: int, least: int = LANGUAGE_TEXTS) -> DataFrame:
    """Different (lang, text) pairs, about `quotas` of each language, picked by a hash of the text."""
    hashed = labelled.withColumn("_hash", F.xxhash64("text", F.lit(7)))
    different = hashed.select("lang", "_hash").distinct()
    found = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn: map or filter the labels first")
    sizes = {r.lang: r.n for r in found}
    keep = F.lit(False)
    for lang, quota in quotas(sizes, documents, least).items():
        place = F.shiftrightunsigned("_hash", 1)
        picked = F.lit(True) if quota >= sizes[lang] else place < int(2**63 * quota / sizes[lang])
        keep = keep | ((F.col("lang") == F.lit(lang)) & picked)
    return hashed.where(keep).dropDuplicates(["lang", "_hash"]).drop("_hash")


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", documents: int = TRAIN_DOCUMENTS, max_grams: int = MAX_GRAMS
) -> Model:
    """Learn from about `documents` different labelled texts, shared among all languages, picked by a hash of the text.

    Every language is learned, from all its texts where it has few. Letter groups are counted by Spark; the
    `max_grams` groups with the largest share of a language reach the driver. More than MAX_LANGUAGES languages are an
    error. Rows without text or language teach nothing; copies of a text teach once.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    labelled = training_texts(labelled, documents)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text, lang in zip(batch["text"], batch["lang"]):
                for word, times in Counter(words_of(text)).items():
                    seen[lang, "script", script_of(word)] += times
                    for gram in grams_of(word):
                        seen[lang, "gram", gram] += times
            rows = [(*key, n) for key, n in seen.items()]
            yield pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])

    counts = labelled.mapInPandas(count, "lang string, kind string, item string, n long")
    counts = materialize(counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "letter-groups")
    grams = counts.where("kind = 'gram'")
    found = grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()
    languages = sorted(r.lang for r in found)
    place = {lang: i for i, lang in enumerate(languages)}
    # A group counts by its largest share of a language, so small languages keep their groups next to large ones.
    sums = F.create_map(*[F.lit(x) for r in found for x in (r.lang, float(r.n))]) if found else F.create_map().cast("map<string,double>")
    numbers = F.create_map(*[F.lit(x) for item in place.items() for x in item]) if found else F.create_map().cast("map<string,int>")
    entry = F.struct(numbers[F.col("lang")].cast("int").alias("place"), "n")
    known = grams.where(F.col("lang").isin(languages))
    best = known.groupBy("item").agg(F.max(F.col("n") / sums[F.col("lang")]).alias("share"), F.collect_list(entry).alias("entries"))
    # Arrow columns with the counts that are not 0: no row objects, and no broadcast of the groups.
    kept = best.orderBy(F.desc("share"), "item").limit(max_grams).select("item", "entries").toArrow().combine_chunks().sort_by("item")
    groups = kept["item"].combine_chunks()
    groups = groups if isinstance(groups, pa.Array) else pa.array([], pa.string())
    tally = np.zeros((len(groups) + 1, len(languages)), np.float64)
    if len(groups):
        entries = kept["entries"].combine_chunks()
        owner = np.repeat(np.arange(len(groups)), entries.value_lengths().to_numpy())
        tally[owner, entries.flatten().field("place").to_numpy()] = entries.flatten().field("n").to_numpy()
    del kept
    scripts: dict[str, Counter] = {}
    for row in counts.where("kind = 'script'").collect():
        if row.lang in place:
            scripts.setdefault(row.item, Counter())[row.lang] = row.n
    weights = np.log(tally + SMOOTHING) - np.log(tally.sum(axis=0) + SMOOTHING * len(tally))
    by_lang: Counter = Counter()
    for counts_of in scripts.values():
        by_lang.update(counts_of)
    allowed = {
        script: np.array([counts_of[lang] >= SCRIPT_SHARE * by_lang[lang] for lang in languages])
        for script, counts_of in scripts.items()
    }
    return Model(languages, groups, weights.astype(np.float32), {s: a for s, a in allowed.items() if a.any()})


def identify(text: Column, model: Model, spark, penalty: float = SWITCH_PENALTY) -> Column:
    """Struct column of a text column: lang, score (share of letters in that language) and word spans."""
    shared = spark.sparkContext.broadcast(model.scorer())

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            if own.languages:
                rows = [row for group in text_groups(list(texts)) for row in label_texts(own, group, penalty)]
            else:
                rows = [(UNDETERMINED, 0.0, [])] * len(texts)
            yield pd.DataFrame(rows, columns=["lang", "score", "spans"])

    return run(text)


def with_language(
    docs: DataFrame, model: Model, out: str = "language", text_col: str = "text", penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """The documents with a struct column `out`: lang, score, spans.

    Candidates of a word are the languages that use its script; a script no language uses leaves all. NULL,
    empty and letterless texts get `und` with score 0 and no span, as does every text when nothing was
    learned. Ties go to the first language in alphabetical order. A column already named `out` is replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    return docs.withColumn(out, identify(F.col(text_col), model, spark, penalty))


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """The documents in one of `languages` (any learned one by default); texts without a language go."""
    found = with_language(docs, model, "_llm_language")
    wanted = F.col("_llm_language.lang").isin(languages if languages is not None else model.languages)
    return found.where(wanted).select(*docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may teach: those outside the held-out fold."""
    return docs.where(fold("doc_id", 4) != 2)


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), "language.spans",
    )


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict = {}
