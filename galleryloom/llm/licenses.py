"""License scans: a positional index of rare licence words, relative positions, and mandatory key phrases."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, table
from galleryloom.llm.decontaminate import words_of

# Rarest shared words of a file and a template that are looked up in the index, and how many of them must agree on a place.
ANCHORS = 3
AGREEING = 2
# Templates travel to every task: an index beyond this many words is an error.
MAX_INDEX_WORDS = 1_000_000
RESULT = "struct<n_words:long,places:array<struct<label:string,base:boolean,start:long,end:long,score:double>>>"


@dataclass(frozen=True)
class Template:
    """A licence notice. It fits a place where at least `share` of its words stand within `slack` words of their place, and
    each of `phrases` (by default the whole notice) stands there word for word."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    slack: int = 0
    share: float = 1.0
    base: bool = False


# Phrases that always count, wherever their words stand consecutively.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
# Notices of common public licences, with the phrases without which the notice is not that licence.
NOTICES = tuple(
    Template(label, text, phrases, 3, 0.6)
    for label, text, phrases in (
        ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
        ("apache-2.0", "apache license version 2 0 january 2004", ("apache license version 2 0",)),
        ("mit", "released under the mit license", ("mit license",)),
        ("mit", "licensed under the mit license", ("mit license",)),
        (
            "mit",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            ("permission is hereby granted free of charge", "to any person obtaining a copy"),
        ),
        ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
        ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
        (
            "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
            ("free software", "gnu general public license"),
        ),
        ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
        ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
        ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
        ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
        ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
        ("cc-by", "licensed under the creative commons attribution license", ("creative commons attribution",)),
        ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
        (
            "bsd", "redistribution and use in source and binary forms with or without modification are permitted",
            ("redistribution and use in source and binary forms",),
        ),
        ("bsd", "licensed under the bsd license", ("bsd license",)),
        ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    )
)
TEMPLATES = BASE + NOTICES


@dataclass
class Index:
    """Postings of all licence words: word → (template, place in it); with the files each word is in."""

    templates: tuple[Template, ...]
    files: dict[bytes, int]
    words: list[list[bytes]] = field(init=False)
    phrases: list[list[list[bytes]]] = field(init=False)
    needed: list[frozenset[bytes]] = field(init=False)
    postings: dict[bytes, dict[int, list[int]]] = field(init=False)
    order: dict[bytes, tuple[int, bytes]] = field(init=False)

    def __post_init__(self):
        self.words = [words_of(t.text) for t in self.templates]
        self.phrases = [[words_of(p) for p in (t.phrases or (t.text,))] for t in self.templates]
        self.needed = [frozenset(w for p in ps for w in p) for ps in self.phrases]
        self.postings = defaultdict(dict)
        for number, words in enumerate(self.words):
            for place, word in enumerate(words):
                self.postings[word].setdefault(number, []).append(place)
        # Highest IDF first, that is the word in the fewest files; ties by word.
        self.order = {w: (self.files.get(w, 0), w) for w in self.postings}

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, its place, share of its words) for every place where a template fits."""
        shared = self.postings.keys() & set(words)
        could = [t for t, needed in enumerate(self.needed) if needed and needed <= shared]
        if not could:
            return []
        at: dict[bytes, list[int]] = defaultdict(list)
        for place, word in enumerate(words):
            if word in shared:
                at[word].append(place)
        out = []
        for number in could:
            template, own = self.templates[number], self.words[number]
            anchors = sorted(shared.intersection(own), key=self.order.__getitem__)[:ANCHORS]
            # An occurrence of an anchor votes for the place where the template would start.
            votes = sorted((p - t, word) for word in anchors for p in at[word] for t in self.postings[word][number])
            for start in _agreed(votes, template.slack, min(AGREEING, len(anchors))):
                share = self._share(words, own, start, template.slack)
                if share >= template.share and self._phrases_stand(words, number, start, template.slack):
                    out.append((number, start, share))
        return out

    @staticmethod
    def _share(words: list[bytes], own: list[bytes], start: int, slack: int) -> float:
        found = sum(word in words[max(0, start + t - slack) : max(0, start + t + slack + 1)] for t, word in enumerate(own))
        return found / len(own)

    def _phrases_stand(self, words: list[bytes], number: int, start: int, slack: int) -> bool:
        low, high = max(0, start - slack), start + len(self.words[number]) + slack
        return all(
            any(words[p : p + len(phrase)] == phrase for p in range(low, min(high, len(words)) - len(phrase) + 1)) for phrase in self.phrases[number]
        )


def _agreed(votes: list[tuple[int, bytes]], slack: int, wanted: int) -> Iterator[int]:
    """Starts with votes of `wanted` different words within `slack` of them, in order."""
    near: Counter = Counter()
    low = high = 0
    last = None
    for start, _ in votes:
        if start == last:
            continue
        last = start
        while high < len(votes) and votes[high][0] <= start + slack:
            near[votes[high][1]] += 1
            high += 1
        while votes[low][0] < start - slack:
            word = votes[low][1]
            near[word] -= 1
            if not near[word]:
                del near[word]
            low += 1
        if len(near) >= wanted:
            yield start


def file_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many of all texts hold each licence word; at most the vocabulary leaves a task or reaches the driver."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame([(w.decode("utf-8", "surrogatepass"), n) for w, n in seen.items()], columns=["word", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode("utf-8", "surrogatepass"): r.n for r in found.collect()}


def build_index(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> Index:
    """The index of the templates, with word counts over all documents."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))
    if sum(len(words_of(t.text)) for t in templates) > MAX_INDEX_WORDS:
        raise ValueError(f"templates of more than {MAX_INDEX_WORDS} words")
    for t in templates:
        if not all(set(words_of(p)) <= set(words_of(t.text)) for p in t.phrases):
            raise ValueError(f"a key phrase of {t.label} has words that its notice lacks")
    return Index(tuple(templates), file_counts(docs, vocabulary, text_col))


def _scan(text: Column, index: Index, spark) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                found = [
                    {
                        "label": own.templates[t].label, "base": own.templates[t].base, "start": max(0, start),
                        "end": min(len(words), start + len(own.words[t])), "score": share,
                    }
                    for t, start, share in own.places(words)
                ]
                rows.append((len(words), sorted(found, key=lambda f: (f["start"], f["end"], f["label"], f["base"]))))
            yield pd.DataFrame(rows, columns=["n_words", "places"])

    return run(text)


def with_licenses(docs: DataFrame, index: Index, out: str = "licenses", text_col: str = "text") -> DataFrame:
    """The documents with a struct column `out`: n_words, and places (label, base, start, end, score) in word positions.

    Per template all of whose mandatory words a text holds, the ANCHORS words that fewest files hold (ties by word) are looked up; starts
    that AGREEING of them name within the slack are verified: share of the template's words in place, then every mandatory
    phrase. `score` is that share, 1 for base phrases. Overlapping places are all listed. NULL and wordless texts have no
    words and places; repeated rows are scanned each; an empty table stays empty. A column already named `out` is replaced.
    """
    arrow_batches(docs.sparkSession)
    return docs.withColumn(out, _scan(F.col(text_col), index, docs.sparkSession))


def labels_of(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def op11_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_licenses(docs, build_index(docs)).select("doc_id", "licenses.n_words", "licenses.places")
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def _listed(words: list[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """SQL for the digest of op11 over plain tables of template words and phrases."""
    index = Index(templates, {})
    rows = ",\n".join(
        f"({i}, '{t.label}', {_listed(index.words[i])}, [{', '.join(_listed(p) for p in index.phrases[i])}], {t.slack}, {t.share}::DOUBLE, {t.base})"
        for i, t in enumerate(templates)
    )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH t(id, label, words, phrases, slack, share, base) AS (VALUES {rows}),
tw AS (SELECT id, label, slack, words[p + 1] AS word, p AS place FROM (SELECT *, unnest(range(len(words))) AS p FROM t)),
needed AS (SELECT id, list_distinct(flatten(phrases)) AS need FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, w[p + 1] AS word, p AS place FROM (SELECT r, w, unnest(range(len(w))) AS p FROM d) WHERE w[p + 1] IN (SELECT word FROM tw)),
held AS (SELECT r, list(DISTINCT word) AS words FROM dw GROUP BY r),
df AS (SELECT word, count(DISTINCT r) AS n FROM dw GROUP BY word),
could AS (SELECT r, id FROM held JOIN needed ON list_has_all(words, need)),
anchors AS (SELECT r, id, word FROM (SELECT could.r, could.id, x.word, row_number() OVER (PARTITION BY could.r, could.id ORDER BY n, x.word) AS k
  FROM could JOIN held ON held.r = could.r JOIN (SELECT DISTINCT id, word FROM tw) x ON x.id = could.id AND list_contains(held.words, x.word)
  JOIN df ON df.word = x.word) WHERE k <= {ANCHORS}),
votes AS (SELECT DISTINCT a.r, a.id, a.word, tw.slack, dw.place - tw.place AS start FROM anchors a JOIN dw ON dw.r = a.r AND dw.word = a.word
  JOIN tw ON tw.id = a.id AND tw.word = a.word),
wanted AS (SELECT r, id, least({AGREEING}, count(*)) AS wanted FROM anchors GROUP BY r, id),
agreed AS (SELECT v.r, v.id, v.start FROM votes v JOIN votes o ON o.r = v.r AND o.id = v.id AND abs(o.start - v.start) <= v.slack
  JOIN wanted ON wanted.r = v.r AND wanted.id = v.id GROUP BY v.r, v.id, v.start, wanted HAVING count(DISTINCT o.word) >= wanted),
shares AS (SELECT a.r, a.id, a.start, count(DISTINCT tw.place) AS hit FROM agreed a JOIN tw ON tw.id = a.id
  JOIN dw ON dw.r = a.r AND dw.word = tw.word AND dw.place BETWEEN a.start + tw.place - tw.slack AND a.start + tw.place + tw.slack GROUP BY ALL),
near AS (SELECT s.r, s.id, s.start, hit, t.label, t.base, t.share, t.phrases, len(t.words) AS size, greatest(s.start - slack, 0) AS low,
  least(s.start + len(t.words) + slack, len(d.w)) AS high, d.w FROM shares s JOIN t ON t.id = s.id JOIN d ON d.r = s.r),
fits AS (SELECT r, id, label, base, greatest(start, 0) AS start, hit::DOUBLE / size AS score FROM near WHERE hit::DOUBLE / size >= share AND len(list_filter(phrases,
  lambda f: len(list_filter(range(low, high - len(f) + 1), lambda p: w[p + 1:p + len(f)] = f)) = 0)) = 0),
summed AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM fits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN summed ON summed.r = d.r"""


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": oracle()}
