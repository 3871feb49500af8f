"""Text expressions: tokens, n-grams, accents. All stay in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from galleryloom.functions.annotations import BLANKS, trim_blanks

# The usual English stop-word list.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he "
    "him his himself she she's her hers herself it it's its itself they them their theirs themselves what "
    "which who whom this that that'll these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain "
    "aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't "
    "ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't "
    "won won't wouldn wouldn't"
).split()

# Characters of tokens. Letters are spelt as Unicode classes since a bare \w is ASCII here.
ALPHABETIC = r"\p{L}\p{Nl}\p{No}_"
WORD = r"\p{L}\p{N}_"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def runs_of(text: Column, chars: str) -> Column:
    """The longest runs of the characters of a class, in order.

    The text is cut at all others: extracting every match costs several times as much.
    """
    return F.filter(F.split(text, f"[^{chars}]+"), lambda t: t != "")


def tokenize_basic(c: str | Column, shortest: int = 3, longest: int = 30, digits: bool = False) -> Column:
    """Lower-cased word tokens within the length bounds; accents are kept.

    By default digits separate tokens and tokens starting with `_` are dropped; with `digits` every
    run of word characters counts.
    """
    runs = runs_of(F.lower(text_or_empty(c)), WORD if digits else ALPHABETIC)
    sized = F.filter(runs, lambda t: F.length(t).between(shortest, longest))
    return sized if digits else F.filter(sized, lambda t: ~t.startswith("_"))


def remove_stopwords(tokens: str | Column, stopwords: list[str] | None = None) -> Column:
    """Drop stop words; order and repeats stay. The literal list becomes a hash set in the plan."""
    words = stopwords or ENGLISH_STOPWORDS
    return F.filter(_col(tokens), lambda t: ~t.isin(*words))


def split_whitespace(c: str | Column) -> Column:
    return F.filter(F.split(text_or_empty(c), BLANKS + "+"), lambda t: t != "")


def word_tokens(c: str | Column) -> Column:
    """Runs of at least two word characters of the lower-cased text, the vectoriser's tokens."""
    return F.filter(F.split(F.lower(text_or_empty(c)), f"[^{WORD}]+"), lambda t: F.length(t) >= 2)


def word_ngrams(tokens: Column, shortest: int, longest: int) -> Column:
    """All n-grams of the token list, joined by single spaces.

    Longer n-grams grow from shorter ones by zipping with the shifted token list, so the work is
    linear; slicing the list at every position would copy it each time.
    """
    size = F.size(tokens)
    grams = {1: tokens}
    for n in range(2, longest + 1):
        room = F.greatest(size - (n - 1), F.lit(0))
        grams[n] = F.zip_with(
            F.slice(grams[n - 1], F.lit(1), room),
            F.slice(tokens, F.lit(n), room),
            lambda head, tail: F.concat_ws(" ", head, tail),
        )
    return F.concat(*[grams[n] for n in range(shortest, longest + 1)])


def squeeze_blanks(c: str | Column) -> Column:
    """Lower-case and turn runs of two or more white-space characters into one space."""
    return F.regexp_replace(F.lower(text_or_empty(c)), BLANKS + "{2,}", " ")


def char_ngrams(text: Column, shortest: int, longest: int) -> Column:
    """All character n-grams across the text; none of a length the text does not reach.

    A look-ahead captures the n characters at every position in one linear scan; positions inside a
    surrogate pair are skipped.
    """
    at = r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))"
    return F.concat(*[F.regexp_extract_all(text, F.lit(at % n), F.lit(1)) for n in range(shortest, longest + 1)])


def _fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def _fold_table() -> tuple[str, str]:
    """Characters of the Latin blocks whose accent-free form is one character."""
    blocks = [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)]
    pairs = [(chr(c), _fold(chr(c))) for c in blocks]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _fold_table()
# translate() deletes what has no counterpart: combining marks stand at the end.
_ACCENTED += "".join(chr(c) for c in range(0x0300, 0x0370) if unicodedata.combining(chr(c)))
# Characters the table settles: ASCII, its own entries, and Latin characters that fold to themselves.
_SETTLED = "".join(
    chr(c) for c in [*range(0x00A0, 0x0250), *range(0x0300, 0x0370), *range(0x1E00, 0x1F00)] if len(_fold(chr(c))) <= 1
)


def _fold_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(_fold, na_action="ignore")


def fold_accents(c: str | Column, full: bool = False) -> Column:
    """Accent-free text by compatibility decomposition.

    The default covers the Latin blocks with a character table in the JVM. With `full`, texts holding
    any other non-ASCII character go through an Arrow batch function; all others reach it as NULL.
    """
    text = _col(c)
    plain = F.translate(text, _ACCENTED, _PLAIN)
    if not full:
        return plain
    rest = F.translate(text, _SETTLED, "")
    return F.coalesce(F.pandas_udf(_fold_batches, "string")(F.when(rest.rlike(r"[^\x00-\x7F]"), text)), plain)


def language_of(text: str | Column) -> Column:
    """`english` when over 95 % of the characters are ASCII and a Latin letter occurs, else `multilingual`."""
    t = _col(text)
    ascii_share = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.greatest(F.length(t), F.lit(1))
    return F.when((ascii_share > 0.95) & t.rlike("[A-Za-z]"), "english").otherwise("multilingual")


__all__ = [
    "ENGLISH_STOPWORDS", "char_ngrams", "fold_accents", "language_of", "remove_stopwords", "split_whitespace",
    "squeeze_blanks", "text_or_empty", "tokenize_basic", "trim_blanks", "word_ngrams", "word_tokens",
]
