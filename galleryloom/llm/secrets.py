"""Secret scans: candidates in their context, cleared of false positives by a random forest. No Python in the tasks."""

from __future__ import annotations

import json
import math
import re
from string import ascii_lowercase

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm import secret_forms
from galleryloom.llm.common import table
from galleryloom.session import materialize

MIN_LENGTH = 8
THRESHOLD = 0.5
MASK = "[SECRET]"
# The forest is fitted on at most about this many labelled findings; of the words and letter pairs of all texts the most frequent are kept.
TRAIN_FINDINGS = 20_000
DICTIONARY_WORDS = 300
LETTER_PAIRS = 150
TREES, DEPTH, SEED = 24, 6, 7
# Words that stand before credentials, shapes of issued keys, and shapes of harmless tokens.
CREDENTIAL_WORDS = "pass|passwd|password|pwd|secret|token|apikey|api_key|api-key|key|auth|bearer|credential|credentials"
KEY_SHAPES = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abp]-[0-9A-Za-z-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^sk_live_[0-9A-Za-z]{16,}$"
HARMLESS_SHAPES = r"^[0-9.,:()+/-]+$|^[^@]+@[^@]+\.[A-Za-z]+$|^(https?|ftp):|^v?[0-9]+(\.[0-9a-z]+)+$"
WORD_AND_NUMBER = "^[A-Za-z]+[0-9]{1,3}$"
# Keys in base 64 may look like paths; the parts of a path consist of words or of common letter pairs to this share.
PATH = "^([A-Za-z0-9_.-]*/)+[A-Za-z0-9_.-]*$"
PATH_WORDS, PATH_PAIRS = 0.25, 0.35
# The word before a candidate is hashed into so many flags.
BEFORE_BUCKETS = 16
URL_PASSWORD = "//[^/@:]+:[^/@]+@|^[^/@:]+:[^/@]+@"
JWT = r"^eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}$"
FEATURES = (
    "length", "digits", "capitals", "small", "others", "class_changes", "common_pairs", "dictionary", "slashes", "dots", "at_sign",
    "distinct", "hexadecimal", "numeric", "credential_before", "assigned", "quoted", "credential_near", "issued", "url_password", "plain_pairs",
    *(f"before_{i}" for i in range(BEFORE_BUCKETS)),
)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _count(value: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))


def _any_of(items: list[str]) -> str:
    """A pattern for any of the items, the longest first; nothing when there are none."""
    return "|".join(re.escape(x) for x in sorted(items, key=lambda x: (-len(x), x))) or "(?!)"


class Language:
    """Common words and letter pairs of the corpus, as patterns."""

    def __init__(self, words: list[str], pairs: list[str], counts: dict[str, int] | None = None):
        self.words, self.pairs, self.common = _any_of(words), f"(?=({_any_of(pairs)}))", list(words)
        counts = counts or dict.fromkeys(pairs, 1)
        every = [a + b for a in ascii_lowercase for b in ascii_lowercase]
        total = sum(counts.get(p, 0) for p in every) + len(every)
        # Log probability of a letter pair, by 26 x first + second letter.
        self.logs = [math.log((counts.get(p, 0) + 1) / total) for p in every]

    @classmethod
    def learn(cls, docs: DataFrame, text_col: str = "text") -> Language:
        """The most frequent words of three letters or more, and letter pairs, of all texts."""
        words = docs.select(F.col(text_col).alias("text")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
        counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
        top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).select("word").collect()
        pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
        pairs = counts.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
        # Pairs of a-z: 676 rows at most.
        found = sorted(pairs.collect(), key=lambda r: (-r.n, r.pair))
        return cls([r.word for r in top], [r.pair for r in found[:LETTER_PAIRS]], {r.pair: r.n for r in found})


# A sign or a piece between blanks, quotes and brackets, with the quote before it; marks that may cut a piece further.
PIECE = r"""["']?[=:]{1,2}=?|["']?[^\s"'()\[\]{}<>]+"""
MARKS = "[,;&?]"
SIGN = "^[\"']?[=:]{1,2}=?$"


def candidates(text: Column, language: Language) -> Column:
    """Array of (value, before, and the features) of a text's tokens that may be secrets.

    Texts are cut at blanks, quotes and brackets into pieces, and pieces at commas, semicolons, ampersands and question
    marks into parts. Each part is a token, and so is a piece of several parts whose marks do not stand before a name. The value of a
    token is what stands behind `name=` or `name:`, without marks at its end; it is a candidate from MIN_LENGTH characters
    on if it has a digit or follows a credential word and its sign, or Bearer. `before` is the name, or the word before the token or before its sign.
    """
    wanted = f"(?i)[0-9]|(?:{CREDENTIAL_WORDS})[=:]"
    logs = F.from_json(F.lit(json.dumps(language.logs)), "array<double>")

    def context(token: Column, last: Column, further: Column, after: Column, quoted: Column) -> Column:
        sign = last.rlike(SIGN)
        name = F.regexp_extract(token, "^([A-Za-z_-]+)[=:]", 1)
        value = F.regexp_extract(token, "^(?:[A-Za-z_-]+[=:])?(.*?)[^A-Za-z0-9+/=_]*$", 1)
        before = F.when(name != "", name).when(sign, further).otherwise(last)
        return F.struct(
            value.alias("value"), F.regexp_replace(before, "[\"':=,;.]+$", "").alias("before"),
            (sign | (name != "") | last.rlike("[=:]$")).alias("assigned"), quoted.alias("quoted"),
            F.concat_ws(" ", further, last, after).alias("near"),
        )

    def tokens(pieces: Column, i: Column) -> Column:
        """The candidates of a piece: its parts, and the piece as a whole."""
        bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "^[\"']", "")
        # Of the pieces before, the part that stands next to this one.
        tail = lambda x: F.regexp_extract(x, f"([^,;&?]*){MARKS}*$", 1)
        piece, last, further, after = bare(F.get(pieces, i)), tail(bare(F.get(pieces, i - 1))), tail(bare(F.get(pieces, i - 2))), bare(F.get(pieces, i + 1))
        quoted = F.get(pieces, i).rlike("^[\"']")
        whole = context(piece, last, further, after, quoted)

        def cut(parts: Column) -> Column:
            at = lambda j: F.get(parts, j)
            return F.transform(
                parts,
                lambda part, j: context(
                    part, F.when(j > 0, at(j - 1)).otherwise(last), F.when(j > 1, at(j - 2)).when(j > 0, last).otherwise(further), F.coalesce(at(j + 1), after), quoted,
                ),
            )

        parts = _let(F.split(piece, f"{MARKS}+"), cut)
        named = piece.rlike(f"{MARKS}[A-Za-z_-]+[=:]")
        inner = piece.rlike(f"{MARKS}[^,;&?]*[A-Za-z0-9]")
        return F.when(~inner, F.array(whole)).when(named, parts).otherwise(F.concat(F.array(whole), parts))

    def features(c: Column) -> Column:
        value = c["value"]
        size = F.length(value).cast("double")
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003")
        flag = lambda x: x.cast("double")
        letters = F.regexp_extract_all(F.lower(value), F.lit("(?=([a-z]{2}))"), F.lit(1))
        log = lambda p: F.get(logs, (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97)
        plain = F.aggregate(letters, F.lit(0.0), lambda a, p: a + log(p)) / F.greatest(F.size(letters), F.lit(1))
        bucket = F.crc32(F.lower(c["before"]).cast("binary")) % BEFORE_BUCKETS
        columns = {
            "length": F.log2(size), "digits": _count(value, "[0-9]") / size, "capitals": _count(value, "[A-Z]") / size,
            "small": _count(value, "[a-z]") / size, "others": _count(value, "[^A-Za-z0-9]") / size, "class_changes": F.length(classes) / size,
            "common_pairs": F.size(F.regexp_extract_all(F.lower(value), F.lit(language.pairs), F.lit(1))) / size,
            "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), language.words, "")) / size,
            "slashes": _count(value, "/") / size, "dots": _count(value, "\\.") / size, "at_sign": flag(value.contains("@")),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0)), "hexadecimal": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            "numeric": flag(value.rlike("^[0-9.,:()+-]+$")), "credential_before": flag(c["before"].rlike(f"(?i)(^|[_-])({CREDENTIAL_WORDS})$")),
            "assigned": flag(c["assigned"]), "quoted": flag(c["quoted"]), "credential_near": flag(c["near"].rlike(f"(?i)\\b({CREDENTIAL_WORDS})\\b")),
            "issued": flag(value.rlike(f"{KEY_SHAPES}|{JWT}")), "url_password": flag(value.rlike(URL_PASSWORD)), "plain_pairs": plain,
            **{f"before_{i}": flag(bucket == i) for i in range(BEFORE_BUCKETS)},
        }
        return F.struct(value.alias("value"), c["before"].alias("before"), *[columns[f].cast("double").alias(f) for f in FEATURES])

    def follows(pieces: Column, i: Column) -> Column:
        """The piece before is a credential word with its sign, a sign behind a credential word, or Bearer."""
        last, further = F.coalesce(F.get(pieces, i - 1), F.lit("")), F.coalesce(F.get(pieces, i - 2), F.lit(""))
        word = f"(?i)(^|[\"'_,;&?-])({CREDENTIAL_WORDS})"
        return last.rlike(f"{word}[=:]$|(?i)^[\"']?bearer$") | (last.rlike(SIGN) & further.rlike(f"{word}$"))

    def of(pieces: Column) -> Column:
        # Without pieces the sequence runs from 0 down to -1; no place there is long enough.
        places = F.filter(
            F.sequence(F.lit(0), F.size(pieces) - 1),
            lambda i: (F.length(F.get(pieces, i)) >= MIN_LENGTH) & (F.get(pieces, i).rlike(wanted) | follows(pieces, i)),
        )
        named = lambda c: (c["assigned"] & c["before"].rlike(f"(?i)(^|[_-])({CREDENTIAL_WORDS})$")) | c["before"].rlike("(?i)^bearer$")
        worth = lambda c: (F.length(c["value"]) >= MIN_LENGTH) & (c["value"].rlike("[0-9]") | named(c))
        found = F.flatten(F.transform(places, lambda i: F.filter(tokens(pieces, i), worth)))
        return F.transform(found, features)

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    return _let(F.filter(pieces, lambda p: p.rlike("[\\p{L}\\p{N}=:]")), of)


def shape_label(candidate: Column) -> Column:
    """Label of a candidate by its shape: 1 for issued keys and assigned credentials, 0 for harmless tokens, else NULL.

    What is assigned to a credential word is never 0: it is 1 if mixed, also where it looks like a path without words or like a word and
    a number, and has no label otherwise.
    """
    value = candidate["value"]
    path = value.rlike(PATH) & ((candidate["dictionary"] >= PATH_WORDS) | (candidate["common_pairs"] >= PATH_PAIRS))
    harmless = value.rlike(HARMLESS_SHAPES) | path
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12) & ~harmless
    credential = (candidate["assigned"] > 0) & (candidate["credential_before"] > 0)
    return F.when(value.rlike(KEY_SHAPES) | (credential & mixed), 1.0).when(~credential & (harmless | value.rlike(WORD_AND_NUMBER)), 0.0)


def labelled_findings(docs: DataFrame, language: Language, text_col: str = "text", limit: int = TRAIN_FINDINGS) -> DataFrame:
    """Candidates of all texts that their shape labels, each different one once; about `limit` of them by hash."""
    rows = docs.select(F.explode(candidates(F.col(text_col), language)).alias("c"))
    rows = rows.select(F.xxhash64("c.value", "c.before").alias("_hash"), shape_label(F.col("c")).alias("label"), *[F.col("c")[f].alias(f) for f in FEATURES])
    rows = materialize(rows.where("label IS NOT NULL").dropDuplicates(["_hash"]), "findings")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    keep = None
    for label, size in sizes.items():
        share = min(1_000_000, int(1_000_000 * limit / 2 / size) + 1)
        picked = (F.col("label") == label) & (F.pmod("_hash", F.lit(1_000_000)) < share)
        keep = picked if keep is None else keep | picked
    return rows.where(keep if keep is not None else F.lit(False)).drop("_hash")


class Forest:
    """Trees as nested tuples (feature number, bound, left, right), leaves are votes."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def fit(cls, findings: DataFrame) -> Forest | None:
        """MLlib's random forest over rows with `label` and the features; None unless both labels occur."""
        findings = materialize(findings.select("label", *FEATURES), "sample")
        if findings.select("label").distinct().count() < 2:
            return None
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(findings)
        forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        return cls([parse_tree(t.toDebugString) for t in forest.fit(rows).trees])

    def score(self, candidate: Column) -> Column:
        """Share of the trees that vote for a secret: the nodes are literal arrays that are walked from each root."""
        feature, bound, right, roots = [], [], [], []

        def lay(node) -> None:
            """Nodes in the order of a walk: the left one stands behind its parent; leaves have feature -1 and their vote as bound."""
            here = len(feature)
            leaf = not isinstance(node, tuple)
            feature.append(-1 if leaf else node[0])
            bound.append(float(node) if leaf else node[1])
            right.append(0)
            if not leaf:
                lay(node[2])
                right[here] = len(feature)
                lay(node[3])

        for tree in self.trees:
            roots.append(len(feature))
            lay(tree)
        literal = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
        features, bounds, rights = literal(feature, "int"), literal(bound, "double"), literal(right, "int")
        steps = F.sequence(F.lit(1), F.lit(DEPTH))

        def step(x: Column, n: Column) -> Column:
            own = F.get(features, n)
            return F.when(own < 0, n).when(F.get(x, own) <= F.get(bounds, n), n + 1).otherwise(F.get(rights, n))

        def votes(x: Column) -> Column:
            leaf = lambda root: F.aggregate(steps, root, lambda n, _: step(x, n))
            return F.aggregate(literal(roots, "int"), F.lit(0.0), lambda total, root: total + F.get(bounds, leaf(root)))

        return _let(F.array(*[candidate[f] for f in FEATURES]), votes) / len(self.trees)


def parse_tree(text: str):
    """A tree from MLlib's description: If (feature i <= x), Else, Predict lines."""
    lines = iter([x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        next(lines)
        return int(feature), float(bound), left, node()

    return node()


def with_secrets(docs: DataFrame, language: Language, forest: Forest | None, out: str = "findings", text_col: str = "text") -> DataFrame:
    """The documents with `out`: array of (value, before, score) of all candidates, in text order.

    Scoring stays in the row, so no text is moved and one hot source or text is no burden. Without a
    forest the shapes decide (1 or 0). NULL and empty texts have no candidates; repeated tokens and rows are
    scored each; a column already named `out` is replaced.
    """

    def scored(c: Column) -> Column:
        score = forest.score(c) if forest else F.coalesce(shape_label(c), F.lit(0.0))
        return F.struct(c["value"].alias("value"), c["before"].alias("before"), score.alias("score"))

    return docs.withColumn(out, F.transform(candidates(F.col(text_col), language), scored))


def secrets_of(findings: Column, threshold: float = THRESHOLD) -> Column:
    """The different values that score the threshold or more."""
    return F.array_distinct(F.transform(F.filter(findings, lambda f: f["score"] >= threshold), lambda f: f["value"]))


def redact(docs: DataFrame, language: Language, forest: Forest | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret, wherever it stands in the text, replaced by MASK; longer secrets first."""
    found = with_secrets(docs, language, forest, "_llm_findings", text_col)
    longest = F.array_sort(F.transform(secrets_of(F.col("_llm_findings"), threshold), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    text = F.aggregate(longest, F.col(text_col), lambda t, s: F.replace(t, s["s"], F.lit(MASK)))
    return found.withColumn(text_col, text).select(*docs.columns)


def taught_findings(spark, language: Language, rows: list[tuple[str, str, float]]) -> DataFrame:
    """Labelled findings of texts (text, value, label): the candidates that are, or hold, the text's value."""
    texts = spark.createDataFrame(rows, "text string, value string, label double")
    found = texts.select("value", "label", F.explode(candidates(F.col("text"), language)).alias("c"))
    own = (F.col("c.value") == F.col("value")) | (F.col("c.value").contains(F.col("value")) & (F.length("c.value") <= F.length("value") + 12))
    return found.where(own).select("label", *[F.col("c")[f].alias(f) for f in FEATURES])


def learn(docs: DataFrame) -> tuple[Language, Forest | None]:
    """Words and pairs of the corpus, and the forest fitted on its findings that their shape labels and on the generated forms.

    An empty corpus teaches nothing.
    """
    language = Language.learn(docs)
    own = labelled_findings(docs, language)
    if not language.common and own.isEmpty():
        return language, None
    generated = taught_findings(docs.sparkSession, language, secret_forms.examples(language.common))
    return language, Forest.fit(own.select("label", *FEATURES).unionByName(generated))


def op7_secret_scan(spark, sf_dir):
    """Per document: candidates, secrets, the highest score and the secrets themselves, joined by line ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_secrets(docs, *learn(docs))
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets_of(F.col("findings"))).cast("long").alias("n_secrets"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("max_score"),
        F.array_join(F.array_sort(secrets_of(F.col("findings"))), "\n").alias("secrets"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict = {}
