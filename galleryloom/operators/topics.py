"""Topic tables: dictionaries, class TF-IDF keywords, coherence, and topic distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.functions.text import word_tokens
from galleryloom.operators import windows
from galleryloom.operators.keyed import checked_lookup, join_lookup, place_by_key, quantile_values, unroll
from galleryloom.session import materialize

NOISE = -1
COHERENCE_WINDOW = 110
# Fixed value: keeps logarithms finite for words that never meet.
EPSILON = 1e-12


def dictionary(docs: DataFrame, no_below: int = 5, no_above: float = 0.5, keep_n: int = 100_000) -> DataFrame:
    """(term, df, term_id): terms within the document-frequency bounds, the keep_n most frequent."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    found = unroll(docs, [], F.array_distinct("tokens"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = (
        found.where((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above).cast("double") * n))
        .orderBy(F.desc("df"), "term")
        .limit(keep_n)
    )
    # At most keep_n rows reach this window.
    return kept.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)


def doc_to_bow(docs: DataFrame, terms: DataFrame, key: str = "key") -> DataFrame:
    """(key, term_id, term, n); words outside the dictionary are dropped."""
    placed = place_by_key(docs.select(key, "tokens"), key)
    counts = unroll(placed, [key], F.col("tokens"), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    return join_lookup(counts, checked_lookup(terms, "dictionary"), "term", load="df", spread=key).select(
        key, "term_id", "term", "n"
    )


def top_terms(weights: DataFrame, k: int = 10, topic: str = "topic") -> DataFrame:
    """(topic, rank, term, weight): k heaviest terms per topic, ties by term.

    The rank limit is applied per task before the shuffle, so each task sends at most k rows per topic.
    """
    order = Window.partitionBy(topic).orderBy(F.desc("weight"), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(topic, "rank", "term", "weight")


def rendered_terms(top: DataFrame, pattern: str, separator: str, out: str, topic: str = "topic") -> DataFrame:
    """One text per topic from its ranked terms, for instance `word:0.1234; …`."""
    entry = F.struct("rank", F.format_string(pattern, "term", "weight").alias("t"))
    return top.groupBy(topic).agg(F.array_join(F.array_sort(F.collect_list(entry))["t"], separator).alias(out))


def dominant(probabilities: str | Column, ids: list[int] | None = None) -> tuple[Column, Column]:
    """(topic id, probability) of the first maximum of a probability array."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    best = F.array_max(p)
    position = F.array_position(p, best).cast("int") - 1
    topic = position if ids is None else F.get(F.array(*[F.lit(i) for i in ids]), position)
    return topic, best


def topic_doc_coverage(docs: DataFrame, topics: int, topic: str = "topic") -> DataFrame:
    """Documents per dominant topic, 0 for topics without any."""
    counts = docs.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(topics).select(F.col("id").cast("int").alias(topic))
    return every.join(counts, topic, "left").select(topic, F.coalesce("n", F.lit(0)).alias("doc_count"))


def topic_summary(coverage: DataFrame, top: DataFrame, topic: str = "topic") -> DataFrame:
    """topic_id, doc_count and `term(0.1234), …`, by falling doc_count."""
    texts = rendered_terms(top, "%s(%.4f)", ", ", "top10_terms_with_weights", topic)
    return (
        coverage.join(texts, topic, "left")
        .select(
            F.col(topic).alias("topic_id"),
            "doc_count",
            F.coalesce("top10_terms_with_weights", F.lit("")).alias("top10_terms_with_weights"),
        )
        .orderBy(F.desc("doc_count"), "topic_id")
    )


def ctfidf_weights(docs: DataFrame, text: str = "text", topic: str = "topic") -> DataFrame:
    """(topic, term, weight): share of the term in its topic x ln(1 + A / occurrences overall).

    A is the mean number of words per topic, whole number. Terms are grouped once; a term has at most
    one row per topic, so its total comes with it and no join on hot terms is needed.
    """
    terms = unroll(docs.select(topic, word_tokens(text).alias("_t")), [topic], F.col("_t"), "term")
    counts = materialize(terms.groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n")), "topic-terms")
    sizes = counts.groupBy(topic).agg(F.sum("n").alias("_size"))
    mean = F.floor(sizes.agg(F.avg("_size")).scalar())
    per_term = counts.groupBy("term").agg(
        F.sum("n").alias("_total"), F.collect_list(F.struct(topic, "n")).alias("_rows")
    )
    idf = F.log(F.lit(1.0) + mean / F.col("_total"))
    rows = per_term.select("term", idf.alias("idf"), F.inline("_rows"))
    sized = join_lookup(rows, checked_lookup(sizes, "topic-sizes"), topic, spread="term")
    return sized.select(topic, "term", "idf", (F.col("n") / F.col("_size") * F.col("idf")).alias("weight"))


def ctfidf_keywords(weights: DataFrame, k: int = 10, topic: str = "topic") -> DataFrame:
    """Top words per topic rendered as `word:0.1234; …`; near-equal weights rank by word."""
    rounded = weights.select(topic, "term", F.round("weight", 9).alias("weight"))
    return rendered_terms(top_terms(rounded, k, topic), "%s:%.4f", "; ", "keywords_weights", topic)


def topic_table(docs: DataFrame, keywords: DataFrame, topic: str = "topic") -> DataFrame:
    """Topic, document count and keywords without the noise topic, by falling count."""
    counts = docs.where(F.col(topic) != NOISE).groupBy(topic).agg(F.count(F.lit(1)).alias("document_count"))
    return counts.join(keywords, topic, "left").select(
        topic, "document_count", F.coalesce("keywords_weights", F.lit("")).alias("keywords_weights")
    ).orderBy(F.desc("document_count"), topic)


def list_topic_ids(docs: DataFrame, topic: str = "topic") -> DataFrame:
    return docs.where(F.col(topic) != NOISE).select(topic).distinct().orderBy(topic)


def relabel_by_size(assigned: DataFrame, cluster: str, distance: str, quantile: float = 0.95) -> DataFrame:
    """Topics from clusters: 0 is the largest; rows beyond their cluster's distance quantile are noise.

    The quantile is exact: its rank is found through histograms, so a cluster is never sorted whole.
    """
    limits = quantile_values(assigned, cluster, distance, quantile, distance)
    stats = limits.select(cluster, F.col("n").alias("_n"), F.col("limit").alias("_limit"))
    # One row per cluster reaches this window.
    ranked = stats.withColumn("_topic", F.row_number().over(Window.orderBy(F.desc("_n"), cluster)) - 1)
    joined = join_lookup(assigned, checked_lookup(ranked, "clusters"), cluster, spread=distance)
    topic = F.when(F.col(distance) > F.col("_limit"), NOISE).otherwise(F.col("_topic"))
    return joined.withColumn("topic", topic).drop("_n", "_limit", "_topic")


def topic_coherence(docs: DataFrame, top: DataFrame, window: int = COHERENCE_WINDOW, key: str = "key") -> DataFrame:
    """(topic, coherence): c_v of each topic's top terms over boolean sliding windows.

    Windows are never unrolled. A word at position p lies in the windows starting at p-window+1 … p;
    the windows holding a word, or either word of a pair, are the union of such ranges, counted from
    sorted positions. Windows holding both words follow as |A| + |B| - |A or B|. Only documents with
    a top term count. The list of words and pairs is fixed by topics x top terms.
    """
    words = materialize(top.select("topic", "term").distinct(), "top-terms")
    other = words.select("topic", F.col("term").alias("other"))
    pairs = words.join(other, "topic").where(F.col("term") < F.col("other")).select("term", "other").distinct()
    word_or_pair = (
        words.select("term").distinct().select("term", F.col("term").alias("other")).unionByName(pairs)
    )
    members = checked_lookup(
        unroll(word_or_pair, ["term", "other"], F.array_distinct(F.array("term", "other")), "token")
        .groupBy("token")
        .agg(F.collect_list(F.struct("term", "other")).alias("units")),
        "coherence-units",
    )
    rows = (
        place_by_key(docs.select(key, "tokens"), key)
        .select(key, F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("pos", "token"))
    )
    hits = join_lookup(rows, members, "token", spread=key)
    last_start = F.greatest(F.col("n") - window, F.lit(0))
    per_doc = hits.groupBy(key).agg((F.first(last_start) + 1).cast("bigint").alias("windows"))
    ranges = hits.select(
        key,
        F.least("pos", last_start).alias("hi"),
        F.greatest(F.col("pos") - window + 1, F.lit(0)).alias("lo"),
        "pos",
        F.inline("units"),
    )
    before = F.lag("hi").over(Window.partitionBy(key, "term", "other").orderBy("pos"))
    fresh = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(before + 1, F.lit(0))) + 1, F.lit(0))
    covered = materialize(
        ranges.select("term", "other", fresh.alias("w")).groupBy("term", "other").agg(F.sum("w").alias("w")),
        "window-counts",
    )
    total = per_doc.agg(F.sum("windows").cast("double")).scalar()
    single = covered.where("term = other").select("term", F.col("w").alias("n"))
    either = covered.where("term <> other")
    both_ways = either.unionByName(either.select(F.col("other").alias("term"), F.col("term").alias("other"), "w"))
    cells = (
        words.join(other, "topic")
        .join(single.withColumnRenamed("n", "n_a"), "term", "left")
        .join(single.select(F.col("term").alias("other"), F.col("n").alias("n_b")), "other", "left")
        .join(both_ways, ["term", "other"], "left")
        .withColumn("total", total)
    )
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    both = F.when(F.col("term") == F.col("other"), n_a).otherwise(n_a + n_b - F.coalesce("w", F.lit(0)))
    staged = cells.select(
        "topic", "term", "other",
        (both / F.col("total")).alias("p"),
        (n_a / F.col("total")).alias("p_a"),
        (n_b / F.col("total")).alias("p_b"),
    )
    ratio = F.try_divide(F.col("p") + EPSILON, F.col("p_a") * F.col("p_b"))
    npmi = F.coalesce(F.log(ratio) / -F.log(F.col("p") + EPSILON), F.lit(0.0))
    vectors = materialize(staged.select("topic", "term", "other", npmi.alias("v")), "npmi")
    whole = vectors.groupBy("topic", "other").agg(F.sum("v").alias("s"))
    norms = whole.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("s_norm"))
    cosines = (
        vectors.join(whole, ["topic", "other"])
        .groupBy("topic", "term")
        .agg(F.sum(F.col("v") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        .join(norms, "topic")
    )
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("s_norm")), F.lit(0.0))
    return cosines.groupBy("topic").agg(F.avg(cosine).alias("coherence"))


def approx_topic_distribution(
    docs: DataFrame,
    weights: DataFrame,
    window: int = 8,
    stride: int = 4,
    min_similarity: float = 0.1,
    key: str = "key",
    topic: str = "topic",
) -> DataFrame:
    """(key, topic, probability) from token windows compared with the topics' class TF-IDF.

    Each window's similarity to a topic is the cosine of their weighted term vectors, zero below
    min_similarity; every token of the window receives it, and a document's sums are normalised. The
    last window is the first that reaches the end.

    Windows are counted inside the token list. The most frequent terms travel to the documents; only places of
    the other terms are joined and come back as one list per document. Rows of repeated or NULL keys are one
    document and take the row-wise way.
    """
    entry = F.when(F.col(topic) != NOISE, F.struct(F.col(topic).alias("topic"), "weight"))
    stored = checked_lookup(
        weights.where(F.col("term").isNotNull()).groupBy("term").agg(F.max("idf").alias("idf"), F.collect_list(entry).alias("topics")), "term-topics"
    )
    norms = stored.select(F.inline("topics")).groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).orderBy("topic").collect()
    law = windows.Law(window, stride, min_similarity, [r.topic for r in norms], [r.norm for r in norms])
    limit = windows.frequent_from(stored)
    frequent = stored.where(windows.step() >= limit)
    terms = windows.Terms(docs.sparkSession, frequent.toArrow(), law)

    several = (F.count(F.lit(1)) > 1) | F.col(key).isNull()
    repeated = materialize(docs.groupBy(key).agg(several.alias("_again")).where("_again"), "repeated-keys")
    alone = docs.select(key, "tokens")
    again = None
    if not repeated.isEmpty():
        marked = join_lookup(alone, repeated, key, "left", spread="tokens")
        doubled = F.col("_again").isNotNull() | F.col(key).isNull()
        alone, again = marked.where(~doubled).drop("_again"), marked.where(doubled).drop("_again")
    rare = windows.other_places(alone, key, terms).join(stored.where(windows.step() < limit), "term")
    lists = rare.groupBy(key).agg(F.collect_list(F.struct("pos", "idf", "topics")).alias("others"))
    found = windows.distribution(place_by_key(alone, key).join(lists, key, "left"), key, terms, docs.schema[key], weights.schema[topic])
    return found if again is None else found.unionByName(_distribution_by_rows(again, stored, law, key, topic))


def _distribution_by_rows(docs: DataFrame, stored: DataFrame, law: windows.Law, key: str, topic: str) -> DataFrame:
    """`approx_topic_distribution` where a document may be several rows. Tokens know their windows from their position, and
    all steps after the placement by document stay inside it."""
    norm = F.create_map(*[F.lit(x) for pair in zip(law.topics, law.norms) for x in pair]) if law.topics else F.lit(None).cast("map<int,double>")
    unit = F.transform("topics", lambda e: F.struct(e["topic"].alias(topic), (e["weight"] / F.element_at(norm, e["topic"])).alias("u")))
    lookup = checked_lookup(stored.select("term", "idf", unit.alias("topics")), "term-units")
    window, stride = law.window, law.stride
    rows = (
        place_by_key(docs.select(key, "tokens"), key)
        .select(key, F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("pos", "term"))
        .where(F.col("term").isNotNull())
    )
    last = F.ceil(F.greatest(F.col("n") - window, F.lit(0)) / stride).cast("int")
    first_window = F.greatest(F.ceil((F.col("pos") - window + 1) / stride).cast("int"), F.lit(0))
    last_window = F.least(F.floor(F.col("pos") / stride).cast("int"), last)
    placed = rows.select(key, "n", "term", F.explode_outer(F.sequence(first_window, last_window)).alias("w"))
    counts = placed.groupBy(key, "n", "w", "term").agg(F.count(F.lit(1)).alias("c"))
    known = join_lookup(counts, lookup, "term", spread=key).withColumn("x", F.col("c") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key, "w")))
    scored = (
        known.withColumn("length", length)
        .select(key, "n", "w", "x", "length", F.inline_outer("topics"))
        .where(F.col(topic).isNotNull())
        .groupBy(key, "n", "w", topic)
        .agg((F.sum(F.col("x") * F.col("u")) / F.first("length")).alias("similarity"))
        .where(F.col("similarity") >= law.min_similarity)
    )
    tokens_in_window = F.least(F.lit(window), F.col("n") - F.col("w") * stride)
    sums = scored.groupBy(key, topic).agg(F.sum(F.col("similarity") * tokens_in_window).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(key))
    return sums.select(key, topic, (F.col("_s") / total).alias("probability"))


def proportions_wide(
    source: DataFrame, distribution: DataFrame, ids: list[int], key: str = "key", topic: str = "topic"
) -> DataFrame:
    """Source rows with one `topic_{id}_prob` column per given id, zero where absent, joined by key."""
    names = [f"topic_{i}_prob" for i in ids]
    wide = distribution.groupBy(key).pivot(topic, ids).agg(F.first("probability"))
    renamed = wide.select(key, *[F.col(f"`{i}`").alias(n) for i, n in zip(ids, names)])
    return source.join(renamed, key, "left").na.fill(0.0, names)


def with_dominant(wide: DataFrame, ids: list[int]) -> DataFrame:
    """Add dominant_topic and dominant_prob from the `topic_{id}_prob` columns; first maximum wins."""
    topic, prob = dominant(F.array(*[F.col(f"topic_{i}_prob") for i in ids]), ids)
    return wide.withColumn("dominant_topic", topic).withColumn("dominant_prob", prob)
