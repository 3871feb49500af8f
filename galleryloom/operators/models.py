"""Distributed classifiers and topic models on the vectors of the feature operators."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleryloom.operators import boosting, grams, linear, network
from galleryloom.operators import features as ft
from galleryloom.operators import topics as tp
from galleryloom.operators.cells import sparse_cells, vector_size
from galleryloom.operators.keyed import checked_lookup, hash_key, join_lookup
from galleryloom.session import materialize

# Weights of this many features still fit a model; a larger vocabulary without max_features is an error.
VOCABULARY_SIZE = 1 << 24
# Texts of an Arrow batch whose counts return together.
BATCH_ROWS = 1024
VALIDATION_FRACTION = 0.1
# Fixed value: best words of a topic that its coherence is taken over.
COHERENCE_TERMS = 20


# ---------------------------------------------------------------- vectors


@dataclass
class TextFeatures:
    """Fitted word and character TF-IDF as sparse vectors, families side by side."""

    families: tuple[ft.Family, ...]
    counters: list[pa.Array]
    model: PipelineModel

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add `features`; the n-gram lists live only inside the job."""
        return self.weigh(counted(docs, self.families, self.counters, text), docs.columns)

    def weigh(self, counts: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` columns and `features` from the counts of `counted`.

        The per-feature attributes are dropped: with a large vocabulary they would travel in every plan.
        """
        features = F.col("features").alias("features", metadata={"families": [f.unit for f in self.families]})
        return self.model.transform(counts).select(*keep, features)

    def size(self) -> int:
        return sum(len(terms) for terms in self.counters)

    def layout(self) -> linear.Layout:
        """How the counts of `counted` become the features of `weigh`."""
        idf = [stage.getScalingVec().toArray() for stage in self.model.stages if isinstance(stage, ElementwiseProduct)]
        return linear.Layout((0, *map(int, np.cumsum([len(terms) for terms in self.counters]))), np.concatenate(idf))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/vectors")
        spark = SparkSession.getActiveSession()
        rows = [{k: str(v) for k, v in asdict(f).items()} for f in self.families]
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").json(f"{path}/families")
        stored = [pa.table({"term": terms, "place": pa.array(range(len(terms)), pa.int32()), "family": pa.array([i] * len(terms), pa.int32())}) for i, terms in enumerate(self.counters)]
        spark.createDataFrame(pa.concat_tables(stored)).write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextFeatures:
        def family(row) -> ft.Family:
            limit = None if row["max_features"] == "None" else int(row["max_features"])
            return ft.Family(
                row["prefix"], row["unit"], int(row["shortest"]), int(row["longest"]), int(row["min_df"]),
                float(row["max_df"]), limit,
            )

        stored = spark.read.json(f"{path}/families").collect()
        model = PipelineModel.load(f"{path}/vectors")
        order = {"w:": 0, "c:": 1}
        families = sorted((family(r) for r in stored), key=lambda f: order.get(f.prefix, 2))
        terms = spark.read.parquet(f"{path}/terms").toArrow().sort_by([("family", "ascending"), ("place", "ascending")])
        counters = [terms.filter(pc.equal(terms["family"], i))["term"].combine_chunks() for i in range(len(families))]
        return TextFeatures(tuple(families), counters, model)


def fit_counters(train: DataFrame, families: tuple[ft.Family, ...], text: str = "text") -> list[pa.Array]:
    """The vocabularies of the families, from the train rows: terms by falling occurrences, ties by term."""
    n = train.agg(F.count(F.lit(1))).scalar()
    counters = []
    for family in families:
        stats = grams.term_stats(ft.with_units(train, family, text), family.shortest, family.longest, least=family.min_df)
        within = (F.col("df") >= family.min_df) & (F.col("df") <= F.lit(family.max_df).cast("double") * n)
        kept = checked_lookup(stats.where(within), "terms")
        if family.max_features is None and kept.count() >= VOCABULARY_SIZE:
            raise ValueError(
                f"more than {VOCABULARY_SIZE} terms: a vector model cannot hold them all; give the family max_features or a higher min_df"
            )
        ordered = kept.orderBy(F.desc("total"), "term").select("term")
        terms = (ordered.limit(family.max_features) if family.max_features else ordered).toArrow()["term"].combine_chunks()
        if not len(terms):
            raise ValueError("no term within the document-frequency bounds; lower min_df")
        counters.append(terms)
    return counters


def counted(docs: DataFrame, families: tuple[ft.Family, ...], counters: list[pa.Array], text: str = "text") -> DataFrame:
    """The rows with a vector `_counts0` … of term counts per family."""
    kept, staged = docs.columns, docs
    for i, (family, terms) in enumerate(zip(families, counters)):
        units = ft.with_units(staged, family, text, tuple(staged.columns))
        count = grams.vector_counter(docs.sparkSession, grams.Vocabulary(terms, family.unit == "word"), family.shortest, family.longest)
        staged = units.withColumn(f"_counts{i}", count(F.col("units"))).drop("units")
    return staged.select(*kept, *[f"_counts{i}" for i in range(len(families))])


def count_cells(edges: tuple[int, ...]) -> tuple[Column, Column]:
    """Positions and counts of the features of all families, which lie end to end, cut at `edges`."""
    parts = [sparse_cells(f"_counts{i}") for i in range(len(edges) - 1)]

    def moved(places: Column, at: int) -> Column:
        return F.transform(places, lambda p: p + F.lit(at))

    return F.concat(*[moved(places, at) for (places, _), at in zip(parts, edges)]), F.concat(*[counts for _, counts in parts])


def text_features(families: tuple[ft.Family, ...], counters: list[pa.Array], train_counts: DataFrame) -> TextFeatures:
    """Vectors of unit length per family from counts; the library's idf lacks the + 1, which is added here."""
    stages: list = []
    for i in range(len(families)):
        idf = IDF(inputCol=f"_counts{i}", outputCol="_idf").fit(train_counts).idf
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol=f"_counts{i}", outputCol=f"_weighted{i}"
        )
        stages += [weigh, Normalizer(p=2.0, inputCol=f"_weighted{i}", outputCol=f"_unit{i}")]
    stages.append(VectorAssembler(inputCols=[f"_unit{i}" for i in range(len(families))], outputCol="features"))
    return TextFeatures(families, counters, PipelineModel(stages))


def fit_text_features(
    train: DataFrame, families: tuple[ft.Family, ...] = (ft.WORDS, ft.CHARS), text: str = "text"
) -> TextFeatures:
    """Vocabulary and idf from the train rows."""
    counters = fit_counters(train, families, text)
    return text_features(families, counters, counted(train, families, counters, text))


def label_indexer(train: DataFrame, label: str) -> Model:
    """Classes as text in text order; labels not seen in training are an error."""
    return StringIndexer(
        inputCol=label, outputCol="class_index", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(train)


def with_class_weight(train: DataFrame, label: str) -> DataFrame:
    weights = checked_lookup(ft.class_weights(train, label).select(label, "weight"), "class-weights")
    return join_lookup(train, weights, label, spread="key")


def vectors_from_long(docs: DataFrame, cells: DataFrame, size: int, key: str = "key") -> DataFrame:
    """Dense `features` from (key, component, value) cells; documents without cells get zeros."""
    dense = ft.dense_rows(cells, size)
    zeros = F.array_repeat(F.lit(0.0), size)
    joined = docs.join(dense, key, "left")
    return joined.withColumn("features", array_to_vector(F.coalesce("values", zeros))).drop("values")


# ---------------------------------------------------------------- classifiers


@dataclass
class TextClassifier:
    """A fitted classifier with its class names; input rows carry `features`."""

    classifier: Model | linear.LinearModels | boosting.BoostedTrees | network.Network
    classes: list[str]

    def predict(self, rows: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
        """(image_name, true, pred)."""
        names = F.array(*[F.lit(c) for c in self.classes])
        scored = self.classifier.transform(rows).withColumn("pred", F.get(names, F.col("prediction").cast("int")))
        return scored.select(F.col(key).alias("image_name"), F.col(label).cast("string").alias("true"), "pred")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        kind = type(self.classifier).__name__
        own = [k for k in OWN_MODELS if isinstance(self.classifier, k)]
        spark.createDataFrame([(kind if own else "pipeline", self.classes)], "kind string, classes array<string>").write.mode("overwrite").parquet(f"{path}/about")
        if own:
            self.classifier.save(spark, f"{path}/model")
        else:
            PipelineModel([self.classifier]).write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(path: str) -> TextClassifier:
        spark = SparkSession.getActiveSession()
        about = spark.read.parquet(f"{path}/about").first()
        own = {k.__name__: k for k in OWN_MODELS}
        if about.kind in own:
            return TextClassifier(own[about.kind].load(spark, f"{path}/model"), about.classes)
        return TextClassifier(PipelineModel.load(f"{path}/model").stages[0], about.classes)

    def params(self) -> dict[str, str]:
        if isinstance(self.classifier, Model):
            return {p.name: str(v) for p, v in self.classifier.extractParamMap().items()}
        return {"kind": type(self.classifier).__name__, "classes": str(len(self.classes))}


OWN_MODELS = (linear.LinearModels, boosting.BoostedTrees, network.Network)


def _prepared(train: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    indexer = label_indexer(train, label)
    return indexer.transform(with_class_weight(train, label)), indexer.labels


def _validation(key: str, seed: int) -> Column:
    """True for a fixed share of the rows: the first hex digits of the hash are uniform, so nothing is counted or ranked.

    The seed differs from the split's, whose train rows all have high hashes.
    """
    slot = F.conv(F.substring(hash_key(key, seed + 1), 1, 4), 16, 10).cast("int")
    return slot < int(VALIDATION_FRACTION * 65536)


def _width(rows: DataFrame) -> int:
    """Number of features; all rows of a vector column have the same."""
    first = rows.select(vector_size("features").alias("n")).first()
    return first.n if first else 0


def train_linear_svc(
    train: DataFrame, label: str = "label", c: float = 5.0, max_iter: int = 100, vectoriser: TextFeatures | None = None
) -> TextClassifier:
    """One-vs-rest linear machines with balanced weights and squared hinge, all classes in one pass per iteration.

    With a `vectoriser`, rows also carry its counts: these are stored for the passes, in a fraction of the room of their weights.
    """
    rows, classes = _prepared(train, label)
    layout = linear.Layout((0, _width(rows))) if vectoriser is None else vectoriser.layout()
    positions, values = sparse_cells("features") if vectoriser is None else count_cells(layout.edges)
    cells = rows.select(F.col("class_index").cast("int").alias("label"), "weight", positions.alias("positions"), values.alias("values"))
    return TextClassifier(linear.fit(linear.make_blocks(cells, layout), layout, len(classes), c, max_iter), classes)


def train_random_forest(
    train: DataFrame, label: str = "label", trees: int = 1000, depth: int = 30, seed: int = 42
) -> TextClassifier:
    rows, classes = _prepared(train, label)
    forest = RandomForestClassifier(
        labelCol="class_index", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt",
        seed=seed, cacheNodeIds=False,
    )
    return TextClassifier(forest.fit(rows), classes)


def train_boosted_trees(
    train: DataFrame, label: str = "label", key: str = "key", rounds: int = 2000, depth: int = 6, step: float = 0.1, seed: int = 42
) -> TextClassifier:
    """Softmax boosting of all classes, stopped by the loss of a validation slice hashed out of the train rows."""
    rows, classes = _prepared(train, label)
    marked = rows.select("features", F.col("class_index").alias("label"), "weight", _validation(key, seed).alias("valid"))
    law = boosting.Settings(rounds=rounds, depth=depth, step=step, seed=seed)
    return TextClassifier(boosting.fit(marked, len(classes), _width(rows), law), classes)


def train_mlp(
    train: DataFrame, label: str = "label", hidden: tuple[int, ...] = (512, 256), max_iter: int = 100, seed: int = 42, size: int = ft.PROJECTION_SIZE, key: str = "key"
) -> TextClassifier:
    """Dense network with ReLU, dropout and class weights, stopped by a validation slice hashed out of the train rows."""
    rows, classes = _prepared(train, label)
    marked = rows.select("features", F.col("class_index").alias("label"), "weight", _validation(key, seed).alias("valid"))
    return TextClassifier(network.fit(marked, len(classes), size, network.Settings(hidden=hidden, epochs=max_iter, seed=seed)), classes)


def score_argmax(scores: DataFrame, probabilities: str | Column, classes: list[str], keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns, class name and probability of the first maximum of a probability array."""
    position, best = tp.dominant(probabilities)
    names = F.array(*[F.lit(c) for c in classes])
    return scores.select(*keep, F.get(names, position).alias("pred"), best.alias("probability"))


def grid_feature_counts(train: DataFrame, words: list[int], chars: list[int], min_dfs: list[int], text: str = "text") -> DataFrame:
    """(word_longest, char_longest, min_df, num_features) of a vocabulary grid from one count per unit.

    The longest setting is counted once; shorter ones are parts of it.
    """
    n = train.agg(F.count(F.lit(1))).scalar()

    def sizes(unit: str, shortest: int, longest: list[int], max_df: float, name: str) -> DataFrame:
        family = ft.Family("", unit, shortest, max(longest), 1, max_df)
        counted = grams.term_stats(ft.with_units(train, family, text), family.shortest, family.longest, least=min(min_dfs))
        length = F.length("term") if unit == "char" else F.size(F.split("term", " "))
        kept = counted.where(F.col("df") <= F.lit(max_df).cast("double") * n)
        cells = [
            F.count_if((length <= m) & (F.col("df") >= d)).alias(f"{m}_{d}") for m in longest for d in min_dfs
        ]
        wide = kept.agg(*cells)
        entries = [
            F.struct(F.lit(m).alias(name), F.lit(d).alias("min_df"), F.col(f"{m}_{d}").alias(f"{unit}_features"))
            for m in longest
            for d in min_dfs
        ]
        return wide.select(F.inline(F.array(*entries)))

    word = sizes("word", 1, words, 0.9, "word_longest")
    char = sizes("char", 3, chars, 0.95, "char_longest")
    return word.join(char, "min_df").select(
        "word_longest", "char_longest", "min_df", (F.col("word_features") + F.col("char_features")).alias("num_features")
    )


# ---------------------------------------------------------------- topic models


@dataclass
class TopicModel:
    """LDA with the dictionary it was trained on."""

    counter: CountVectorizerModel
    lda: Model

    def vectors(self, docs: DataFrame) -> DataFrame:
        return self.counter.transform(docs)

    def top_terms(self, k: int = 10) -> DataFrame:
        """(topic, rank, term, weight)."""
        spark = SparkSession.getActiveSession()
        words = spark.createDataFrame(list(enumerate(self.counter.vocabulary)), "term_id int, term string")
        pairs = F.arrays_zip(F.col("termIndices").alias("term_id"), F.col("termWeights").alias("weight"))
        listed = self.lda.describeTopics(k).select("topic", F.posexplode(pairs).alias("rank", "e"))
        return listed.select("topic", (F.col("rank") + 1).alias("rank"), "e.term_id", "e.weight").join(words, "term_id").select(
            "topic", "rank", "term", "weight"
        )

    def doc_topics(self, docs: DataFrame, key: str = "key") -> DataFrame:
        """key, dominant_topic, topic_prob and the full distribution as `topic_i` columns."""
        probs = self.lda.transform(self.vectors(docs)).select(key, vector_to_array("topicDistribution").alias("p"))
        topic, best = tp.dominant("p")
        k = self.lda.getK()
        return probs.select(
            key, topic.alias("dominant_topic"), best.alias("topic_prob"), *[F.col("p")[i].alias(f"topic_{i}") for i in range(k)]
        )

    def save(self, path: str) -> None:
        PipelineModel([self.counter, self.lda]).write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> TopicModel:
        return TopicModel(*PipelineModel.load(path).stages)


def fit_dictionary(docs: DataFrame, no_below: int = 5, no_above: float = 0.5, keep_n: int = 100_000) -> CountVectorizerModel:
    """The dictionary of the topic operators (ranked by document count) as a vectoriser."""
    terms = tp.dictionary(docs, no_below, no_above, keep_n).orderBy("term_id").select("term").collect()
    return CountVectorizerModel.from_vocabulary([r.term for r in terms], inputCol="tokens", outputCol="features")


def topic_vectors(docs: DataFrame, counter: CountVectorizerModel) -> DataFrame:
    """`features` of the documents, written once for the passes of a fit."""
    return materialize(counter.transform(docs).select("features"), "lda-vectors")


def lda_train(
    docs: DataFrame,
    k: int,
    passes: int = 10,
    share: float = 0.2,
    seed: int = 42,
    counter: CountVectorizerModel | None = None,
    vectors: DataFrame | None = None,
) -> TopicModel:
    """Online variational LDA over (key, tokens); one pass visits every document once on average.

    Each update sees a fixed share of the documents, so the number of updates does not grow with them. Several fits may share the
    `vectors` that the dictionary `counter` makes of the documents.
    """
    counter = counter or fit_dictionary(docs)
    vectors = topic_vectors(docs, counter) if vectors is None else vectors
    lda = LDA(
        k=k, optimizer="online", seed=seed, featuresCol="features", subsamplingRate=share, maxIter=math.ceil(passes / share),
        learningOffset=1.0, learningDecay=0.5, optimizeDocConcentration=False, docConcentration=[1.0 / k] * k, topicConcentration=1.0 / k,
    )
    return TopicModel(counter, lda.fit(vectors))


def choose_best_k(docs: DataFrame, ks: list[int], passes: int = 10, seed: int = 42) -> tuple[DataFrame, TopicModel]:
    """((k, coherence) table, best model); of equal coherences the smallest k wins."""
    docs = materialize(docs, "lda-docs")
    counter = fit_dictionary(docs)
    vectors, results, best = topic_vectors(docs, counter), [], None
    for k in ks:
        model = lda_train(docs, k, passes, seed=seed, counter=counter, vectors=vectors)
        coherence = tp.topic_coherence(docs, model.top_terms(COHERENCE_TERMS)).agg(F.avg("coherence")).first()[0]
        results.append((k, coherence))
        if best is None or coherence > best[0]:
            best = (coherence, model)
    table = docs.sparkSession.createDataFrame(results, "k int, coherence double").orderBy("k")
    return table, best[1]


def embed_docs(docs: DataFrame, family: ft.Family = ft.WORDS, size: int = ft.PROJECTION_SIZE, text: str = "text") -> DataFrame:
    """(key, features): TF-IDF of the text projected to `size` dimensions."""
    vocabulary = ft.fit_vocabulary(docs, family, text)
    weights = ft.tfidf(docs, vocabulary, family, text)
    return vectors_from_long(docs.select("key"), ft.sparse_projection(weights, vocabulary, size), size)


def embed_with(docs: DataFrame, encoder, text: str = "text") -> DataFrame:
    """(key, values): vectors from a pluggable batch encoder (iterator of frames to iterator of frames)."""
    return docs.select("key", text).mapInPandas(encoder, "key string, values array<double>")


def cluster_docs(vectors: DataFrame, k: int, key: str = "key", quantile: float = 0.95, seed: int = 42) -> DataFrame:
    """(key, topic): clusters of normalised vectors, far rows as noise -1, 0 the largest cluster."""
    unit = Normalizer(p=2.0, inputCol="features", outputCol="_unit")
    kmeans = KMeans(k=k, seed=seed, featuresCol="_unit", predictionCol="cluster")
    model = Pipeline(stages=[unit, kmeans]).fit(vectors)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())]
    table = vectors.sparkSession.createDataFrame(centers, "cluster int, _center array<double>")
    assigned = join_lookup(model.transform(vectors).select(key, "cluster", vector_to_array("_unit").alias("_v")), table, "cluster", spread=key)
    gaps = F.zip_with("_v", "_center", lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))
    placed = materialize(assigned.select(key, "cluster", distance.alias("distance")), "clusters")
    return tp.relabel_by_size(placed, "cluster", "distance", quantile).select(key, "topic")
