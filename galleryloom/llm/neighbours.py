"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, table
from galleryloom.session import materialize

NEIGHBOURS = 20
TREES = 8
LEAF_ROWS = 100
# Planes are fitted on at most about this many vectors; every vector is then put into its leaves.
FIT_ROWS = 40_000
# Leaves that a query visits over all trees: this share of them, and at least so many.
LEAF_SHARE = 0.12
MIN_LEAVES = 40
SEED = 17
# Rows of a shard of vectors, queries of a block.
SHARD_ROWS = 4096
BLOCK_QUERIES = 8192


class Forest:
    """Trees of `depth` levels: node n has the children 2n+1 and 2n+2, the last level are the leaves.

    `normals[t, n]` and `offsets[t, n]` are a node's plane; the sign of the margin tells the child.
    """

    def __init__(self, normals: np.ndarray, offsets: np.ndarray, depth: int):
        self.normals, self.offsets, self.depth = normals, offsets, depth

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Forest:
        """Each plane is the bisector of two groups of random rows of its node, moved to the median."""
        deepest = max(0, int(math.log2(max(1, len(sample) / 8))))
        depth = min(deepest, max(0, math.ceil(math.log2(max(1, rows / leaf_rows)))))
        width = sample.shape[1] if sample.ndim == 2 else 0
        nodes = (1 << depth) - 1
        normals, offsets = np.zeros((trees, nodes, width), np.float32), np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            inside = [np.arange(len(sample))]
            for n in range(nodes):
                own = sample[inside[n]]
                half = max(1, min(16, len(own) // 2))
                picked = own[rng.permutation(len(own))[: 2 * half]] if len(own) > 1 else np.zeros((2, width))
                normal = picked[:half].mean(axis=0) - picked[half:].mean(axis=0)
                size = np.linalg.norm(normal)
                normal = normal / size if size > 1e-12 else rng.normal(size=width) / math.sqrt(max(1, width))
                place = own @ normal
                offset = float(np.median(place)) if len(own) else 0.0
                normals[t, n], offsets[t, n] = normal, offset
                right = place > offset
                inside += [inside[n][~right], inside[n][right]]
        return cls(normals, offsets, depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, numbered from 0 per tree."""
        out = np.zeros((len(vectors), len(self.normals)), np.int64)
        rows = np.arange(len(vectors))
        for t, (normals, offsets) in enumerate(zip(self.normals, self.offsets)):
            node = np.zeros(len(vectors), np.int64)
            if self.depth:
                margins = vectors.astype(np.float32) @ normals.T - offsets
                for _ in range(self.depth):
                    node = 2 * node + 1 + (margins[rows, node] > 0)
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def visits(self, queries: np.ndarray, budget: int) -> list[np.ndarray]:
        """Per query, the `budget` nearest leaves (tree * leaves + leaf) by one queue shared by all trees.

        The queue holds the smallest margin by which the way to a node has stayed on the query's side;
        a child on the other side counts its distance as negative.
        """
        inner, width = (1 << self.depth) - 1, 1 << self.depth
        out = []
        for start in range(0, len(queries), 256):
            block = queries[start : start + 256].astype(np.float32)
            margins = np.concatenate([block @ n.T - o for n, o in zip(self.normals, self.offsets)], axis=1) if inner else None
            for q in range(len(block)):
                own = margins[q].tolist() if inner else []
                heap = [(-math.inf, t, 0) for t in range(len(self.normals))]
                heapify(heap)
                found = []
                while heap and len(found) < budget:
                    cost, t, node = heappop(heap)
                    if node >= inner:
                        found.append(t * width + node - inner)
                        continue
                    margin = own[t * inner + node]
                    heappush(heap, (max(cost, margin), t, 2 * node + 1))
                    heappush(heap, (max(cost, -margin), t, 2 * node + 2))
                out.append(np.array(found, np.int64))
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector as doubles) of the rows that take part.

    Left out are NULL ids, and vectors that are NULL, empty, zero, hold NULL or non-finite components, or
    have another length than most. A row repeated in full counts once.
    """
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), doubles.alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes.n if sizes else 0)).distinct()


def fit_forest(rows: DataFrame, total: int, fit_rows: int = FIT_ROWS, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> Forest:
    sample = rows
    if total > fit_rows:
        sample = rows.where(F.pmod(F.xxhash64("id", "vector", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    return Forest.fit(_matrix(sample.orderBy("id").toPandas()["vector"]).astype(np.float32), total, trees, leaf_rows)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES,
    leaf_rows: int = LEAF_ROWS, leaf_share: float = LEAF_SHARE, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of largest inner product found, nearest first.

    The planes (trees * 2^depth of them, bounded by `fit_rows`) are fitted on a sample and broadcast. Every
    row is put into a leaf of each tree. A query visits the same share of all leaves at every size; its candidates are the rows
    of these leaves, ranked by the exact inner product of the original vectors in double precision.
    Rows lie in shards by a hash of their id and queries in blocks; a block meets a shard once, and k rows per query
    and shard are ranked again. Ties go to the smaller id; a query's own id is no neighbour of it. Rows that
    can't be compared (see `valid_vectors`) neither ask nor answer; no rows give no result.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    rows = materialize(valid_vectors(vectors, id_col, vector_col), "vectors")
    asked = materialize(valid_vectors(queries, id_col, vector_col), "queries")
    total, count = rows.count(), asked.count()
    if not total or not count or len(rows.first().vector) != len(asked.first().vector):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = fit_forest(rows, total, fit_rows, trees, leaf_rows)
    leaves = trees << forest.depth
    budget = min(leaves, max(MIN_LEAVES, math.ceil(leaf_share * leaves)))
    shared = spark.sparkContext.broadcast(forest)
    shards, blocks = -(-total // SHARD_ROWS), -(-count // BLOCK_QUERIES)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shared.value.visits(_matrix(batch["vector"]), budget)
            bits = np.zeros((len(found), leaves), bool)
            for i, f in enumerate(found):
                bits[i, f] = True
            yield batch.assign(leaves=[row.tobytes() for row in np.packbits(bits, axis=1)])

    kind = "id long, vector array<double>"
    visiting = materialize(asked.mapInPandas(visit, f"{kind}, leaves binary"), "visits")
    placed = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    sent = visiting.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def meet(key: tuple, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(asking):
            ids, matrix = own["id"].to_numpy(), _matrix(own["vector"])
            width = 1 << shared.value.depth
            number = shared.value.leaves(matrix) + np.arange(trees) * width
            for query, vector, packed in zip(asking["id"], asking["vector"], asking["leaves"]):
                visited = np.unpackbits(np.frombuffer(packed, np.uint8), count=leaves).view(bool)
                candidates = np.flatnonzero(visited[number].any(axis=1) & (ids != query))
                scores = matrix[candidates] @ np.asarray(vector, np.float64)
                best = best_of(scores, ids[candidates], k)
                columns["query_id"].append(np.full(len(best), query, np.int64))
                columns["vec_id"].append(ids[candidates[best]])
                columns["score"].append(scores[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64 if c != "score" else float) for c, v in columns.items()})

    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = spread.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
    met = pairs.applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op1_nearest_neighbours": op1_nearest_neighbours}
ORACLES: dict = {}
