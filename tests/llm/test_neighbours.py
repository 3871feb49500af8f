import math

import numpy as np

from galleryloom.llm import neighbours
from galleryloom.llm.common import table


def brute(ids, matrix, queries, k):
    out = {}
    for q in queries:
        scores = matrix @ matrix[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_query_recall(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    ids, matrix = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = collected(neighbours.op1_nearest_neighbours(spark, sf))
    want = brute(ids, matrix, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        vector = matrix[ids.index(q)]
        assert all(abs(s - matrix[ids.index(i)] @ vector) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_recall_and_work_on_many_rows(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<float>")
    got = collected(neighbours.nearest(df, df.where("vec_id % 50 = 0"), 10))
    want = brute(list(range(6000)), matrix.astype(np.float64), range(0, 6000, 50), 10)
    assert recall(got, want) >= 0.9
    forest = neighbours.Forest.fit(matrix, 6000)
    visits = forest.visits(matrix[:40], 20)
    assert all(len(set(v.tolist())) == 20 for v in visits)
    own = forest.leaves(matrix[:40]) + np.arange(len(forest.normals)) * (1 << forest.depth)
    assert np.mean([set(o) <= set(v.tolist()) for o, v in zip(own, visits)]) > 0.9


def test_edges(spark):
    good = [(i, [float(i % 7) + 1, 1.0, -float(i % 3)]) for i in range(30)]
    odd = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [math.nan, 1.0, 1.0]), (180, [math.inf, 1.0, 1.0]), (200, []), (None, [1.0, 1.0, 1.0]), (220, [1.0, 2.0])]
    rows = [*good, *odd, good[0], good[5]]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank string, score double")
    got = collected(neighbours.nearest(df, df.where("vec_id % 20 = 0"), 40))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {
        q: [i for i, _ in v] for q, v in brute([i for i, _ in good], np.array([v for _, v in good]), [0, 20], 40).items()
    }
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0
