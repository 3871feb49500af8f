import hashlib
import math

import pytest

from galleryloom.operators import features as ft


@pytest.mark.parametrize("size", [1, 4, 300])
def test_cells_are_drawn_as_the_digits_say(spark, size, monkeypatch):
    """Every term's cells against the plain reading, also where all cells are used; the empty ones leave before they are put into lists."""
    written = []
    monkeypatch.setattr(ft, "checked_lookup", lambda df, label: written.append(df) or df)
    terms = [f"wört {i}" for i in range(size)]
    vocabulary = spark.createDataFrame([(t, 5) for t in terms], "term string, df long")
    weights = spark.createDataFrame([(t, t, 2.0) for t in terms], "key string, term string, weight double")
    got = {(r.key, r.component): r.value for r in ft.sparse_projection(weights, vocabulary, 16).collect()}
    root, wanted = math.sqrt(size), {}
    for t in terms:
        for c in range(16):
            u = int(hashlib.md5(f"42|{t}|{c}".encode()).hexdigest()[:8], 16) / 2**32
            if u < 1 / root:
                wanted[t, c] = 2.0 * (-1 if u < 0.5 / root else 1) * math.sqrt(root / 16)
    assert got == pytest.approx(wanted)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
