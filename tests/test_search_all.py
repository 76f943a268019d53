"""The vector search for all queries against numpy."""

from __future__ import annotations

import numpy as np

from repolith.operators import search


def test_nearest_of_every_query(spark):
    v = np.random.default_rng(5).normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in search.nearest(df, k=60).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == {0, 50, 100}
    for q, ranked in got.items():
        assert [ranked[k] for k in range(1, 61)] == np.argsort(-(u @ u[q]), kind="stable")[:60].tolist()
