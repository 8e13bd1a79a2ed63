"""Queries that the limit of cells stops short are searched exactly."""

import numpy as np

from pathloom.llm import neighbours


def test_capped_queries_lose_nothing(spark):
    x = np.random.default_rng(3).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, df.where("vec_id < 12"), cell_rows=100, cells=1).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(12):
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q][k] for k in range(1, 21)] == np.argsort(-s)[:20].tolist()


def test_visits_tell_whether_the_mass_is_reached():
    t = neighbours.Tables(8, 10, 0.7, 0.5, 3.0, 1, most=50)
    line = t.lines(np.ones((1, 8)), True)[0][0]
    cells, whole = t.visits(0, line, 0.86)
    assert not whole and len(cells) >= 50
    assert t.visits(0, line, 1e-6)[1]
