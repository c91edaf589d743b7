from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratagrid.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, id string, v int, score double"


def exact(x, ids, queries, k):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    out = {}
    for q in queries:
        s = u @ u[q]
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-round(s[i], 12), ids[i]))
        out[ids[q]] = [ids[i] for i in order[:k]]
    return out


def rows_of(x, ids):
    return [(int(i), [float(y) for y in r], "a", 1, 0.5) for i, r in zip(ids, x, strict=True)]


def test_recall_ties_and_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 100)
    monkeypatch.setattr(N, "QUERY_CHUNK", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:2000] = x[0]
    ids = np.arange(3000) * 2
    got = N.nearest(spark.createDataFrame(rows_of(x, ids), SCHEMA), F.col("id") % 50 == 0, list_size=64, calibrate=200).toPandas()
    want = exact(x.astype(np.float64), ids, range(0, 3000, 25), 5)
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 5).all()
    found = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    hits = np.mean([len(set(found[q].vec_id) & set(want[q])) / 5 for q in want])
    assert hits >= 0.9
    assert found[0].vec_id.tolist() == [2000, 2002, 2004, 2006, 2008] and np.allclose(found[0].score, 1)
    for q, g in found.items():
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and g.score.is_monotonic_decreasing
        u, v = x[q // 2].astype(float), x[g.vec_id.to_numpy() // 2].astype(float)
        assert np.allclose(g.score, v @ u / np.linalg.norm(u) / np.linalg.norm(v, axis=1), atol=1e-14)


def test_what_takes_no_part_and_small_tables(spark):
    ok = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (50, [0.0, -3.0]), (3, [1e20, 1e20]), (1, [2.0, 0.1])]
    bad = [(100, None), (150, []), (200, [0.0, 0.0]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (350, [None, 1.0]), (400, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "a", 1, 0.5) for i, v in ok + bad], SCHEMA)
    got = N.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 3)]
    assert N.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0
    assert N.nearest(df.where("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_any_magnitude_takes_part(spark):
    x = np.random.default_rng(5).normal(size=(40, 4))
    scale = np.array([1e200, 1e-200, 1.0, 5e-324, 1e308])
    big = [(i, [float(y) for y in x[i] / np.abs(x[i]).max() * scale[i % 5]]) for i in range(40)]
    got = N.nearest(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, list_size=1000).toPandas()
    plain = np.array([np.ldexp(np.array(v), -np.frexp(np.abs(v).max())[1]) for _, v in big])
    want = exact(plain, list(range(40)), range(0, 40, 10), 5)
    assert {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")} == want and got.score.between(-1 - 1e-12, 1 + 1e-12).all()


def test_large_cells_are_cut_into_lists(spark, monkeypatch):
    """As on a table far larger than the sample: two levels of lists, and the recall of the real walk."""
    monkeypatch.setattr(N, "CHUNK", 200)
    monkeypatch.setattr(N, "QUERY_CHUNK", 7)
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(4000, 12)) + 2 * rng.normal(size=(30, 12))[rng.integers(0, 30, 4000)]).astype(np.float32)
    ids = np.arange(4000)
    cut = []
    inner = N.sub_lists
    monkeypatch.setattr(N, "sub_lists", lambda *a: cut.append(len(a[1])) or inner(*a))
    got = N.nearest(spark.createDataFrame(rows_of(x, ids), SCHEMA), F.col("id") % 20 == 0, list_size=32, max_lists=12, sample=1000).toPandas()
    assert cut and cut[0] >= 6
    want = exact(x.astype(np.float64), ids, range(0, 4000, 20), 5)
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert set(found) == set(want) and np.mean([len(found[q] & set(want[q])) / 5 for q in want]) >= 0.9


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c = N.unit(rng.normal(size=(500, 24)))
    x = N.unit(rng.normal(size=(200, 24)))
    ids, dist = N.Graph(c).search(x, 1.1)
    true = np.sqrt(2 - 2 * x @ c.T)
    assert (np.abs(dist[:, 0] - true.min(axis=1)) < 1e-9).mean() > 0.97
    inside = (true <= 1.1 * true.min(axis=1)[:, None]).sum(axis=1).clip(max=96)
    assert (dist <= 1.1 * true.min(axis=1)[:, None]).sum() / inside.sum() > 0.97
    assert np.allclose(dist[ids >= 0], np.take_along_axis(true, ids, 1)[ids >= 0]) and (np.diff(dist, axis=1)[np.isfinite(dist[:, 1:])] >= 0).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids)
    ids, dist = N.Graph(c[:1]).search(x[:3], 1.1)
    assert (ids[:, 0] == 0).all() and (ids[:, 1:] == -1).all()


def test_lists_are_balanced():
    rng = np.random.default_rng(3)
    x = N.unit(np.concatenate([rng.normal(size=(3000, 8)) * 0.1 + np.eye(8)[0], rng.normal(size=(300, 8))]))
    c = N.balanced_centroids(x, 40)
    sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    assert len(c) >= 38 and sizes.max() < 6 * len(x) / len(c)
    assert len(N.balanced_centroids(np.repeat(x[:1], 50, axis=0), 5)) == 1
