"""Searches by lists against brute force; recall of visits to a few lists; SMOTE and k-nearest imputation with true neighbours."""

from __future__ import annotations

import math

import numpy as np
import pytest

from millrace.operators import joins, neighbours, rows, scaling


def _table(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")


def _brute(x, k, include_self=False, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    out = {}
    for q, i in enumerate(ids):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = sorted((dist, j) for dist, j in zip(d.tolist(), ids, strict=True) if include_self or j != i)
        out[i] = order[:k]
    return out


@pytest.mark.parametrize(("d", "n"), [(2, 900), (24, 400)])
def test_knn_join_by_brute_force(spark, monkeypatch, d, n):
    monkeypatch.setattr(neighbours, "ROWS_PER_LIST", 40)
    monkeypatch.setattr(neighbours, "SLAB", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    r = np.random.default_rng(d)
    x = np.round(r.normal(size=(n, d)) * r.choice([0.1, 1, 5], size=(n, 1)), 3)
    x[n // 2 :: 3] = x[0]  # a group of copies, over several slabs
    df = _table(spark, range(n), x)
    got: dict[int, list] = {}
    for g in neighbours.knn_join(df, df, 6).orderBy("source", "rank").collect():
        got.setdefault(g.source, []).append((g.distance, g.neighbour))
    want = _brute(x, 6)
    for i in range(n):
        assert np.allclose([a for a, _ in got[i]], [a for a, _ in want[i]], atol=1e-9)
        if d == 2:
            assert [b for _, b in got[i]] == [b for _, b in want[i]]


def test_knn_join_of_nulls_repeats_few_and_none(spark):
    df = _table(spark, [1, 1, 2, 3, None], [[0, 0], [0, 0], [1, 0], None, [5, 5]])
    got = neighbours.knn_join(df, df, 10).collect()
    assert sorted((g.source, g.neighbour) for g in got) == [(1, 2), (1, 2), (2, 1), (2, 1)]
    assert neighbours.knn_join(df, df.limit(0), 3).count() == 0 == neighbours.knn_join(df.limit(0), df, 3).count()


def test_recall_of_lists_and_exactness_of_bounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_LIST", 100)  # twenty lists
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0")
    pairs = {m: {(r.source, r.neighbour) for r in joins.nearest_neighbors(df, "embedding", "vec_id", 5, queries=asked, **kw).collect()} for m, kw in {"none": {}, "bounds": {"index": "bounds"}, "lists": {"index": "lists", "probes": 1}}.items()}
    assert pairs["bounds"] == pairs["none"]
    assert len(pairs["none"] & pairs["lists"]) < len(pairs["none"])  # one list of twenty misses some
    neighbours_of = lambda p: len(pairs["none"] & {(r.source, r.neighbour) for r in p.collect()}) / len(pairs["none"])
    assert neighbours_of(joins.nearest_neighbors(df, "embedding", "vec_id", 5, queries=asked, index="lists", probes=14)) >= 0.9
    with pytest.raises(ValueError):
        joins.nearest_neighbors(df, "embedding", "vec_id", index="lists", metric="manhattan")


def test_impute_knn_by_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 3))
    x[200:220] = x[100:120]
    x[:, :2][r.random((300, 2)) < 0.15] = np.nan
    x[7] = np.nan
    df = spark.createDataFrame([(i, *(None if math.isnan(c) else float(c) for c in v)) for i, v in enumerate(x)], "key long, a double, b double, c double")
    got = np.array([list(g)[1:] for g in scaling.impute_knn(df, ["a", "b", "c"], "key", 4).orderBy("key").collect()], float)
    full = [i for i in range(300) if not np.isnan(x[i]).any()]
    for i in range(300):
        gone = np.isnan(x[i])
        if gone.any():
            seen = ~gone
            near = sorted(full, key=lambda j: (math.dist(x[j][seen], x[i][seen]), j))[:4]
            assert np.allclose(got[i][gone], x[near][:, gone].mean(0))
        assert np.allclose(got[i][~gone], x[i][~gone])
    none = spark.createDataFrame([(1, None), (2, None)], "key long, a double")
    assert [g.a for g in scaling.impute_knn(none, ["a"], "key").collect()] == [None, None]
    assert scaling.impute_knn(none.limit(0), ["a"], "key").count() == 0


def test_smote_points_lie_between_true_neighbours(spark):
    r = np.random.default_rng(9)
    small = np.round(np.concatenate([r.normal(size=(30, 2)), r.normal(size=(10, 2)) + 50]), 3)
    data = [("small", *map(float, v)) for v in small] + [("big", *map(float, v)) for v in r.normal(size=(140, 2))] + [("one", 1.0, 2.0), ("lacks", None, 1.0), (None, 0.0, 0.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "y string, a double, b double")
    out = rows.smote_oversample(df, "y", ["a", "b"], k=3).collect()
    assert sorted(tuple(map(str, o)) for o in out) == sorted(tuple(map(str, o)) for o in rows.smote_oversample(df, "y", ["a", "b"], k=3).collect())
    count = lambda y: sum(o.y == y for o in out)
    assert [count(y) for y in ("small", "big", "one", None, "lacks")] == [140, 140, 140, 140, 1]
    near = _brute(small, 3)
    for o in (o for o in out if o.y == "small" and o.synthetic):
        p = np.array([o.a, o.b])
        gaps = []
        for i, found in near.items():
            for _, j in found:
                u, w = small[i], small[j]
                t = np.clip(np.dot(p - u, w - u) / max(np.dot(w - u, w - u), 1e-12), 0, 1)
                gaps.append(np.linalg.norm(u + t * (w - u) - p))
        assert min(gaps) < 1e-9
