"""DBSCAN by cells against brute force, with crowded cells, text keys, ties at eps and missing values."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import models


def _brute(keys, x, eps, least):
    n = len(x)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = [None] * n
    for i in sorted(range(n), key=lambda i: keys[i]):
        if core[i] and label[i] is None:
            stack, label[i] = [i], keys[i]
            while stack:
                for j in np.nonzero(near[stack.pop()] & core)[0]:
                    if label[j] is None:
                        label[j] = keys[i]
                        stack.append(j)
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in np.nonzero(near[i] & core)[0]), default=None)
    return label


@pytest.mark.parametrize(("d", "eps", "least"), [(1, 0.05, 3), (2, 0.3, 5), (3, 0.5, 4)])
def test_dbscan_by_brute_force(spark, d, eps, least):
    r = np.random.default_rng(d)
    x = np.concatenate([r.normal(size=(120, d)), r.normal(size=(150, d)) * 0.02 + 3, r.normal(size=(60, d)) * 0.1 - 2, np.repeat(r.normal(size=(1, d)) + 5, 20, axis=0)])
    # a lattice with steps of exactly eps: ties decide
    x = np.concatenate([x, np.arange(24)[:, None] * 0.5 * np.eye(1, d) + 20]) if eps == 0.5 else x
    keys = [f"k{i:04d}" for i in r.permutation(len(x))]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in zip(keys, x, strict=True)] + [("none", None, *[1.0] * (d - 1)), ("inf", float("inf"), *[1.0] * (d - 1))], "k string, " + ", ".join(f"c{i} double" for i in range(d)))
    got = {g.k: g.cluster for g in models.dbscan(df, "k", [f"c{i}" for i in range(d)], eps, least, scale=False).collect()}
    assert got.pop("none") is None and got.pop("inf") is None
    assert got == dict(zip(keys, ["-1" if v is None else v for v in _brute(keys, x, eps, least)], strict=True))


def test_a_crowded_cell_and_an_empty_table(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.random((30_000, 2)) * 0.1, r.random((30_000, 2)) * 0.1 + [0.45, 0], [[5.0, 5.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    sizes = {g.cluster: g["count"] for g in models.dbscan(df, "k", ["a", "b"], 0.5, 5, scale=False).groupBy("cluster").count().collect()}
    assert sizes == {0: 60_000, -1: 1}
    apart = {g.cluster: g["count"] for g in models.dbscan(df, "k", ["a", "b"], 0.34, 5, scale=False).groupBy("cluster").count().collect()}
    assert apart == {0: 30_000, 30_000: 30_000, -1: 1}
    assert models.dbscan(df.limit(0), "k", ["a", "b"]).count() == 0
