"""Single linkage from the spanning tree against merging the closest clusters one by one."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import linkage
from millrace.operators.linkage import spanning_tree
from millrace.operators.models import semantic_cluster


def _brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.linalg.norm(u[:, None] - u[None], axis=2)
    label = np.arange(len(x))
    while len(set(label)) > k:
        apart = np.where(label[:, None] != label[None], d, np.inf)
        i, j = np.unravel_index(apart.argmin(), d.shape)
        label[label == label[j]] = label[i]
    first = {c: i for i, c in reversed(list(enumerate(label)))}
    order = sorted(first, key=first.get)
    return [order.index(c) for c in label]


def _table(spark, x, extra=()):
    return spark.createDataFrame([(f"k{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)] + list(extra), "k string, e array<double>")


@pytest.mark.parametrize("dims", [3])
def test_clusters_by_brute_force(spark, dims):
    r = np.random.default_rng(dims)
    # crowded groups, so that all known neighbours are inside, scattered points, and copies
    x = np.concatenate([r.normal(size=(1, dims)) + r.normal(size=(40, dims)) * 0.01 for _ in range(4)] + [r.normal(size=(30, dims))])
    x = x[r.permutation(len(x))]
    x = np.concatenate([x, x[:5]])
    df = _table(spark, x, [("none", None), ("zero", [0.0] * dims), ("gap", [None] + [1.0] * (dims - 1))])
    got = {g.k: g.cluster for g in semantic_cluster(df, "k", "e", 6).collect()}
    assert [got.pop(k) for k in ("none", "zero", "gap")] == [None] * 3
    assert [got[f"k{i:04d}"] for i in range(len(x))] == _brute(x, 6)


def test_tree_is_as_short_as_it_can_be(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(60, 3)), r.normal(size=(60, 3)) * 0.05 + 4])
    edges = spanning_tree(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    total, reached, gap = 0.0, np.zeros(len(x), bool), d[0].copy()
    reached[0] = True
    for _ in range(len(x) - 1):
        j = np.where(reached, np.inf, gap).argmin()
        total += gap[j]
        reached[j] = True
        gap = np.minimum(gap, d[j])
    assert len(edges) == len(x) - 1
    assert abs(sum(e.d for e in edges) - total) < 1e-9


def test_small_tables(spark):
    df = _table(spark, np.array([[1.0, 0], [2.0, 0], [0, 1.0]]))
    assert {g.k: g.cluster for g in semantic_cluster(df, "k", "e", 2).collect()} == {"k0000": 0, "k0001": 0, "k0002": 1}
    with pytest.raises(ValueError, match="4 clusters of 3 rows"):
        semantic_cluster(df, "k", "e", 4)


def test_the_largest_component_never_searches(spark, monkeypatch):
    asked, search = [], linkage.best_pairs

    def counted(queries, base, *args):
        if "kind" in queries.columns:
            asked.append(queries.count())
        return search(queries, base, *args)

    monkeypatch.setattr(linkage, "best_pairs", counted)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(150, 12)), r.normal(size=(12, 12)) * 0.01 + 9])
    edges = spanning_tree(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")).collect()
    assert len(edges) == len(x) - 1 and sum(e.d > 10 for e in edges) == 1
    # the twelve apart know each other only, the others know each other
    assert 12 <= sum(asked) < 40
