"""Distances of all pairs and best pairs by blocks against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from millrace.operators import blocks, joins


def _distance(x, y, metric):
    if x is None or y is None or None in x or None in y or len(x) != len(y):
        return None
    dot = lambda a, b: sum(i * j for i, j in zip(a, b, strict=True))
    if metric == "dot":
        return -dot(x, y)
    if metric == "cosine":
        size = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
        return 1 - dot(x, y) / size if size else None
    gap = [abs(i - j) for i, j in zip(x, y, strict=True)]
    return math.sqrt(dot(gap, gap)) if metric == "euclidean" else sum(gap) if metric == "manhattan" else max(gap)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot", "manhattan", "chebyshev"])
def test_distances_of_any_number_of_queries(spark, metric):
    r = np.random.default_rng(3)
    x = {f"k{i:02d}": [float(c) for c in v] for i, v in enumerate(r.normal(size=(40, 3)))}
    x |= {"none": None, "gap": [1.0, None, 2.0], "zero": [0.0] * 3, "short": [1.0, 2.0], "copy": x["k05"]}
    df = spark.createDataFrame(list(x.items()), "k string, e array<double>").repartition(3)
    got = joins.distance_matrix(df, "e", "k", metric, maxRows=7)
    assert got.columns == ["a", "b", "distance"]
    rows = got.collect()
    assert len(rows) == len(x) ** 2 == len({(g.a, g.b) for g in rows})
    for g in rows:
        want = _distance(x[g.a], x[g.b], metric)
        assert g.distance == want if want is None else abs(g.distance - want) < 1e-12, g


def test_distances_of_more_than_a_thousand_queries(spark):
    df = spark.range(1100).selectExpr("cast(id as int) as k", "array(cast(id as float), 1f) as e")
    got = joins.distance_matrix(df, "e", "k", queries=df).selectExpr("count(*) n", "sum(distance) s", "count_if(distance = abs(a - b)) same").first()
    assert got.n == 1100**2 == got.same and got.s == sum(2 * (1100 - d) * d for d in range(1100))


def test_distances_of_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0])], "k int, e array<double>")
    assert joins.distance_matrix(df, "e", "k", queries=df.limit(0)).count() == 0 == joins.distance_matrix(df.limit(0), "e", "k", queries=df).count()
    assert joins.distance_matrix(df, "e", "k", outputFormat="square").collect() == [(1, 0.0)]
    assert blocks.block_rows(None) == blocks.MOST_ROWS


def _ranked(x, k, metric, include_self):
    """Neighbours by a plain loop: the best first, ties to the least id."""
    out = {}
    for i, v in x.items():
        far = [(_distance(v, w, metric), j) for j, w in x.items() if include_self or j != i]
        out[i] = [j for d, j in sorted((round(d, 13), j) for d, j in far if d is not None)[:k]]
    return {i: js for i, js in out.items() if js}


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan", "chebyshev"])
def test_best_pairs_by_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "MOST_ROWS", 50)
    monkeypatch.setattr(blocks, "CHUNK", 16)
    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(size=(120, 5)), np.repeat(r.normal(size=(1, 5)), 90, 0), r.normal(size=(20, 5)) * 0.01 + 3])
    x = {f"k{i:03d}": [float(c) for c in v[j]] for i, j in enumerate(r.permutation(len(v)))}
    df = spark.createDataFrame([*x.items(), ("none", None), ("gap", [None, *[1.0] * 4]), (None, [1.0] * 5)], "k string, e array<double>").repartition(5)
    for include_self in (False, True):
        got = {}
        for g in joins.top_k_similar(df, "e", "k", 4, metric, include_self).collect():
            if g.top_k_indices is not None:
                got[g.k] = g.top_k_indices
        assert got == _ranked(x, 4, metric, include_self)


def test_blocks_of_a_task_are_small(spark):
    """The scores of 4,000 queries and 25,000 rows together would be 800 MB."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    side = lambda n: blocks._Side(pa.table({"id": pa.array(np.arange(n)), "v": pa.array(list(r.normal(size=(n, 8))))}), "cosine")
    best, base = blocks._Best(side(4_000), 3, "cosine", False), [side(blocks.block_rows(64)) for _ in range(6)]
    tracemalloc.start()
    for y in base:
        best.meet(y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert best.found().num_rows == 12_000
