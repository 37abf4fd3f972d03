"""Adjusted p values against their definitions, with ties, NULLs, text and values over several partitions."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import statistics


def _adjusted(p, method):
    order, m = np.argsort(p, kind="stable"), len(p)
    x, k = p[order], np.arange(1, len(p) + 1)
    if method == "bonferroni":
        y = x * m
    elif method == "holm":
        y = np.maximum.accumulate((m - k + 1) * x)
    else:
        y = np.minimum.accumulate((x * m / k * ((1 / k).sum() if method == "fdr_by" else 1))[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(1, y)
    return out


@pytest.mark.parametrize("method", ["bonferroni", "holm", "fdr_bh", "fdr_by"])
@pytest.mark.parametrize("most", [0, 100_000])
def test_adjusted_by_definition(spark, monkeypatch, method, most):
    monkeypatch.setattr(statistics, "MOST_BROADCAST", most)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = np.random.default_rng(6)
    p = np.concatenate([r.random(2500) ** 4, np.full(1000, 1.0), np.full(300, 1e-5), r.random(200) * 1e-3])
    text = [repr(float(x)) for x in p]  # 1e-05 sorts behind 0.5 as text
    df = spark.createDataFrame([*enumerate(text), (-1, None), (-2, None)], "i int, p string")
    try:
        got = statistics.multiple_comparison_correction(df, "p", method, 0.1)
        assert got.columns == ["i", "p", "p_adjusted", "significant"]
        got = {g.i: g for g in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = _adjusted(p, method)
    assert np.allclose([got[i].p_adjusted for i in range(len(p))], want, rtol=1e-12, atol=0)
    assert [got[i].significant for i in range(len(p))] == [g <= 0.1 for g in (got[i].p_adjusted for i in range(len(p)))]
    assert all(got[i].p_adjusted is None and got[i].significant is False for i in (-1, -2)) and len(got) == len(p) + 2


@pytest.mark.parametrize("method", ["holm", "fdr_by"])
def test_no_p_values(spark, method):
    df = spark.createDataFrame([(1, None)], "i int, p double")
    assert [tuple(g) for g in statistics.multiple_comparison_correction(df, "p", method).collect()] == [(1, None, None, False)]
    assert statistics.multiple_comparison_correction(df.limit(0), "p", method).count() == 0
