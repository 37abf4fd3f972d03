"""Unit-root tests of long series cut into blocks, against the plain computation."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import ordered


def _ols(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, e, np.linalg.inv(x.T @ x)


def _adf(y, regression, most):
    d, best = np.diff(y), None
    for p in range(most + 1):
        t = d[most:]
        at = np.arange(1, len(t) + 1, dtype=float)
        x = np.column_stack([y[most:-1], *(d[most - k : -k] for k in range(1, p + 1)), *(at**k for k in range({"n": 0, "c": 1, "ct": 2}[regression]))])
        b, e, inv = _ols(x, t)
        aic = len(t) * np.log(e @ e / len(t)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, b[0] / np.sqrt(inv[0, 0] * (e @ e) / (len(t) - x.shape[1])), p, len(t))
    return best[1:]


def _kpss(y, regression):
    n = len(y)
    x = np.column_stack([np.ones(n), np.arange(n)])[:, : 1 if regression == "c" else 2]
    e = _ols(x, y)[1]
    lags = min(int(np.ceil(12 * (n / 100) ** 0.25)), n - 1)
    s2 = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / s2, lags


@pytest.mark.parametrize("block", [7, 64, 50_000])
def test_tests_by_blocks_equal_the_whole(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "SERIES_BLOCK", block)
    r = np.random.default_rng(4)
    walk, noise = np.cumsum(r.normal(size=260)) + 100, r.normal(size=190) + 0.01 * np.arange(190)
    data = [("walk", i, v) for i, v in enumerate(walk)] + [("noise", i, v) for i, v in enumerate(noise)] + [(None, i, v) for i, v in enumerate(noise[:9])] + [("short", 1, 2.0), ("none", 1, None), ("walk", 500, None)]
    df = spark.createDataFrame([(s, i, None if v is None else float(v)) for s, i, v in data], "s string, t long, y double").repartition(3)
    series = {"walk": walk, "noise": noise, None: noise[:9]}
    for regression in ("c", "ct"):
        got = {g.s: g for g in ordered.adf_test(df, "y", "t", ["s"], regression).collect()}
        also = {g.s: g for g in ordered.kpss_test(df, "y", "t", ["s"], regression).collect()}
        assert set(got) == {"walk", "noise", None, "short", "none"} == set(also)
        for s, y in series.items():
            n = len(y)
            stat, lags, n_obs = _adf(y, regression, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3))
            assert (got[s].lags, got[s].n_obs) == (lags, n_obs)
            assert got[s].statistic == pytest.approx(stat, rel=1e-6)
            k, lags = _kpss(y, regression)
            assert also[s].statistic == pytest.approx(k, rel=1e-8) and also[s].lags == lags
        assert got["short"].statistic is None and got["short"].n_obs == 1 and got["none"].n_obs == 0 and also["short"].statistic is None
    whole = df.where("s = 'walk'")
    assert ordered.adf_test(whole, "y", "t", regression="n", max_lag=2).first().statistic == pytest.approx(_adf(walk, "n", 2)[0], rel=1e-6)
    assert ordered.kpss_test(whole, "y", "t").first().stationary is (bool(_kpss(walk, "c")[0] < 0.463))
