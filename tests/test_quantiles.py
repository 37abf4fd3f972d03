"""Quantiles by narrowed intervals against numpy, on spread, tied and skewed values."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.functions import quantiles
from millrace.operators.scaling import scale_robust


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 5)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)


@pytest.mark.parametrize("kind", ["spread", "two values", "skewed"])
def test_by_numpy(spark, small, kind):
    r = np.random.default_rng(2)
    x = {"spread": r.normal(size=3_001), "two values": np.repeat([1.0, 2.0], [1_000, 1_001]), "skewed": np.concatenate([np.zeros(900), 10.0 ** r.uniform(-200, 200, 1_100)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    ps = [0.0, 0.25, 0.4999, 0.5, 0.75, 1.0]
    assert np.allclose(quantiles.exact_quantiles(df, "x", ps), np.quantile(x, ps), rtol=1e-12, atol=0)


def test_empty_nan_and_scaling(spark, small):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    assert quantiles.exact_quantiles(df.where("x < 0"), "x", [0.5]) == [None]
    assert quantiles.exact_quantiles(df.union(df.selectExpr("double('nan') as x")), "x", [0.5]) == [50.0]
    assert {g.x: g.x_robust for g in scale_robust(df, ["x"]).collect()} == {float(i): (i - 50) / 50 for i in range(101)} | {None: None}
