"""Closest pairs over blocks against the same walk over the whole table."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators.matching import closest_pairs
from millrace.operators.statistics import propensity_score_matching


def _brute(rows, caliper):
    rows = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    out, used = [], set()
    for p in {r[2] for r in rows}:
        one, two = ([r for r in rows if r[2] == p and r[1] == t] for t in (1, 0))
        for a, b in zip(one, two, strict=False):
            out.append((a[0], b[0]))
            used |= {a, b}
    rows = [r for r in rows if r not in used]
    while True:
        best = min(((rows[i + 1][2] - rows[i][2], i) for i in range(len(rows) - 1) if rows[i][1] != rows[i + 1][1]), default=None)
        if best is None or best[0] > caliper:
            return sorted(out)
        a, b = rows[best[1]], rows[best[1] + 1]
        out.append((a[0], b[0]) if a[1] else (b[0], a[0]))
        del rows[best[1] : best[1] + 2]


def _cases():
    r = np.random.default_rng(5)
    yield "mixed", [(i, int(r.random() < 0.3), float(r.random())) for i in range(160)], 0.02
    yield "ties", [(i, int(r.random() < 0.5), int(r.integers(40)) / 64) for i in range(160)], 0.1
    # a run of treated rows beside a run of controls: partners are found from their border outwards
    yield "runs", [(i, 1, 0.3 - i / 1024) for i in range(40)] + [(100 + i, 0, 0.3125 + i / 1024) for i in range(40)], 0.08
    # gaps that grow, so that each pair waits for the one before
    x = np.cumsum(0.001 * 1.02 ** np.arange(100))
    yield "chain", [(i, i % 2, float(v)) for i, v in enumerate(x)], 0.5
    yield "one kind", [(i, 1, 0.5) for i in range(50)], 0.1


@pytest.mark.parametrize(("name", "rows", "caliper"), list(_cases()), ids=[c[0] for c in _cases()])
def test_blocks_find_what_one_walk_finds(spark, name, rows, caliper):
    df = spark.createDataFrame(rows, "k long, y int, p double")
    for block in (40, 100_000):
        got = sorted((g.treated, g.control) for g in closest_pairs(df, caliper, block).collect())
        assert got == _brute(rows, caliper), block


def test_scores_keys_and_missing_values(spark):
    rows = [(f"k{i}", i % 3 == 0, float(i % 7) + (i % 3 == 0)) for i in range(90)] + [("none", None, 1.0), ("no x", True, None)]
    df = spark.createDataFrame(rows, "k string, y boolean, x double")
    got = propensity_score_matching(df, "k", "y", ["x"], 0.3).collect()
    assert len({g.treated for g in got}) == len({g.control for g in got}) == len(got) > 20
    assert all(abs(g.treated_score - g.control_score) <= 0.3 for g in got)
    assert not {"none", "no x"} & {x for g in got for x in (g.treated, g.control)}
    assert closest_pairs(spark.createDataFrame([], "k string, y int, p double"), 0.1).count() == 0
