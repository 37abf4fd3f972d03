"""Exact quantiles of a whole table, without a map of all its values in one task."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import num

#: Values of an interval that one task may sort; relative rank error of the sketches that narrow intervals down.
SMALL, ACCURACY = 50_000, 10_000


def _narrowed(values: DataFrame, open_: dict[int, tuple]) -> dict[int, tuple]:
    """rank -> (low, high, rows below low, rows within) after one step: ends from sketches, then counts that say whether the rank is between them."""
    within = {r: F.col("x").between(F.lit(a), F.lit(b)) for r, (a, b, *_) in open_.items()}
    sketch = []
    for r, (_, _, below, n) in open_.items():
        at = (r - below + 0.5) / n
        sides = [float(min(1, max(0, at + s * 3 / ACCURACY))) for s in (-1, 1)]
        sketch.append(F.percentile_approx(F.when(within[r], F.col("x")), sides, ACCURACY).alias(f"q{r}"))
    ends = values.agg(*sketch).first()
    tries = {r: tuple(ends[f"q{r}"]) for r in open_}
    counts = []
    for r, (a, b) in tries.items():
        inside = lambda side: F.when(within[r] & side, F.col("x"))  # noqa: E731, B023
        counts += [F.count_if(F.col("x") < a).alias(f"less{r}"), F.count_if(F.col("x") == a).alias(f"same{r}"), F.count_if(F.col("x") <= b).alias(f"upto{r}")]
        # the next values around the ends, so that each step drops at least one value
        counts += [F.max(inside(F.col("x") < a)).alias(f"before{r}"), F.min(inside(F.col("x") > a)).alias(f"after{r}"), F.min(inside(F.col("x") > b)).alias(f"beyond{r}")]
    seen, out = values.agg(*counts).first(), {}
    for r, (a, b) in tries.items():
        low, high, below, n = open_[r]
        less, same, upto = (seen[f"{k}{r}"] for k in ("less", "same", "upto"))
        if r < less:
            high, n = seen[f"before{r}"], less - below
        elif r < less + same:
            low, high, below, n = a, a, less, same
        elif r < upto:
            low, high, below, n = seen[f"after{r}"], b, less + same, upto - less - same
        else:
            low, below, n = seen[f"beyond{r}"], upto, below + n - upto
        out[r] = (low, high, below, n)
    return out


def exact_quantiles(df: DataFrame, column: str, ps: list[float]) -> list[float | None]:
    """The quantiles of a column with linear interpolation, as ``percentile`` gives them; NULL and NaN do not count, no values give None.

    An interval around each rank is narrowed down by sketches and confirmed by counts, until it holds few rows or one value.
    The driver sees ends and counts only; a task never holds more than SMALL values.
    """
    values = df.select(num(column).alias("x")).where("x is not null and not isnan(x)")
    first = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not first.n:
        return [None] * len(ps)
    places = [p * (first.n - 1) for p in ps]
    found = {r: (first.low, first.high, 0, first.n) for x in places for r in (floor(x), ceil(x))}
    is_open = lambda s: s[0] != s[1] and s[3] > SMALL
    while left := {r: s for r, s in found.items() if is_open(s)}:
        found |= _narrowed(values, left)
    exact = {r: s[0] for r, s in found.items() if s[0] == s[1]}
    few = {r: s for r, s in found.items() if r not in exact}
    if few:
        pick = [F.get(F.array_sort(F.collect_list(F.when(F.col("x").between(F.lit(a), F.lit(b)), F.col("x")))), F.lit(r - below)).alias(f"v{r}") for r, (a, b, below, _) in few.items()]
        row = values.agg(*pick).first()
        exact |= {r: row[f"v{r}"] for r in few}
    return [exact[floor(x)] if floor(x) == ceil(x) else (ceil(x) - x) * exact[floor(x)] + (x - floor(x)) * exact[ceil(x)] for x in places]
