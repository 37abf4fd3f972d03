"""Feature scaling and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import finite, num, numeric_columns, with_stats
from millrace.functions.quantiles import exact_quantiles
from millrace.operators.neighbours import knn_join
from millrace.operators.rows import numbered
from millrace.plans.lineage import origin, per_column
from millrace.plans.registry import operator
from millrace.scratch import settle


def _scaled(df: DataFrame, stats: dict, new: dict) -> DataFrame:
    out = with_stats(df, **stats)
    return out.withColumns(new).drop(*stats)


@operator(columns=("columns",), lineage=per_column("columns", "scale"))
def scale_standard(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / sample deviation, 0 where that is 0."""
    stats = {f"__m{c}": F.mean(num(c)) for c in columns} | {f"__s{c}": F.stddev_samp(num(c)) for c in columns}
    return _scaled(df, stats, {c + suffix: F.when(F.coalesce(f"__s{c}", F.lit(0.0)) == 0, F.lit(0.0)).otherwise((num(c) - F.col(f"__m{c}")) / F.col(f"__s{c}")) for c in columns})


@operator(columns=("columns",), lineage=per_column("columns", "scale"))
def scale_minmax(df: DataFrame, columns: list[str], rangeMin: float = 0.0, rangeMax: float = 1.0, suffix: str = "_minmax") -> DataFrame:
    """To [rangeMin, rangeMax]; a span of 0 counts as 1."""
    stats = {f"__l{c}": F.min(num(c)) for c in columns} | {f"__h{c}": F.max(num(c)) for c in columns}
    span = lambda c: F.when(F.col(f"__h{c}") == F.col(f"__l{c}"), F.lit(1.0)).otherwise(F.col(f"__h{c}") - F.col(f"__l{c}"))
    return _scaled(df, stats, {c + suffix: (num(c) - F.col(f"__l{c}")) / span(c) * (rangeMax - rangeMin) + rangeMin for c in columns})


@operator(columns=("columns",), lineage=per_column("columns", "scale"))
def scale_robust(df: DataFrame, columns: list[str], suffix: str = "_robust") -> DataFrame:
    """(x - median) / interquartile range, with interpolated quantiles (exact, in passes over the table); a range of 0 counts as 1, NaN does not count."""
    new = {}
    for c in columns:
        low, mid, high = (F.lit(q).cast("double") for q in exact_quantiles(df, c, [0.25, 0.5, 0.75]))
        new[c + suffix] = (num(c) - mid) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return df.withColumns(new)


@operator(columns=("columns",))
def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2, includeInteractions: bool = True) -> DataFrame:
    new = {f"{c}_pow{d}": F.pow(num(c), d) for c in columns for d in range(2, degree + 1)}
    if includeInteractions:
        new |= {f"{a}_x_{b}": num(a) * num(b) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    return df.withColumns(new)


def _yeo(x, l: float):  # noqa: E741
    pos = F.log1p(x) if abs(l) < 1e-9 else (F.pow(x + 1, l) - 1) / l
    neg = -F.log1p(-x) if abs(l - 2) < 1e-9 else -(F.pow(1 - x, 2 - l) - 1) / (2 - l)
    return F.when(x >= 0, pos).otherwise(neg)


@operator(columns=("columns",), lineage=per_column("columns", "scale"))
def yeo_johnson(df: DataFrame, columns: list[str], suffix: str = "_yj") -> DataFrame:
    """The power transform of largest likelihood, standardised. Two grids of exponents, each one aggregate for all columns."""
    best = dict.fromkeys(columns, 0.0)
    for grid in ([x / 4 for x in range(-12, 13)], [x / 40 for x in range(-10, 11)]):
        tried = {c: [best[c] + g for g in grid] for c in columns}
        terms = []
        for c in columns:
            x = num(c)
            jac = F.sum(F.signum(x) * F.log1p(F.abs(x)))
            terms += [(-F.count(x) / 2 * F.ln(F.greatest(F.var_pop(_yeo(x, l)), F.lit(1e-300))) + (l - 1) * jac).alias(f"{c}|{i}") for i, l in enumerate(tried[c])]
        row = df.agg(*terms).first()
        for c in columns:
            found = [(row[f"{c}|{i}"], l) for i, l in enumerate(tried[c]) if row[f"{c}|{i}"] is not None]
            best[c] = max(found)[1] if found else 1.0
    new = {c: _yeo(num(c), best[c]) for c in columns}
    stats = {f"__m{c}": F.mean(new[c]) for c in columns} | {f"__s{c}": F.stddev_pop(new[c]) for c in columns}
    return _scaled(df, stats, {c + suffix: finite((new[c] - F.col(f"__m{c}")) / F.nullif(F.col(f"__s{c}"), F.lit(0.0))) for c in columns})


@operator(columns=("columns",), lineage=per_column("columns", "impute"))
def impute_mean_median_mode(df: DataFrame, columns: list[str], strategy: str = "auto") -> DataFrame:
    """auto: the median of numbers, the mode of others (the least of equally frequent values)."""
    numeric = set(numeric_columns(df))
    pick = lambda c: strategy if strategy != "auto" else ("median" if c in numeric else "mode")
    fn = {"mean": lambda c: F.mean(num(c)), "median": lambda c: F.median(num(c)), "mode": lambda c: F.mode(c, True)}
    stats = {f"__v{c}": fn[pick(c)](c) for c in columns}
    return _scaled(df, stats, {c: F.coalesce(num(c) if pick(c) != "mode" else F.col(c), F.col(f"__v{c}")) for c in columns})


@operator(columns=("columns",), lineage=lambda inputs, p, outputs: {c: origin("df", p["columns"], "impute") for c in p["columns"]})
def impute_knn(df: DataFrame, columns: list[str], key: str, k: int = 5) -> DataFrame:
    """Missing values become the mean over the k nearest complete rows, by Euclidean distance over the columns that the row has; ties go to the least key.

    One exact search by lists for each pattern of missing columns. Rows without any value take the mean over
    the k complete rows of least key; without any complete row nothing is filled in. Repeated keys are filled each by its own
    values; a NULL key asks like any other.
    """
    values = [F.when(~F.isnan(num(c)), num(c)) for c in columns]
    own = settle(df.withColumns({"__pattern": F.array(*(v.isNull() for v in values)), "__values": F.array(*values), "__row": F.monotonically_increasing_id()}), "impute-rows")
    holes = own.where(F.array_contains("__pattern", True))
    # numbered in the order of keys, so that the least number is the least key
    complete = settle(numbered(own.where(~F.array_contains("__pattern", True)), [key, "__row"], "__n").select("__n", "__values"), "impute-complete")
    found = []
    for (pattern,) in holes.select("__pattern").distinct().collect():
        asked = holes.where(F.col("__pattern") == F.array(*(F.lit(x) for x in pattern)))
        seen = [i for i, gone in enumerate(pattern) if not gone]
        if seen:
            part = F.array(*(F.get("__values", F.lit(i)) for i in seen))
            near = knn_join(asked.select(F.col("__row").alias("id"), part.alias("v")), complete.select(F.col("__n").alias("id"), part.alias("v")), k, include_self=True)
            found.append(near.select(F.col("source").alias("__row"), F.col("neighbour").alias("__n")).join(complete, "__n").select("__row", "__values"))
        else:
            first = complete.where(F.col("__n") <= k).select("__values")
            found.append(asked.select("__row").crossJoin(F.broadcast(first)))
    if not found:
        return df
    means = reduce(DataFrame.unionByName, found).groupBy("__row").agg(*(F.mean(F.get("__values", F.lit(i))).alias(f"__v{i}") for i in range(len(columns))))
    return own.join(means, "__row", "left").withColumns({c: F.coalesce(v, F.col(f"__v{i}")) for i, (c, v) in enumerate(zip(columns, values, strict=True))}).select(*df.columns)


@operator(columns=("columns",), lineage=lambda inputs, p, outputs: {c: origin("df", p["columns"], "impute") for c in p["columns"]})
def impute_mice(df: DataFrame, columns: list[str], maxIter: int = 10) -> DataFrame:
    """Chained least squares: each column's gaps from the others, round by round. A round is one aggregate of products and one select."""
    import numpy as np

    start = {f"__o{c}": num(c) for c in columns}
    means = df.agg(*(F.mean(num(c)).alias(c) for c in columns)).first()
    filled = df.withColumns(start).withColumns({c: F.coalesce(num(c), F.lit(means[c])) for c in columns})
    before = None
    for _ in range(maxIter):
        coefs = []
        for c in columns:
            xs = [F.lit(1.0), *(F.col(o) for o in columns if o != c)]
            seen = filled.where(F.col(f"__o{c}").isNotNull())
            sums = seen.agg(*(F.coalesce(F.sum(a * b), F.lit(0.0)) for a in xs for b in xs), *(F.coalesce(F.sum(a * F.col(f"__o{c}")), F.lit(0.0)) for a in xs)).first()
            n = len(xs)
            g, r = np.array(sums[: n * n]).reshape(n, n), np.array(sums[n * n :])
            coefs.append(np.linalg.pinv(g + 1e-9 * np.eye(n)) @ r)
        base = df.withColumns(start).withColumns({c: F.coalesce(num(c), F.lit(means[c])) for c in columns}) if before is None else filled
        guess = {c: F.coalesce(F.col(f"__o{c}"), reduce(lambda a, b: a + b, [F.lit(float(coefs[i][0])), *(F.lit(float(v)) * F.col(o) for v, o in zip(coefs[i][1:], [o for o in columns if o != c], strict=True))])) for i, c in enumerate(columns)}
        filled = base.withColumns(guess)
        now = np.concatenate(coefs)
        if before is not None and np.allclose(now, before, rtol=1e-3, atol=1e-6):
            break
        before = now
    return filled.drop(*start)
