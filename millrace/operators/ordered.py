"""Windows and ordered operators. Series are told apart by partition_by; without it a table is one series, and so one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import names, num, order, window, with_stats
from millrace.operators.rows import numbered
from millrace.plans.lineage import origin, per_column
from millrace.plans.registry import operator
from millrace.scratch import settle

By = list[str] | None


def _rows(by: By, order_by: list, lo: int, hi: int):
    return window(by, order_by).rowsBetween(lo, hi)


def _upto(by: By, order_by: list):
    return _rows(by, order_by, Window.unboundedPreceding, 0)


def _over_window(inputs, p, outputs):
    keys = [k if isinstance(k, str) else k["column"] for k in p["orderBy"] or []]
    read = [p["column"]] if p["column"] else [] if p["fn"] == "count" else keys
    return {p["as_"] or f"{p['fn']}_{p['column'] or 'rows'}": origin("df", read, "window", f"{p['fn']}({p['column'] or '*'})")}


@operator(lineage=_over_window)
def window_aggregate(df: DataFrame, fn: str, column: str | None = None, partitionBy: By = None, orderBy: list | None = None, as_: str | None = None, frame: str | None = None, start: int | None = None, end: int | None = None, offset: int = 1, buckets: int = 4) -> DataFrame:
    """sum, mean, min, max, count, rank, dense_rank, percent_rank, ntile, row_number, lag, lead, first, last; the frame is SQL's default unless given as rows or range."""
    w = window(partitionBy, orderBy)
    if frame:
        lo, hi = Window.unboundedPreceding if start is None else start, Window.currentRow if end is None else end
        w = w.rowsBetween(lo, hi) if frame == "rows" else w.rangeBetween(lo, hi)
    ranks = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "row_number": F.row_number}
    if fn in ranks:
        c = ranks[fn]()
    elif fn == "ntile":
        c = F.ntile(buckets)
    elif fn in ("lag", "lead"):
        c = getattr(F, fn)(column, offset)
    elif fn == "count" and not column:
        c = F.count(F.lit(1))
    else:
        c = {"sum": F.sum, "mean": F.mean, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last}[fn](column)
    return df.withColumn(as_ or f"{fn}_{column or 'rows'}", c.over(w))


_ROLL = {"mean": F.mean, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def _rolled(inputs, p, outputs):
    return {x.get("as") or f"{x['column']}_{x['fn']}_{x['window']}": origin("df", x["column"], "window", f"{x['fn']}({x['column']})") for x in p["windows"]}


@operator(columns=("time_column",), lineage=_rolled)
def rolling(df: DataFrame, time_column: str, windows: list[dict], min_periods: int = 1, partition_by: By = None) -> DataFrame:
    """windows [{column, fn, window, as}]: window is a number of rows, or a time such as 7d that covers (t - w, t]."""
    t = F.unix_micros(F.col(time_column).cast("timestamp"))
    out = df.withColumn("__t", t)
    for x in windows:
        size = str(x["window"])
        if size.isdigit():
            w = _rows(partition_by, [time_column], -(int(size) - 1), 0)
        else:
            micros = int("".join(c for c in size if c.isdigit())) * {"s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400, "w": 604800}["".join(c for c in size if not c.isdigit())] * 1_000_000
            w = Window.partitionBy(*(partition_by or [])).orderBy("__t").rangeBetween(-micros + 1, 0)
        c = F.when(F.count(x["column"]).over(w) >= min_periods, _ROLL[x["fn"]](x["column"]).over(w))
        out = out.withColumn(x.get("as") or f"{x['column']}_{x['fn']}_{size}", c)
    return out.drop("__t")


@operator(columns=("columns",), lineage=per_column("columns", "lag"))
def lag_features(df: DataFrame, columns: list[str], sortColumn: str, lags: str | list = "1", groupColumn: str | None = None) -> DataFrame:
    w = window([groupColumn] if groupColumn else None, [sortColumn])
    return df.withColumns({f"{c}_lag{n}": F.lag(c, int(n)).over(w) for c in columns for n in names(str(lags) if isinstance(lags, int) else lags)})


@operator(columns=("columns",), lineage=per_column("columns", "impute"))
def impute_forward_backward(df: DataFrame, columns: list[str], sortColumn: str, direction: str = "forward", groupColumn: str | None = None) -> DataFrame:
    by = [groupColumn] if groupColumn else None
    ahead, back = _upto(by, [sortColumn]), _rows(by, [sortColumn], 0, Window.unboundedFollowing)
    fill = {"forward": lambda c: F.last(c, True).over(ahead), "backward": lambda c: F.first(c, True).over(back), "both": lambda c: F.coalesce(F.last(c, True).over(ahead), F.first(c, True).over(back))}[direction]
    return df.withColumns({c: fill(c) for c in columns})


@operator(columns=("columns",), lineage=per_column("columns", "impute"))
def impute_interpolation(df: DataFrame, columns: list[str], sortColumn: str, method: str = "linear", groupColumn: str | None = None) -> DataFrame:
    """Linear by row place inside gaps; ``nearest`` fills forward, then backward."""
    by = [groupColumn] if groupColumn else None
    if method != "linear":
        return impute_forward_backward(df, columns, sortColumn, "both", groupColumn)
    out = df.withColumn("__i", F.row_number().over(window(by, [sortColumn])))
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct("__i", num(c).alias("v")))
        out = out.withColumn("__a", F.last(at, True).over(_upto(by, [sortColumn]))).withColumn("__b", F.first(at, True).over(_rows(by, [sortColumn], 0, Window.unboundedFollowing)))
        line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__i") - F.col("__a.__i")) / (F.col("__b.__i") - F.col("__a.__i"))
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), num(c)).otherwise(line)).drop("__a", "__b")
    return out.drop("__i")


@operator()
def sensor_resample_regular(df: DataFrame, timestampColumn: str, valueColumn: str, sensorColumn: str, intervalSeconds: float = 60.0) -> DataFrame:
    """A regular grid for each sensor, interpolated between the readings before and after."""
    step = int(intervalSeconds * 1_000_000)
    rows = df.select(F.col(sensorColumn).alias("s"), F.unix_micros(F.col(timestampColumn).cast("timestamp")).alias("t"), num(valueColumn).alias("v")).dropna().groupBy("s", "t").agg(F.mean("v").alias("v"))
    grid = rows.groupBy("s").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("s", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("t"))
    both = rows.withColumn("g", F.lit(False)).unionByName(grid.select("s", "t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("g")))
    known = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    w = Window.partitionBy("s").orderBy("t")
    both = both.withColumn("a", F.last(known, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(known, True).over(w.rangeBetween(0, Window.unboundedFollowing))).where("g")
    line = F.when(F.col("a.t") == F.col("b.t"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return both.select(F.col("s").alias(sensorColumn), F.timestamp_micros("t").alias(timestampColumn), line.alias(valueColumn))


@operator()
def stream_drift_detect(df: DataFrame, valueColumn: str, orderColumn: str, threshold: float = 50.0, delta: float = 0.005, partition_by: By = None) -> DataFrame:
    """Page-Hinkley: the running sum of deviations from the running mean, above its running minimum (or 0) by more than the threshold."""
    w = _upto(partition_by, [orderColumn])
    out = df.withColumn("__d", num(valueColumn) - F.mean(num(valueColumn)).over(w) - delta).withColumn("__c", F.sum("__d").over(w))
    out = out.withColumn("ph_stat", F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(w)))
    return out.withColumn("drift", F.col("ph_stat") > threshold).drop("__d", "__c")


@operator()
def downsample_cic(df: DataFrame, valueColumn: str, orderColumn: str, decimationFactor: int = 10, stages: int = 3, partition_by: By = None) -> DataFrame:
    """Integrators, decimation, combs, and the gain taken off."""
    w, out = window(partition_by, [orderColumn]), df.withColumn("__v", num(valueColumn)).withColumn("__i", F.row_number().over(window(partition_by, [orderColumn])))
    for _ in range(stages):
        out = out.withColumn("__v", F.sum("__v").over(_upto(partition_by, [orderColumn])))
    out = out.where((F.col("__i") - 1) % decimationFactor == 0)
    for _ in range(stages):
        out = out.withColumn("__v", F.col("__v") - F.coalesce(F.lag("__v").over(w), F.lit(0.0)))
    return out.withColumn("filtered", F.col("__v") / float(decimationFactor**stages)).drop("__v", "__i")


@operator()
def multi_sensor_fusion(df: DataFrame, sensorColumns: list[str], weights: str | list = "", outputColumn: str = "fused") -> DataFrame:
    w = [float(x) for x in names(weights)] if weights else [1.0] * len(sensorColumns)
    return df.withColumn(outputColumn, sum((num(c) * (x / sum(w)) for c, x in zip(sensorColumns, w, strict=True)), F.lit(0.0)))


@operator()
def anomaly_zscore(df: DataFrame, value: str, order_by: list, size: int = 30, threshold: float = 3.0, min_periods: int = 10, partition_by: By = None) -> DataFrame:
    w = _rows(partition_by, order_by, -(size - 1), 0)
    ready = F.count(value).over(w) >= min_periods
    z = (num(value) - F.mean(num(value)).over(w)) / F.greatest(F.stddev_samp(num(value)).over(w), F.lit(1e-9))
    out = df.withColumn("z_score", F.when(ready, z))
    return out.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))


@operator()
def changepoint_detection(df: DataFrame, value: str, order_by: list, threshold: float = 5.0, drift: float = 0.5, partition_by: By = None) -> DataFrame:
    """Two-sided CUSUM of z values from the second row on, as running sums less their running extremes."""
    p = Window.partitionBy(*(partition_by or []))
    w, first = _upto(partition_by, order_by), F.row_number().over(window(partition_by, order_by)) == 1
    z = (num(value) - F.mean(num(value)).over(p)) / F.nullif(F.stddev_pop(num(value)).over(p), F.lit(0.0))
    out = df.withColumn("__z", F.coalesce(z, F.lit(0.0))).withColumn("__first", first)
    out = out.withColumn("__u", F.sum(F.when(F.col("__first"), 0.0).otherwise(F.col("__z") - drift)).over(w)).withColumn("__l", F.sum(F.when(F.col("__first"), 0.0).otherwise(F.col("__z") + drift)).over(w))
    out = out.withColumn("cusum_pos", F.col("__u") - F.min("__u").over(w)).withColumn("cusum_neg", F.max("__l").over(w) - F.col("__l"))
    return out.withColumn("is_changepoint", F.greatest("cusum_pos", "cusum_neg") > threshold).drop("__z", "__first", "__u", "__l")


@operator()
def replace_outliers(df: DataFrame, value: str, flag: str, order_by: list, size: int = 7, output_column: str = "value_clean", partition_by: By = None) -> DataFrame:
    """Flagged values become the median of the rows before (at least two)."""
    w = _rows(partition_by, order_by, -(size - 1), 0)
    median = F.when(F.count(value).over(w) >= 2, F.percentile(num(value), 0.5).over(w))
    return df.withColumn(output_column, F.when(F.col(flag), F.coalesce(median, num(value))).otherwise(num(value)))


@operator()
def acf_pacf(df: DataFrame, value: str, order_by: list, max_lag: int = 40) -> DataFrame:
    """(lag, acf, pacf, bound): lagged products in one aggregate; Levinson-Durbin on these few numbers."""
    s = with_stats(df.where(F.col(value).isNotNull()), __m=F.mean(num(value))).withColumn("__x", num(value) - F.col("__m"))
    w = window(None, order_by)
    lagged = s.select("__x", *(F.lag("__x", k).over(w).alias(f"l{k}") for k in range(1, max_lag + 1)))
    row = lagged.agg(F.count(F.lit(1)), F.sum(F.col("__x") * F.col("__x")), *(F.sum(F.col("__x") * F.col(f"l{k}")) for k in range(1, max_lag + 1))).first()
    n, c0 = row[0], row[1]
    if not n or not c0:
        return df.sparkSession.createDataFrame([], "lag int, acf double, pacf double, bound double")
    r = [1.0] + [(x or 0.0) / c0 for x in row[2:]]
    pacf, phi = [1.0], []
    for k in range(1, max_lag + 1):
        den = 1 - sum(phi[j] * r[j + 1] for j in range(k - 1))
        a = (r[k] - sum(phi[j] * r[k - 1 - j] for j in range(k - 1))) / den if abs(den) > 1e-12 else 0.0
        phi = [phi[j] - a * phi[k - 2 - j] for j in range(k - 1)] + [a]
        pacf.append(a)
    return df.sparkSession.createDataFrame([(k, r[k], pacf[k], 1.96 / math.sqrt(n)) for k in range(max_lag + 1)], "lag int, acf double, pacf double, bound double")


#: Rows of a series that one group of a test holds, besides the overlap.
SERIES_BLOCK = 50_000


def _series_rows(df: DataFrame, value: str, order_by: str, series: list[str]) -> tuple[DataFrame, DataFrame]:
    """(s, i, y) of the rows with a value, numbered from 0 in each series through range partitions, and (s, n, series...) of all series as written tables. ``s`` is a struct of the series' columns."""
    head = F.struct(*series) if series else F.struct(F.lit(0).alias("all"))
    rows = df.select(head.alias("s"), F.col(order_by).alias("t"), num(value).alias("y"))
    at = numbered(rows.where(F.col("y").isNotNull() & ~F.isnan("y")), ["s", "t"], "g")
    starts = at.groupBy("s").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    every = rows.select("s").distinct().join(starts, "s", "left")
    every = settle(every.withColumn("n", F.coalesce("n", F.lit(0))), "series")
    # few columns of each series, so a long series is the skewed side of a join that AQE splits
    placed = at.join(every.select("s", "first", "n"), "s").select("s", (F.col("g") - F.col("first")).alias("i"), "y", "n")
    return settle(placed, "series-rows"), every


def _blocks(rows: DataFrame, before: Column) -> DataFrame:
    """Rows by block of SERIES_BLOCK places, each block with the ``before`` places that precede it (of any earlier block)."""
    block = F.floor(F.col("i") / SERIES_BLOCK)
    last = F.least(F.floor((F.col("i") + before) / SERIES_BLOCK), F.floor((F.col("n") - 1) / SERIES_BLOCK))
    return rows.withColumn("block", F.explode(F.sequence(block, last)))


def _most_lags(n: Column, max_lag: int | None) -> Column:
    usual = F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.greatest(F.lit(0), F.floor(n / 2) - 3))
    return F.lit(max_lag).cast("long") if max_lag is not None else usual.cast("long")


@operator()
def adf_test(df: DataFrame, value: str, order_by: str, series: By = None, regression: str = "c", max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic of each series, lags by AIC, MacKinnon's asymptotic critical values, and a verdict.

    Blocks of a series with the lagged rows before them give products of all regressors, which are added up; what is
    solved for a series is one small matrix, so a single long series is many tasks. Fewer than 8 values give NULLs.
    """
    critical = {"n": (-2.56574, -1.94100, -1.61682), "c": (-3.43035, -2.86154, -2.56677), "ct": (-3.95877, -3.41049, -3.12705), "ctt": (-4.37113, -3.83239, -3.55326)}[regression]
    trends = {"n": 0, "c": 1, "ct": 2, "ctt": 3}[regression]
    rows, every = _series_rows(df, value, order_by, series or [])
    rows = rows.where("n >= 8").withColumn("most", _most_lags(F.col("n"), max_lag))

    def products(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("i")
        n, most, block = int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0]), int(pdf["block"].iloc[0])
        y, first = pdf["y"].to_numpy(float), int(pdf["i"].iloc[0])
        d = np.diff(y)  # d[j] = y[j + 1] - y[j]; the regression is of d at places most, most + 1, ... of the series
        at = np.arange(max(most, block * SERIES_BLOCK - 1), min(n - 1, (block + 1) * SERIES_BLOCK - 1)) - first
        if not len(at):
            return pd.DataFrame({"r": [], "c": [], "p": []})
        trend = (at + first - most + 1) / n
        x = np.column_stack([d[at], y[at], *(np.power(trend, k) for k in range(trends)), *(d[at - k] for k in range(1, most + 1))])
        gram = x.T @ x
        r, c = np.indices(gram.shape)
        return pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "p": gram.ravel()})

    def keyed(key, pdf):
        out = products(pdf)
        out["k"] = [int(pdf["g"].iloc[0])] * len(out)
        return out[["k", "r", "c", "p"]]

    ids = settle(every.where("n >= 8").select(F.monotonically_increasing_id().alias("g"), "s", "n", _most_lags(F.col("n"), max_lag).alias("most")), "series-ids")
    dealt = _blocks(rows.join(ids.select("s", "g"), "s"), F.col("most") + 1).drop("s")
    gram = dealt.groupBy("g", "block").applyInPandas(keyed, "k long, r int, c int, p double").groupBy("k", "r", "c").agg(F.sum("p").alias("p"))

    def solve(key, pdf):
        import numpy as np
        import pandas as pd

        size = int(pdf["r"].max()) + 1
        g = np.zeros((size, size))
        g[pdf["r"], pdf["c"]] = pdf["p"]
        most, best = size - 2 - trends, None
        n_obs = int(pdf["n"].iloc[0]) - 1 - most
        for p in range(most + 1):
            use = np.arange(1, 2 + trends + p)
            scale = np.sqrt(np.maximum(np.diag(g)[use], 1e-300))
            inv = np.linalg.pinv(g[np.ix_(use, use)] / np.outer(scale, scale)) / np.outer(scale, scale)
            beta = inv @ g[use, 0]
            rest = max(float(g[0, 0] - beta @ g[use, 0]), 0.0)
            error = np.sqrt(max(inv[0, 0] * rest / max(1, n_obs - len(use)), 0.0))
            aic = n_obs * np.log(max(rest / n_obs, 1e-300)) + 2 * len(use)
            if best is None or aic < best[0]:
                best = (aic, beta[0] / error if error else None, p)
        return pd.DataFrame([{"g": key[0], "statistic": best[1], "lags": best[2], "n_obs": n_obs}])

    solved = gram.join(ids.select(F.col("g").alias("k"), "n"), "k").groupBy("k").applyInPandas(solve, "g long, statistic double, lags int, n_obs int").join(ids.select("g", "s"), "g")
    out = every.select("s", F.col("n").alias("__n")).join(solved, "s", "left").withColumn("n_obs", F.coalesce("n_obs", F.col("__n").cast("int")))
    levels = [F.lit(c).alias(f"crit_{k}") for k, c in zip((1, 5, 10), critical, strict=True)]
    return out.select(*(F.col(f"s.{c}").alias(c) for c in series or []), "statistic", "lags", "n_obs", *levels, (F.col("statistic") < critical[1]).alias("stationary"))


@operator()
def kpss_test(df: DataFrame, value: str, order_by: str, series: By = None, regression: str = "c") -> DataFrame:
    """KPSS statistic of each series with a Bartlett window of ceil(12 (n/100)^1/4) lags, and a verdict at 5 %.

    The fitted line comes from sums; blocks of the residuals, with those before them, give products by lag and running sums that are
    carried from block to block. Fewer than 4 values give NULLs.
    """
    critical = {"c": 0.463, "ct": 0.146}[regression]
    rows, every = _series_rows(df, value, order_by, series or [])
    x = F.col("i") / F.col("n") - 0.5
    mean, slope = F.avg("y"), F.try_divide(F.covar_pop(x, F.col("y")), F.var_pop(x)) if regression == "ct" else F.lit(0.0)
    fit = rows.where("n >= 4").groupBy("s").agg(mean.alias("m"), slope.alias("b"), F.avg(x).alias("mx"), F.max("n").alias("n"))
    fit = settle(fit.select(F.monotonically_increasing_id().alias("g"), "s", "m", "b", "mx", F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.col("n") - 1).cast("int").alias("lags")), "series-fits")
    rest = rows.join(fit, "s").select("g", "i", "n", "lags", (F.col("y") - F.col("m") - F.col("b") * (x - F.col("mx"))).alias("e"))

    def products(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("i")
        e, lags = pdf["e"].to_numpy(float), int(pdf["lags"].iloc[0])
        own = int((pdf["i"] < key[1] * SERIES_BLOCK).sum())  # places of the overlap
        mine = e[own:]
        starts = [max(own, k) for k in range(min(lags, len(e) - 1) + 1)]
        by_lag = [float(e[at:] @ e[at - k : len(e) - k]) for k, at in enumerate(starts)]
        run = np.cumsum(mine)
        weighted = by_lag[0] + 2 * sum((1 - k / (lags + 1)) * v for k, v in enumerate(by_lag[1:], 1))
        return pd.DataFrame([{"g": key[0], "block": key[1], "rows": len(mine), "weighted": weighted, "total": float(run[-1]), "runs": float(run.sum()), "squares": float(run @ run)}])

    blocks = _blocks(rest, F.col("lags").cast("long")).groupBy("g", "block").applyInPandas(products, "g long, block long, rows long, weighted double, total double, runs double, squares double")
    before = F.coalesce(F.sum("total").over(Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    carried = settle(blocks, "series-blocks").withColumn("c", before)
    sums = carried.groupBy("g").agg(F.sum("weighted").alias("w"), F.sum(F.col("rows") * F.col("c") * F.col("c") + 2 * F.col("c") * F.col("runs") + F.col("squares")).alias("q"), F.sum("rows").alias("n"))
    stat = fit.join(sums, "g").select("s", "lags", F.when(F.col("w") > 0, F.col("q") / F.col("n") / F.col("w")).alias("statistic"))
    out = every.select("s").join(stat, "s", "left")
    return out.select(*(F.col(f"s.{c}").alias(c) for c in series or []), "statistic", "lags", F.lit(critical).alias("critical_5"), (F.col("statistic") < critical).alias("stationary"))


@operator(columns=("time_column", "value_column"))
def seasonal_decompose(df: DataFrame, time_column: str, value_column: str, period: int, model: str = "additive", partition_by: By = None) -> DataFrame:
    """Classical decomposition: centred moving average, mean deviation of each place in the period, remainder. Ends of the trend are NULL."""
    w, p = window(partition_by, [time_column]), [*(partition_by or [])]
    v, half = num(value_column), period // 2
    out = df.withColumn("__i", F.row_number().over(w) - 1)
    full = F.count(v).over(_rows(partition_by, [time_column], -half, half)) == 2 * half + 1
    if period % 2:
        trend = F.mean(v).over(_rows(partition_by, [time_column], -half, half))
    else:
        trend = (F.sum(v).over(_rows(partition_by, [time_column], -half, half)) - 0.5 * (F.lag(v, half).over(w) + F.lead(v, half).over(w))) / period
    out = out.withColumn("trend", F.when(full, trend))
    add = model == "additive"
    out = out.withColumn("__d", v - F.col("trend") if add else F.try_divide(v, F.col("trend"))).withColumn("__pos", F.col("__i") % period)
    out = out.withColumn("__s", F.mean("__d").over(Window.partitionBy(*p, "__pos")))
    one = F.when(F.row_number().over(Window.partitionBy(*p, "__pos").orderBy("__i")) == 1, F.col("__s"))
    out = out.withColumn("__one", one).withColumn("__c", F.mean("__one").over(Window.partitionBy(*p)))
    out = out.withColumn("seasonal", F.col("__s") - F.col("__c") if add else F.try_divide(F.col("__s"), F.col("__c")))
    resid = v - F.col("trend") - F.col("seasonal") if add else F.try_divide(v, F.col("trend") * F.col("seasonal"))
    return out.withColumn("residual", resid).drop("__i", "__d", "__pos", "__s", "__one", "__c")


@operator(columns=("time_column", "value_column"))
def forecast(df: DataFrame, time_column: str, value_column: str, horizon: int = 30, method: str = "auto", seasonal_period: int = 0, series: By = None) -> DataFrame:
    """horizon rows for each series with a 95 % band of 1.96 sigma sqrt(h): naive, ets (Holt's line) or holt_winters (additive season), fitted by a grid of smoothing weights."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.dropna(subset=[value_column, time_column]).sort_values(time_column)
        y, t = pdf[value_column].to_numpy(float), pd.to_datetime(pdf[time_column])
        head = {c: pdf[c].iloc[0] for c in series or []} if len(pdf) else {}
        cols = [*(series or []), time_column, "forecast", "lower", "upper"]
        if len(y) < 2:
            return pd.DataFrame(columns=cols)
        m = seasonal_period if seasonal_period > 1 and len(y) >= 2 * seasonal_period else 0
        kind = method if method != "auto" else ("holt_winters" if m else "ets" if len(y) >= 10 else "naive")
        if kind == "holt_winters" and not m:
            kind = "ets"

        def fit(a, b, g):
            level, slope = y[: m or 1].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m if m else y[1] - y[0]
            season, errors = list(y[:m] - level) if m else [], []
            for i, v in enumerate(y):
                s = season[i % m] if m else 0.0
                errors.append(v - (level + slope + s))
                new = a * (v - s) + (1 - a) * (level + slope)
                slope = b * (new - level) + (1 - b) * slope
                if m:
                    season[i % m] = g * (v - new) + (1 - g) * s
                level = new
            return float(np.square(errors[m or 1 :]).sum()), level, slope, season, np.array(errors)

        h = np.arange(1, horizon + 1)
        if kind == "naive":
            last = y[-m:] if m else y[-1:]
            path, errors = last[(h - 1) % len(last)], np.diff(y)
        else:
            grid = (0.1, 0.3, 0.5, 0.8)
            _, level, slope, season, errors = min((fit(a, b, g) for a in grid for b in (0.01, 0.1, 0.3) for g in ((0.1, 0.3) if m and kind == "holt_winters" else (0.0,))), key=lambda x: x[0])
            path = level + slope * h + (np.array([season[(len(y) + k - 1) % m] for k in h]) if m and kind == "holt_winters" else 0.0)
        sigma = float(np.std(errors[1:])) if len(errors) > 1 else 0.0
        step = (t.diff().dropna().median()) if len(t) > 1 else pd.Timedelta(days=1)
        out = pd.DataFrame({time_column: [t.iloc[-1] + step * int(k) for k in h], "forecast": path, "lower": path - 1.96 * sigma * np.sqrt(h), "upper": path + 1.96 * sigma * np.sqrt(h)})
        for c, v in head.items():
            out[c] = v
        return out[cols]

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in series or []), f"`{time_column}` timestamp, forecast double, lower double, upper double"])
    rows = df.select(*(series or []), F.col(time_column).cast("timestamp").alias(time_column), num(value_column).alias(value_column))
    return rows.groupBy(*(series or [F.lit(0).alias("__all")])).applyInPandas(run, schema)


@operator()
def sequential_sprt(df: DataFrame, convertedColumn: str, orderColumn: str, p0: float, p1: float, alpha: float = 0.05, beta: float = 0.2, partition_by: By = None) -> DataFrame:
    """Cumulative log likelihood ratio; the first bound crossed decides for good."""
    w = _upto(partition_by, [orderColumn])
    hit = num(F.col(convertedColumn).cast("int"))
    llr = F.sum(F.coalesce(hit * math.log(p1 / p0) + (1 - hit) * math.log((1 - p1) / (1 - p0)), F.lit(0.0))).over(w)
    out = df.withColumn("llr", llr)
    crossed = F.when(F.col("llr") >= math.log((1 - beta) / alpha), "accept_h1").when(F.col("llr") <= math.log(beta / (1 - alpha)), "accept_h0")
    return out.withColumn("decision", F.coalesce(F.first(crossed, True).over(w), F.lit("continue")))


def running_total(df: DataFrame, value: Column, order_by: list, name: str) -> DataFrame:
    """A cumulative sum over a whole table without one task for all rows: sums by range partition, then inside each."""
    ordered = settle(df.orderBy(*order(order_by)).withColumn("__part", F.spark_partition_id()), "running-total")
    sums = ordered.groupBy("__part").agg(F.sum(value).alias("__s"))
    starts = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    local = F.sum(value).over(Window.partitionBy("__part").orderBy(*order(order_by)).rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("__l", local).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__l")).drop("__part", "__l", "__start")


