"""Grouping, pivots, and the business tables that are groupings."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import finite, names, num, numeric_columns, order, percentile, with_stats
from millrace.plans.lineage import origin
from millrace.plans.registry import operator
from millrace.scratch import settle

FUNCTIONS = {"sum": F.sum, "mean": F.mean, "avg": F.mean, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "std": F.stddev_samp, "median": F.median, "first": F.first, "approx_count_distinct": F.approx_count_distinct}


def aggregate(spec: dict) -> Column:
    fn, column = spec["fn"].lower(), spec.get("column")
    if fn in ("count", "count(*)") and not column:
        c = F.count(F.lit(1))
    elif not column:
        raise ValueError(f"{fn} needs a column")
    else:
        c = FUNCTIONS[fn](column) if fn in FUNCTIONS else F.expr(f"{fn}(`{column}`)")
    return c.alias(spec.get("as") or f"{fn}_{column or 'rows'}")


def _aggregated(inputs, p, outputs):
    read = {a.get("as") or f"{a['fn'].lower()}_{a.get('column') or 'rows'}": a for a in p["aggregates"]}
    return {o: origin("df", [a["column"]] if a.get("column") else [], "aggregate", f"{a['fn']}({a.get('column') or '*'})") for o, a in read.items()}


@operator(columns=("groupBy",), lineage=_aggregated)
def group_aggregate(df: DataFrame, aggregates: list[dict], groupBy: list[str] | None = None, mode: str = "group", sets: list[list[str]] | None = None) -> DataFrame:
    """Aggregates [{fn, column, as}] by group, over the whole table without groups; mode also rollup, cube, grouping_sets."""
    keys = groupBy or []
    if mode == "grouping_sets":
        grouped = df.groupingSets([[F.col(c) for c in s] for s in sets or []], *keys)
    else:
        grouped = {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[mode](*keys)
    return grouped.agg(*(aggregate(a) for a in aggregates))


def _widened(inputs, p, outputs):
    return {o: origin("df", [p["names_from"], p["values_from"]], "pivot", f"{p['agg']}({p['values_from']})") for o in outputs if o not in (p["id"] or [])}


@operator(lineage=_widened)
def pivot_wider(df: DataFrame, names_from: str, values_from: str, id: list[str] | None = None, agg: str = "sum", values: list | None = None) -> DataFrame:
    """Distinct names become columns; give ``values`` to save the job that finds them."""
    return df.groupBy(*(id or [])).pivot(names_from, values).agg(FUNCTIONS[agg](values_from))


def _lengthened(inputs, p, outputs):
    return {p["names_to"]: origin("df", [], "column names"), p["values_to"]: origin("df", p["value_cols"], "unpivot")}


@operator(columns=("value_cols",), lineage=_lengthened)
def pivot_longer(df: DataFrame, value_cols: list[str], id: list[str] | None = None, names_to: str = "name", values_to: str = "value") -> DataFrame:
    """Columns become rows; rows whose value is NULL are dropped."""
    return df.unpivot(id or [], value_cols, names_to, values_to).where(F.col(values_to).isNotNull())


@operator(columns=("columns",))
def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(col_a, col_b, r) for all pairs, from rows complete in the pair; NULL where a column is constant. Kendall's is tau-b, exact over all rows."""
    cols = columns or numeric_columns(df)
    pairs = [(a, b) for a in cols for b in cols]
    if method == "kendall":
        found = {(x, y): kendall_tau(df, x, y) for i, x in enumerate(cols) for y in cols[i:]}
        rows = [(x, y, found.get((x, y), found.get((y, x)))) for x, y in pairs]
        return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
    ranked = df.select(*(num(c).alias(c) for c in cols))
    if method == "spearman":
        out = []
        for x, y in pairs:
            complete = df.select(num(x).alias("x"), num(y).alias("y")).dropna()
            r = average_rank(average_rank(complete, "x", "__rx"), "y", "__ry")
            out.append(r.agg(F.corr("__rx", "__ry").alias("r")).select(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), finite(F.col("r")).alias("r")))
        return reduce(DataFrame.unionByName, out)
    return ranked.agg(F.array(*(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), finite(F.corr(x, y)).alias("r")) for x, y in pairs)).alias("x")).select(F.inline("x"))


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j sign(x_i - x_j) sign(y_i - y_j) over all pairs: the highest bit in which two ranks of y differ orders a pair."""
    rank = np.unique(y, return_inverse=True)[1]
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group, high = rank >> (bit + 1), (rank >> bit & 1).astype(bool)
        by = np.lexsort((x, group))
        g, v, up, weight = group[by], x[by], high[by], w[by]
        low = np.concatenate(([0.0], np.cumsum(np.where(up, 0.0, weight))))
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_run = new_group | np.concatenate(([True], v[1:] != v[:-1]))

        def around(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts = np.append(np.flatnonzero(new), len(new))
            at = np.cumsum(new) - 1
            return low[starts[at]], low[starts[at + 1]]

        (first, last), (before, after) = around(new_group), around(new_run)
        total += float(np.sum(weight[up] * ((before - first) - (last - after))[up]))
    return total


def kendall_tau(df: DataFrame, x: str, y: str, rows_per_block: int = 50_000, max_blocks: int = 300) -> float | None:
    """Kendall's tau-b of two columns over all rows; None if one of them is constant or there are no rows.

    Equal rows are counted first. Quantiles cut both axes into blocks, a quantile itself being a block of its own, so
    that a frequent value is never in a block with others. Pairs in different blocks of both axes follow from the block
    counts (at most (2 max_blocks + 1) squared rows), the others are counted inside the blocks of one axis in tasks.
    """
    points = settle(df.select(num(x).alias("x"), num(y).alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "tau")
    n = points.count()
    blocks = min(max_blocks, n // rows_per_block + 1)
    found = points.approxQuantile(["x", "y"], [k / blocks for k in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else [[], []]
    single = {}
    for axis, at in zip("xy", found, strict=True):
        cuts = sorted({v for q in at if math.isfinite(q) for v in (q, math.nextafter(q, math.inf))} or {0.0})
        single[axis] = [k + 1 for k, v in enumerate(cuts) if v in at]
        points = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=axis, outputCol=f"b{axis}").transform(points)
    points = settle(points.withColumns({b: F.col(b).cast("long") for b in ("bx", "by")}), "tau-blocks")
    cells = points.groupBy("bx", "by").agg(F.sum("w").alias("w")).collect()
    grid = np.zeros((max((c.bx for c in cells), default=0) + 1, max((c.by for c in cells), default=0) + 1))
    for c in cells:
        grid[c.bx, c.by] = c.w
    above = np.cumsum(grid, axis=0) - grid
    upto = np.cumsum(above, axis=1)
    score = float(np.sum(grid * (upto - above - (upto[:, -1:] - upto))))

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [concordance(group["u"].to_numpy(), group["v"].to_numpy(), group["w"].to_numpy())]})

    in_x = points.where(~F.col("bx").isin(single["x"])).select(F.col("bx").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"), "w")
    in_y = points.where(~F.col("by").isin(single["y"])).groupBy("by", "bx", "y").agg(F.sum("w").alias("w")).select(F.col("by").alias("b"), F.col("bx").cast("double").alias("u"), F.col("y").alias("v"), "w")
    for part in (in_x, in_y):
        score += part.groupBy("b").applyInPandas(inside, "s double").agg(F.sum("s")).first()[0] or 0.0
    free = []
    for axis in "xy":
        ties = points.groupBy(axis).agg(F.sum("w").alias("w")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("q")).first()
        free.append(((ties.n or 0.0) ** 2 - (ties.q or 0.0)) / 2)
    return score / math.sqrt(free[0] * free[1]) if free[0] and free[1] else None


def average_rank(df: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 with ties averaged. Values are counted first, so the one ordered window sees distinct values only."""
    by = by or []
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(name, F.sum("__n").over(w) - (F.col("__n") - 1) / 2).drop("__n")
    return df.join(ranks, [*by, column])


@operator(columns=("column",))
def bin_numeric(df: DataFrame, column: str, mode: str = "equal_width", bins: int = 5, breaks: str | list = "", as_: str = "bin") -> DataFrame:
    """equal_width: bins 1..n between minimum and maximum; custom_breaks: labels ``< b``, ``[a, b)``, ``>= z``."""
    c = num(column)
    if mode == "custom_breaks":
        cuts = sorted(float(b) for b in names(breaks))
        label = lambda x: f"{x:g}"
        case = F.when(c < cuts[0], f"< {label(cuts[0])}")
        for a, b in zip(cuts, cuts[1:], strict=False):
            case = case.when(c < b, f"[{label(a)}, {label(b)})")
        return df.withColumn(as_, case.otherwise(f">= {label(cuts[-1])}"))
    s = with_stats(df, __lo=F.min(c), __hi=F.max(c))
    k = F.when(F.col("__hi") == F.col("__lo"), F.when(c.isNotNull(), 1)).otherwise(F.least(F.lit(bins), F.floor((c - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)) + 1))
    return s.withColumn(as_, k.cast("int")).drop("__lo", "__hi")


@operator()
def null_pattern_audit(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Counts of the combinations of NULL columns."""
    pattern = F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.col(f"`{c}`").isNull(), c) for c in df.columns)), lambda x: x.isNotNull())), ", ")
    n = F.filter(F.array(*(F.col(f"`{c}`").isNull() for c in df.columns)), lambda x: x)
    counts = df.groupBy(pattern.alias("pattern"), F.size(n).alias("n_nulls")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "pattern").limit(top_n)


@operator(columns=("actual", "predicted"))
def confusion_matrix(df: DataFrame, actual: str, predicted: str, normalize: str = "counts") -> DataFrame:
    """(actual, predicted, count, rate); rate is by row, or by column or of all rows."""
    counts = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    by = {"column_percent": ["predicted"], "all_percent": []}.get(normalize, ["actual"])
    return counts.withColumn("rate", F.col("count") / F.sum("count").over(Window.partitionBy(*by))).orderBy("actual", "predicted")


def _periods(days: Column, period: str) -> Column:
    return F.floor(days / {"week": 7, "month": 30, "quarter": 90}[period])


def _cohorts(df: DataFrame, user: str, signup: str, activity: str, cohort: Column, period: str) -> DataFrame:
    rows = df.select(F.col(user).alias("u"), F.col(signup).cast("date").alias("s"), F.col(activity).cast("date").alias("a")).dropna()
    return rows.select("u", cohort.alias("cohort"), _periods(F.datediff("a", "s"), period).alias("offset"))


@operator(columns=("userColumn", "signupDateColumn", "activityDateColumn"))
def cohort_table(df: DataFrame, userColumn: str, signupDateColumn: str, activityDateColumn: str, period: str = "month", output: str = "count", wide: bool = True) -> DataFrame:
    """Distinct users by cohort (signup period) and whole periods since signup, as counts or shares of offset 0."""
    rows = _cohorts(df, userColumn, signupDateColumn, activityDateColumn, F.trunc("s", period), period)
    counts = rows.groupBy("cohort", "offset").agg(F.count_distinct("u").alias("users"))
    if output == "rate":
        first = F.max(F.when(F.col("offset") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
        counts = counts.withColumn("users", F.try_divide("users", first))
    return counts.groupBy("cohort").pivot("offset").agg(F.first("users")) if wide else counts


@operator(columns=("userColumn", "signupDateColumn", "activityDateColumn"))
def retention_curve(df: DataFrame, userColumn: str, signupDateColumn: str, activityDateColumn: str, period: str = "month", maxPeriods: int = 12) -> DataFrame:
    """Mean retention by offset over cohorts of 7, 30 or 90 days since the epoch."""
    days = {"week": 7, "month": 30, "quarter": 90}[period]
    rows = _cohorts(df, userColumn, signupDateColumn, activityDateColumn, F.floor(F.unix_date("s") / days), period)
    sizes = rows.groupBy("cohort").agg(F.count_distinct("u").alias("size"))
    kept = rows.where((F.col("offset") >= 0) & (F.col("offset") < maxPeriods)).groupBy("cohort", "offset").agg(F.count_distinct("u").alias("n"))
    return kept.join(sizes, "cohort").groupBy("offset").agg(F.mean(F.col("n") / F.col("size")).alias("retention"), F.count(F.lit(1)).alias("cohorts")).orderBy("offset")


@operator(columns=("customerColumn", "periodColumn", "revenueColumn"))
def ltv_with_discount(df: DataFrame, customerColumn: str, periodColumn: str, revenueColumn: str, discountRate: float = 0.05) -> DataFrame:
    return df.groupBy(customerColumn).agg(F.sum(num(revenueColumn) / F.pow(F.lit(1 + discountRate), num(periodColumn))).alias("ltv"), F.sum(num(revenueColumn)).alias("revenue"), F.max(periodColumn).alias("periods"))


@operator(columns=("tenureColumn", "eventColumn"))
def survival_retention(df: DataFrame, tenureColumn: str, eventColumn: str) -> DataFrame:
    """Kaplan-Meier estimate by whole tenure."""
    from millrace.operators.statistics import kaplan_meier

    return kaplan_meier(df, tenureColumn, eventColumn).select(F.col("time").alias("tenure"), "at_risk", "events", "survival")


def _step_flags(df: DataFrame, user: str, event: str, steps: list[str]) -> DataFrame:
    return df.where(F.col(event).isin(steps)).groupBy(user).agg(*(F.max((F.col(event) == s).cast("int")).alias(f"s{i}") for i, s in enumerate(steps)))


@operator(columns=("userColumn", "eventColumn"))
def step_funnel(df: DataFrame, userColumn: str, eventColumn: str, funnelSteps: str | list[str], timestampColumn: str | None = None) -> DataFrame:
    """Users who did each step and all before it, and their share of the first step. With a time column, steps must come in order."""
    steps = names(funnelSteps)
    if timestampColumn:
        t = df.groupBy(userColumn).agg(F.array_sort(F.collect_list(F.when(F.col(eventColumn).isin(steps), F.struct(F.col(timestampColumn).alias("t"), F.col(eventColumn).alias("e"))))).alias("x"))
        reached = F.aggregate("x", F.lit(0), lambda k, v: k + F.when(F.get(F.array(*(F.lit(s) for s in steps)), k) == v["e"], 1).otherwise(0))
        flags = t.select(*((reached > i).cast("int").alias(f"s{i}") for i in range(len(steps))))
    else:
        flags = _step_flags(df, userColumn, eventColumn, steps)
    upto = [F.sum(F.least(*(F.col(f"s{j}") for j in range(i + 1))) if i else F.col("s0")) for i in range(len(steps))]
    rows = flags.agg(F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("event"), F.coalesce(upto[i], F.lit(0)).alias("users")) for i, s in enumerate(steps))).alias("x"), F.coalesce(upto[0], F.lit(0)).alias("first"))
    return rows.select("first", F.inline("x")).select("step", "event", "users", F.try_divide(F.col("users"), F.col("first")).alias("conversion"))


@operator(columns=("userColumn", "eventColumn"))
def drop_off_attribution(df: DataFrame, userColumn: str, eventColumn: str, funnelSteps: str | list[str]) -> DataFrame:
    """Users at each step, users lost on entering it (the first step loses from all users), and the rate of loss."""
    total = df.agg(F.count_distinct(userColumn).alias("all"))
    rows = step_funnel(df, userColumn, eventColumn, funnelSteps).crossJoin(F.broadcast(total))
    before = F.coalesce(F.lag("users").over(Window.partitionBy().orderBy("step")), F.col("all"))
    return rows.withColumn("before", before).select("step", "event", "users", (F.col("before") - F.col("users")).alias("dropped"), F.try_divide(F.col("before") - F.col("users"), F.col("before")).alias("drop_rate"))


@operator(columns=("userColumn", "eventColumn"))
def multi_path_funnel(df: DataFrame, userColumn: str, eventColumn: str, targetSteps: str | list[str]) -> DataFrame:
    """Users by number of target steps done, and shares."""
    steps = names(targetSteps)
    done = df.groupBy(userColumn).agg(F.count_distinct(F.when(F.col(eventColumn).isin(steps), F.col(eventColumn))).alias("steps_done"))
    counts = done.groupBy("steps_done").agg(F.count(F.lit(1)).alias("users"))
    return counts.withColumn("share", F.col("users") / F.sum("users").over(Window.partitionBy())).orderBy("steps_done")


@operator(columns=("userColumn", "timestampColumn", "eventColumn"))
def time_to_convert(df: DataFrame, userColumn: str, timestampColumn: str, eventColumn: str, firstEvent: str, lastEvent: str) -> DataFrame:
    """Seconds and hours between the first of each of two events; may be negative; users with both."""
    first = lambda e: F.min(F.when(F.col(eventColumn) == e, F.col(timestampColumn)))
    out = df.groupBy(userColumn).agg(first(firstEvent).alias("started"), first(lastEvent).alias("converted")).dropna()
    seconds = (F.unix_micros(F.col("converted").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return out.withColumn("seconds", seconds).withColumn("hours", F.col("seconds") / 3600)


@operator(columns=("customerColumn", "dateColumn", "amountColumn"))
def rfm_score(df: DataFrame, customerColumn: str, dateColumn: str, amountColumn: str, asOfDate: str | None = None, bins: int = 5) -> DataFrame:
    """Recency, frequency and monetary value of customers, their bins 1..n by interpolated quantiles (recency inverted), and the segment r-f-m. Amounts over 0 only."""
    rows = df.where(num(amountColumn) > 0)
    as_of = F.lit(asOfDate).cast("date") if asOfDate else None
    per = rows.groupBy(customerColumn).agg(F.max(F.col(dateColumn).cast("date")).alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum(num(amountColumn)).alias("monetary"))
    if as_of is None:
        per = with_stats(per, __as_of=F.max("last"))
        as_of = F.col("__as_of")
    per = per.withColumn("recency", F.datediff(as_of, "last")).drop("__as_of")
    qs = [i / bins for i in range(1, bins)]
    s = with_stats(per, **{f"__q{c}": percentile(c, qs) for c in ("recency", "frequency", "monetary")})
    bin_of = lambda c: F.size(F.filter(F.col(f"__q{c}"), lambda q: num(c) > q)) + 1
    s = s.withColumn("r", (bins + 1 - bin_of("recency"))).withColumn("f", bin_of("frequency")).withColumn("m", bin_of("monetary"))
    return s.withColumn("segment", F.concat_ws("-", "r", "f", "m")).select(customerColumn, "recency", "frequency", "monetary", "r", "f", "m", "segment")


@operator(columns=("customerColumn", "dateColumn"))
def churn_lite(df: DataFrame, customerColumn: str, dateColumn: str, windowDays: int = 90, asOfDate: str | None = None) -> DataFrame:
    per = df.groupBy(customerColumn).agg(F.max(F.col(dateColumn).cast("date")).alias("last_activity"), F.count(F.lit(1)).alias("activities"))
    per = with_stats(per, __as_of=F.max("last_activity")) if not asOfDate else per.withColumn("__as_of", F.lit(asOfDate).cast("date"))
    return per.withColumn("days_since", F.datediff("__as_of", "last_activity")).withColumn("is_churned", F.col("days_since") > windowDays).drop("__as_of")


@operator(columns=("customerColumn",))
def repeat_purchase_rate(df: DataFrame, customerColumn: str, dateColumn: str | None = None, minPurchases: int = 2, groupColumn: str | None = None) -> DataFrame:
    keys = [groupColumn] if groupColumn else []
    per = df.groupBy(*keys, customerColumn).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") >= minPurchases).alias("repeaters"), F.mean((F.col("n") >= minPurchases).cast("double")).alias("repeat_rate"))


def _touches(df: DataFrame, user: str, channel: str, ts: str | None, converted: str) -> DataFrame:
    """Touches of users who converted at any time."""
    rows = df.select(F.col(user).alias("u"), F.col(channel).alias("channel"), *([F.col(ts).alias("t")] if ts else []), F.coalesce(F.col(converted).cast("boolean"), F.lit(False)).alias("c"))
    return rows.withColumn("__any", F.max("c").over(Window.partitionBy("u"))).where("__any").drop("__any", "c")


@operator()
def attribution_first_touch(df: DataFrame, userColumn: str, channelColumn: str, timestampColumn: str, convertedColumn: str) -> DataFrame:
    rows = _touches(df, userColumn, channelColumn, timestampColumn, convertedColumn).groupBy("u").agg(F.min_by("channel", F.struct("t", "channel")).alias("channel"))
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("conversions"))


@operator()
def attribution_last_touch(df: DataFrame, userColumn: str, channelColumn: str, timestampColumn: str, convertedColumn: str) -> DataFrame:
    rows = _touches(df, userColumn, channelColumn, timestampColumn, convertedColumn).groupBy("u").agg(F.max_by("channel", F.struct("t", "channel")).alias("channel"))
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("conversions"))


@operator()
def attribution_linear(df: DataFrame, userColumn: str, channelColumn: str, convertedColumn: str) -> DataFrame:
    rows = _touches(df, userColumn, channelColumn, None, convertedColumn)
    return rows.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("u"))).groupBy("channel").agg(F.sum("w").alias("credit"))


@operator()
def attribution_time_decay(df: DataFrame, userColumn: str, channelColumn: str, timestampColumn: str, convertedColumn: str, halfLifeDays: float = 7.0) -> DataFrame:
    u = Window.partitionBy("u")
    rows = _touches(df, userColumn, channelColumn, timestampColumn, convertedColumn)
    age = F.floor((F.unix_micros(F.max("t").over(u).cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 86_400_000_000)
    rows = rows.withColumn("w", F.exp(-F.ln(F.lit(2.0)) / halfLifeDays * age))
    return rows.withColumn("w", F.col("w") / F.sum("w").over(u)).groupBy("channel").agg(F.sum("w").alias("credit"))


@operator()
def attribution_position_based(df: DataFrame, userColumn: str, channelColumn: str, timestampColumn: str, convertedColumn: str, firstWeight: float = 0.4, lastWeight: float = 0.4) -> DataFrame:
    """One touch has all; two share the middle weight; otherwise first and last weights, and the rest between the others."""
    rows = _touches(df, userColumn, channelColumn, timestampColumn, convertedColumn)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("t", "channel"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u")))
    mid = 1 - firstWeight - lastWeight
    w = F.when(F.col("n") == 1, 1.0).when((F.col("n") == 2) & (F.col("k") == 1), firstWeight + mid / 2).when(F.col("n") == 2, lastWeight + mid / 2).when(F.col("k") == 1, firstWeight).when(F.col("k") == F.col("n"), lastWeight).otherwise(mid / (F.col("n") - 2))
    return rows.withColumn("w", w).groupBy("channel").agg(F.sum("w").alias("credit"))


@operator()
def attribution_markov(df: DataFrame, userColumn: str, channelColumn: str, timestampColumn: str, convertedColumn: str, steps: int = 200) -> DataFrame:
    """Credit by removal effect in a chain START -> channels -> CONVERT or NULL. Transitions are counted on Spark; the chain of channels is small."""
    import numpy as np

    rows = df.select(F.col(userColumn).alias("u"), F.col(channelColumn).cast("string").alias("c"), F.col(timestampColumn).alias("t"), F.coalesce(F.col(convertedColumn).cast("boolean"), F.lit(False)).alias("done"))
    w = Window.partitionBy("u").orderBy("t", "c")
    end = F.when(F.max("done").over(Window.partitionBy("u")), "__CONVERT").otherwise("__NULL")
    hops = rows.select(F.coalesce(F.lag("c").over(w), F.lit("__START")).alias("a"), F.col("c").alias("b")).unionByName(rows.withColumn("next", F.lead("c").over(w)).withColumn("end", end).where("next is null").select(F.col("c").alias("a"), F.col("end").alias("b")))
    counts = hops.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    states = sorted({r.a for r in counts} | {r.b for r in counts} | {"__CONVERT", "__NULL", "__START"})
    at = {s: i for i, s in enumerate(states)}
    m = np.zeros((len(states), len(states)))
    for r in counts:
        m[at[r.a], at[r.b]] = r.n

    def chance(gone: str | None) -> float:
        p = m.copy()
        if gone:
            p[:, at["__NULL"]] += p[:, at[gone]]
            p[:, at[gone]] = 0
        s = p.sum(1, keepdims=True)
        p = np.divide(p, s, out=np.zeros_like(p), where=s > 0)
        for x in ("__CONVERT", "__NULL"):
            p[at[x]] = 0
            p[at[x], at[x]] = 1
        x = np.zeros(len(states))
        x[at["__START"]] = 1
        for _ in range(steps):
            x = x @ p
        return float(x[at["__CONVERT"]])

    base = chance(None)
    channels = [s for s in states if not s.startswith("__")]
    effect = {c: (base - chance(c)) / base if base else 0.0 for c in channels}
    total = sum(effect.values()) or 1.0
    return df.sparkSession.createDataFrame([(c, effect[c], effect[c] / total) for c in channels], "channel string, removal_effect double, share double")


@operator(columns=("categoryColumn", "targetColumn"))
def target_encoding(df: DataFrame, categoryColumn: str, targetColumn: str, smoothing: float = 10.0, outputColumn: str | None = None) -> DataFrame:
    """(mean x n + smoothing x overall mean) / (n + smoothing) of each category."""
    t = num(targetColumn)
    stats = with_stats(df.groupBy(F.col(categoryColumn).alias("__c")).agg(F.sum(t).alias("__s"), F.count(t).alias("__n")), __ts=F.sum("__s"), __tn=F.sum("__n"))
    enc = (F.col("__s") + smoothing * F.col("__ts") / F.col("__tn")) / (F.col("__n") + smoothing)
    return df.join(stats.select("__c", enc.alias(outputColumn or f"{categoryColumn}_te")), F.col(categoryColumn).eqNullSafe(F.col("__c")), "left").drop("__c")


@operator(columns=("categoryColumn", "targetColumn"))
def woe_iv(df: DataFrame, categoryColumn: str, targetColumn: str, outputColumn: str = "woe", report: bool = False) -> DataFrame:
    """Weight of evidence of each category, ln(share of events / share of non-events) with counts of at least 1; report: a row (iv, strength)."""
    t = num(targetColumn)
    per = df.groupBy(F.col(categoryColumn).alias("__c")).agg(F.greatest(F.lit(1), F.count_if(t == 1)).alias("e"), F.greatest(F.lit(1), F.count_if(t == 0)).alias("n"))
    s = with_stats(per, te=F.sum("e"), tn=F.sum("n")).withColumn("pe", F.col("e") / F.col("te")).withColumn("pn", F.col("n") / F.col("tn")).withColumn(outputColumn, F.ln(F.col("pe") / F.col("pn")))
    if report:
        iv = s.agg(F.sum((F.col("pe") - F.col("pn")) * F.col(outputColumn)).alias("iv"))
        return iv.withColumn("strength", F.when(F.col("iv") < 0.02, "none").when(F.col("iv") < 0.1, "weak").when(F.col("iv") < 0.3, "medium").otherwise("strong"))
    return df.join(s.select("__c", outputColumn), F.col(categoryColumn).eqNullSafe(F.col("__c")), "left").withColumn(outputColumn, F.coalesce(outputColumn, F.lit(0.0))).drop("__c")


@operator(columns=("quasiIdentifiers",))
def k_anonymity_check(df: DataFrame, quasiIdentifiers: list[str], k: int = 5, summary: bool = False) -> DataFrame:
    """The 100 smallest classes, or a summary row."""
    sizes = df.groupBy(*quasiIdentifiers).agg(F.count(F.lit(1)).alias("class_size"))
    if summary:
        return sizes.agg(F.count(F.lit(1)).alias("classes"), F.min("class_size").alias("smallest"), F.count_if(F.col("class_size") < k).alias("violating"), F.coalesce(F.sum(F.when(F.col("class_size") < k, F.col("class_size"))), F.lit(0)).alias("rows_at_risk"))
    return sizes.withColumn("ok", F.col("class_size") >= k).orderBy("class_size", *quasiIdentifiers).limit(100)


@operator(columns=("quasiIdentifiers", "sensitiveColumn"))
def l_diversity_check(df: DataFrame, quasiIdentifiers: list[str], sensitiveColumn: str, l: int = 3) -> DataFrame:  # noqa: E741
    return df.groupBy(*quasiIdentifiers).agg(F.count_distinct(sensitiveColumn).alias("distinct_values")).withColumn("ok", F.col("distinct_values") >= l)


@operator(columns=("quasiIdentifiers", "sensitiveColumn"))
def t_closeness(df: DataFrame, quasiIdentifiers: list[str], sensitiveColumn: str, t: float = 0.2) -> DataFrame:
    """Total variation distance of each class from the whole table."""
    s = F.coalesce(F.col(sensitiveColumn).cast("string"), F.lit("\x00"))
    cells = df.groupBy(*quasiIdentifiers, s.alias("__s")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*quasiIdentifiers)))
    whole = df.groupBy(s.alias("__s")).agg(F.count(F.lit(1)).alias("m")).withColumn("q", F.col("m") / F.sum("m").over(Window.partitionBy())).drop("m")
    # values that a class lacks add their whole share: 1 - the shares of those that it has
    both = cells.join(whole, "__s").groupBy(*quasiIdentifiers).agg(((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("distance"))
    return both.withColumn("ok", F.col("distance") <= t)


@operator(columns=("valueColumn", "groupColumn"))
def dp_aggregate_laplace(df: DataFrame, valueColumn: str, groupColumn: str, epsilon: float = 1.0, sensitivity: float = 1.0, seed: int = 42, keep_true: bool = False) -> DataFrame:
    sums = df.groupBy(groupColumn).agg(F.sum(num(valueColumn)).alias("true_sum")).orderBy(groupColumn)
    u = F.rand(seed) - 0.5
    out = sums.withColumn("__u", u).withColumn("noisy_sum", F.col("true_sum") - sensitivity / epsilon * F.signum("__u") * F.ln(F.greatest(F.lit(1e-300), 1 - 2 * F.abs("__u")))).drop("__u")
    return out if keep_true else out.drop("true_sum")


@operator(columns=("valueColumn", "groupColumn"))
def dp_aggregate_gaussian(df: DataFrame, valueColumn: str, groupColumn: str, epsilon: float = 1.0, delta: float = 1e-5, sensitivity: float = 1.0, seed: int = 42, keep_true: bool = False) -> DataFrame:
    import math

    sigma = sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon
    out = df.groupBy(groupColumn).agg(F.sum(num(valueColumn)).alias("true_sum")).orderBy(groupColumn).withColumn("noisy_sum", F.col("true_sum") + F.randn(seed) * sigma)
    return out if keep_true else out.drop("true_sum")


@operator(ports=("df", "conditions"))
def charlson_index(df: DataFrame, conditions: DataFrame, patientColumn: str, codeColumn: str) -> DataFrame:
    """Comorbidities of each patient and their weighted score. conditions(prefix, condition, weight, priority): a code has the condition of its first matching prefix."""
    code = F.upper(F.regexp_replace(F.col(codeColumn).cast("string"), r"[.\s]", ""))
    table = conditions.select(F.upper("prefix").alias("prefix"), "condition", "weight", "priority")
    rows = df.select(F.col(patientColumn).alias("patient"), code.alias("code")).distinct()
    cut = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("code"))))).withColumn("prefix", F.expr("substring(code, 1, n)"))
    found = cut.join(table, "prefix").groupBy("patient", "code").agg(F.min_by(F.struct("condition", "weight"), "priority").alias("x")).select("patient", "x.*").distinct()
    scores = found.groupBy("patient").agg(F.sum("weight").alias("charlson"), F.array_sort(F.collect_set("condition")).alias("conditions"))
    return rows.select("patient").distinct().join(scores, "patient", "left").select("patient", F.coalesce("charlson", F.lit(0)).alias("charlson"), F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))


@operator(columns=("time_column",))
def resample(df: DataFrame, time_column: str, aggregations: list[dict], interval: str = "1d", fill_gaps: bool = True, fill_value: str = "null", by: list[str] | None = None, max_buckets: int = 1_000_000) -> DataFrame:
    """Buckets of fixed length, labelled by their start (weeks start on Monday), with sum, mean, median, min, max, count, std, first, last; gaps between the first and the last bucket of a group become rows."""
    n, unit = int("".join(c for c in interval if c.isdigit()) or 1), "".join(c for c in interval if not c.isdigit())
    seconds = n * {"s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400, "w": 604800}[unit]
    by = by or []
    t = F.unix_micros(F.col(time_column).cast("timestamp"))
    shift = 345_600 if unit == "w" else 0
    bucket = (F.floor((t / 1_000_000 - shift) / seconds) * seconds + shift).cast("long")
    pick = {"first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), t)), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), t))}
    cols = [(a.get("as") or f"{a['column']}_{a['fn']}", pick.get(a["fn"], FUNCTIONS.get(a["fn"]))(a["column"])) for a in aggregations]
    out = df.where(F.col(time_column).isNotNull()).groupBy(*by, bucket.alias("__b")).agg(*(c.alias(n) for n, c in cols))
    if fill_gaps:
        ends = out.groupBy(*by).agg(F.min("__b").alias("lo"), F.max("__b").alias("hi"))
        # a range too long for max_buckets raises instead of filling the cluster
        grid = ends.select(*by, F.explode(F.when((F.col("hi") - F.col("lo")) / seconds < max_buckets, F.sequence("lo", "hi", F.lit(seconds))).otherwise(F.raise_error(F.lit("too many buckets")))).alias("__b"))
        out = grid.join(out, [*by, "__b"], "left")
        if str(fill_value) == "0":
            out = out.fillna(0, subset=[n for n, _ in cols])
    return out.select(*by, F.timestamp_seconds("__b").alias(time_column), *(n for n, _ in cols)).orderBy(*order([*by, time_column]))
