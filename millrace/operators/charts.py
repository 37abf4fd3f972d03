"""The tables behind charts; nothing is drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dist
from millrace.functions.expressions import num, order, percentile, with_stats
from millrace.plans.registry import operator


@operator("export_to_image")
def chart_data(df: DataFrame, kind: str = "auto", x: str | None = None, y: str | None = None, hue: str | None = None, bins: int = 20, columns: list[str] | None = None, max_points: int = 10_000, seed: int = 42) -> DataFrame:
    """histogram, bar_counts, stacked_bar, percent_bar, heatmap, hexbin, line or scatter as aggregated rows; auto chooses by the columns' types."""
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    if kind == "auto":
        kind = "scatter" if x in numeric and y in numeric else "line" if y in numeric else "histogram" if x in numeric else "bar_counts"
    if kind == "histogram":
        return histogram(df, x, bins)
    if kind == "bar_counts":
        return df.groupBy(F.col(x).alias("label")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "label")
    if kind in ("stacked_bar", "percent_bar"):
        c = df.groupBy(F.col(x).alias("label"), F.col(hue).alias("hue")).agg(F.count(F.lit(1)).cast("double").alias("value") if not y else F.sum(num(y)).alias("value"))
        return c.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("label"))) if kind == "percent_bar" else c
    if kind == "heatmap":
        if columns:
            from millrace.operators.grouping import correlation_matrix

            return correlation_matrix(df, columns)
        return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("count"))
    if kind == "hexbin":
        s = with_stats(df.where(num(x).isNotNull() & num(y).isNotNull()), x0=F.min(num(x)), x1=F.max(num(x)), y0=F.min(num(y)), y1=F.max(num(y)))
        cell = lambda c, a, b: F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(num(c) - F.col(a), F.col(b) - F.col(a)), F.lit(0.0)) * bins))
        row = cell(y, "y0", "y1")
        shift = (row % 2) * 0.5
        col = F.floor(F.coalesce(F.try_divide(num(x) - F.col("x0"), F.col("x1") - F.col("x0")), F.lit(0.0)) * bins + shift)
        return s.groupBy(col.alias("cell_x"), row.alias("cell_y")).agg(F.count(F.lit(1)).alias("count"))
    if kind == "line":
        return df.groupBy(F.col(x).alias("x"), *([F.col(hue).alias("hue")] if hue else [])).agg(F.mean(num(y)).alias("y")).orderBy("x")
    return df.select(*(c for c in (x, y, hue) if c)).orderBy(F.rand(seed)).limit(max_points)


@operator()
def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, count), all bins."""
    c = num(column)
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo is not null")
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((c - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    counts = df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin")


@operator()
def pareto_chart(df: DataFrame, label: str, value: str, top_n: int = 20) -> DataFrame:
    """Sums by label, the top n, and cumulative percent of what is shown."""
    s = df.groupBy(F.col(label).alias("label")).agg(F.sum(num(value)).alias("value")).orderBy(F.desc("value"), "label").limit(top_n)
    w = Window.orderBy(F.desc("value"), "label").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("cumulative_percent", 100 * F.sum("value").over(w) / F.sum("value").over(Window.partitionBy())).orderBy(F.desc("value"), "label")


@operator()
def funnel_chart(df: DataFrame, stage: str, value: str, order_by: list) -> DataFrame:
    """Value of each stage and its percent of the stage before."""
    w = Window.orderBy(*order(order_by))
    return df.select(F.col(stage).alias("stage"), num(value).alias("value"), (100 * F.try_divide(num(value), F.lag(num(value)).over(w))).alias("percent_of_previous"))


@operator()
def waterfall_chart(df: DataFrame, label: str, value: str, order_by: list) -> DataFrame:
    """Start and end of each step, and a total."""
    w = Window.orderBy(*order(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    steps = df.select(F.row_number().over(Window.orderBy(*order(order_by))).alias("position"), F.col(label).cast("string").alias("label"), num(value).alias("value"), F.sum(num(value)).over(w).alias("end"))
    steps = steps.withColumn("start", F.col("end") - F.col("value"))
    total = steps.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("position"), F.lit("Total").alias("label"), F.sum("value").alias("value"), F.lit(0.0).alias("start"), F.sum("value").alias("end"))
    return steps.select("position", "label", "value", "start", "end").unionByName(total)


@operator()
def mosaic_marimekko(df: DataFrame, rowGroup: str, columnGroup: str, valueColumn: str) -> DataFrame:
    """Width of each column and the share of each row in it, of positive values."""
    c = df.where(num(valueColumn) > 0).groupBy(F.col(rowGroup).alias("row"), F.col(columnGroup).alias("column")).agg(F.sum(num(valueColumn)).alias("value"))
    own = F.sum("value").over(Window.partitionBy("column"))
    return c.withColumn("column_share", own / F.sum("value").over(Window.partitionBy())).withColumn("row_share", F.col("value") / own)


@operator()
def pie_donut(df: DataFrame, labelColumn: str, valueColumn: str) -> DataFrame:
    """Positive sums by label and their shares."""
    s = df.groupBy(F.col(labelColumn).alias("label")).agg(F.sum(num(valueColumn)).alias("value")).where("value > 0")
    return s.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy())).orderBy(F.desc("value"), "label")


@operator()
def treemap(df: DataFrame, labelColumn: str, valueColumn: str, colorColumn: str | None = None) -> DataFrame:
    s = pie_donut(df, labelColumn, valueColumn)
    if colorColumn:
        s = s.join(df.groupBy(F.col(labelColumn).alias("label")).agg(F.mean(num(colorColumn)).alias("color")), "label", "left")
    return s


@operator()
def calendar_heatmap(df: DataFrame, dateColumn: str, valueColumn: str, year: int | None = None) -> DataFrame:
    s = df.groupBy(F.col(dateColumn).cast("date").alias("date")).agg(F.sum(num(valueColumn)).alias("value")).where("date is not null")
    s = s.where(F.year("date") == year) if year else s
    return s.select("date", "value", F.weekofyear("date").alias("week"), (F.weekday("date") + 1).alias("weekday")).orderBy("date")


def _edges(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    return df.where(num(value) > 0).groupBy(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target")).agg(F.sum(num(value)).alias("value")).dropna()


@operator()
def chord_diagram(df: DataFrame, sourceColumn: str, targetColumn: str, valueColumn: str) -> DataFrame:
    """(source, target, value) sums of positive edges, with both nodes' totals."""
    e = _edges(df, sourceColumn, targetColumn, valueColumn)
    ends = e.select(F.col("source").alias("n"), "value").unionByName(e.select(F.col("target").alias("n"), "value")).groupBy("n").agg(F.sum("value").alias("t"))
    a, b = ends.select(F.col("n").alias("source"), F.col("t").alias("source_total")), ends.select(F.col("n").alias("target"), F.col("t").alias("target_total"))
    return e.join(a, "source").join(b, "target").select("source", "target", "value", "source_total", "target_total")


@operator()
def sankey_flow(df: DataFrame, sourceColumn: str, targetColumn: str, valueColumn: str, max_depth: int = 20) -> DataFrame:
    """Edge sums and the levels of their ends: the longest way from a source, however long it is.

    Each round takes away the nodes without edges into them; a node's level is the number of rounds that it outlasts. Nodes
    on a cycle or behind one have no longest way; when only those are left they get max_depth, or the round's number if it is larger.
    """
    from millrace.scratch import settle

    e = settle(_edges(df, sourceColumn, targetColumn, valueColumn).where("source <> target"), "sankey-edges")
    nodes = e.select(F.col("source").alias("n")).unionByName(e.select(F.col("target").alias("n"))).distinct()
    level = settle(nodes.withColumn("level", F.lit(0)), "sankey-levels")
    left, before, depth = e.select("source", "target"), level.count(), 0
    while before:
        ahead = settle(left.select(F.col("target").alias("n")).distinct(), "sankey-ahead")
        held, depth = ahead.count(), depth + 1
        reached = depth if held < before else max(depth, max_depth)
        if held:
            level = settle(level.join(ahead.withColumn("new", F.lit(reached)), "n", "left").select("n", F.coalesce("new", "level").alias("level")), "sankey-levels")
        if held == before:
            break
        left, before = settle(left.join(ahead, left["source"] == ahead["n"], "left_semi"), "sankey-left"), held
    a, b = level.select(F.col("n").alias("source"), F.col("level").alias("source_level")), level.select(F.col("n").alias("target"), F.col("level").alias("target_level"))
    return e.join(a, "source").join(b, "target").select("source", "target", "value", "source_level", "target_level")


@operator()
def network_graph(df: DataFrame, sourceColumn: str, targetColumn: str, valueColumn: str | None = None, order_by: str | None = None, communityDetection: bool = True, rounds: int = 10, top: int = 20) -> DataFrame:
    """The ``top`` nodes by degree with their communities, by label propagation (each node takes the heaviest label around it, least first). A repeated pair keeps its last value by order_by."""
    from millrace.scratch import settle

    v = num(valueColumn) if valueColumn else F.lit(1.0)
    a, b = F.col(sourceColumn).cast("string"), F.col(targetColumn).cast("string")
    pairs = df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), v.alias("w"), (F.col(order_by) if order_by else v).alias("o")).where("u <> v").groupBy("u", "v").agg(F.max_by("w", F.struct("o", "w")).alias("w"))
    both = settle(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "network-edges")
    label = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for k in range(rounds if communityDetection else 0):
        votes = both.join(label, both["v"] == label["node"]).groupBy("u", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("u").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("new"))
        # half of the nodes move in a round, so that pairs do not swap labels for ever
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        label = settle(label.join(best, label["node"] == best["u"], "left").select("node", F.when(moves, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label")), "network-labels")
    degree = both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))
    return degree.join(label, "node").select("node", "degree", "weight", F.col("label").alias("community")).orderBy(F.desc("degree"), "node").limit(top)


def _group(group: str | None) -> Column:
    return (F.col(group).cast("string") if group else F.lit("all")).alias("group")


@operator()
def box_plot(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Quartiles, whiskers within 1.5 ranges, and counts of outliers."""
    rows = df.select(_group(group), num(value).alias("x")).dropna()
    q = rows.groupBy("group").agg(percentile("x", [0.25, 0.5, 0.75]).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select("group", "n", *(F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q1", "median", "q3"))))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(lo, hi)
    return rows.join(q, "group").groupBy("group", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("lower_whisker"), F.max(F.when(inside, F.col("x"))).alias("upper_whisker"), F.count_if(~inside).alias("outliers"))


@operator()
def ecdf_plot(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    c = df.select(_group(group), num(value).alias("x")).dropna().groupBy("group", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("group")
    return c.select("group", "x", (F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)).alias("cumulative_share"))


@operator()
def density_plot(df: DataFrame, value: str, group: str | None = None, points: int = 100, bins: int = 1_000, shared: bool = False) -> DataFrame:
    """Gaussian density by group on a grid, with Scott's bandwidth; values are counted in fine bins first, so the grid meets bins and not rows."""
    rows = df.select(_group(group), num(value).alias("x")).dropna()
    s = rows.groupBy("group").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("h", F.greatest(F.lit(1e-9), F.coalesce("sd", F.lit(0.0)) * F.pow(F.col("n"), -0.2)))
    if shared:
        s = with_stats(s, glo=F.min("lo"), ghi=F.max("hi")).withColumn("lo", F.col("glo")).withColumn("hi", F.col("ghi")).drop("glo", "ghi")
    step = F.greatest(F.lit(1e-12), (F.col("hi") - F.col("lo")) / bins)
    b = rows.join(s, "group").groupBy("group", F.floor((F.col("x") - F.col("lo")) / step).alias("b")).agg(F.mean("x").alias("c"), F.count(F.lit(1)).alias("k"))
    grid = s.select("group", "h", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") - 3 * F.col("h") + i * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("c")) / F.col("h")
    return grid.join(b, "group").groupBy("group", "x").agg((F.sum(F.col("k") * F.exp(-z * z / 2)) / F.max(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density")).orderBy("group", "x")


@operator()
def violin_plot(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    return density_plot(df, value, group).join(box_plot(df, value, group), "group")


@operator()
def ridge_plot(df: DataFrame, value: str, group: str) -> DataFrame:
    """Densities on one axis."""
    return density_plot(df, value, group, shared=True)


@operator()
def qq_plot(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """(p, theoretical, sample): normal and sample quantiles at (i - 1/2) / points."""
    ps = [(i + 0.5) / points for i in range(points)]
    q = df.agg(percentile(value, ps).alias("q")).select(F.posexplode("q").alias("i", "sample"))
    table = F.broadcast(df.sparkSession.createDataFrame([(i, p, dist.norm_ppf(p)) for i, p in enumerate(ps)], "i int, p double, theoretical double"))
    return q.join(table, "i").select("p", "theoretical", "sample").orderBy("p")


@operator()
def horizon_chart(df: DataFrame, dateColumn: str, groupColumn: str, valueColumn: str, bands: int = 3) -> DataFrame:
    """Deviation from the overall median and its band, -bands to bands."""
    s = df.groupBy(F.col(dateColumn).alias("date"), F.col(groupColumn).alias("group")).agg(F.mean(num(valueColumn)).alias("value"))
    s = with_stats(s, __m=F.median("value")).withColumn("deviation", F.col("value") - F.col("__m"))
    s = with_stats(s, __w=F.max(F.abs("deviation")))
    band = F.when(F.col("__w") == 0, 0).otherwise(F.signum("deviation") * F.least(F.lit(bands), F.ceil(F.abs("deviation") / (F.col("__w") / bands))))
    return s.withColumn("band", band.cast("int")).drop("__m", "__w")


@operator()
def stream_graph(df: DataFrame, dateColumn: str, groupColumn: str, valueColumn: str) -> DataFrame:
    """Sums by date and group with zeros filled in, stacked around a centred baseline."""
    c = df.groupBy(F.col(dateColumn).alias("date"), F.col(groupColumn).cast("string").alias("group")).agg(F.sum(num(valueColumn)).alias("value")).dropna()
    grid = c.select("date").distinct().crossJoin(F.broadcast(c.select("group").distinct()))
    d = grid.join(c, ["date", "group"], "left").fillna(0.0, ["value"])
    w = Window.partitionBy("date")
    top = F.sum("value").over(w.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)) - F.sum("value").over(w) / 2
    return d.withColumn("upper", top).withColumn("lower", F.col("upper") - F.col("value"))


@operator("candlestick_chart")
def ohlc(df: DataFrame, timeColumn: str, priceColumn: str, interval: str = "day", by: list[str] | None = None, volumeColumn: str | None = None) -> DataFrame:
    """Open, high, low and close of each interval."""
    t, p = F.col(timeColumn), num(priceColumn)
    v = [F.sum(num(volumeColumn)).alias("volume")] if volumeColumn else []
    return df.where(p.isNotNull()).groupBy(*(by or []), F.date_trunc(interval, t).alias("time")).agg(F.min_by(p, F.struct(t, p)).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, F.struct(t, p)).alias("close"), *v)
