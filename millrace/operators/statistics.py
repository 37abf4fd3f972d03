"""Tests, intervals and estimates from group moments, ranks and counts. Distribution functions run over the few result rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dist
from millrace.functions.expressions import finite, num, with_stats
from millrace.operators.grouping import average_rank
from millrace.plans.registry import operator
from millrace.scratch import settle

#: Distinct p values up to which they are broadcast to the rows.
MOST_BROADCAST = 100_000


def _moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, n, m, v) of each group, by text of the group."""
    return df.select(F.col(group).cast("string").alias("g"), num(value).alias("x")).dropna().groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.mean("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))


def _two(df: DataFrame, value: str, group: str) -> DataFrame:
    """Moments of the first two groups in one row."""
    m = _moments(df, value, group).agg(F.array_sort(F.collect_list(F.struct("g", "n", "m", "v"))).alias("s"))
    m = m.where(F.size("s") >= 2)
    return m.select(*(F.col("s")[i][c].alias(f"{c}{i + 1}") for i in (0, 1) for c in ("g", "n", "m", "v")))


@operator(columns=("value", "group"))
def t_test(df: DataFrame, value: str, group: str, alternative: str = "two-sided", equal_var: bool = False) -> DataFrame:
    s = _two(df, value, group)
    if equal_var:
        d = F.col("n1") + F.col("n2") - 2
        var = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / d
        se, d = F.sqrt(var * (1 / F.col("n1") + 1 / F.col("n2"))), d.cast("double")
    else:
        a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
        se = F.sqrt(a + b)
        d = F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    s = s.withColumn("statistic", F.try_divide(F.col("m1") - F.col("m2"), se)).withColumn("df", d)
    return s.select("g1", "g2", "n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), "statistic", "df", dist.two_sided_t(F.col("statistic"), F.col("df"), alternative).alias("p_value"))


@operator(columns=("value", "group"))
def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    m = with_stats(_moments(df, value, group), gm=F.sum(F.col("n") * F.col("m")) / F.sum("n"))
    s = m.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ss_between"), F.sum((F.col("n") - 1) * F.col("v")).alias("ss_within"), (F.count(F.lit(1)) - 1).alias("df_between"), (F.sum("n") - F.count(F.lit(1))).alias("df_within"))
    s = s.withColumn("f", F.try_divide(F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within"))).withColumn("eta_squared", F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")))
    return s.withColumn("p_value", dist.apply(dist.f_sf, F.col("f"), F.col("df_between"), F.col("df_within")))


@operator(columns=("row", "col"))
def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Independence of two columns; Yates' correction with one degree of freedom; Cramer's V from the uncorrected value."""
    c = df.select(F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c")).dropna().groupBy("r", "c").agg(F.count(F.lit(1)).alias("o"))
    rt, ct = c.groupBy("r").agg(F.sum("o").alias("rt")), c.groupBy("c").agg(F.sum("o").alias("ct"))
    grid = with_stats(rt.crossJoin(ct), n=F.max("rt"), rows=F.count_distinct("r"), cols=F.count_distinct("c")).drop("n").crossJoin(F.broadcast(c.agg(F.sum("o").alias("n"))))
    cells = grid.join(c, ["r", "c"], "left").withColumn("o", F.coalesce("o", F.lit(0))).withColumn("e", F.col("rt") * F.col("ct") / F.col("n"))
    gap = F.abs(F.col("o") - F.col("e"))
    dof = (F.first("rows") - 1) * (F.first("cols") - 1)
    yates = F.sum(F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("e"))
    plain = F.sum(gap * gap / F.col("e"))
    s = cells.agg(F.when(dof == 1, yates).otherwise(plain).alias("chi2"), dof.alias("dof"), F.first("n").alias("n"), F.sqrt(plain / (F.first("n") * F.nullif(F.least(F.first("rows"), F.first("cols")) - 1, F.lit(0)))).alias("cramers_v"))
    return s.withColumn("p_value", dist.apply(dist.chi2_sf, F.col("chi2"), F.col("dof")))


@operator(columns=("value", "group"))
def effect_size(df: DataFrame, value: str, group: str) -> DataFrame:
    s = _two(df, value, group)
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    s = s.withColumn("cohen_d", F.try_divide(F.col("m1") - F.col("m2"), pooled)).withColumn("hedges_g", F.col("cohen_d") * (1 - 3 / (4 * (n1 + n2) - 9))).withColumn("glass_delta", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt("v2")))
    size = F.abs("cohen_d")
    return s.select("g1", "g2", "cohen_d", "hedges_g", "glass_delta", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large").alias("label"))


@operator(columns=("value", "group"))
def mann_whitney(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> DataFrame:
    """U of the first group, the normal p with tie and continuity corrections, the rank-biserial correlation, and the medians."""
    rows = df.select(F.col(group).cast("string").alias("g"), num(value).alias("x")).dropna()
    ends = rows.agg(F.array_sort(F.collect_set("g")).alias("gs")).select(F.col("gs")[0].alias("g1"), F.col("gs")[1].alias("g2"))
    two = rows.crossJoin(F.broadcast(ends)).where("g = g1 or g = g2").select("g", "x", (F.col("g") == F.col("g1")).alias("a"))
    ranked = average_rank(two, "x", "r")
    ties = two.groupBy("x").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    s = ranked.agg(F.sum(F.when(F.col("a"), F.col("r"))).alias("r1"), F.count_if("a").cast("double").alias("n1"), F.count_if(~F.col("a")).cast("double").alias("n2"), F.median(F.when(F.col("a"), F.col("x"))).alias("median1"), F.median(F.when(~F.col("a"), F.col("x"))).alias("median2")).crossJoin(ties)
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("n", F.col("n1") + F.col("n2"))
    mu = F.col("n1") * F.col("n2") / 2
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    z = {"two-sided": (F.abs(F.col("u") - mu) - 0.5) / sigma, "greater": (F.col("u") - mu - 0.5) / sigma, "less": (F.col("u") - mu + 0.5) / sigma}[alternative]
    return s.withColumn("z", z).select("u", "n1", "n2", "median1", "median2", (2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"), dist.p_normal(F.col("z"), alternative).alias("p_value"))


@operator(columns=("value", "group"))
def ks_test(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> DataFrame:
    """Largest gap of the two groups' distribution functions and its asymptotic p."""
    rows = df.select(F.col(group).cast("string").alias("g"), num(value).alias("x")).dropna()
    ends = rows.agg(F.array_sort(F.collect_set("g")).alias("gs")).select(F.col("gs")[0].alias("g1"), F.col("gs")[1].alias("g2"))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy("x").agg(F.count_if(F.col("g") == F.col("g1")).alias("a"), F.count_if(F.col("g") == F.col("g2")).alias("b"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    c = with_stats(counts, ta=F.sum("a"), tb=F.sum("b")).withColumn("d", F.sum("a").over(w) / F.col("ta") - F.sum("b").over(w) / F.col("tb"))
    d = {"two-sided": F.max(F.abs("d")), "greater": F.max("d"), "less": -F.min("d")}[alternative]
    s = c.agg(d.alias("statistic"), F.first("ta").alias("n1"), F.first("tb").alias("n2"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    p = dist.apply(lambda e, x: dist.kolmogorov_sf(e * x) if alternative == "two-sided" else math.exp(-2 * (e * x) ** 2), en, F.col("statistic"))
    return s.withColumn("p_value", p)


@operator(columns=("value",))
def bootstrap_ci(df: DataFrame, value: str, statistic: str = "mean", confidence: float = 0.95, n_iter: int = 2000, seed: int = 42) -> DataFrame:
    """(estimate, lower, upper) by a Poisson bootstrap: each row gets Poisson(1) weights for all replicates in its task, and tasks return weighted sums.

    Quantile statistics use weights by rounded value, so what is gathered follows the distinct values.
    """
    x = df.select(num(value).alias("x")).dropna()
    low = (1 - confidence) / 2
    if statistic in ("mean", "std"):

        def sums(frames):
            import numpy as np
            import pandas as pd

            from pyspark import TaskContext

            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            total = np.zeros((n_iter, 3))
            for pdf in frames:
                v = pdf["x"].to_numpy(float)
                for at in range(0, len(v), 2000):
                    y = v[at : at + 2000]
                    w = rng.poisson(1.0, (n_iter, len(y))).astype(float)
                    total += np.stack([w.sum(1), w @ y, w @ (y * y)], 1)
            yield pd.DataFrame({"k": np.arange(n_iter), "w": total[:, 0], "s": total[:, 1], "q": total[:, 2]})

        reps = x.mapInPandas(sums, "k int, w double, s double, q double").groupBy("k").agg(*(F.sum(c).alias(c) for c in "wsq"))
        mean = F.col("s") / F.col("w")
        stat = mean if statistic == "mean" else F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("w") * mean * mean) / (F.col("w") - 1)))
        reps = reps.select(stat.alias("v"))
        point = x.agg((F.mean("x") if statistic == "mean" else F.stddev_samp("x")).alias("estimate"))
    else:
        pick = (lambda c, w: F.percentile(c, 0.5, w)) if statistic == "median" else (lambda c, w: F.percentile(c, 0.75, w) - F.percentile(c, 0.25, w))
        chunk = x.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        rep = chunk.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_iter))))

        @F.pandas_udf("long")
        def draw(n, k, h):
            import numpy as np
            import pandas as pd

            return pd.Series([np.random.default_rng([seed, int(a), int(b) & 0xFFFFFFFFFFFF]).poisson(int(c)) for a, b, c in zip(k, h, n, strict=True)])

        reps = rep.withColumn("w", draw("n", "k", F.xxhash64("x"))).where("w > 0").groupBy("k").agg(pick(F.col("x"), F.col("w")).alias("v"))
        point = x.agg(pick(F.col("x"), F.lit(1)).alias("estimate"))
    return point.crossJoin(reps.agg(F.percentile("v", low).alias("lower"), F.percentile("v", 1 - low).alias("upper")))


@operator(columns=("p_column",))
def multiple_comparison_correction(df: DataFrame, p_column: str, method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """Adjusted p values (bonferroni, holm, fdr_bh, fdr_by) and whether they are below alpha.

    Equal values are adjusted alike, so the distinct ones are ordered, in range partitions with their offsets: no task
    sees all rows.
    """
    p = num(p_column)
    values = df.select(p.alias("p")).where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    values = settle(values.orderBy("p").withColumn("part", F.spark_partition_id()), "p-values")
    total = values.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("m")).first()
    m = total.m
    if method == "bonferroni":
        adjusted = values.select("p", (F.col("p") * m).alias("adj"))
    else:
        upto, down = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
        # a row a partition: what is before it, and below what is at or beyond it
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = values.groupBy("part").agg(F.sum("n").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
        last = F.col("start") + F.sum("n").over(upto)
        values = values.join(F.broadcast(starts), "part").withColumn("last", last)
        if method == "holm":
            best, other, within, beyond = F.max, F.greatest, upto, before
            ratio = (m - F.col("last") + F.col("n")) * F.col("p")
        else:
            best, other, within, beyond = F.min, F.least, down, Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
            harmonic = df.sparkSession.range(1, m + 1).agg(F.sum(1 / F.col("id"))).first()[0] if method == "fdr_by" and m else 1.0
            ratio = F.col("p") * m / F.col("last") * harmonic
        values = settle(values.select("part", "p", ratio.alias("x")), "p-ratios")
        ends = values.groupBy("part").agg(best("x").alias("x")).select("part", best("x").over(beyond).alias("end"))
        adjusted = values.withColumn("x", best("x").over(within)).join(F.broadcast(ends), "part").select("p", other("x", "end").alias("adj"))
    adjusted = adjusted.select(F.col("p").alias("__p"), F.least(F.lit(1.0), "adj").alias("p_adjusted"))
    few = F.broadcast(adjusted) if total.distinct <= MOST_BROADCAST else adjusted
    return df.join(few, p == F.col("__p"), "left").withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False))).drop("__p")


@operator(columns=("durationColumn", "eventColumn"))
def kaplan_meier(df: DataFrame, durationColumn: str, eventColumn: str, groupColumn: str | None = None) -> DataFrame:
    """(time, at_risk, events, survival, lower, upper) for each time and group, with log-log Greenwood limits."""
    g = F.col(groupColumn).cast("string") if groupColumn else F.lit("all")
    t = df.select(g.alias("group"), num(durationColumn).alias("time"), F.coalesce(F.col(eventColumn).cast("int"), F.lit(0)).alias("e")).where("time is not null").groupBy("group", "time").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("events"))
    back, ahead = Window.partitionBy("group").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("group").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("at_risk", F.sum("n").over(back))
    dead = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(ahead) == 1
    t = t.withColumn("survival", F.when(dead, 0.0).otherwise(F.exp(F.sum(F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk")))).over(ahead))))
    v = F.sum(F.try_divide(F.col("events"), F.col("at_risk") * (F.col("at_risk") - F.col("events")))).over(ahead)
    t = t.withColumn("__v", v)
    wide = 1.959963984540054 * F.sqrt("__v") / F.abs(F.ln("survival"))
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    limit = lambda s: F.when(inside, F.exp(-F.exp(F.ln(-F.ln("survival")) + s * wide))).otherwise(F.col("survival"))
    out = t.withColumn("lower", limit(1)).withColumn("upper", limit(-1)).select(*(["group"] if groupColumn else []), "time", "at_risk", "events", "survival", "lower", "upper")
    return out.withColumnRenamed("group", groupColumn) if groupColumn else out


@operator(columns=("durationColumn", "eventColumn", "groupColumn"))
def log_rank_test(df: DataFrame, durationColumn: str, eventColumn: str, groupColumn: str) -> DataFrame:
    """(chi2, dof, p_value) for equal survival of k groups. Risk tables are built on Spark; a k x k system is solved at the end."""
    import numpy as np

    rows = df.select(F.col(groupColumn).cast("string").alias("g"), num(durationColumn).alias("t"), F.coalesce(F.col(eventColumn).cast("int"), F.lit(0)).alias("e")).dropna()
    per = rows.groupBy("g", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d"))
    grid = per.select("g").distinct().crossJoin(per.where("d > 0").select("t").distinct())
    both = grid.withColumn("at", F.lit(True)).join(per, ["g", "t"], "full").fillna(0, ["n", "d"]).withColumn("r", F.sum("n").over(Window.partitionBy("g").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))).where("at")
    tot = both.groupBy("t").agg(F.sum("r").alias("all_r"), F.sum("d").alias("all_d"), F.collect_list(F.struct("g", "r")).alias("gs"))
    e = both.join(tot.select("t", "all_r", "all_d"), "t").groupBy("g").agg(F.sum("d").alias("o"), F.sum(F.col("all_d") * F.col("r") / F.col("all_r")).alias("e")).orderBy("g").collect()
    cov = tot.where("all_r > 1").select("all_r", "all_d", F.explode("gs").alias("a"), "gs").select("all_r", "all_d", "a", F.explode("gs").alias("b"))
    f = F.col("all_d") * (F.col("all_r") - F.col("all_d")) / (F.col("all_r") - 1)
    pa, pb = F.col("a.r") / F.col("all_r"), F.col("b.r") / F.col("all_r")
    found = cov.groupBy(F.col("a.g").alias("x"), F.col("b.g").alias("y")).agg(F.sum(f * pa * (F.when(F.col("a.g") == F.col("b.g"), 1.0).otherwise(0.0) - pb)).alias("v")).collect()
    names = [r.g for r in e]
    at = {g: i for i, g in enumerate(names)}
    v = np.zeros((len(names), len(names)))
    for r in found:
        v[at[r.x], at[r.y]] = r.v
    z = np.array([r.o - r.e for r in e], float)[:-1]
    chi2 = float(z @ np.linalg.pinv(v[:-1, :-1]) @ z) if len(z) else 0.0
    return df.sparkSession.createDataFrame([(chi2, len(names) - 1, dist.chi2_sf(chi2, max(1, len(names) - 1)))], "chi2 double, dof int, p_value double")


@operator(columns=("durationColumn", "eventColumn", "featureColumns"))
def cox_proportional_hazards(df: DataFrame, durationColumn: str, eventColumn: str, featureColumns: list[str], max_iter: int = 25, tol: float = 1e-8) -> DataFrame:
    """(term, coef, hazard_ratio, std_error, z, p_value, lower, upper), Breslow ties. A Newton step is sums by distinct time, a reverse cumulative window over times, and a small solve."""
    import numpy as np

    k = len(featureColumns)
    rows = df.select(num(durationColumn).alias("t"), F.coalesce(F.col(eventColumn).cast("int"), F.lit(0)).alias("e"), *(num(c).alias(f"x{i}") for i, c in enumerate(featureColumns))).dropna()
    means = rows.agg(*(F.mean(f"x{i}") for i in range(k))).first()
    rows = rows.withColumns({f"x{i}": F.col(f"x{i}") - float(means[i] or 0) for i in range(k)}).persist()
    b = np.zeros(k)
    for _ in range(max_iter):
        w = F.exp(sum((F.col(f"x{i}") * float(b[i]) for i in range(k)), F.lit(0.0)))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        per = rows.withColumn("w", w).groupBy("t").agg(F.sum("e").alias("d"), F.sum("w").alias("s0"), *(F.sum(F.col("w") * F.col(f"x{i}")).alias(f"s1_{i}") for i in range(k)), *(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s2_{i}_{j}") for i, j in pairs), *(F.sum(F.col("e") * F.col(f"x{i}")).alias(f"e{i}") for i in range(k)))
        back = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        cum = per.select("d", *(f"e{i}" for i in range(k)), F.sum("s0").over(back).alias("s0"), *(F.sum(f"s1_{i}").over(back).alias(f"s1_{i}") for i in range(k)), *(F.sum(f"s2_{i}_{j}").over(back).alias(f"s2_{i}_{j}") for i, j in pairs))
        row = cum.agg(*(F.sum(F.col(f"e{i}") - F.col("d") * F.col(f"s1_{i}") / F.col("s0")) for i in range(k)), *(F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - F.col(f"s1_{i}") * F.col(f"s1_{j}") / F.pow("s0", F.lit(2)))) for i, j in pairs)).first()
        grad, h = np.array(row[:k], float), np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k:], strict=True):
            h[i, j] = h[j, i] = v
        step = np.linalg.pinv(h) @ grad
        b = b + step
        if np.abs(step).max() < tol:
            break
    se = np.sqrt(np.diag(np.linalg.pinv(h)))
    out = [(c, float(b[i]), math.exp(b[i]), float(se[i]), float(b[i] / se[i]), 2 * dist.norm_cdf(-abs(b[i] / se[i])), math.exp(b[i] - 1.959964 * se[i]), math.exp(b[i] + 1.959964 * se[i])) for i, c in enumerate(featureColumns)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, hazard_ratio double, std_error double, z double, p_value double, lower double, upper double")


@operator()
def beta_binomial_posterior(df: DataFrame, groupColumn: str, successColumn: str, trialsColumn: str, priorAlpha: float = 1.0, priorBeta: float = 1.0) -> DataFrame:
    g = df.groupBy(groupColumn).agg(F.sum(num(successColumn)).alias("s"), F.sum(num(trialsColumn)).alias("n"))
    g = g.select(groupColumn, (F.col("s") + priorAlpha).alias("alpha"), (F.col("n") - F.col("s") + priorBeta).alias("beta"))
    q = lambda p: dist.apply(lambda a, b: dist.beta_ppf(p, a, b), F.col("alpha"), F.col("beta"))
    return g.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).withColumn("lower", q(0.025)).withColumn("upper", q(0.975))


@operator()
def conjugate_normal(df: DataFrame, groupColumn: str, valueColumn: str, priorMean: float = 0.0, priorVariance: float = 100.0, likelihoodVariance: float = 1.0) -> DataFrame:
    g = df.groupBy(groupColumn).agg(F.count(valueColumn).alias("n"), F.mean(num(valueColumn)).alias("sample_mean"))
    g = g.withColumn("posterior_variance", 1 / (1 / F.lit(float(priorVariance)) + F.col("n") / float(likelihoodVariance)))
    g = g.withColumn("posterior_mean", F.col("posterior_variance") * (float(priorMean / priorVariance) + F.coalesce(F.col("n") * F.col("sample_mean"), F.lit(0.0)) / float(likelihoodVariance)))
    return g.withColumn("lower", F.col("posterior_mean") - 1.96 * F.sqrt("posterior_variance")).withColumn("upper", F.col("posterior_mean") + 1.96 * F.sqrt("posterior_variance"))


@operator()
def bayes_factor(df: DataFrame, successColumn: str, trialsColumn: str, p0: float, p1: float) -> DataFrame:
    s = df.agg(F.sum(num(successColumn)).alias("successes"), F.sum(num(trialsColumn)).alias("trials"))
    ln = F.col("successes") * math.log(p1 / p0) + (F.col("trials") - F.col("successes")) * math.log((1 - p1) / (1 - p0))
    s = s.withColumn("log_bf10", ln).withColumn("bf10", F.exp(ln))
    b = F.col("bf10")
    return s.withColumn("evidence", F.when(b > 100, "extreme for H1").when(b > 10, "strong for H1").when(b > 3, "moderate for H1").when(b >= 1 / 3, "inconclusive").when(b >= 0.1, "moderate for H0").when(b >= 0.01, "strong for H0").otherwise("extreme for H0"))


def _gram(df: DataFrame, xs: list[Column], y: Column):
    """X'X, X'y, y'y and n by one aggregate."""
    import numpy as np

    k = len(xs)
    cols = df.select(*(x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)), y.cast("double").alias("y")).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = cols.agg(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs), *(F.sum(F.col(f"x{i}") * F.col("y")) for i in range(k)), F.sum(F.col("y") * F.col("y")), F.sum("y"), F.count(F.lit(1))).first()
    g = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=False):
        g[i, j] = g[j, i] = v or 0.0
    at = len(pairs)
    return g, np.array([v or 0.0 for v in row[at : at + k]]), row[at + k] or 0.0, row[at + k + 1] or 0.0, row[at + k + 2]


def least_squares(df: DataFrame, terms: dict[str, Column], y: Column) -> DataFrame:
    """(term, estimate, std_error, t, p_value) of a linear fit with an intercept."""
    import numpy as np

    names = ["intercept", *terms]
    g, r, yy, _, n = _gram(df, [F.lit(1.0), *terms.values()], y)
    inv = np.linalg.pinv(g)
    b = inv @ r
    dof = max(1, n - len(names))
    s2 = max(0.0, yy - b @ r) / dof
    se = np.sqrt(np.maximum(0, np.diag(inv) * s2))
    t = np.divide(b, se, out=np.full(len(b), np.nan), where=se > 0)
    rows = [(c, float(b[i]), float(se[i]), None if np.isnan(t[i]) else float(t[i]), None if np.isnan(t[i]) else 2 * dist.t_sf(abs(float(t[i])), dof)) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t double, p_value double")


@operator()
def bayesian_regression(df: DataFrame, targetColumn: str, featureColumns: list[str], priorPrecision: float = 1.0) -> DataFrame:
    """Posterior mean and 95 % interval of each coefficient under a normal prior (the intercept's is flat); noise from the residuals."""
    import numpy as np

    g, r, yy, _, n = _gram(df, [F.lit(1.0), *(F.col(c) for c in featureColumns)], F.col(targetColumn))
    k = len(featureColumns) + 1
    s2 = max(1e-12, (yy - np.linalg.pinv(g) @ r @ r) / max(1, n - k))
    prior = np.diag([0.0] + [priorPrecision] * (k - 1))
    cov = np.linalg.pinv(g / s2 + prior)
    m, se = cov @ (r / s2), np.sqrt(np.diag(cov))
    return df.sparkSession.createDataFrame([(c, float(m[i]), float(m[i] - 1.96 * se[i]), float(m[i] + 1.96 * se[i])) for i, c in enumerate(["intercept", *featureColumns])], "term string, posterior_mean double, lower double, upper double")


@operator()
def delta_method_ratio(df: DataFrame, groupColumn: str, numeratorColumn: str, denominatorColumn: str, confidence: float = 0.95) -> DataFrame:
    a, b = num(numeratorColumn), num(denominatorColumn)
    g = df.where(a.isNotNull() & b.isNotNull()).groupBy(groupColumn).agg(F.count(F.lit(1)).alias("n"), F.mean(a).alias("ma"), F.mean(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c"))
    r = F.try_divide("ma", "mb")
    se = F.sqrt((F.col("va") - 2 * r * F.col("c") + r * r * F.col("vb")) / (F.col("n") * F.col("mb") * F.col("mb")))
    z = dist.norm_ppf(1 - (1 - confidence) / 2)
    return g.select(groupColumn, "n", r.alias("ratio"), se.alias("std_error"), (r - z * se).alias("lower"), (r + z * se).alias("upper"))


@operator()
def best_bayesian_ab(df: DataFrame, variantColumn: str, convertedColumn: str, samples: int = 50_000, seed: int = 42) -> DataFrame:
    """(variant, conversions, n, p_best): Beta posteriors are drawn in tasks over a range of samples."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(variantColumn).cast("string").alias("variant")).agg(F.sum(F.col(convertedColumn).cast("int")).alias("conversions"), F.count(convertedColumn).alias("n")).orderBy("variant").collect()

    def draw(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            if len(pdf):
                rng = np.random.default_rng([seed, int(pdf["id"].iloc[0])])
                x = np.stack([rng.beta(1 + (r.conversions or 0), 1 + r.n - (r.conversions or 0), len(pdf)) for r in counts])
                wins = np.bincount(x.argmax(0), minlength=len(counts))
                yield pd.DataFrame({"i": np.arange(len(counts)), "w": wins})

    wins = spark.range(samples).mapInPandas(draw, "i int, w long").groupBy("i").agg(F.sum("w").alias("w"))
    table = spark.createDataFrame([(i, r.variant, r.conversions, r.n) for i, r in enumerate(counts)], "i int, variant string, conversions long, n long")
    return table.join(wins, "i", "left").select("variant", "conversions", "n", (F.coalesce("w", F.lit(0)) / samples).alias("p_best"))


@operator()
def diff_in_diff(df: DataFrame, outcomeColumn: str, treatedColumn: str, postColumn: str, controlColumns: list[str] | None = None) -> DataFrame:
    """Least squares on treated, post, their product and controls."""
    t, p = num(F.col(treatedColumn).cast("int")), num(F.col(postColumn).cast("int"))
    return least_squares(df, {"treated": t, "post": p, "treated_x_post": t * p} | {c: num(c) for c in controlColumns or []}, num(outcomeColumn))


@operator()
def instrumental_variables(df: DataFrame, outcomeColumn: str, endogenousColumn: str, instrumentColumns: list[str], controlColumns: list[str] | None = None) -> DataFrame:
    """Two-stage least squares; errors are those of the second stage."""
    import numpy as np

    own = controlColumns or []
    first = [F.lit(1.0), *(num(c) for c in [*instrumentColumns, *own])]
    complete = df.dropna(subset=[outcomeColumn, endogenousColumn, *instrumentColumns, *own])
    g, r, *_ = _gram(complete, first, num(endogenousColumn))
    b = np.linalg.pinv(g) @ r
    hat = reduce(lambda x, y: x + y, (c * float(v) for c, v in zip(first, b, strict=True)))
    return least_squares(complete, {endogenousColumn: hat} | {c: num(c) for c in own}, num(outcomeColumn))


@operator()
def regression_discontinuity(df: DataFrame, outcomeColumn: str, runningColumn: str, cutoff: float, bandwidth: float) -> DataFrame:
    """A line on each side of the cutoff within the bandwidth, and the jump between their values there."""
    x, y = num(runningColumn) - float(cutoff), num(outcomeColumn)
    r = df.select(x.alias("x"), y.alias("y")).where(F.abs("x") <= bandwidth).dropna()
    side = lambda fn, s: fn(F.when((F.col("x") >= 0) == s, F.col("y")), F.when((F.col("x") >= 0) == s, F.col("x")))
    return r.agg(side(F.regr_intercept, False).alias("left_value"), side(F.regr_intercept, True).alias("right_value"), side(F.regr_slope, False).alias("left_slope"), side(F.regr_slope, True).alias("right_slope"), F.count_if(F.col("x") < 0).alias("n_left"), F.count_if(F.col("x") >= 0).alias("n_right")).withColumn("jump", F.col("right_value") - F.col("left_value"))


@operator()
def propensity_score_matching(df: DataFrame, key: str, treatmentColumn: str, covariateColumns: list[str], caliper: float = 0.1) -> DataFrame:
    """(treated, control, treated_score, control_score): logistic scores, then the closest pairs first until no two unlike rows within the caliper are left (``matching.closest_pairs``). Rows without a treatment or a covariate take no part."""
    from pyspark.ml.functions import vector_to_array

    from millrace.operators.matching import closest_pairs
    from millrace.operators.models import assemble, logistic_model

    rows = assemble(df.withColumn("__y", F.col(treatmentColumn).cast("int").cast("double")).where("__y is not null"), covariateColumns)
    scored = logistic_model(rows, "__y").transform(rows).select(F.col(key).alias("k"), F.col("__y").alias("y"), vector_to_array("probability")[1].alias("p"))
    return closest_pairs(scored, caliper)


@operator()
def synthetic_control(df: DataFrame, unitColumn: str, timeColumn: str, outcomeColumn: str, treatedUnit: str, treatmentTime: float, max_donors: int = 500) -> DataFrame:
    """(time, observed, synthetic, effect): donor weights on the simplex that fit the treated unit before treatment. Products of donors are summed on Spark; the weights are solved from that small matrix."""
    import numpy as np

    r = df.select(F.col(unitColumn).cast("string").alias("u"), F.col(timeColumn).alias("t"), num(outcomeColumn).alias("y")).dropna()
    donors = [x.u for x in r.where(F.col("u") != treatedUnit).select("u").distinct().orderBy("u").limit(max_donors + 1).collect()]
    if len(donors) > max_donors:
        raise ValueError(f"more than {max_donors} donors")
    before = r.where(num("t") < treatmentTime)
    own = before.where(F.col("u") == treatedUnit).select("t", F.col("y").alias("target"))
    d = before.where(F.col("u") != treatedUnit)
    g = d.alias("a").join(d.alias("b"), "t").join(own.select("t"), "t").groupBy(F.col("a.u").alias("x"), F.col("b.u").alias("z")).agg(F.sum(F.col("a.y") * F.col("b.y")).alias("v")).collect()
    c = d.join(own, "t").groupBy("u").agg(F.sum(F.col("y") * F.col("target")).alias("v")).collect()
    at = {u: i for i, u in enumerate(donors)}
    q, p = np.zeros((len(donors), len(donors))), np.zeros(len(donors))
    for x in g:
        q[at[x.x], at[x.z]] = x.v
    for x in c:
        p[at[x.u]] = x.v
    w = np.full(len(donors), 1 / max(1, len(donors)))
    scale = np.linalg.norm(q, 2) or 1.0
    for _ in range(5_000):
        v = w - (q @ w - p) / scale
        s = np.sort(v)[::-1]
        k = np.arange(1, len(s) + 1)
        rho = np.nonzero(s - (np.cumsum(s) - 1) / k > 0)[0][-1]
        new = np.maximum(v - (np.cumsum(s)[rho] - 1) / (rho + 1), 0)
        if np.abs(new - w).max() < 1e-10:
            break
        w = new
    table = F.broadcast(df.sparkSession.createDataFrame([(u, float(w[i])) for u, i in at.items()], "u string, w double"))
    made = r.join(table, "u").groupBy("t").agg(F.sum(F.col("y") * F.col("w")).alias("synthetic"))
    seen = r.where(F.col("u") == treatedUnit).groupBy("t").agg(F.mean("y").alias("observed"))
    return seen.join(made, "t", "left").select(F.col("t").alias("time"), "observed", "synthetic", finite(F.col("observed") - F.col("synthetic")).alias("effect"))
