"""Data quality: checks, expectations, drift, outliers, gates and audit."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import names, num, numeric_columns, percentile, row_hash, safe_expr, with_stats
from millrace.functions.quantiles import exact_quantiles
from millrace.plans.registry import operator


def _passes(check: str, column: str | None, p: dict) -> Column:
    c = F.col(column) if column else None
    if check == "not_null":
        return c.isNotNull()
    if check == "between":
        ok = F.lit(True)
        ok = ok & (num(c) >= p["min"]) if p.get("min") is not None else ok
        return ok & (num(c) <= p["max"]) if p.get("max") is not None else ok
    if check in ("in_set", "in"):
        return c.cast("string").isin([str(x) for x in names(p.get("set") or p.get("values") or [])])
    if check in ("regex", "regex_match"):
        return c.cast("string").rlike(p["pattern"])
    if check == "expression":
        return safe_expr(p["expression"])
    raise ValueError(f"unknown check {check}")


def _flagged(df: DataFrame, check: str, column: str | None, p: dict) -> DataFrame:
    """__ok for each row; NULL values fail not_null only."""
    if check == "unique":
        counts = df.groupBy(F.col(column).alias("__c")).agg((F.count(F.lit(1)) == 1).alias("__one"))
        return df.join(counts, F.col(column) == F.col("__c"), "left").withColumn("__ok", F.coalesce("__one", F.lit(True))).drop("__c", "__one")
    return df.withColumn("__ok", F.coalesce(_passes(check, column, p), F.lit(check != "not_null")))


@operator()
def check_data(df: DataFrame, check: str = "not_null", column: str | None = None, severity: str = "warn", name: str | None = None, **params) -> DataFrame:
    """The rows, if the rule holds or severity is warn; with severity error a violation raises. See check_report for counts."""
    if severity == "error":
        bad = _flagged(df, check, column, params).where("not __ok").limit(1).count()
        if bad:
            raise ValueError(f"{name or check} is violated")
    return df


@operator()
def check_report(df: DataFrame, check: str = "not_null", column: str | None = None, name: str | None = None, **params) -> DataFrame:
    """(name, total, violations, fraction)."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("__ok"))
    return _flagged(df, check, column, params).agg(F.lit(name or check).alias("name"), n.alias("total"), bad.alias("violations"), F.try_divide(bad, n).alias("fraction"))


@operator()
def quarantine(df: DataFrame, check: str = "not_null", column: str | None = None, **params) -> DataFrame:
    """The violating rows."""
    return _flagged(df, check, column, params).where("not __ok").drop("__ok")


@operator()
def expectations(df: DataFrame, rules: list[dict], fail_on_violation: bool = False) -> DataFrame:
    """(rule, column, passed, observed) for rules unique, not_null, between, in, regex_match, row_count_between, null_fraction, cardinality_between; one aggregate."""
    n = F.count(F.lit(1))
    items = []
    for r in rules:
        kind, c = r["type"], r.get("column")
        if kind == "row_count_between":
            seen = n.cast("double")
            ok = seen.between(r.get("min", 0), r.get("max", float("inf")))
        elif kind == "null_fraction":
            seen = F.coalesce(F.try_divide(n - F.count(c), n), F.lit(0.0))
            ok = seen <= r.get("max", 0.0)
        elif kind in ("cardinality_between", "unique"):
            seen = (F.count_distinct(c) if kind == "cardinality_between" else F.count(c) - F.count_distinct(c)).cast("double")
            ok = seen.between(r.get("min", 0), r.get("max", float("inf"))) if kind == "cardinality_between" else seen == 0
        else:
            seen = F.count_if(~F.coalesce(_passes(kind, c, r), F.lit(kind != "not_null"))).cast("double")
            ok = seen == 0
        items.append(F.struct(F.lit(r.get("name", kind)).alias("rule"), F.lit(c).cast("string").alias("column"), ok.alias("passed"), seen.alias("observed")))
    out = df.agg(F.array(*items).alias("x")).select(F.inline("x"))
    if fail_on_violation:
        bad = [r.rule for r in out.where("not passed").collect()]
        if bad:
            raise ValueError(f"expectations failed: {', '.join(bad)}")
    return out


@operator(columns=("value",))
def outliers_iqr(df: DataFrame, value: str, k: float = 1.5, output_column: str = "is_outlier") -> DataFrame:
    s = with_stats(df, __q=percentile(value, [0.25, 0.75]))
    a, b = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    return s.withColumn(output_column, F.coalesce((num(value) < a - k * (b - a)) | (num(value) > b + k * (b - a)), F.lit(False))).drop("__q")


@operator(columns=("value", "partition"))
def psi_drift(df: DataFrame, value: str, partition: str, n_bins: int = 10, baseline: str | None = None) -> DataFrame:
    """(psi, level) of two partitions over the quantile bins of the baseline, which is the first value in order unless given."""
    p = F.col(partition).cast("string")
    rows = df.select(p.alias("p"), num(value).alias("v")).dropna()
    base = rows.crossJoin(F.broadcast(rows.agg(F.min("p").alias("__b")))) if baseline is None else rows.withColumn("__b", F.lit(baseline))
    base = base.withColumn("is_base", F.col("p") == F.col("__b"))
    edges = base.where("is_base").agg(percentile("v", [i / n_bins for i in range(1, n_bins)]).alias("q"))
    binned = base.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("q", lambda q: F.col("v") > q)))
    counts = F.broadcast(df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))).join(binned.groupBy("bin").agg(F.count_if("is_base").alias("b"), F.count_if(~F.col("is_base")).alias("a")), "bin", "left").fillna(0)
    tot = with_stats(counts, tb=F.sum("b"), ta=F.sum("a"))
    e = 1e-9
    x, y = F.greatest(F.try_divide("b", "tb"), F.lit(e)), F.greatest(F.try_divide("a", "ta"), F.lit(e))
    return tot.agg(F.sum((y - x) * F.ln(y / x)).alias("psi")).withColumn("level", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("major"))


@operator(columns=("columns",))
def outliers_isolation_forest(df: DataFrame, columns: list[str], contamination: float = 0.05, n_estimators: int = 100, seed: int = 42, output_column: str = "is_outlier", sample: int = 256) -> DataFrame:
    """Trees on random samples of ``sample`` rows each, grown in tasks; all rows scored by the broadcast forest (its size is trees x sample nodes); the highest scores are outliers."""
    spark = df.sparkSession
    rows = df.select(*(num(c).alias(c) for c in columns)).dropna()
    drawn = rows.withColumn("__h", F.rand(seed)).orderBy("__h").limit(n_estimators * sample).withColumn("__tree", (F.floor(F.rand(seed + 1) * n_estimators)).cast("int"))

    def grow(pdf):
        import numpy as np
        import pandas as pd

        k = int(pdf["__tree"].iloc[0])
        rng = np.random.default_rng(seed + k)
        x = pdf[columns].to_numpy(float)
        deep = int(np.ceil(np.log2(max(2, len(x)))))

        def split(rows, d):
            if d >= deep or len(rows) <= 1:
                return {"n": len(rows)}
            f = int(rng.integers(x.shape[1]))
            lo, hi = x[rows, f].min(), x[rows, f].max()
            if lo == hi:
                return {"n": len(rows)}
            c = float(rng.uniform(lo, hi))
            low = x[rows, f] < c
            return {"f": f, "c": c, "l": split(rows[low], d + 1), "r": split(rows[~low], d + 1)}

        return pd.DataFrame({"tree": [json.dumps(split(np.arange(len(x)), 0))], "n": [len(x)]})

    trees = drawn.groupBy("__tree").applyInPandas(grow, "tree string, n long").collect()
    sent = spark.sparkContext.broadcast([json.loads(t.tree) for t in trees])
    size = sum(t.n for t in trees) / max(1, len(trees))

    @F.pandas_udf("double")
    def score(*cols):
        import numpy as np
        import pandas as pd

        def avg(n):
            return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))

        def walk(node, at, d):
            if not len(at):
                return
            if "n" in node:
                total[at] += d + avg(node["n"])
                return
            low = x[at, node["f"]] < node["c"]
            walk(node["l"], at[low], d + 1)
            walk(node["r"], at[~low], d + 1)

        ok = np.flatnonzero(~np.isnan(x).any(axis=1))
        for t in sent.value:
            walk(t, ok, 0)
        out = np.power(2.0, -total / max(1, len(sent.value)) / max(avg(size), 1e-9))
        out[np.isnan(x).any(axis=1)] = np.nan
        return pd.Series(out)

    scored = df.withColumn("anomaly_score", score(*(num(c) for c in columns))).withColumn("anomaly_score", F.when(~F.isnan("anomaly_score"), F.col("anomaly_score"))).persist()
    (cut,) = exact_quantiles(scored, "anomaly_score", [1 - contamination])
    return scored.withColumn(output_column, F.coalesce(F.col("anomaly_score") > F.lit(cut).cast("double"), F.lit(False)))


@operator()
def column_lineage_report(df: DataFrame, stageLabel: str = "post-pipeline") -> DataFrame:
    """(stage, column, dtype, distinct, nulls, min, max, mean) of each column, from one aggregate."""
    numeric = set(numeric_columns(df))
    plain = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))]
    item = lambda c, t: F.struct(F.lit(stageLabel).alias("stage"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count_distinct(c).alias("distinct"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), (F.mean(num(c)) if c in numeric else F.lit(None).cast("double")).alias("mean"))
    return df.agg(F.array(*(item(c, t) for c, t in plain)).alias("x")).select(F.inline("x"))


def _content(df: DataFrame) -> DataFrame:
    """(rows, content_hash): the same for the same rows in any order."""
    h = row_hash(df)
    agg = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor("h").cast("string").alias("x"))
    return agg.select("rows", F.sha2(F.concat_ws("|", F.lit(",".join(sorted(f"{c}:{t}" for c, t in df.dtypes))), "rows", F.coalesce("s", F.lit("")), F.coalesce("x", F.lit(""))).cast("binary"), 256).alias("content_hash"))


@operator()
def provenance_certificate(df: DataFrame, issuer: str, datasetName: str, intendedUse: str = "") -> DataFrame:
    return _content(df).select(F.lit(issuer).alias("issuer"), F.lit(datasetName).alias("dataset"), F.lit(intendedUse).alias("intended_use"), F.lit(len(df.columns)).alias("columns"), "rows", "content_hash", F.current_timestamp().alias("issued_at"))


@operator()
def tamper_evident_log(df: DataFrame, logPath: str, annotation: str = "") -> DataFrame:
    """Append the content hash of the table, chained to the log's last entry, to a Parquet log; the rows pass through. verify_log checks the chain."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(logPath).orderBy(F.desc("seq")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    row = _content(df).first()
    seq, before = (last.seq + 1, last.entry_hash) if last else (0, "")
    entry = hashlib.sha256(f"{seq}|{before}|{row.content_hash}|{row.rows}|{annotation}".encode()).hexdigest()
    spark.createDataFrame([(seq, row.rows, row.content_hash, annotation, before, entry)], "seq long, rows long, content_hash string, annotation string, previous_hash string, entry_hash string").write.mode("append").parquet(logPath)
    return df


def verify_log(log: DataFrame) -> DataFrame:
    """(seq, valid) of each entry."""
    w = Window.orderBy("seq")
    text = F.concat_ws("|", F.col("seq").cast("string"), "previous_hash", "content_hash", F.col("rows").cast("string"), "annotation")
    linked = F.col("previous_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit(""))
    return log.select("seq", (linked & (F.sha2(text.cast("binary"), 256) == F.col("entry_hash"))).alias("valid"))


@operator()
def schema_gate(df: DataFrame, requiredColumns: str | list[str] = "", expectedTypes: dict[str, str] | None = None, allowExtraColumns: bool = True) -> DataFrame:
    """The rows, or an error if columns are missing, have other types, or are not expected. Runs no job."""
    kinds, wanted = dict(df.dtypes), names(requiredColumns)
    bad = [f"missing {c}" for c in wanted if c not in kinds]
    bad += [f"{c} is {kinds.get(c)}, not {t}" for c, t in (expectedTypes or {}).items() if kinds.get(c) != t]
    if not allowExtraColumns:
        bad += [f"unexpected {c}" for c in kinds if c not in set(wanted) | set(expectedTypes or {})]
    if bad:
        raise ValueError("; ".join(bad))
    return df


@operator(ports=("df", "expected"))
def golden_row_assert(df: DataFrame, expected: DataFrame, idColumn: str, tolerance: float = 0.0, fail: bool = False) -> DataFrame:
    """(id, column, expected, actual, problem) for expected(id, column, value) cells that differ, or whose id is missing or not unique."""
    ids = df.groupBy(F.col(idColumn).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns))).alias("r"))
    cells = ids.select("id", "n", F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.col(f"r.{c}") for c in df.columns)))).alias("column", "actual"))
    want = expected.select(F.col("id").cast("string").alias("id"), "column", F.col("value").cast("string").alias("expected"))
    both = want.join(cells, ["id", "column"], "left")
    a, b = F.col("actual").try_cast("double"), F.col("expected").try_cast("double")
    same = F.col("actual").eqNullSafe(F.col("expected")) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    out = both.withColumn("problem", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "not unique").when(~same, "differs")).where("problem is not null").select("id", "column", "expected", "actual", "problem")
    if fail and out.limit(1).count():
        raise ValueError("golden rows differ")
    return out


@operator()
def pipeline_snapshot_test(df: DataFrame, expectedSnapshot: dict | None = None, tolerance: float = 0.0) -> DataFrame:
    """(rows, columns, content_hash, passed, problems) against an expected {rows, columns, content_hash}; rows may differ by tolerance percent."""
    e = expectedSnapshot or {}
    out = _content(df).withColumn("columns", F.lit(",".join(df.columns)))
    tests = []
    if "rows" in e:
        tests.append(F.when(F.abs(F.col("rows") - e["rows"]) > e["rows"] * tolerance / 100, "rows"))
    if "columns" in e:
        tests.append(F.when(F.col("columns") != ",".join(e["columns"]), "columns"))
    if "content_hash" in e:
        tests.append(F.when(F.col("content_hash") != e["content_hash"], "content_hash"))
    problems = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return out.withColumn("problems", problems).withColumn("passed", F.size("problems") == 0)

