"""Services on whole tables: profiles, type detection, diffs, drift, freshness, lineage."""

from __future__ import annotations



from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import num, numeric_columns
from millrace.plans.registry import operator


def _plain(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))]


@operator()
def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, dtype, rows, nulls, null_fraction, distinct, min, max, mean, std, min_length, max_length, mean_length) over the whole table, from one aggregate."""
    numeric, n = set(numeric_columns(df)), F.count(F.lit(1))

    def item(c: str, t: str):
        text = t == "string"
        none = F.lit(None).cast("double")
        length = F.length(c)
        return F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("dtype"), n.alias("rows"), (n - F.count(c)).alias("nulls"), F.try_divide(n - F.count(c), n).alias("null_fraction"),
            (F.approx_count_distinct(c) if approx else F.count_distinct(c)).alias("distinct"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
            (F.mean(num(c)) if c in numeric else none).alias("mean"), (F.stddev_samp(num(c)) if c in numeric else none).alias("std"),
            (F.min(length) if text else F.lit(None).cast("int")).alias("min_length"), (F.max(length) if text else F.lit(None).cast("int")).alias("max_length"), (F.mean(length) if text else none).alias("mean_length"),
        )

    return df.agg(F.array(*(item(c, t) for c, t in _plain(df))).alias("x")).select(F.inline("x"))


@operator()
def top_values(df: DataFrame, top_k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count, rank) for the most frequent values of each column; one aggregate over column-value pairs."""
    cols = columns or [c for c, _ in _plain(df)]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols))).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))).where(F.col("rank") <= top_k)


# Patterns by which text columns are recognised.
SEMANTIC = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^(https?|ftp)://\S+$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$|^[0-9a-fA-F:]*::?[0-9a-fA-F:]+$",
    "phone": r"^\+?[\d\s().\-]{7,20}$",
    "color": r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?",
    "percentage": r"^-?\d+(\.\d+)?\s*%$",
    "currency": r"^[$€£¥]\s?-?[\d,]+(\.\d+)?$",
    "boolean": r"^(?i:true|false|yes|no)$",
    "integer": r"^[+-]?\d{1,18}$",
    "bignum": r"^[+-]?\d{19,}$",
    "scientific": r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$",
    "decimal_string": r"^[+-]?\d*\.\d+$",
    "hex": r"^(0x)?[0-9a-fA-F]{6,}$",
    "json": r"^\s*[\[{].*[\]}]\s*$",
    "timezone": r"^(UTC|GMT|[A-Z][a-z]+/[A-Za-z_]+)$",
    "country": r"^[A-Z]{2,3}$",
}


@operator()
def detect_types(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(column, type, score, rank) for semantic types that at least the share ``threshold`` of a text column's values fit; earlier types win ties."""
    cols = [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, type string, score double, rank int")
    items = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.lit(i).alias("i"), F.avg(F.col(c).rlike(p).cast("double")).alias("score")) for c in cols for i, (k, p) in enumerate(SEMANTIC.items())]
    long = df.agg(F.array(*items).alias("x")).select(F.inline("x")).where(F.col("score") >= threshold)
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("score"), "i"))).drop("i")


@operator(ports=("a", "b"))
def diff_keyed(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """(key..., change, cells): rows added, dropped or changed between two tables, and the cells that changed."""
    keys = [key] if isinstance(key, str) else key
    cols = [c for c in a.columns if c in b.columns and c not in keys]
    x = a.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in cols), F.lit(1).alias("__here")).alias("a"))
    y = b.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in cols), F.lit(1).alias("__here")).alias("b"))
    j = x.join(y, keys, "full")
    cells = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("before"), F.col(f"b.{c}").alias("after"))) for c in cols))) if cols else F.array()
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").when(F.size("cells") > 0, "changed")
    out = j.withColumn("cells", cells).withColumn("change", change).where("change is not null")
    return out.select(*keys, "change", F.when(F.col("change") == "changed", F.col("cells")).alias("cells"))


@operator(ports=("a", "b"))
def diff_unkeyed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (over the common columns) only in a, marked 'dropped', or only in b, marked 'added', as often as they are."""
    cols = [c for c in a.columns if c in b.columns]
    return a.select(*cols).exceptAll(b.select(*cols)).withColumn("change", F.lit("dropped")).unionByName(b.select(*cols).exceptAll(a.select(*cols)).withColumn("change", F.lit("added")))


@operator(ports=("df", "previous"))
def schema_drift(df: DataFrame, previous: DataFrame) -> DataFrame:
    """(column, change, before, after) against an earlier table; runs no job on either."""
    now, was = dict(df.dtypes), dict(previous.dtypes)
    rows = [(c, "added" if c not in was else "removed" if c not in now else "retyped", was.get(c), now.get(c)) for c in sorted(now.keys() | was.keys()) if now.get(c) != was.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, change string, before string, after string")


@operator()
def row_count_anomaly(runs: DataFrame, orderColumn: str, countColumn: str, by: list[str] | None = None, history: int = 5, least: int = 3, z_limit: float = 2.0, deviation: float = 0.1) -> DataFrame:
    """Flags runs whose row count is z_limit population deviations and at least 10 % off the mean of the runs before."""
    w = Window.partitionBy(*(by or [])).orderBy(orderColumn).rowsBetween(-history, -1)
    n = num(countColumn)
    out = runs.withColumn("mean", F.mean(n).over(w)).withColumn("std", F.stddev_pop(n).over(w)).withColumn("seen", F.count(n).over(w))
    out = out.withColumn("z", F.when(F.col("seen") >= least, F.try_divide(n - F.col("mean"), F.col("std"))))
    off = F.abs(n - F.col("mean")) >= deviation * F.abs(F.col("mean"))
    return out.withColumn("is_anomaly", F.coalesce((F.col("seen") >= least) & off & ((F.abs("z") >= z_limit) | (F.col("std") == 0) & (n != F.col("mean"))), F.lit(False))).drop("seen")


@operator()
def freshness(df: DataFrame, lastColumn: str, slaSeconds: float, warnAt: float = 0.8, now: str | None = None) -> DataFrame:
    """fresh, due (past the warning share of the agreed age), stale or never."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = F.unix_timestamp(at) - F.unix_timestamp(F.col(lastColumn).cast("timestamp"))
    return df.withColumn("age_seconds", age).withColumn("status", F.when(age.isNull(), "never").when(age > slaSeconds, "stale").when(age > slaSeconds * warnAt, "due").otherwise("fresh"))


@operator()
def with_row_id(df: DataFrame, key: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """An id for row lineage: the hash of the key columns, or of all; the same in every run."""
    cols = key or [c for c, _ in _plain(df)]
    return df.withColumn(name, F.xxhash64(*(F.col(c) for c in cols)))


@operator()
def lineage_aggregate(df: DataFrame, groupBy: list[str], aggregates: list[dict], row_id: str = "row_id") -> DataFrame:
    """group_aggregate that also lists the rows behind each result row."""
    from millrace.operators.grouping import aggregate

    return df.groupBy(*groupBy).agg(*(aggregate(a) for a in aggregates), F.array_sort(F.collect_set(row_id)).alias("source_rows"))


@operator()
def overview(df: DataFrame) -> DataFrame:
    """(operator, params) suggestions for a first look at a table, from its profile."""
    import json

    rows = profile(df, approx=True).collect()
    out: list[tuple[str, dict]] = [("profile", {})]
    numeric = [r.column for r in rows if r.mean is not None]
    few = [r.column for r in rows if r.mean is None and 1 < r.distinct <= 50]
    times = [r.column for r in rows if r.dtype in ("timestamp", "timestamp_ntz", "date")]
    out += [("histogram", {"column": c}) for c in numeric[:5]]
    out += [("group_aggregate", {"groupBy": [c], "aggregates": [{"fn": "count"}]}) for c in few[:5]]
    if len(numeric) > 1:
        out.append(("correlation_matrix", {"columns": numeric[:8]}))
    if times and numeric:
        out.append(("resample", {"time_column": times[0], "aggregations": [{"column": numeric[0], "fn": "mean"}]}))
    out += [("outliers_iqr", {"value": c}) for c in numeric[:2]]
    return df.sparkSession.createDataFrame([(o, json.dumps(p)) for o, p in out], "operator string, params string")


