"""Filters, duplicates, order, limits and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import num, order, safe_expr
from millrace.operators.neighbours import knn_join
from millrace.plans.registry import operator
from millrace.scratch import settle


@operator()
def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the predicate is true."""
    return df.where(safe_expr(predicate))


@operator(columns=("key",))
def deduplicate(df: DataFrame, key: list[str] | None = None, order_by: list | None = None) -> DataFrame:
    """One row for each key (all columns if none); with order_by the first one stays, otherwise any."""
    if not key or not order_by:
        return df.dropDuplicates(key) if key else df.distinct()
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order(order_by)))).where("__rn = 1").drop("__rn")


@operator()
def sort_rows(df: DataFrame, by: list) -> DataFrame:
    """Several keys, NULLs last both ways."""
    return df.orderBy(*order(by))


def _shuffled(seed: int, order_by: list | None = None) -> Column:
    """A place in a seeded random order: by the hash of the key columns where given, so that reruns agree."""
    return F.xxhash64(F.lit(seed), *order_by) if order_by else F.rand(seed)


def numbered(df: DataFrame, order_by: list, name: str = "__rn") -> DataFrame:
    """Consecutive numbers from 1 in a global order, without one task for all rows: range-sorted partitions plus their offsets."""
    ordered = df.orderBy(*order(order_by)).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    ordered = settle(ordered, "numbered")  # written, so that the offsets fit also after an executor is lost
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__start")
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + local + 1).drop("__part", "__id", "__start")


@operator()
def sample_rows(df: DataFrame, kind: str = "head", n: int = 1000, pct: float = 10, seed: int = 42, order_by: list | None = None) -> DataFrame:
    """head, tail (needs order_by), random_n or random_pct."""
    if kind == "head":
        return (df.orderBy(*order(order_by)) if order_by else df).limit(n)
    if kind == "tail":
        flipped = [{"column": x, "desc": True} if isinstance(x, str) else {"column": x["column"], "desc": not x.get("desc")} for x in order_by or []]
        if not flipped:
            raise ValueError("tail needs order_by")
        return df.orderBy(*order(flipped)).limit(n)
    return df.orderBy(_shuffled(seed, order_by)).limit(n) if kind == "random_n" else df.sample(fraction=pct / 100, seed=seed)


@operator(columns=("strataColumn",))
def sample_stratified(df: DataFrame, strataColumn: str, sampleSize: int = 1000, seed: int = 42, order_by: list | None = None) -> DataFrame:
    """At least one row of each stratum, otherwise its share of sampleSize."""
    counts = df.groupBy(strataColumn).agg(F.count(F.lit(1)).alias("__n"))
    quota = counts.withColumn("__q", F.greatest(F.lit(1), F.round(sampleSize * F.col("__n") / F.sum("__n").over(Window.partitionBy())))).withColumnRenamed(strataColumn, "__s").drop("__n")
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(strataColumn).orderBy(_shuffled(seed, order_by))))
    return ranked.join(quota, ranked[strataColumn].eqNullSafe(quota["__s"])).where("__rn <= __q").select(*df.columns)


@operator(columns=("clusterColumn",))
def sample_cluster(df: DataFrame, clusterColumn: str, numClusters: int = 10, seed: int = 42) -> DataFrame:
    """All rows of a few random clusters."""
    chosen = df.select(clusterColumn).distinct().orderBy(F.xxhash64(F.lit(seed), clusterColumn)).limit(numClusters).withColumnRenamed(clusterColumn, "__c")
    return df.join(F.broadcast(chosen), df[clusterColumn].eqNullSafe(F.col("__c")), "left_semi")


@operator()
def sample_reservoir(df: DataFrame, sampleSize: int = 1000, seed: int = 42, order_by: list | None = None) -> DataFrame:
    """A uniform sample of exactly sampleSize rows."""
    return df.orderBy(_shuffled(seed, order_by)).limit(sampleSize)


@operator()
def sample_systematic(df: DataFrame, order_by: list, sampleSize: int = 1000, seed: int = 42, every: int | None = None) -> DataFrame:
    """Every k-th row from a start that the seed sets, k = rows // sampleSize or ``every``."""
    rows = numbered(df, order_by)
    k = F.lit(max(2, every)) if every else F.greatest(F.lit(1), F.floor(F.col("__all") / sampleSize))
    if not every:
        rows = rows.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__all"))))
    start = F.lit(0) if every else F.pmod(F.xxhash64(F.lit(seed)), k)
    out = rows.where((F.col("__rn") - 1 - start) % k == 0)
    return (out if every else out.orderBy("__rn").limit(sampleSize)).select(*df.columns)


@operator(columns=("weightColumn",))
def sample_weighted(df: DataFrame, weightColumn: str, sampleSize: int = 1000, withReplacement: bool = False, seed: int = 42, order_by: list | None = None) -> DataFrame:
    """Rows with chances in proportion to their weight; rows without a positive weight come last."""
    w = num(weightColumn)
    u = (F.pmod(F.xxhash64(F.lit(seed), *order_by), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1)) if order_by else F.rand(seed)
    if not withReplacement:
        return df.withColumn("__k", F.when(w > 0, -F.ln(u) / w)).orderBy(F.asc_nulls_last("__k")).limit(sampleSize).drop("__k")
    # expected draws of each row: a Poisson number of copies, then sampleSize of them
    shares = df.crossJoin(F.broadcast(df.agg(F.sum(F.when(w > 0, w)).alias("__all")))).where(w > 0)
    copies = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(sampleSize * w / F.col("__all") * 4 + 8))))
    draws = shares.withColumn("__copy", copies).withColumn("__k", -F.ln(F.rand(seed)) / w)
    return draws.orderBy("__k").limit(sampleSize).select(*df.columns)


@operator(columns=("targetColumn",))
def undersample(df: DataFrame, targetColumn: str, ratio: float = 1.0, seed: int = 42, order_by: list | None = None) -> DataFrame:
    """No class has more than ratio times the rows of the smallest one."""
    cap = df.groupBy(targetColumn).agg(F.count(F.lit(1)).alias("n")).agg(F.floor(F.min("n") * ratio).alias("__cap"))
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(targetColumn).orderBy(_shuffled(seed, order_by))))
    return ranked.crossJoin(F.broadcast(cap)).where("__rn <= __cap").select(*df.columns)


@operator()
def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.2, stratify_by: str | None = None, seed: int = 42, output_column: str = "split") -> DataFrame:
    """'test' for the share test_size (of each stratum), 'train' for the rest, in the hash order of ``key``."""
    w = Window.partitionBy(*([stratify_by] if stratify_by else [])).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    if stratify_by:
        ranked = df.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(stratify_by)))
    else:
        ranked = numbered(df.withColumn("__h", F.xxhash64(F.lit(seed), *key)), ["__h", *key]).drop("__h").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))))
    return ranked.withColumn(output_column, F.when(F.col("__rn") <= F.ceil(F.col("__n") * test_size), "test").otherwise("train")).drop("__rn", "__n")


@operator()
def kfold_split(df: DataFrame, key: list[str], n_splits: int = 5, stratify_by: str | None = None, seed: int = 42, output_column: str = "fold") -> DataFrame:
    """Folds 0..k-1 of equal size, dealt in the hash order of ``key``."""
    if stratify_by:
        ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(stratify_by).orderBy(F.xxhash64(F.lit(seed), *key), *key)))
    else:
        ranked = numbered(df.withColumn("__h", F.xxhash64(F.lit(seed), *key)), ["__h", *key]).drop("__h")
    return ranked.withColumn(output_column, ((F.col("__rn") - 1) % n_splits).cast("int")).drop("__rn")


@operator(columns=("targetColumn", "featureColumns"))
def smote_oversample(df: DataFrame, targetColumn: str, featureColumns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Classes are filled up to the largest with points between a row and one of its k nearest of the class (true neighbours, by an exact search).

    Each complete row of a class gives as many points as any other, or one more; which rows, neighbours and places between them follow
    seeded hashes, so reruns on the same files agree. Ties between neighbours are broken by place in the table. Rows lacking a feature
    stay but give no points; a class with a single complete row repeats it, one without any stays as it is; a NULL class is a class.
    """
    x = [num(c) for c in featureColumns]
    counts = df.groupBy(F.col(targetColumn).alias("__y")).agg(F.count(F.lit(1)).alias("n")).collect()
    most = max((r.n for r in counts), default=0)
    whole = settle(df.withColumn("__v", F.array(*x)).where(~F.exists("__v", lambda v: v.isNull() | F.isnan(v))).select(F.col(targetColumn).alias("__y"), "__v"), "smote-rows")
    made = []
    for c in counts:
        if c.n == most:
            continue
        rows = numbered(whole.where(F.col("__y").eqNullSafe(F.lit(c["__y"]))).select("__v", F.xxhash64(F.lit(seed), "__v").alias("__h")), ["__h", "__v"], "id").select("id", F.col("__v").alias("v"))
        rows = settle(rows, "smote-class")
        n = rows.count()
        if not n:
            continue
        need, rest = divmod(most - c.n, n)
        near = knn_join(rows, rows, k).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour")))["neighbour"].alias("near"))
        seeds = rows.withColumn("copies", F.lit(need) + F.when(F.col("id") <= rest, 1).otherwise(0)).where("copies > 0")
        each = seeds.join(near, seeds["id"] == near["source"], "left").select("id", "v", "near", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        one = F.coalesce(F.get("near", F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "id", "copy"), F.greatest(F.size("near"), F.lit(1))).cast("int")), F.col("id"))
        share = F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "id", "copy"), F.lit(1 << 30)) / float(1 << 30)
        ends = each.withColumns({"__other": one, "__share": share}).join(rows.select(F.col("id").alias("__other"), F.col("v").alias("w")), "__other")
        between = F.zip_with("v", "w", lambda a, b: b - a)
        ends = ends.withColumn("__new", F.zip_with("v", F.transform(between, lambda d: d * F.col("__share")), lambda a, d: a + d))
        made.append(ends.select(F.lit(c["__y"]).cast(df.schema[targetColumn].dataType).alias(targetColumn), *(F.get("__new", F.lit(i)).alias(f) for i, f in enumerate(featureColumns))))
    base = df.select(targetColumn, *(num(c).alias(c) for c in featureColumns))
    out = base.withColumn("synthetic", F.lit(False))
    for points in made:
        out = out.unionByName(points.withColumn("synthetic", F.lit(True)))
    return out


@operator()
def preview(df: DataFrame, method: str = "head", size: int = 500, every_n: int = 10, seed: int = 42, column: str | None = None, time_column: str | None = None, bucket: str = "day", order_by: list | None = None) -> DataFrame:
    """Table previews: head, tail, random, systematic, stratified, per_group, time_bucket, weighted, bootstrap; head if the column is missing."""
    have = set(df.columns)
    if method == "tail":
        return sample_rows(df, "tail", size, order_by=order_by)
    if method == "random":
        return sample_reservoir(df, size, seed, order_by)
    if method == "systematic":
        return sample_systematic(df, order_by, every=every_n).limit(size)
    if method == "stratified" and column in have:
        return sample_stratified(df, column, size, seed, order_by)
    if method in ("per_group", "time_bucket") and (column if method == "per_group" else time_column) in have:
        key = F.col(column) if method == "per_group" else F.date_trunc(bucket, F.col(time_column))
        w = Window.partitionBy("__g").orderBy(*(order(order_by) if order_by else [_shuffled(seed)]))
        return df.withColumn("__g", key).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size).drop("__g", "__rn")
    if method == "weighted" and column in have:
        return sample_weighted(df, column, size, False, seed, order_by)
    if method == "bootstrap":
        total = df.count()
        draws = df.sparkSession.range(size).select((F.floor(F.rand(seed) * total) + 1).alias("__rn"))
        return numbered(df, order_by or [df.columns[0]]).join(F.broadcast(draws), "__rn").drop("__rn")
    return sample_rows(df, "head", size, order_by=order_by)
