"""Joins, set operations and nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import num
from millrace.operators.blocks import all_distances, best_pairs
from millrace.operators.neighbours import knn_join, unit
from millrace.plans.lineage import Origin, both_ports, origin
from millrace.plans.registry import operator

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "anti_left": "left_anti", "anti_right": "left_anti", "semi": "left_semi"}


def _condition(key: dict) -> Column:
    op, a = key.get("op", "="), F.col(f"l.{key['left']}")
    if op == "between" and key.get("right2"):
        return a.between(F.col(f"r.{key['right']}"), F.col(f"r.{key['right2']}"))
    b = F.col(f"r.{key['right']}")
    if op in ("≈", "~"):
        return F.lower(F.trim(a.cast("string"))) == F.lower(F.trim(b.cast("string")))
    return {"=": a == b, "between": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _joined(inputs, p, outputs):
    left, right = inputs["left"].columns, inputs["right"].columns
    kind, rule, (x, y) = p["kind"], p["columnCollisions"], p["suffixes"]
    if kind == "anti_right":
        return {c: origin("right", c, "join") for c in right}
    if kind in ("anti_left", "semi"):
        return {c: origin("left", c, "join") for c in left}
    keys = {} if kind == "cross" else {k["right"]: k["left"] for k in p["keys"] if k.get("op", "=") == "="}
    both = {c for c in left if c in right and c not in keys}
    made = {}
    for c in left:
        others = {("right", r) for r, k in keys.items() if k == c} if p["coalesce_keys"] else set()
        if c in both and rule == "coalesce" and kind != "cross":
            others = {("right", c)}
        made[c + x if c in both and rule == "keep_both" and kind != "cross" else c] = Origin(frozenset({("left", c)} | others), "join")
    for c in right:
        if kind == "cross" or c not in keys and not (c in left and rule in ("keep_left", "coalesce")):
            made[c + y if c in left and (kind == "cross" or c in both and rule == "keep_both") else c] = origin("right", c, "join")
    return made


@operator(ports=("left", "right"), lineage=_joined)
def join(left: DataFrame, right: DataFrame, keys: list[dict] | None = None, kind: str = "inner", columnCollisions: str = "keep_both", suffixes: list[str] | tuple[str, str] = ("_x", "_y"), coalesce_keys: bool = False, bucket: float | None = None) -> DataFrame:
    """Join on keys [{left, op, right, right2?}] with ops = < <= > >= ≈ between, all of which must hold.

    The right column of an equality key is dropped, so right and full rows without a left match have a NULL key unless
    coalesce_keys. Other columns of one name are kept twice with suffixes (keep_both), from one side, or coalesced.
    bucket = width turns a ``between`` key over numbers into an equality join on interval buckets.
    """
    if kind == "cross":
        return left.crossJoin(right.select(*(F.col(c).alias(c + suffixes[1] if c in left.columns else c) for c in right.columns)))
    if kind == "anti_right":
        flipped = [{"left": k["right"], "right": k["left"], "op": {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(k.get("op", "="), k.get("op", "="))} for k in keys]
        return join(right, left, flipped, "anti_left")
    a, b = left.alias("l"), right.alias("r")
    on = reduce(Column.__and__, (_condition(k) for k in keys))
    ranged = next((k for k in keys if k.get("op") == "between" and k.get("right2")), None)
    if bucket and ranged and kind in ("inner", "left"):
        cells = F.explode(F.sequence(F.floor(F.col(ranged["right"]) / bucket), F.floor(F.col(ranged["right2"]) / bucket)))
        a = left.withColumn("__cell", F.floor(F.col(ranged["left"]) / bucket)).alias("l")
        b = right.withColumn("__cell", cells).alias("r")
        on = on & (F.col("l.__cell") == F.col("r.__cell"))
    joined = a.join(b, on, KINDS[kind])
    if kind in ("anti_left", "semi"):
        return joined.select(*(F.col(f"l.{c}") for c in left.columns))
    gone = {k["right"]: k["left"] for k in keys if k.get("op", "=") == "="}
    out = []
    for c in left.columns:
        own = F.col(f"l.{c}")
        if coalesce_keys and c in gone.values():
            own = F.coalesce(own, *(F.col(f"r.{r}") for r, x in gone.items() if x == c))
        both = c in right.columns and c not in gone
        if both and columnCollisions == "keep_right":
            continue
        if both and columnCollisions == "coalesce":
            own = F.coalesce(own, F.col(f"r.{c}"))
        out.append(own.alias(c + suffixes[0] if both and columnCollisions == "keep_both" else c))
    for c in right.columns:
        both = c in left.columns
        if c in gone or both and columnCollisions in ("keep_left", "coalesce"):
            continue
        out.append(F.col(f"r.{c}").alias(c + suffixes[1] if both and columnCollisions == "keep_both" else c))
    return joined.select(*out)


@operator(ports=("top", "bottom"), lineage=both_ports)
def union(top: DataFrame, bottom: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of both, columns by name, missing ones NULL."""
    out = top.unionByName(bottom, allowMissingColumns=True)
    return out.distinct() if distinct else out


@operator(ports=("top", "bottom"))
def intersect(top: DataFrame, bottom: DataFrame, all: bool = False) -> DataFrame:
    return top.intersectAll(bottom.select(*top.columns)) if all else top.intersect(bottom.select(*top.columns))


@operator("except", ports=("top", "bottom"))
def except_(top: DataFrame, bottom: DataFrame, all: bool = False) -> DataFrame:
    return top.exceptAll(bottom.select(*top.columns)) if all else top.subtract(bottom.select(*top.columns))


@operator(ports=("df", "reference"), lineage=lambda inputs, p, outputs: {p["prefix"] + c: origin("reference", c, "lookup") for c in p["outputs"]})
def lookup_join(df: DataFrame, reference: DataFrame, column: str, keys: list[str], outputs: list[str], normalise: bool = True, prefix: str = "") -> DataFrame:
    """Columns of a reference table by a code or name, which may be in any of its key columns; the first key column wins.

    The reference is reduced to one row a key, and Spark broadcasts it while it is small.
    """
    clean = lambda c: F.upper(F.trim(F.col(c).cast("string"))) if normalise else F.col(c).cast("string")
    rows = reduce(DataFrame.unionByName, (reference.select(clean(k).alias("__key"), F.lit(i).alias("__i"), *(F.col(o).alias(prefix + o) for o in outputs)) for i, k in enumerate(keys)))
    best = rows.where("__key is not null").groupBy("__key").agg(F.min_by(F.struct(*(prefix + o for o in outputs)), F.struct("__i", *(F.col(prefix + o).cast("string") for o in outputs))).alias("__v"))
    return df.withColumn("__key", clean(column)).join(best, "__key", "left").select(*df.columns, *(F.col(f"__v.{prefix + o}").alias(prefix + o) for o in outputs))


def _as_of(inputs, p, outputs):
    left = inputs["left"].columns
    return {c if c not in left else f"{c}_r": origin("right", c, "as-of join") for c in inputs["right"].columns if c not in (p["by"] or [])}


@operator(ports=("left", "right"), lineage=_as_of)
def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, tolerance: float | None = None) -> DataFrame:
    """Each left row with the last right row of its group at or before it; one union and one window, no pairs."""
    own = [c for c in right.columns if c not in (by or [])]
    a = left.select(F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*own)).schema[0].dataType).alias("__r"), *(by or []), F.col(left_on).alias("__t"), F.lit(1).alias("__side"))
    b = right.select(F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*own).alias("__r"), *(by or []), F.col(right_on).alias("__t"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*(by or [])).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    near = F.lit(True) if tolerance is None else num("__t") - num(F.col(f"__r.{right_on}")) <= tolerance
    return found.select("__l.*", *(F.when(near, F.col(f"__r.{c}")).alias(c if c not in left.columns else f"{c}_r") for c in own))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two vectors; cosine is 1 - similarity, dot is minus the product."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    if metric == "dot":
        return -dot
    if metric == "cosine":
        size = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
        return 1 - F.try_divide(dot, size(a) * size(b))
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "euclidean":
        return F.sqrt(total(F.transform(gap, lambda x: x * x)))
    return total(gap) if metric == "manhattan" else F.array_max(gap)


def _neighbours(queries: DataFrame, base: DataFrame, vector: str, label: str, k: int, metric: str, include_self: bool) -> DataFrame:
    """(source, neighbour, distance, rank): the k nearest rows of ``base`` for each query, by blocks of both sides.

    What is shuffled is the rows once and k rows for each query and share of the base, never all pairs.
    """
    pick = lambda df: df.select(F.col(label).alias("id"), F.col(vector).alias("v"))
    found = best_pairs(pick(queries), pick(base), k, metric, include_self)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "neighbour"))
    far = 1 - F.col("score") if metric == "cosine" else -F.col("score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("source", "neighbour", far.alias("distance"), "rank")


def _by_lists(queries: DataFrame, base: DataFrame, vector: str, label: str, k: int, metric: str, include_self: bool, probes: int | None) -> DataFrame:
    """As _neighbours, by the lists of millrace.operators.neighbours; cosine is Euclidean between vectors of length one."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"an index serves cosine and euclidean, not {metric}")
    v = F.col(vector).cast("array<double>")
    pick = lambda df: df.select(F.col(label).alias("id"), (unit(v) if metric == "cosine" else v).alias("v"))
    near = knn_join(pick(queries), pick(base), k, include_self, probes)
    far = F.col("distance") * F.col("distance") / 2 if metric == "cosine" else F.col("distance")
    return near.select("source", "neighbour", far.alias("distance"), "rank")


def _near(queries: DataFrame, base: DataFrame, vector: str, label: str, k: int, metric: str, include_self: bool, index: str, probes: int) -> DataFrame:
    if index not in ("none", "bounds", "lists"):
        raise ValueError(f"unknown index {index}")
    if index == "none":
        return _neighbours(queries, base, vector, label, k, metric, include_self)
    return _by_lists(queries, base, vector, label, k, metric, include_self, probes if index == "lists" else None)


@operator(columns=("embedding_column", "label_column"))
def nearest_neighbors(df: DataFrame, embedding_column: str, label_column: str, k: int = 5, metric: str = "cosine", queries: DataFrame | None = None, index: str = "none", probes: int = 32) -> DataFrame:
    """(source, neighbour, distance, rank), one row each; a row is not its own neighbour. Queries default to all rows.

    index: none compares every query with every row; bounds is as exact, by lists of rows that triangle bounds leave out where
    they can; lists visits the ``probes`` nearest lists only and may miss neighbours that lie in others: measure the recall on
    some queries against none, and take more probes where it is below what is wanted.
    """
    return _near(queries if queries is not None else df, df, embedding_column, label_column, k, metric, False, index, probes)


@operator(columns=("vectorColumn", "labelColumn"))
def top_k_similar(df: DataFrame, vectorColumn: str, labelColumn: str, k: int = 5, metric: str = "cosine", includeSelf: bool = False, indicesColumn: str = "top_k_indices", scoresColumn: str = "top_k_scores", index: str = "none", probes: int = 32) -> DataFrame:
    """Arrays of the k most similar rows and their scores (cosine and dot: larger is nearer; euclidean: smaller)."""
    near = _near(df, df, vectorColumn, labelColumn, k, metric, includeSelf, index, probes)
    score = F.col("distance") if metric == "euclidean" else 1 - F.col("distance") if metric == "cosine" else -F.col("distance")
    lists = near.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", score.alias("score")))).alias("x"))
    lists = lists.select(F.col("source").alias("__s"), F.col("x.neighbour").alias(indicesColumn), F.col("x.score").alias(scoresColumn))
    return df.join(lists, df[labelColumn] == F.col("__s"), "left").drop("__s")


@operator(columns=("vectorColumn",))
def distance_matrix(df: DataFrame, vectorColumn: str, labelColumn: str, metric: str = "euclidean", outputFormat: str = "long", maxRows: int = 1000, queries: DataFrame | None = None) -> DataFrame:
    """All pairs of a row of ``queries`` (df's own rows without it) and a row of df, as rows (a, b, distance) or as a square.

    Any number of queries is taken, at most maxRows of them in a block; df is not shuffled.
    """
    pick = lambda rows: rows.select(F.col(labelColumn).alias("id"), F.col(vectorColumn).alias("v"))
    long = all_distances(pick(df if queries is None else queries), pick(df), metric, maxRows)
    return long if outputFormat == "long" else long.groupBy("a").pivot("b").agg(F.first("distance"))
