"""Mixing sources to target weights as a min-cost flow over membership patterns.

A pattern is the set of sources that a document belongs to. Spark adds up the words of each pattern; the flow then
routes pattern capacity to source quotas. The k-th copy of a document costs k, so costs are convex and a cheapest flow
first spreads new documents and only then repeats them. Only the table of pattern sums, one row for each pattern, is
solved on the driver. Which documents a pattern gives is decided on Spark by a seeded order of the documents:
prefix sums over hash digits find the cut, so no pattern is ever sorted or collected whole. The document at the cut is
taken if that brings the pattern's sum nearer to its flow.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import n_words
from millrace.scratch import settle

WEIGHTS, SHARE, MAX_COPIES, DIGITS = (5, 2, 1), 1.5, 2, 3


def quotas(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = MAX_COPIES) -> dict[str | None, float]:
    """Targets of the sources: weights go round the sources by code point (null last); no target exceeds limit x size, the excess is shared anew by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = set(names), share * sum(sizes.values()), {}
    while open_:
        total = sum(weight[s] for s in names if s in open_)
        full = [s for s in names if s in open_ and left * weight[s] / total > limit * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in names if s in open_}
        for s in full:
            out[s] = float(limit * sizes[s])
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def route(capacity: dict[tuple, int], quota: dict, copies: int = MAX_COPIES) -> dict[tuple, int]:
    """Words that each pattern gives in a cheapest flow: successive shortest paths, copy k of a word costs k.

    Nodes are the patterns and the sources, so the graph is as large as the table of patterns.
    """
    patterns, sources = list(capacity), list(quota)
    at = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    arcs: list[list[list]] = [[] for _ in range(len(at) + 2)]

    def arc(u: int, v: int, cap: float, cost: int) -> None:
        arcs[u].append([v, cap, cost, len(arcs[v])])
        arcs[v].append([u, 0, -cost, len(arcs[u]) - 1])

    for p in patterns:
        for k in range(copies):
            arc(0, at["p", p], capacity[p], k + 1)
        for s in p:
            if s in quota:
                arc(at["p", p], at["s", s], copies * capacity[p], 0)
    for s in sources:
        arc(at["s", s], 1, round(quota[s]), 0)
    potential = [0] * len(arcs)
    while True:
        dist, back, heap = [float("inf")] * len(arcs), [None] * len(arcs), [(0, 0)]
        dist[0] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(arcs[u]):
                if cap > 0 and d + cost + potential[u] - potential[v] < dist[v]:
                    dist[v] = d + cost + potential[u] - potential[v]
                    back[v] = (u, k)
                    heapq.heappush(heap, (dist[v], v))
        if back[1] is None:
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
        flow, v = float("inf"), 1
        while v:
            u, k = back[v]
            flow, v = min(flow, arcs[u][k][1]), u
        v = 1
        while v:
            u, k = back[v]
            arcs[u][k][1] -= flow
            arcs[v][arcs[u][k][3]][1] += flow
            v = u
    return {p: int(copies * capacity[p] - sum(a[1] for a in arcs[0] if a[0] == at["p", p])) for p in patterns}


def _order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _cut(pool: DataFrame, quota: DataFrame) -> DataFrame:
    """(pattern, cut, need): in the order of h, whole prefixes below ``cut`` fit in the quota, and rows that share it have ``need`` words left.

    Two passes narrow the cut by DIGITS hex digits each, so a window sees sums by digit only.
    """
    out = quota.withColumn("cut", F.lit(""))
    for k in (1, 2):
        near = pool.join(F.broadcast(out), "pattern").where(F.substring("h", 1, (k - 1) * DIGITS) == F.col("cut"))
        sums = near.groupBy("pattern", "need", F.substring("h", 1, k * DIGITS).alias("d")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pattern").orderBy("d"))).where("upto > need")
        out = sums.groupBy("pattern").agg(F.min_by(F.struct("d", "n", "upto", "need"), "d").alias("x")).select("pattern", F.col("x.d").alias("cut"), F.expr("x.need - (x.upto - x.n)").alias("need"))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES, seed: int = 42, max_patterns: int = 100_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; rows with taken = 0 are left out of the mix.

    source_col is a string, or an array of strings where sources overlap; source_size and target are then sums over the
    pattern's sources. Null texts and empty ones have size 0 and are taken 0 times; a null source is a source of its
    own, last in order; null ids share one place in the seeded order; repeated rows count one by one; an empty
    table gives no rows. More than max_patterns patterns raise an error, as the flow is solved on the driver.
    """
    spark = docs.sparkSession
    array = docs.schema[source_col].dataType.typeName() == "array"
    pattern = F.array_sort(F.array_distinct(F.col(source_col))) if array else F.array(F.col(source_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.when(F.size(pattern) > 0, pattern).otherwise(F.array(F.lit(None).cast("string"))).alias("s")), {"ignoreNullFields": "false"}).alias("pattern"), n_words(F.col(text_col)).alias("size"), _order(id_col, seed).alias("h"))
    rows = settle(rows, "mix-sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(json.loads(r.pattern)["s"]): r.n for r in found}
    text = {tuple(json.loads(r.pattern)["s"]): r.pattern for r in found}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    total = sum(capacity.values())
    quota = quotas(sizes, weights, share * total / max(1, sum(sizes.values())), copies)
    given = route(capacity, quota, copies)
    kind = "pattern string, source_size long, target double, base int, need long"
    plan = [(text[p], sum(sizes[s] for s in p), float(sum(quota[s] for s in p)), *(divmod(given[p], capacity[p]) if capacity[p] else (0, 0))) for p in capacity]
    table = spark.createDataFrame([(a, b, c, int(d), int(e)) for a, b, c, d, e in plan], kind)
    cuts = _cut(rows, table.select("pattern", "need")).select("pattern", "cut", F.col("need").alias("left"))
    rows = rows.join(F.broadcast(settle(table.join(cuts, "pattern", "left"), "mix-cuts")), "pattern")
    head = F.substring("h", 1, 2 * DIGITS)
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(head == F.col("cut")).withColumn("more", F.when(2 * run - F.col("size") <= 2 * F.col("left"), 1).otherwise(0))
    clear = rows.where(F.col("cut").isNull() | (head != F.col("cut"))).withColumn("more", F.when((head < F.col("cut")) & (F.col("need") > 0), 1).otherwise(0))
    return clear.unionByName(edge).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("more"))).alias("taken"))
