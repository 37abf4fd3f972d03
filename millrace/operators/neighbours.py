"""Nearest neighbours by lists: rows are listed under the nearest of some centroids, and triangle bounds say which lists a query needs.

Centroids are fitted on a bounded sample and every row is listed. A query first visits its nearest lists until they hold
enough rows; the k-th distance found there bounds the rest: a list is needed only if the query's distance to its
centroid, less the list's radius, is within it. Visits are grouped by list, slab of the list and block of queries, all of bounded
size, so that a list (or one point) with a third of all rows is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import settle

#: Rows that centroids are fitted on, at most; rows of a list on average, down to which the number of lists grows; lists at most.
SAMPLE, ROWS_PER_LIST, MOST_LISTS = 20_000, 1_000, 4_096
#: Rows of a slab and queries of a block, about.
SLAB, BLOCK = 4_096, 8_192


def unit(v: Column) -> Column:
    """The vector at length one, for cosine distances; NULL for length zero."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y; column by column where there are few, which rounds least."""
    if x.shape[1] <= 16:
        out = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            out += np.subtract.outer(x[:, j], y[:, j]) ** 2
        return out
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T))


def fit_centroids(base: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """Centroids of a sample of at most SAMPLE rows (the least by a seeded hash) by ten rounds of k-means."""
    rows = base.select("v").orderBy(F.xxhash64(F.lit(seed), "id", "v")).limit(SAMPLE).collect()
    x = np.array([r.v for r in rows], float)
    lists = int(min(MOST_LISTS, max(1, n // ROWS_PER_LIST), len(x)))
    c = np.unique(x[:: max(1, len(x) // lists)][:lists], axis=0)
    for _ in range(10):
        near = np.concatenate([_squares(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n_near = np.bincount(near, minlength=len(c))
        c = np.where(n_near[:, None] > 0, total / np.maximum(n_near, 1)[:, None], c)
    return c


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def listed(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """base(id, v) as a written table (row, id, v, list, gap): the nearest centroid and the distance to it."""
    kind = dict(base.dtypes)["id"]

    def assign(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                v = _matrix(part["v"])
                near = _squares(v, centroids).argmin(1)
                yield part.assign(list=near, gap=np.sqrt(((v - centroids[near]) ** 2).sum(1)))

    rows = base.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    return settle(rows.mapInPandas(assign, f"row long, id {kind}, v array<double>, list int, gap double"), "neighbour-lists")


def _visit(queries: DataFrame, centroids: np.ndarray, size: np.ndarray, radius: np.ndarray, enough: int, probes: int | None, bound: bool) -> DataFrame:
    """(row, id, v, list, away, limit) of the lists each query visits.

    First round: the nearest lists until they hold ``enough`` rows, or the nearest ``probes``. Second round (bound): the
    other lists that may hold a row within the query's limit.
    """
    kind = dict(queries.dtypes)["id"]

    def visits(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                v = _matrix(part["v"])
                away = np.sqrt(((v[:, None] - centroids[None]) ** 2).sum(2)) if v.shape[1] * len(centroids) < 20_000 else np.sqrt(_squares(v, centroids))
                order = np.argsort(away, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                first = np.zeros_like(away, bool)
                taken = np.arange(len(centroids))[None] < probes if probes else np.concatenate([np.ones((len(v), 1), bool), held[:, :-1] < enough], axis=1)
                np.put_along_axis(first, order, np.broadcast_to(taken, away.shape), axis=1)
                limit = part["limit"].to_numpy(float) if bound else np.full(len(v), np.inf)
                slack = 1e-6 * (1 + away + np.where(np.isfinite(limit), limit, 0)[:, None])
                go = ~first & (away - radius[None] <= limit[:, None] + slack) if bound else first
                q, c = np.nonzero(go & (size[None] > 0))
                yield pd.DataFrame({"row": part["row"].to_numpy()[q], "id": part["id"].to_numpy()[q], "v": part["v"].to_numpy()[q], "list": c.astype("int32"), "away": away[q, c], "limit": limit[q]})

    return settle(queries.mapInPandas(visits, f"row long, id {kind}, v array<double>, list int, away double, limit double"), "neighbour-visits")


def _search(visits: DataFrame, lists: DataFrame, sizes: DataFrame, k: int, include_self: bool) -> DataFrame:
    """(row, source, neighbour, distance): the k best of each query in each slab that it visits.

    Where both sides have a column ``kind``, rows of the query's own kind are left out in place of those of its id.
    """
    kind = ["kind"] if "kind" in visits.columns else []
    source, neighbour = dict(visits.dtypes)["id"], dict(lists.dtypes)["id"]
    blocks = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    plan = settle(sizes.select("list", F.ceil(F.col("n") / SLAB).alias("slabs")).join(blocks, "list").coalesce(1), "neighbour-plan")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    # at most MOST_LISTS rows
    b = lists.join(F.broadcast(plan), "list").select("list", (F.col("row") % F.col("slabs")).alias("slab"), every(F.col("blocks")).alias("block"), "id", "v", "gap", *kind)
    q = visits.join(F.broadcast(plan), "list").select("list", every(F.col("slabs")).alias("slab"), F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"), "row", "id", "v", "away", "limit", *kind)

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", kind="stable")
            y, ids, gap = _matrix(held["v"]), held["id"].to_numpy(), held["gap"].to_numpy()
            for at in range(0, len(asked), 512):
                part = asked.iloc[at : at + 512]
                x = _matrix(part["v"])
                d = _squares(x, y)
                limit = part["limit"].to_numpy()[:, None]
                # rows of the list whose distance to the centroid differs too much from the query's
                d[np.abs(gap[None] - part["away"].to_numpy()[:, None]) > limit + 1e-6 * (1 + np.where(np.isfinite(limit), limit, 0) + gap[None])] = np.inf
                if not include_self:
                    own = kind[0] if kind else "id"
                    d[part[own].to_numpy()[:, None] == held[own].to_numpy()[None]] = np.inf
                m = min(len(y), k + 16)
                pick = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(y) else np.broadcast_to(np.arange(len(y)), d.shape)
                edge = np.take_along_axis(d, pick, 1).max(1)
                for i in range(len(x)):
                    near = np.sort(pick[i])
                    near = near[np.isfinite(d[i, near])]
                    exact = np.sqrt(((y[near] - x[i]) ** 2).sum(1))
                    if m < len(y) and len(near) and (k > len(near) or np.partition(exact, k - 1)[k - 1] ** 2 * (1 + 1e-6) + 1e-9 >= edge[i]):
                        # ties or rounding at the edge of what was picked: all rows, exactly
                        near = np.nonzero(np.isfinite(d[i]))[0]
                        exact = np.sqrt(((y[near] - x[i]) ** 2).sum(1))
                    top = np.argsort(exact, kind="stable")[:k]  # ids are sorted, so ties go to the least
                    out.append(pd.DataFrame({"row": part["row"].iat[i], "source": part["id"].iat[i], "neighbour": ids[near[top]], "distance": exact[top]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "source": [], "neighbour": [], "distance": []})

    keys = ["list", "slab", "block"]
    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(best, f"row long, source {source}, neighbour {neighbour}, distance double")


def knn_join(queries: DataFrame, base: DataFrame, k: int, include_self: bool = False, probes: int | None = None, seed: int = 42) -> DataFrame:
    """(row, source, neighbour, distance, rank): the k nearest rows of base(id, v) for each row of queries(id, v), by Euclidean distance.

    Exact without ``probes``; with it, only so many nearest lists are visited. Ties go to the least id; without
    include_self, rows with the query's own id are left out; rows with a NULL id, a NULL vector or a NULL in it neither ask
    nor answer. ``row`` numbers the queries, so repeated ids ask for themselves. No base or no query gives no rows.
    """
    whole = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("id", F.col("v").cast("array<double>").alias("v"))
    base, asked = whole(base), settle(whole(queries).select(F.monotonically_increasing_id().alias("row"), "id", "v"), "neighbour-queries")
    n = base.count()
    ids = dict(asked.dtypes)["id"], dict(base.dtypes)["id"]
    if not n:
        return asked.sparkSession.createDataFrame([], f"row long, source {ids[0]}, neighbour {ids[1]}, distance double, rank int")
    centroids = fit_centroids(base, n, seed)
    lists = listed(base, centroids)
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    size, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in sizes.collect():  # at most MOST_LISTS rows
        size[r.list], radius[r.list] = r.n, r.radius
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "neighbour"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    near = _search(_visit(asked, centroids, size, radius, k + 1, probes, False), lists, sizes, k, include_self)
    if probes:
        return best(near)
    near = settle(best(near).drop("rank"), "neighbours-first")
    limits = near.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("limit"))
    bounded = asked.join(limits, "row", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    more = _search(_visit(bounded, centroids, size, radius, k + 1, None, True), lists, sizes, k, include_self)
    return best(near.unionByName(more))
