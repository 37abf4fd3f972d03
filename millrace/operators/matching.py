"""Pairs of treated and control rows by score, the closest first, over blocks of a global order.

The closest pair of unlike rows always stands side by side in the order of scores, so matching is a walk over that
order. A block of consecutive rows walks alone: a pair is settled there if no row that is unseen or undecided could be
nearer to either member. What stays open at the edges of blocks is numbered anew and meets in blocks cut half a block
further on, until no pair is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import numbered
from millrace.scratch import settle

#: Rows of a block: what one task holds.
BLOCK = 100_000


def walk(p: np.ndarray, y: np.ndarray, caliper: float, left: list[float], right: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(mate, dead) of the rows of a block, sorted by score: the place of the partner or -1, and whether none can come any more.

    left[t] is the greatest score of an unseen row of kind t before the block, right[t] the least after it.
    """
    n = len(p)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    mate = np.full(n, -1)
    low, high = list(left), list(right)
    heap = [(p[i + 1] - p[i], i, i + 1) for i in np.flatnonzero((y[:-1] != y[1:]) & (np.diff(p) <= caliper)).tolist()] if n > 1 else []
    heapq.heapify(heap)
    while heap:
        gap, i, j = heapq.heappop(heap)
        if mate[i] >= 0 or mate[j] >= 0:
            continue
        # of equal gaps the one further left goes first
        from_left, from_right = p[i] - low[1 - y[i]] <= gap, high[1 - y[j]] - p[j] < gap
        for k in (i, j):
            if from_left:
                low[y[k]] = max(low[y[k]], p[k])
            if from_right:
                high[y[k]] = min(high[y[k]], p[k])
        if from_left or from_right:
            continue
        mate[i], mate[j] = j, i
        a, b = before[i], after[j]
        if a >= 0:
            after[a] = b
        if b >= 0:
            before[b] = a
        if a >= 0 and b >= 0 and y[a] != y[b] and p[b] - p[a] <= caliper:
            heapq.heappush(heap, (p[b] - p[a], a, b))
    open_ = mate < 0
    near = np.zeros(n, bool)
    for t in (0, 1):
        other = open_ & (y != t)
        last = np.maximum.accumulate(np.concatenate([[left[1 - t]], np.where(other, p, -np.inf)]))[1:]
        first = np.minimum.accumulate(np.concatenate([np.where(other, p, np.inf), [right[1 - t]]])[::-1])[::-1][:-1]
        near |= (y == t) & ((p - last <= caliper) | (first - p <= caliper))
    return mate, open_ & ~near


def _round(left: DataFrame, caliper: float, shift: int, block: int) -> tuple[DataFrame, int]:
    """(n, y, p, mate) of the rows after one walk of all blocks, without the dead ones, and the number of blocks."""
    rows = numbered(left, ["n"], "m").select("n", "y", "p", F.floor((F.col("m") - 1 + shift) / block).alias("block"))
    ends = [f(F.when(F.col("y") == t, F.col("p"))).alias(f"{f.__name__}{t}") for f in (F.max, F.min) for t in (0, 1)]
    # one row a block
    w = Window.orderBy("block")
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    around = settle(rows.groupBy("block").agg(*ends).select("block", *(F.coalesce(F.max(f"max{t}").over(earlier), F.lit(float("-inf"))).alias(f"left{t}") for t in (0, 1)), *(F.coalesce(F.min(f"min{t}").over(later), F.lit(float("inf"))).alias(f"right{t}") for t in (0, 1))), "match-edges")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        edge = pdf.iloc[0]
        mate, dead = walk(pdf["p"].to_numpy(), pdf["y"].to_numpy(), caliper, [edge.left0, edge.left1], [edge.right0, edge.right1])
        numbers = pdf["n"].to_numpy()
        return pd.DataFrame({"n": numbers, "y": pdf["y"], "p": pdf["p"], "mate": np.where(mate >= 0, numbers[mate], -1)})[~dead]

    done = rows.join(around, "block").groupBy("block").applyInPandas(step, "n long, y int, p double, mate long")
    return settle(done, "match-round"), around.count()


def closest_pairs(scored: DataFrame, caliper: float, block: int = BLOCK) -> DataFrame:
    """(treated, control, treated_score, control_score) from scored(k, y, p): closest pairs within the caliper, each row at most once.

    Rows of equal score are paired first, in the order of their keys. Then, again and again, the two unlike rows with
    the least gap that stand side by side in the order of score and key become a pair and leave, of equal gaps the one of
    less score, until no two unlike rows within the caliper are left. Rows without a score or with a kind other than 0
    and 1 take no part; repeated keys are rows of their own.
    """
    rows = scored.where("p is not null and not isnan(p) and y in (0, 1)").select("k", F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p"))
    rows = settle(numbered(rows, ["p", "y", "k"], "n"), "match-rows")
    firsts = rows.groupBy("p", "y").agg(F.min("n").alias("first"))
    ranked = rows.join(firsts, ["p", "y"]).select("n", "y", "p", (F.col("n") - F.col("first")).alias("rank"))
    one, two = (ranked.where(F.col("y") == t).select(F.col("n").alias(name), "p", "rank") for t, name in ((1, "t"), (0, "u")))
    same = settle(one.join(two, ["p", "rank"]).select("t", "u"), "match-equal")
    left = rows.select("n", "y", "p").join(same.select(F.explode(F.array("t", "u")).alias("n")), "n", "left_anti")
    found, idle, shift = [same], 0, 0
    while idle < 2:
        after, blocks = _round(left, caliper, shift, block)
        pairs = after.where("mate >= 0 and y = 1").select(F.col("n").alias("t"), F.col("mate").alias("u"))
        idle = 0 if pairs.limit(1).count() else idle + 1
        found.append(pairs)
        left = after.where("mate < 0").select("n", "y", "p")
        # with one block nothing was unseen
        if blocks <= 1 or not left.limit(1).count():
            break
        shift = block // 2 - shift
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    one, two = (rows.select(F.col("n").alias(n), F.col("k").alias(k), F.col("p").alias(s)) for n, k, s in (("t", "treated", "treated_score"), ("u", "control", "control_score")))
    return pairs.join(one, "t").join(two, "u").select("treated", "control", "treated_score", "control_score")
