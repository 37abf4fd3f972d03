"""Single linkage: a minimum spanning tree by rounds of nearest other components, cut at its longest edges.

Each round every component but the largest finds its shortest edge to another one, all those edges join the tree, and what
they link becomes one component. Most edges are read off a table of nearest neighbours. Points that know no neighbour
outside their component are compared with all other rows by blocks, within the component's shortest edge so far. Since
the largest component never asks, those are few where one component holds most points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.graph import connected_components
from millrace.operators.blocks import best_pairs
from millrace.operators.neighbours import unit
from millrace.operators.rows import numbered
from millrace.scratch import settle

#: Neighbours that each point knows from the start.
KNOWN = 8


def _across(edges: DataFrame, component: DataFrame) -> DataFrame:
    """The edges (a, b, d) between two components, with them (ca, cb)."""
    own, other = component.select(F.col("id").alias("a"), F.col("c").alias("ca")), component.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    return edges.select("a", "b", "d").join(own, "a").join(other, "b").where("ca <> cb").select("a", "b", "d", "ca", "cb")


def _shortest(across: DataFrame) -> DataFrame:
    """(c, e): the least edge of each component that leaves it; equal lengths are told apart by the two components, so that no ring is closed."""
    e = F.struct("d", F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return across.withColumn("e", e).select(F.explode(F.array("ca", "cb")).alias("c"), "e").groupBy("c").agg(F.min("e").alias("e"))


def _merged(best: DataFrame, largest: int) -> DataFrame:
    """(c, to): the component that each component becomes part of, from best(c, e), by following the chosen edges.

    Each component points at the other end of its edge; the end of every way is the largest component, which chose none, or
    two that chose the same edge, of which the less gives the name.
    """
    end = F.col("c").eqNullSafe(F.col("e.low")) & F.col("e").eqNullSafe(F.col("f"))
    other = best.select(F.col("c").alias("to"), F.col("e").alias("f"))
    ways = best.withColumn("to", F.when(F.col("c") == F.col("e.low"), F.col("e.high")).otherwise(F.col("e.low"))).join(other, "to", "left")
    ways = ways.select("c", F.when(end, F.col("c")).otherwise(F.col("to")).alias("to"))
    ways = settle(ways.unionByName(best.sparkSession.range(1).select(F.lit(largest).cast("long").alias("c"), F.lit(largest).cast("long").alias("to"))), "linkage-ways")
    step = lambda w: w.join(w.select(F.col("c").alias("to"), F.col("to").alias("next")), "to").select("c", F.col("next").alias("to"))
    while True:
        further = step(step(ways)).withColumnRenamed("to", "next")
        further = settle(ways.join(further, "c").select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "linkage-ways")
        ways = further.select("c", "to")
        if not further.where("moved").limit(1).count():
            return ways


def spanning_tree(points: DataFrame) -> DataFrame:
    """(a, b, d): a minimum spanning tree of points(id long, v) by Euclidean distance; ids are unique, and so are vectors."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "neighbour"))
    near = best_pairs(points, points, KNOWN, "euclidean").withColumn("rank", rank).where(F.col("rank") <= KNOWN)
    near = settle(near.select(F.col("source").alias("a"), F.col("neighbour").alias("b"), (-F.col("score")).alias("d")), "linkage-near")
    # beyond this distance a point knows nothing; those that know all points are left out
    reach = settle(near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("reach")).where(F.col("n") >= KNOWN).select("id", "reach"), "linkage-reach")
    component = settle(points.select("id", F.col("id").alias("c")), "linkage-components")
    tree = None
    while len(most := component.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(2).collect()) > 1:
        largest = most[0].c
        near = settle(_across(near, component), "linkage-near")
        best = settle(_shortest(near).where(F.col("c") != largest), "linkage-best")
        # points whose known neighbours are all inside, where an unknown one may be nearer than the component's edge
        blind = reach.join(near.select(F.col("a").alias("id")), "id", "left_anti").join(component.where(F.col("c") != largest), "id").join(best, "c", "left")
        asked = settle(blind.where("e is null or reach < e.d").select("id", F.col("c").alias("kind"), F.coalesce("e.d", F.lit(float("inf"))).alias("limit")), "linkage-asked")
        if asked.limit(1).count():
            found = best_pairs(asked.join(points, "id"), points.join(component.withColumnRenamed("c", "kind"), "id"), 1, "euclidean")
            found = settle(found.select(F.col("source").alias("a"), F.col("neighbour").alias("b"), (-F.col("score")).alias("d")), "linkage-found")
            more = _shortest(_across(found, component)).where(F.col("c") != largest)
            best = settle(best.unionByName(more).groupBy("c").agg(F.min("e").alias("e")), "linkage-best")
        picked = settle(best.select("e.*").distinct(), "linkage-picked")
        tree = picked.select("a", "b", "d") if tree is None else tree.unionByName(picked.select("a", "b", "d"))
        component = settle(component.join(_merged(best, largest), "c").select("id", F.col("to").alias("c")), "linkage-components")
    if tree is None:
        return points.sparkSession.createDataFrame([], "a long, b long, d double")
    return tree


def single_linkage(df: DataFrame, key: str, embedding_column: str, n_clusters: int, output_column: str = "cluster") -> DataFrame:
    """df with its cluster by single linkage over cosine distances: the tree without its n_clusters - 1 longest edges.

    Clusters are numbered from 0 by their least key. Rows whose vector is NULL, has a NULL or NaN in it or is of length zero get NULL.
    Vectors of one direction stay together, so that few directions may give fewer clusters; of equal edges the one
    between later keys is cut first. Repeated keys are rows of their own. Fewer rows than clusters are an error.
    """
    v = F.col(embedding_column).cast("array<double>")
    whole = F.col(embedding_column).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = numbered(df.withColumn("__v", F.when(whole, unit(v))), [key], "__n")
    known = rows.where("__v is not null")
    n = known.count()
    if n < n_clusters:
        raise ValueError(f"{n_clusters} clusters of {n} rows")
    # copies count once: the least key stands for them
    points = settle(known.groupBy(F.col("__v").alias("v")).agg(F.min("__n").alias("id")).select("id", "v"), "linkage-points")
    tree = settle(spanning_tree(points), "linkage-tree")
    longest = tree.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(n_clusters - 1)
    left = tree.join(longest, ["a", "b"], "left_anti")
    linked = connected_components(left, "a", "b")
    held = settle(points.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("c")), "linkage-clusters")
    # one row a cluster
    names = held.select("c").distinct().withColumn("__cluster", F.row_number().over(Window.orderBy("c")) - 1)
    found = points.join(held.join(F.broadcast(names), "c"), "id").select(F.col("v").alias("__v"), "__cluster")
    return rows.join(found, "__v", "left").withColumn(output_column, F.col("__cluster")).drop("__v", "__n", "__cluster")
