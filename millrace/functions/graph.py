"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.scratch import settle

#: Up to this many edges between numbers (some 16 MB) the least neighbours are broadcast, so that edges are not shuffled for them.
MOST_BROADCAST = 500_000
#: Edges a written partition holds, where Spark made more partitions than that.
EDGES_PER_FILE = 100_000


def _star(pairs: DataFrame, larger_only: bool, few: bool) -> DataFrame:
    """pairs(u, v). Every kept neighbour v of u gets linked to the least node around u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(F.broadcast(least) if few else least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node that can be reached from each node that has an edge.

    Self-loops and repeated edges are harmless, null ends are ignored, no edges give no rows. Each round is
    aggregates and joins on the edge list, written to the shared folder; nothing but a checksum reaches the driver.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    stars = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda pairs: pairs.where("u <> v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = state(stars)
    few = mark.n <= MOST_BROADCAST and isinstance(stars.schema["u"].dataType, NumericType)
    for _ in range(max_rounds):
        links = stars.where("u <> v")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # at most one row an edge, so repeats may stay until the round ends
        # written, as the second half reads it three times
        large = settle(_star(both, larger_only=True, few=few).where("u <> v").coalesce(mark.n // EDGES_PER_FILE + 8), "large-stars")
        small = _star(large, larger_only=False, few=few).where("u <> v").distinct()
        stars = settle(small.coalesce(mark.n // EDGES_PER_FILE + 8), "stars")
        now = state(stars)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    loops = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return loops.join(F.broadcast(found) if few else found, "node", "left").withColumn("component", F.coalesce("component", "node"))
