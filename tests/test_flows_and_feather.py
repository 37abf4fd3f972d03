"""Levels of flows against brute force, and Arrow files whose tasks are retried."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.charts import sankey_flow
from millrace.sources import files


def brute_levels(edges, max_depth):
    """Longest ways by relaxing edges; None stands for nodes that cycles reach."""
    nodes = {x for e in edges for x in e}
    level = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes)):
        level = {n: max([0, *(level[a] + 1 for a, b in edges if b == n)]) for n in nodes}
    endless = {n for n in nodes if level[n] >= len(nodes)}
    while more := {b for a, b in edges if a in endless} - endless:
        endless |= more
    last = max([level[n] for n in nodes - endless], default=-1) + 1
    return {n: max(last + 1, max_depth) if n in endless else level[n] for n in nodes}


def levels(spark, edges, **kw):
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a string, b string, v double")
    out = {}
    for r in sankey_flow(df, "a", "b", "v", **kw).collect():
        out |= {r.source: r.source_level, r.target: r.target_level}
    return out


def test_long_chains_are_not_cut(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(24)]
    assert levels(spark, chain) == {f"n{k}": k for k in range(25)}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(str(a), str(b)) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(9 + 4 * seed)) if a != b}
    assert levels(spark, edges, max_depth=15) == brute_levels(edges, 15)


def test_cycles_and_empty_flows(spark):
    assert levels(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], max_depth=9) == {"a": 0, "b": 9, "c": 9, "d": 9}
    assert levels(spark, [("a", "a")]) == {}


def test_feather_files_of_failed_attempts_are_left_out(spark, tmp_path):
    path = str(tmp_path / "x.feather")
    df = spark.range(0, 1000, 1, 4).withColumn("s", F.concat(F.lit("v"), "id"))
    files.write(df, path)
    files.write(df.where("id < 10").repartition(3), path)
    assert files.read(spark, f"{path}/*.feather").count() == 10 and not [f for f in os.listdir(path) if f.startswith("_")]
    files.write(df.where("id >= 990"), path, mode="append")
    assert sorted(r.id for r in files.read(spark, f"{path}/*.feather").collect()) == [*range(10), *range(990, 1000)]
    with pytest.raises(FileExistsError):
        files.write(df, path, mode="error")

    def broken(batches):
        for n, batch in enumerate(batches):
            yield batch
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        files.write(df.mapInArrow(broken, df.schema), path)
    assert files.read(spark, f"{path}/*.feather").count() == 20
