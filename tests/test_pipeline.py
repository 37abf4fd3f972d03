"""Pipeline documents, templates, files and streaming forms."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.plans.pipeline import build, run_pipeline, trace_column, validate
from millrace.plans.registry import OPERATORS, register_op
from millrace.plans.templates import render
from millrace.sources import files

NOW = datetime(2024, 3, 5, 6, 7, tzinfo=UTC)


def test_templates():
    assert render("{{ today }}/{{ vars.x | upper }}-{{ now | strftime: %H }}", NOW, {"x": "a"}) == "2024-03-05/A-06"
    assert render("{{ vars.y | default: none | slug }}", NOW) == "none"
    with pytest.raises(ValueError):
        render("{{ nope }}", NOW)


def spec(tmp_path):
    return {
        "datasets": [{"id": "in", "uri": str(tmp_path / "in.csv")}],
        "nodes": [
            {"id": "d", "op": "derive_column", "inputs": {"df": "in"}, "params": {"name": "total", "expression": "price * n"}},
            {"id": "g", "op": "group_aggregate", "inputs": {"df": "d"}, "params": {"groupBy": ["who"], "aggregates": [{"fn": "sum", "column": "total", "as": "s"}]}},
        ],
        "outputs": [{"name": "out", "source": "g", "sink": {"uri": str(tmp_path / "out.parquet")}}],
    }


def test_csv_pipeline_and_lineage(spark, tmp_path):
    (tmp_path / "in.csv").write_text("who;price;n\na;2.5;2\nb;1;3\na;1;1\n")
    out = run_pipeline(spark, spec(tmp_path), run_log=str(tmp_path / "log"), now=NOW)["out"]
    assert {r.who: r.s for r in out.collect()} == {"a": 6.0, "b": 3.0}
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2 and spark.read.parquet(str(tmp_path / "log")).first().rows == 2
    assert trace_column(spec(tmp_path), "g", "s") == {("in", "price"), ("in", "n")}


def test_validation_finds_problems(tmp_path):
    s = spec(tmp_path)
    s["nodes"][0]["inputs"] = {"df": "g"}
    s["nodes"][1]["op"] = "nothing"
    s["nodes"].append({"id": "x", "op": "filter_rows", "inputs": {"df": "in"}, "params": {"wrong": 1}})
    found = " ".join(validate(s))
    assert "cycle" in found and "unknown operator nothing" in found and "predicate is required" in found and "unknown parameter wrong" in found


def test_subpipelines_and_own_operators(spark):
    register_op("double_it", lambda df, column: df.withColumn(column, F.col(column) * 2))
    try:
        inner = {"datasets": [{"id": "src", "uri": "x"}], "nodes": [{"id": "n", "op": "double_it", "inputs": {"df": "src"}, "params": {"column": "id"}}], "outputs": [{"name": "o", "source": "n"}]}
        outer = {"datasets": [{"id": "a", "uri": "x"}], "nodes": [{"id": "s", "op": "subpipeline", "inputs": {"src": "a"}, "params": {"pipeline_id": "inner"}}], "outputs": [{"name": "o", "source": "s"}]}
        got = build(spark, outer, {"inner": inner}, inputs={"a": spark.range(3)})["o"]
        assert sorted(r.id for r in got.collect()) == [0, 2, 4]
        loop = {**outer, "nodes": [{"id": "s", "op": "subpipeline", "inputs": {"a": "a"}, "params": {"pipeline_id": "loop"}}]}
        with pytest.raises(ValueError, match="contains itself"):
            build(spark, loop, {"loop": loop}, inputs={"a": spark.range(3)})
    finally:
        OPERATORS.pop("double_it")


@pytest.mark.parametrize("ext", ["parquet", "json", "tsv", "orc", "feather"])
def test_round_trips(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "a"), (2, "bé")], "id long, s string")
    path = str(tmp_path / f"x.{ext}")
    files.write(df.coalesce(1), path)
    back = files.read(spark, path + ("/*.feather" if ext == "feather" else ""))
    assert sorted((int(r.id), r.s) for r in back.collect()) == [(1, "a"), (2, "bé")]


def test_headers_and_numpy(spark, tmp_path):
    import numpy as np

    assert files.has_header(["name,age", "ann,3", "bob,4"], ",") and not files.has_header(["1,2", "3,4"], ",")
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    assert [list(r["values"]) for r in files.read(spark, str(tmp_path / "a.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_streaming_forms(spark, tmp_path):
    from millrace.streaming import forms

    src = str(tmp_path / "events")
    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a", float(m)) for m in range(0, 60, 5)], "ts timestamp, k string, v double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)

    def run(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    out = run(forms.windowed(stream, "ts", "30 minutes", [{"fn": "count", "as": "n"}], lateness="0 seconds"), "w1", "complete")
    assert sorted(r.n for r in out) == [6, 6]
    drift = run(forms.page_hinkley(stream, "k", "ts", "v", 20.0), "w2")
    assert len(drift) == 12 and drift[-1].drift
    assert len(run(forms.deduplicate(stream, ["k"], "ts"), "w3")) == 1
    assert run(forms.sprt(stream.withColumn("won", F.lit(True)), "k", "ts", "won", 0.1, 0.5), "w4", "update")[-1].decision == "accept_h1"


def test_registered_queries_have_matching_sql():
    from millrace.plans import queries

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 150
