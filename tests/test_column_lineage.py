"""Origins of columns through joins, renames, expressions, aggregates and subpipelines."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.lineage import origin
from millrace.plans.pipeline import column_lineage, trace_column
from millrace.plans.registry import OPERATORS, register_op


@pytest.fixture
def tables(spark):
    return {
        "orders": spark.createDataFrame([(1, 7, 2.0, 3.0)], "id long, cust long, price double, n double"),
        "people": spark.createDataFrame([(7, "Ann", 1.0)], "id long, name string, price double"),
        "rates": spark.createDataFrame([("Ann", 0.5)], "who string, rate double"),
    }


def node(name, op, params, **inputs):
    return {"id": name, "op": op, "inputs": inputs or {}, "params": params}


def document(*nodes):
    return {"datasets": [{"id": d, "uri": "unused"} for d in ("orders", "people", "rates")], "nodes": list(nodes), "outputs": [{"name": "o", "source": nodes[-1]["id"]}]}


JOINED = document(
    node("r", "rename_columns", {"mapping": [{"from": "n", "to": "amount"}, {"from": "price", "to": "n"}]}, df="orders"),
    node("d", "derive_column", {"name": "total", "expression": "amount * n + length('cust')"}, df="r"),
    node("j", "join", {"keys": [{"left": "cust", "right": "id"}], "kind": "left"}, left="d", right="people"),
    node("l", "lookup_join", {"column": "name", "keys": ["who"], "outputs": ["rate"], "prefix": "x_"}, df="j", reference="rates"),
    node("e", "derive_column", {"name": "total", "expression": "total * x_rate"}, df="l"),
    node("w", "window_aggregate", {"fn": "sum", "column": "total", "partitionBy": ["name"], "orderBy": ["id"], "as_": "upto"}, df="e"),
    node("g", "group_aggregate", {"groupBy": ["name"], "aggregates": [{"fn": "sum", "column": "upto", "as": "s"}, {"fn": "count", "as": "rows"}, {"fn": "max", "column": "price"}]}, df="w"),
)


def test_joins_renames_and_expressions(spark, tables):
    trace = lambda at, c: trace_column(JOINED, at, c, spark, inputs=tables)
    assert trace("r", "n") == {("orders", "price")} and trace("r", "amount") == {("orders", "n")}
    # 'cust' occurs in the text only
    assert trace("d", "total") == {("orders", "price"), ("orders", "n")}
    assert trace("g", "s") == {("orders", "price"), ("orders", "n"), ("rates", "rate")}
    assert trace("g", "name") == {("people", "name")} and trace("g", "max_price") == {("people", "price")}
    assert trace("g", "rows") == set() and trace("orders", "cust") == {("orders", "cust")}
    with pytest.raises(ValueError, match="no column nothing"):
        trace("g", "nothing")


def test_names_are_swapped(spark, tables):
    from millrace.operators.columns import rename_columns

    out = rename_columns(tables["orders"], {"n": "price", "price": "n"})
    assert out.columns == ["id", "cust", "n", "price"] and out.first().n == 2.0 and out.first().price == 3.0
    with pytest.raises(ValueError, match="one name"):
        rename_columns(tables["orders"], {"n": "price"})


def test_steps_are_listed(spark, tables):
    steps = {(s["node"], s["column"]): s for s in column_lineage(JOINED, "e", "total", spark, inputs=tables)}
    assert steps["e", "total"]["expression"] == "total * x_rate" and steps["e", "total"]["sources"] == [("l", "total"), ("l", "x_rate")]
    assert steps["l", "x_rate"]["transform"] == "lookup" and steps["j", "total"]["transform"] == "join" and steps["r", "n"]["transform"] == "rename"
    assert all(s["declared"] for s in steps.values())


@pytest.mark.parametrize(
    ("params", "column", "expected"),
    [
        ({}, "id_x", {("orders", "id")}),
        ({"suffixes": ["_l", "_r"]}, "price_r", {("people", "price")}),
        ({"columnCollisions": "coalesce"}, "price", {("orders", "price"), ("people", "price")}),
        ({"columnCollisions": "keep_right"}, "price", {("people", "price")}),
        ({"columnCollisions": "keep_left"}, "price", {("orders", "price")}),
        ({"kind": "semi"}, "price", {("orders", "price")}),
        ({"kind": "anti_right"}, "price", {("people", "price")}),
        ({"kind": "cross"}, "price_y", {("people", "price")}),
    ],
)
def test_collisions_of_joins(spark, tables, params, column, expected):
    key = {"left": "cust", "right": "id"} if column != "id_x" else {"left": "cust", "right": "price"}
    spec = document(node("j", "join", {"keys": [key], **params}, left="orders", right="people"))
    assert trace_column(spec, "j", column, spark, inputs=tables) == expected


def test_coalesced_keys(spark, tables):
    spec = document(node("j", "join", {"keys": [{"left": "cust", "right": "id"}], "kind": "full", "coalesce_keys": True}, left="orders", right="people"))
    assert trace_column(spec, "j", "cust", spark, inputs=tables) == {("orders", "cust"), ("people", "id")}


def test_shapes_and_sets(spark, tables):
    spec = document(
        node("u", "union", {}, top="orders", bottom="people"),
        node("p", "pivot_longer", {"value_cols": ["price", "n"], "id": ["id"]}, df="u"),
        node("w", "pivot_wider", {"names_from": "name", "values_from": "value", "id": ["id"], "values": ["price"]}, df="p"),
        node("s", "scale_standard", {"columns": ["price", "n"]}, df="u"),
        node("k", "window_aggregate", {"fn": "rank", "orderBy": ["cust"], "as_": "place"}, df="u"),
    )
    trace = lambda at, c: trace_column(spec, at, c, spark, inputs=tables)
    prices = {("orders", "price"), ("people", "price")}
    assert trace("u", "price") == prices and trace("p", "value") == prices | {("orders", "n")} and trace("p", "name") == set()
    assert trace("w", "price") == prices | {("orders", "n")} and trace("w", "id") == {("orders", "id"), ("people", "id")}
    assert trace("s", "n_scaled") == {("orders", "n")} and trace("s", "price") == prices and trace("k", "place") == {("orders", "cust")}


def test_subpipelines_and_own_operators(spark, tables):
    register_op("twice", lambda df, column: df.withColumn("two", F.col(column) * 2))
    register_op("thrice", lambda df, column: df.withColumn("three", F.col(column) * 3), lineage=lambda inputs, p, outputs: {"three": origin("df", p["column"], "times")})
    try:
        inner = {"datasets": [{"id": "src", "uri": "unused"}], "nodes": [node("a", "twice", {"column": "price"}, df="src"), node("b", "thrice", {"column": "two"}, df="a")], "outputs": [{"name": "out", "source": "b"}]}
        spec = document(
            node("r", "rename_columns", {"mapping": {"n": "price", "price": "n"}}, df="orders"),
            node("s", "subpipeline", {"pipeline_id": "inner"}, src="r"),
            node("d", "derive_column", {"name": "x", "expression": "three + 1"}, df="s"),
        )
        steps = column_lineage(spec, "d", "x", spark, pipelines={"inner": inner}, inputs=tables)
        assert {(s["node"], s["column"]) for s in steps} == {("d", "x"), ("s", "three"), ("s/b", "three"), ("s/a", "two"), ("r", "price"), ("orders", "n")}
        assert [s["node"] for s in steps if not s["declared"]] == ["s/a"]
    finally:
        OPERATORS.pop("twice"), OPERATORS.pop("thrice")
