"""Registered queries of the general operators over the given tables, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import charts, columns, geo, grouping, joins, models, nested, ordered, quality, rows, scalars, scaling, statistics, tables, text
from millrace.plans.pipeline import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def q(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def r(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and (not cols or c in cols)})


FLAGSHIP = {
    "datasets": [{"id": "lineitem", "uri": "{{ vars.dir }}/lineitem.parquet"}],
    "nodes": [
        {"id": "f", "op": "filter_rows", "inputs": {"df": "lineitem"}, "params": {"predicate": "l_discount > 0.05"}},
        {"id": "d", "op": "derive_column", "inputs": {"df": "f"}, "params": {"name": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}},
        {"id": "g", "op": "group_aggregate", "inputs": {"df": "d"}, "params": {"groupBy": ["l_returnflag", "l_linestatus"], "aggregates": [{"fn": "sum", "column": "revenue", "as": "sum_revenue"}, {"fn": "mean", "column": "l_quantity", "as": "mean_quantity"}, {"fn": "count", "as": "n"}]}},
        {"id": "s", "op": "sort_rows", "inputs": {"df": "g"}, "params": {"by": ["l_returnflag", "l_linestatus"]}},
    ],
    "outputs": [{"name": "result", "source": "s"}],
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, derive, group and sort as one pipeline document."""
    return r(build(spark, FLAGSHIP, variables={"dir": sf_dir})["result"], 2)


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue, round(avg(l_quantity), 2) AS mean_quantity, count(*) AS n
    FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL"""

# columns
q("select_columns", lambda t: columns.select_columns(t.customer, ["c_name", "c_custkey"]), "SELECT c_name, c_custkey FROM customer")
q("reorder_columns", lambda t: columns.reorder_columns(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderpriority"]), "SELECT o_orderpriority, o_orderkey, o_orderstatus FROM orders")
q("rename_columns", lambda t: columns.rename_columns(t.orders.select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "status", "o_orderkey": "id"}), "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
q("add_column", lambda t: columns.add_column(t.part.select("p_partkey", "p_name"), "score", "integer", "7", "before", "p_name"), "SELECT p_partkey, 7::BIGINT AS score, p_name FROM part")
q("add_runtime_column", lambda t: columns.add_runtime_column(t.customer.select("c_custkey"), "run", "batch-{{ vars.n | upper }}", variables={"n": "ab"}), "SELECT c_custkey, 'batch-AB' AS run FROM customer")
q("derive_column", lambda t: columns.derive_column(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), "unit", "l_extendedprice / l_quantity"), "SELECT l_orderkey, l_quantity, l_extendedprice, l_extendedprice / l_quantity AS unit FROM lineitem")
q("math_equation", lambda t: r(columns.math_equation(t.part.select("p_partkey", "p_size", "p_retailprice"), "m", "log(p_retailprice) + p_size ^ 2")), "SELECT p_partkey, p_size, p_retailprice, round(log10(p_retailprice) + p_size ** 2, 6) AS m FROM part")
q("cast_type", lambda t: columns.cast_type(t.part.select("p_partkey", F.split("p_brand", "#")[1].alias("b"), F.col("p_name").alias("n")), "b", "integer"), "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) AS b, p_name AS n FROM part")
q("cast_report", lambda t: columns.cast_report(t.part.withColumn("x", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).when(F.col("p_size") > 5, F.col("p_name"))), "x", "integer"), "SELECT count(*) AS total, count(*) - count(x) AS source_null, count(x) AS source_non_null, count(*) FILTER (x IS NOT NULL AND TRY_CAST(x AS BIGINT) IS NULL) AS cast_failures FROM (SELECT CASE WHEN p_size > 25 THEN p_size::VARCHAR WHEN p_size > 5 THEN p_name END AS x FROM part)")
q("coalesce_columns", lambda t: columns.coalesce_columns(t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("a"), F.col("o_orderpriority").alias("b")), ["a", "b"], "c", drop=True), "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) AS c FROM orders")
q("pack_unpack_struct", lambda t: columns.unpack_struct(columns.pack_struct(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "s", ["o_orderstatus", "o_orderpriority"]), "s", ["o_orderstatus"], "s_"), "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderstatus AS s_o_orderstatus FROM orders")
q("passthrough", lambda t: columns.passthrough(t.customer.select("c_custkey", "c_name")), "SELECT c_custkey, c_name FROM customer")
q("upper_string", lambda t: columns.upper_string(t.part.select("p_partkey", "p_name"), "p_name"), "SELECT p_partkey, upper(p_name) AS p_name FROM part")
q("round_to_n", lambda t: columns.round_to_n(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 0), "SELECT s_suppkey, round(s_acctbal, 0) AS s_acctbal FROM supplier")
q("zscore", lambda t: r(columns.zscore(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")), "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z_score FROM customer")
q("coerce_nan", lambda t: columns.coerce_nan(t.part.select("p_partkey", F.when(F.col("p_size") < 10, F.lit(float("nan"))).when(F.col("p_size") < 20, F.lit(float("inf"))).otherwise(F.col("p_retailprice")).alias("x"))), "SELECT p_partkey, CASE WHEN p_size >= 20 THEN p_retailprice END AS x FROM part")
q("nan_report", lambda t: columns.nan_report(t.part.select(F.when(F.col("p_size") < 10, F.lit(float("nan"))).when(F.col("p_size") < 20, F.lit(float("inf"))).otherwise(F.col("p_retailprice")).alias("x"))), "SELECT 'x' AS \"column\", count(*) FILTER (p_size < 10) AS nan, count(*) FILTER (p_size >= 10 AND p_size < 20) AS inf FROM part")

# rows
q("filter_rows", lambda t: rows.filter_rows(t.orders, "o_totalprice > 250000 AND o_orderstatus = 'F'"), "SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
q("deduplicate", lambda t: rows.deduplicate(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [{"column": "o_totalprice", "desc": True}, "o_orderkey"]), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
q("deduplicate_all", lambda t: rows.deduplicate(t.lineitem.select("l_returnflag", "l_linestatus", "l_tax")), "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
q("sort_rows", lambda t: rows.sort_rows(t.supplier, [{"column": "s_acctbal", "desc": True}, "s_suppkey"]), "SELECT * FROM supplier")
q("sample_rows_head", lambda t: rows.sample_rows(t.orders, "head", 100, order_by=["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
q("sample_rows_tail", lambda t: rows.sample_rows(t.orders, "tail", 100, order_by=["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 100")
q("sample_rows_random", lambda t: rows.sample_rows(t.orders, "random_n", 500, order_by=["o_orderkey"]))
q("sample_stratified", lambda t: rows.sample_stratified(t.orders, "o_orderpriority", 500, order_by=["o_orderkey"]))
q("sample_cluster", lambda t: rows.sample_cluster(t.customer, "c_nationkey", 5))
q("sample_reservoir", lambda t: rows.sample_reservoir(t.events, 300, order_by=["event_id"]))
q("sample_systematic", lambda t: rows.sample_systematic(t.orders, ["o_orderkey"], every=50), "SELECT * FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 = 0")
q("sample_weighted", lambda t: rows.sample_weighted(t.part, "p_retailprice", 200, order_by=["p_partkey"]))
q("undersample", lambda t: grouping.group_aggregate(rows.undersample(t.labels, "toxic", order_by=["doc_id"]), [{"fn": "count", "as": "n"}], ["toxic"]), "SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY toxic")
q("smote_oversample", lambda t: rows.smote_oversample(t.customer.withColumn("y", (F.col("c_nationkey") < 5).cast("int")), "y", ["c_acctbal", "c_custkey"]).groupBy("y").agg(F.count("*").alias("n")), "SELECT y, (max(n) OVER ())::BIGINT AS n FROM (SELECT (c_nationkey < 5)::INT AS y, count(*) AS n FROM customer GROUP BY 1)")
q("train_test_split", lambda t: rows.train_test_split(t.orders, ["o_orderkey"], 0.2, "o_orderstatus").groupBy("o_orderstatus", "split").agg(F.count("*").alias("n")), "SELECT o_orderstatus, s AS split, CASE s WHEN 'test' THEN ceil(n * 0.2)::BIGINT ELSE n - ceil(n * 0.2)::BIGINT END AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), (VALUES ('test'), ('train')) v(s)")
q("kfold_split", lambda t: rows.kfold_split(t.orders, ["o_orderkey"], 5).groupBy("fold").agg(F.count("*").alias("n")), "SELECT f::INT AS fold, (n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END) AS n FROM (SELECT count(*) AS n FROM orders), range(5) x(f)")
q("preview_per_group", lambda t: rows.preview(t.orders, "per_group", 3, column="o_orderpriority", order_by=["o_orderkey"]), "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3")
q("preview_time_bucket", lambda t: rows.preview(t.events, "time_bucket", 2, time_column="ts", bucket="day", order_by=["event_id"]), "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) <= 2")

# joins
q("join_inner", lambda t: joins.join(t.customer.select("c_custkey", "c_nationkey"), t.nation.select("n_nationkey", "n_name"), [{"left": "c_nationkey", "right": "n_nationkey"}]), "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
q("join_left", lambda t: joins.join(t.customer, t.orders.select("o_custkey", "o_orderkey"), [{"left": "c_custkey", "right": "o_custkey"}], "left"), "SELECT customer.*, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
q("join_full", lambda t: joins.join(t.customer.select("c_custkey", "c_name").where("c_custkey % 2 = 0"), t.orders.select("o_custkey", "o_orderkey"), [{"left": "c_custkey", "right": "o_custkey"}], "full"), "SELECT c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN orders ON c_custkey = o_custkey")
q("join_anti", lambda t: joins.join(t.customer, t.orders, [{"left": "c_custkey", "right": "o_custkey"}], "anti_left"), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("join_anti_right", lambda t: joins.join(t.orders, t.customer, [{"left": "o_custkey", "right": "c_custkey"}], "anti_right"), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("join_semi", lambda t: joins.join(t.customer, t.orders, [{"left": "c_custkey", "right": "o_custkey"}], "semi"), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
q("join_between", lambda t: joins.join(t.part.select("p_partkey", "p_size"), t.region.select((F.col("r_regionkey") * 10).alias("lo"), (F.col("r_regionkey") * 10 + 12).alias("hi"), "r_name"), [{"left": "p_size", "op": "between", "right": "lo", "right2": "hi"}], bucket=10), "SELECT p_partkey, p_size, r_regionkey * 10 AS lo, r_regionkey * 10 + 12 AS hi, r_name FROM part JOIN region ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 12")
q("join_fuzzy", lambda t: joins.join(t.supplier.select("s_suppkey", "s_name"), t.supplier.select(F.concat(F.lit(" "), F.lower("s_name")).alias("key"), F.col("s_suppkey").alias("k2")), [{"left": "s_name", "op": "≈", "right": "key"}]), "SELECT s_suppkey, s_name, ' ' || lower(s_name) AS key, s_suppkey AS k2 FROM supplier")
q("join_collisions", lambda t: joins.join(t.supplier.withColumnRenamed("s_acctbal", "bal"), t.customer.withColumnRenamed("c_acctbal", "bal"), [{"left": "s_suppkey", "right": "c_custkey"}], suffixes=["_s", "_c"]), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal AS bal_s, c_name, c_nationkey, c_acctbal AS bal_c, c_mktsegment FROM supplier JOIN customer ON s_suppkey = c_custkey")
q("union", lambda t: joins.union(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))), "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL BY NAME SELECT l_orderkey AS o_orderkey FROM lineitem")
q("intersect", lambda t: joins.intersect(t.customer.select("c_nationkey"), t.supplier.select(F.col("s_nationkey").alias("c_nationkey"))), "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
q("except", lambda t: joins.except_(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))), "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
q("lookup_join", lambda t: joins.lookup_join(t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("code")), t.nation, "code", ["n_nationkey", "n_name"], ["n_name", "n_regionkey"]), "SELECT c_custkey, c_nationkey::VARCHAR AS code, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
q("asof_join", lambda t: joins.asof_join(t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id")), "ts", "click_ts", ["user_id"]), "SELECT p.event_id, p.user_id, p.ts, c.ts AS click_ts, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
q("nearest_neighbors", lambda t: joins.nearest_neighbors(t.embeddings, "embedding", "vec_id", 5, queries=t.embeddings.where("vec_id % 100 = 0")).drop("distance"), "SELECT a.vec_id AS source, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5")
q("top_k_similar", lambda t: joins.top_k_similar(t.embeddings, "embedding", "vec_id", 3).select("vec_id", F.explode("top_k_indices").alias("neighbour")), "SELECT a.vec_id, b.vec_id AS neighbour FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 3")
q("nearest_neighbors_bounds", lambda t: joins.nearest_neighbors(t.embeddings, "embedding", "vec_id", 5, "euclidean", queries=t.embeddings.where("vec_id % 100 = 0"), index="bounds").select("source", "neighbour", F.round("distance", 6).alias("distance")), "SELECT a.vec_id AS source, b.vec_id AS neighbour, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) <= 5")
q("nearest_neighbors_lists", lambda t: joins.nearest_neighbors(t.embeddings, "embedding", "vec_id", 5, queries=t.embeddings.where("vec_id % 100 = 0"), index="lists"))
q("distance_matrix", lambda t: r(joins.distance_matrix(t.embeddings, "embedding", "vec_id", queries=t.embeddings.where("vec_id % 100 = 0"))), "SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")

# grouping
q("group_aggregate", lambda t: r(grouping.group_aggregate(t.lineitem, [{"fn": f, "column": "l_quantity", "as": f"q_{f}"} for f in ("sum", "mean", "min", "max", "count", "count_distinct", "std")], ["l_returnflag"])), "SELECT l_returnflag, round(sum(l_quantity), 6) AS q_sum, round(avg(l_quantity), 6) AS q_mean, min(l_quantity) AS q_min, max(l_quantity) AS q_max, count(l_quantity) AS q_count, count(DISTINCT l_quantity) AS q_count_distinct, round(stddev_samp(l_quantity), 6) AS q_std FROM lineitem GROUP BY 1")
q("group_aggregate_global", lambda t: r(grouping.group_aggregate(t.orders, [{"fn": "sum", "column": "o_totalprice", "as": "s"}, {"fn": "count", "as": "n"}]), 2), "SELECT round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders")
q("group_rollup", lambda t: r(grouping.group_aggregate(t.lineitem, [{"fn": "sum", "column": "l_quantity", "as": "s"}], ["l_returnflag", "l_linestatus"], "rollup"), 2), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
q("group_cube", lambda t: grouping.group_aggregate(t.orders, [{"fn": "count", "as": "n"}], ["o_orderstatus", "o_orderpriority"], "cube"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("pivot_wider", lambda t: r(grouping.pivot_wider(t.orders, "o_orderstatus", "o_totalprice", ["o_orderpriority"], values=["F", "O", "P"]), 2), "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")
q("pivot_longer", lambda t: grouping.pivot_longer(t.lineitem.select("l_orderkey", "l_partkey", "l_discount", "l_tax"), ["l_discount", "l_tax"], ["l_orderkey", "l_partkey"]), "UNPIVOT (SELECT l_orderkey, l_partkey, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME name VALUE value")
q("correlation_matrix", lambda t: r(grouping.correlation_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])), "SELECT a AS col_a, b AS col_b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_tax', 'l_quantity', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_tax', 'l_extendedprice', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT c, c, 1.0 FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_tax')) v(c))")
q("correlation_spearman", lambda t: r(grouping.correlation_matrix(t.part, ["p_size", "p_retailprice"], "spearman").where("col_a < col_b")), "WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_retailprice' AS col_a, 'p_size' AS col_b, round(corr(a, b), 6) AS r FROM k".replace("'p_retailprice' AS col_a, 'p_size' AS col_b", "'p_retailprice' AS col_a, 'p_size' AS col_b"))
q("correlation_kendall", lambda t: r(grouping.correlation_matrix(t.part, ["p_size", "p_retailprice"], "kendall")), "WITH k AS (SELECT sign(a.p_size - b.p_size) AS x, sign(a.p_retailprice - b.p_retailprice) AS y FROM part a JOIN part b ON a.p_partkey < b.p_partkey), t AS (SELECT round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 6) AS r FROM k) SELECT 'p_size' AS col_a, 'p_retailprice' AS col_b, r FROM t UNION ALL SELECT 'p_retailprice', 'p_size', r FROM t UNION ALL SELECT 'p_size', 'p_size', 1.0::DOUBLE UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0::DOUBLE")
q("bin_numeric", lambda t: grouping.bin_numeric(t.part.select("p_partkey", "p_size"), "p_size", bins=7), "SELECT p_partkey, p_size, least(7, floor((p_size::DOUBLE - lo) / ((hi - lo) / 7.0::DOUBLE)) + 1)::INT AS bin FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part)")
q("bin_numeric_breaks", lambda t: grouping.bin_numeric(t.part.select("p_partkey", "p_size"), "p_size", "custom_breaks", breaks="10,30"), "SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN '< 10' WHEN p_size < 30 THEN '[10, 30)' ELSE '>= 30' END AS bin FROM part")
q("null_pattern_audit", lambda t: r(grouping.null_pattern_audit(t.part.select(F.when(F.col("p_size") > 10, 1).alias("a"), F.when(F.col("p_size") > 30, 1).alias("b")))), "SELECT CASE WHEN p_size <= 10 THEN 'a, b' WHEN p_size <= 30 THEN 'b' ELSE '' END AS pattern, CASE WHEN p_size <= 10 THEN 2 WHEN p_size <= 30 THEN 1 ELSE 0 END AS n_nulls, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM part GROUP BY 1, 2")
q("confusion_matrix", lambda t: r(grouping.confusion_matrix(t.labels, "quality", "toxic")), "SELECT quality AS actual, toxic AS predicted, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS rate FROM labels GROUP BY 1, 2")
q("confusion_matrix_all", lambda t: r(grouping.confusion_matrix(t.labels, "quality", "toxic", "all_percent")), "SELECT quality AS actual, toxic AS predicted, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM labels GROUP BY 1, 2")
_SIGNUP = "(SELECT user_id AS u, min(ts) OVER (PARTITION BY user_id)::DATE AS s, ts::DATE AS a FROM events)"


def _signups(t: Tables) -> DataFrame:
    return t.events.join(t.events.groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("signup")), F.col("user_id") == F.col("u"))


q("cohort_table", lambda t: grouping.cohort_table(_signups(t), "user_id", "signup", "ts", "week", wide=False), f"SELECT date_trunc('week', s)::DATE AS cohort, (a - s) // 7 AS \"offset\", count(DISTINCT u) AS users FROM {_SIGNUP} GROUP BY 1, 2")
q("retention_curve", lambda t: r(grouping.retention_curve(_signups(t), "user_id", "signup", "ts", "week")), f"WITH e AS (SELECT *, floor((s - DATE '1970-01-01') / 7) AS c, (a - s) // 7 AS o FROM {_SIGNUP}), z AS (SELECT c, count(DISTINCT u) AS size FROM e GROUP BY c), k AS (SELECT c, o, count(DISTINCT u) AS n FROM e WHERE o BETWEEN 0 AND 11 GROUP BY c, o) SELECT o AS \"offset\", round(avg(n / size), 6) AS retention, count(*) AS cohorts FROM k JOIN z USING (c) GROUP BY o")
q("ltv_with_discount", lambda t: r(grouping.ltv_with_discount(t.orders.withColumn("p", F.year("o_orderdate") - 1995), "o_custkey", "p", "o_totalprice"), 2), "SELECT o_custkey, round(sum(o_totalprice / pow(1.05, year(o_orderdate) - 1995)), 2) AS ltv, round(sum(o_totalprice), 2) AS revenue, max(year(o_orderdate) - 1995)::INT AS periods FROM orders GROUP BY 1")
_KM = "WITH t AS (SELECT g, time, count(*) AS n, sum(e)::BIGINT AS events FROM ({}) GROUP BY g, time), k AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY time DESC)::BIGINT AS at_risk FROM t) SELECT {} time{}, at_risk, events, round(CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w) END, 6) AS survival FROM k WINDOW w AS (PARTITION BY g ORDER BY time)"
q("survival_retention", lambda t: r(grouping.survival_retention(t.part.withColumn("e", F.col("p_type") == "ECONOMY"), "p_size", "e")), _KM.format("SELECT 1 AS g, p_size::DOUBLE AS time, (p_type = 'ECONOMY')::INT AS e FROM part", "", " AS tenure"))
_FLAGS = "WITH f AS (SELECT user_id, max((event_type = 'view')::INT) AS a, max((event_type = 'click')::INT) AS b, max((event_type = 'purchase' AND value > 150)::INT) AS c FROM events GROUP BY 1), s AS (SELECT sum(a)::BIGINT AS a, sum(least(a, b))::BIGINT AS b, sum(least(a, b, c))::BIGINT AS c FROM f)"


def _funnel(t: Tables) -> DataFrame:
    return t.events.withColumn("e", F.when(F.col("event_type") != "purchase", F.col("event_type")).when(F.col("value") > 150, "purchase"))


q("step_funnel", lambda t: r(grouping.step_funnel(_funnel(t), "user_id", "e", "view,click,purchase")), _FLAGS + " SELECT 1 AS step, 'view' AS event, a AS users, 1.0 AS conversion FROM s UNION ALL SELECT 2, 'click', b, round(b / a, 6) FROM s UNION ALL SELECT 3, 'purchase', c, round(c / a, 6) FROM s")
q("drop_off_attribution", lambda t: r(grouping.drop_off_attribution(_funnel(t), "user_id", "e", "view,click,purchase")), _FLAGS + ", n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT 1 AS step, 'view' AS event, a AS users, n - a AS dropped, round((n - a) / n, 6) AS drop_rate FROM s, n UNION ALL SELECT 2, 'click', b, a - b, round((a - b) / a, 6) FROM s UNION ALL SELECT 3, 'purchase', c, b - c, round((b - c) / b, 6) FROM s")
q("ordered_funnel", lambda t: r(grouping.step_funnel(_funnel(t), "user_id", "e", "view,click,purchase", "ts")))
q("multi_path_funnel", lambda t: r(grouping.multi_path_funnel(_funnel(t), "user_id", "e", "click,purchase")), "SELECT n AS steps_done, count(*) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' AND value > 150 THEN 2 END) AS n FROM events GROUP BY 1) GROUP BY 1")
q("time_to_convert", lambda t: r(grouping.time_to_convert(t.events, "user_id", "ts", "event_type", "signup", "purchase").select("user_id", "seconds", "hours")), "SELECT user_id, round(epoch_us(b) / 1e6 - epoch_us(a) / 1e6, 6) AS seconds, round((epoch_us(b) - epoch_us(a)) / 1e6 / 3600, 6) AS hours FROM (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL".replace("epoch_us(b) / 1e6 - epoch_us(a) / 1e6", "(epoch_us(b) - epoch_us(a)) / 1e6"))
q("rfm_score", lambda t: r(grouping.rfm_score(t.orders, "o_custkey", "o_orderdate", "o_totalprice", "2002-01-01"), 2), "WITH p AS (SELECT o_custkey, DATE '2002-01-01' - max(o_orderdate)::DATE AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1), z AS (SELECT quantile_cont(recency::DOUBLE, [.2, .4, .6, .8]) AS qr, quantile_cont(frequency::DOUBLE, [.2, .4, .6, .8]) AS qf, quantile_cont(monetary, [.2, .4, .6, .8]) AS qm FROM p), b AS (SELECT p.*, (5 - len([x FOR x IN qr IF recency > x]))::INT AS r, (len([x FOR x IN qf IF frequency > x]) + 1)::INT AS f, (len([x FOR x IN qm IF monetary > x]) + 1)::INT AS m FROM p, z) SELECT o_custkey, recency::INT AS recency, frequency, round(monetary, 2) AS monetary, r, f, m, r || '-' || f || '-' || m AS segment FROM b")
q("churn_lite", lambda t: grouping.churn_lite(t.orders, "o_custkey", "o_orderdate", 180, "2001-08-01"), "SELECT o_custkey, max(o_orderdate)::DATE AS last_activity, count(*) AS activities, (DATE '2001-08-01' - max(o_orderdate)::DATE)::INT AS days_since, DATE '2001-08-01' - max(o_orderdate)::DATE > 180 AS is_churned FROM orders GROUP BY 1")
q("repeat_purchase_rate", lambda t: r(grouping.repeat_purchase_rate(t.orders, "o_custkey", minPurchases=3, groupColumn="o_orderstatus")), "SELECT o_orderstatus, count(*) AS customers, count(*) FILTER (n >= 3) AS repeaters, round(avg((n >= 3)::INT), 6) AS repeat_rate FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
_TOUCH = "WITH c AS (SELECT user_id AS u, event_type AS channel, ts FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 200))"


def _touches(t: Tables) -> DataFrame:
    return t.events.withColumn("won", F.col("value") > 200)


q("attribution_first_touch", lambda t: grouping.attribution_first_touch(_touches(t), "user_id", "event_type", "ts", "won"), _TOUCH + " SELECT channel, count(*) AS conversions FROM (SELECT u, arg_min(channel, ts) AS channel FROM c GROUP BY u) GROUP BY 1")
q("attribution_last_touch", lambda t: grouping.attribution_last_touch(_touches(t), "user_id", "event_type", "ts", "won"), _TOUCH + " SELECT channel, count(*) AS conversions FROM (SELECT u, arg_max(channel, ts) AS channel FROM c GROUP BY u) GROUP BY 1")
q("attribution_linear", lambda t: r(grouping.attribution_linear(_touches(t), "user_id", "event_type", "won")), _TOUCH + " SELECT channel, round(sum(w), 6) AS credit FROM (SELECT channel, 1 / count(*) OVER (PARTITION BY u) AS w FROM c) GROUP BY 1")
q("attribution_time_decay", lambda t: r(grouping.attribution_time_decay(_touches(t), "user_id", "event_type", "ts", "won")), _TOUCH + ", w AS (SELECT u, channel, exp(-ln(2) / 7 * floor((epoch_us(max(ts) OVER (PARTITION BY u)) - epoch_us(ts)) / 86400000000)) AS w FROM c) SELECT channel, round(sum(x), 6) AS credit FROM (SELECT channel, w / sum(w) OVER (PARTITION BY u) AS x FROM w) GROUP BY 1")
q("attribution_position_based", lambda t: r(grouping.attribution_position_based(_touches(t), "user_id", "event_type", "ts", "won")), _TOUCH + ", k AS (SELECT channel, row_number() OVER (PARTITION BY u ORDER BY ts, channel) AS k, count(*) OVER (PARTITION BY u) AS n FROM c) SELECT channel, round(sum(CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 0.5 WHEN k = 1 OR k = n THEN 0.4 ELSE 0.2 / (n - 2) END)::DOUBLE, 6) AS credit FROM k GROUP BY 1")
q("attribution_markov", lambda t: r(grouping.attribution_markov(_touches(t), "user_id", "event_type", "ts", "won")))
q("target_encoding", lambda t: r(grouping.target_encoding(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", outputColumn="te")), "SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal, round((sum(c_acctbal) OVER (PARTITION BY c_mktsegment) + 10 * avg(c_acctbal) OVER ()) / (count(*) OVER (PARTITION BY c_mktsegment) + 10), 6) AS te FROM customer")
q("woe_iv", lambda t: r(grouping.woe_iv(t.customer.select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("y")), "c_mktsegment", "y")), "WITH p AS (SELECT c_mktsegment, greatest(1, count(*) FILTER (c_acctbal > 5000)) AS e, greatest(1, count(*) FILTER (c_acctbal <= 5000)) AS n FROM customer GROUP BY 1), w AS (SELECT c_mktsegment, ln((e / sum(e) OVER ()) / (n / sum(n) OVER ())) AS woe FROM p) SELECT c_custkey, c_mktsegment, (c_acctbal > 5000)::INT AS y, round(woe, 6) AS woe FROM customer JOIN w USING (c_mktsegment)")
q("k_anonymity_check", lambda t: grouping.k_anonymity_check(t.customer, ["c_mktsegment", "c_nationkey"], 12, summary=True), "SELECT count(*) AS classes, min(n) AS smallest, count(*) FILTER (n < 12) AS violating, coalesce(sum(n) FILTER (n < 12), 0)::BIGINT AS rows_at_risk FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)")
q("l_diversity_check", lambda t: grouping.l_diversity_check(t.customer, ["c_nationkey"], "c_mktsegment", 5), "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS distinct_values, count(DISTINCT c_mktsegment) >= 5 AS ok FROM customer GROUP BY 1")
q("t_closeness", lambda t: r(grouping.t_closeness(t.customer, ["c_nationkey"], "c_mktsegment", 0.1).drop("ok")), "WITH g AS (SELECT c_mktsegment AS s, count(*) / sum(count(*)) OVER () AS q FROM customer GROUP BY 1), p AS (SELECT c_nationkey, c_mktsegment AS s, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS p FROM customer GROUP BY 1, 2) SELECT c.c_nationkey, round(sum(abs(coalesce(p, 0) - q)) / 2, 6) AS distance FROM (SELECT DISTINCT c_nationkey FROM customer) c CROSS JOIN g LEFT JOIN p ON p.c_nationkey = c.c_nationkey AND p.s = g.s GROUP BY 1")
q("dp_aggregate_laplace", lambda t: grouping.dp_aggregate_laplace(t.orders, "o_totalprice", "o_orderstatus"))
q("dp_aggregate_gaussian", lambda t: grouping.dp_aggregate_gaussian(t.orders, "o_totalprice", "o_orderstatus"))
q("charlson_index", lambda t: grouping.charlson_index(t.part.select("p_partkey", "p_type"), t.part.select(F.substring(F.upper("p_type"), 1, 3).alias("prefix"), F.lower("p_type").alias("condition"), F.length("p_type").alias("weight"), F.lit(1).alias("priority")).distinct(), "p_partkey", "p_type"))
q("resample", lambda t: r(grouping.resample(t.events, "ts", [{"column": "value", "fn": f, "as": f} for f in ("sum", "mean", "count", "max")], "6h")), "WITH b AS (SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600) AS b, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, count(value) AS count, max(value) AS max FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 6 HOUR)) AS b FROM b) SELECT g.b AS ts, sum, mean, count, max FROM g LEFT JOIN b USING (b)")

# ordered
_O = "row_number() OVER (ORDER BY o_orderdate, o_orderkey)"
q("window_aggregate", lambda t: r(ordered.window_aggregate(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "sum", "o_totalprice", ["o_custkey"], ["o_orderkey"], "run"), 2), "SELECT o_orderkey, o_custkey, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS run FROM orders")
q("window_rank", lambda t: ordered.window_aggregate(t.part.select("p_partkey", "p_type", "p_size"), "rank", None, ["p_type"], [{"column": "p_size", "desc": True}], "rk"), "SELECT p_partkey, p_type, p_size, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC)::INT AS rk FROM part")
q("window_lag", lambda t: ordered.window_aggregate(t.conversations.select("conv_id", "turn", "role"), "lag", "role", ["conv_id"], ["turn"], "before"), "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
q("window_frame", lambda t: r(ordered.window_aggregate(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "mean", "o_totalprice", ["o_custkey"], ["o_orderkey"], "m", "rows", -2, 0)), "SELECT o_orderkey, o_custkey, o_totalprice, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING), 6) AS m FROM orders")
q("rolling", lambda t: r(ordered.rolling(t.events.select("event_id", "user_id", "ts", "value"), "ts", [{"column": "value", "fn": "mean", "window": 5, "as": "m5"}, {"column": "value", "fn": "sum", "window": "2d", "as": "s2d"}], 2, ["user_id"])), "SELECT event_id, user_id, ts, value, round(CASE WHEN count(value) OVER a >= 2 THEN avg(value) OVER a END, 6) AS m5, round(CASE WHEN count(value) OVER b >= 2 THEN sum(value) OVER b END, 6) AS s2d FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING), b AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW)")
q("lag_features", lambda t: ordered.lag_features(t.events.select("event_id", "user_id", "value"), ["value"], "event_id", "1,3", "user_id"), "SELECT event_id, user_id, value, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
q("impute_forward_backward", lambda t: ordered.impute_forward_backward(t.events.select("event_id", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("v")), ["v"], "event_id", "both", "user_id"), "SELECT event_id, user_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events)")
q("impute_interpolation", lambda t: r(ordered.impute_interpolation(t.events.select("event_id", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("v")), ["v"], "event_id", groupColumn="user_id")), "WITH e AS (SELECT event_id, user_id, CASE WHEN value > 50 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, last_value(v IGNORE NULLS) OVER a AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib, first_value(v IGNORE NULLS) OVER b AS vb FROM e WINDOW a AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, user_id, round(CASE WHEN v IS NOT NULL THEN v ELSE va + (vb - va) * (i - ia) / (ib - ia) END, 6) AS v FROM k")
q("sensor_resample_regular", lambda t: r(ordered.sensor_resample_regular(t.events, "ts", "value", "user_id", 86400).groupBy("user_id").agg(F.count("*").alias("n"))), "SELECT user_id, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 + 1)::BIGINT AS n FROM events GROUP BY 1")
q("stream_drift_detect", lambda t: r(ordered.stream_drift_detect(t.events.select("event_id", "user_id", "value"), "value", "event_id", 300, partition_by=["user_id"])), "WITH d AS (SELECT event_id, user_id, value, value - avg(value) OVER w - 0.005 AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), c AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM d), p AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY user_id ORDER BY event_id)) AS p FROM c) SELECT event_id, user_id, value, round(p, 6) AS ph_stat, p > 300 AS drift FROM p")
q("downsample_cic", lambda t: r(ordered.downsample_cic(t.events.select("event_id", "user_id", "value"), "value", "event_id", 5, 1, ["user_id"]), 4), "WITH i AS (SELECT event_id, user_id, value, sum(value) OVER w AS s, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), d AS (SELECT * FROM i WHERE (k - 1) % 5 = 0) SELECT event_id, user_id, value, round((s - coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY event_id), 0)) / 5, 4) AS filtered FROM d")
q("multi_sensor_fusion", lambda t: r(ordered.multi_sensor_fusion(t.lineitem.select("l_orderkey", "l_partkey", "l_discount", "l_tax"), ["l_discount", "l_tax"], "3,1")), "SELECT l_orderkey, l_partkey, l_discount, l_tax, round(l_discount * 0.75 + l_tax * 0.25, 6) AS fused FROM lineitem")
q("anomaly_zscore", lambda t: r(ordered.anomaly_zscore(t.events.select("event_id", "user_id", "value"), "value", ["event_id"], 20, 2.5, 5, ["user_id"]), 4), "WITH z AS (SELECT event_id, user_id, value, CASE WHEN count(value) OVER w >= 5 THEN (value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 1e-9) END AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING)) SELECT event_id, user_id, value, round(z, 4) AS z_score, coalesce(abs(z) > 2.5, false) AS is_anomaly FROM z")
q("changepoint_detection", lambda t: r(ordered.changepoint_detection(t.events.select("event_id", "user_id", "value"), "value", ["event_id"], partition_by=["user_id"]).drop("is_changepoint"), 4), "WITH z AS (SELECT event_id, user_id, value, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WINDOW p AS (PARTITION BY user_id)), u AS (SELECT *, sum(CASE WHEN k = 1 THEN 0 ELSE z - 0.5 END) OVER w AS u, sum(CASE WHEN k = 1 THEN 0 ELSE z + 0.5 END) OVER w AS l FROM z WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, user_id, value, round(u - min(u) OVER w, 4) AS cusum_pos, round(max(l) OVER w - l, 4) AS cusum_neg FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
q("replace_outliers", lambda t: ordered.replace_outliers(t.events.select("event_id", "user_id", "value").withColumn("bad", F.col("value") > 150), "value", "bad", ["event_id"], 5, partition_by=["user_id"]), "SELECT event_id, user_id, value, value > 150 AS bad, CASE WHEN value > 150 AND count(value) OVER w >= 2 THEN quantile_cont(value, 0.5) OVER w ELSE value END AS value_clean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)")
q("acf_pacf", lambda t: r(ordered.acf_pacf(t.events.groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("v")), "v", ["d"], 5).select("lag", "acf")), "WITH d AS (SELECT ts::DATE AS d, sum(value) AS v FROM events GROUP BY 1), x AS (SELECT d, v - avg(v) OVER () AS x FROM d), l AS (SELECT x, k, lag(x, k::INT) OVER (PARTITION BY k ORDER BY d) AS y FROM x, range(6) r(k)) SELECT k::INT AS lag, round(coalesce(sum(x * CASE WHEN k = 0 THEN x ELSE y END), 0) / sum(x * x), 6) AS acf FROM l GROUP BY k")
q("adf_test", lambda t: ordered.adf_test(t.events, "value", "event_id", ["event_type"]))
q("kpss_test", lambda t: ordered.kpss_test(t.events, "value", "event_id", ["event_type"]))
q("seasonal_decompose", lambda t: r(ordered.seasonal_decompose(t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v")), "d", "v", 7, partition_by=["event_type"]).select("event_type", "d", "trend"), 4), "WITH s AS (SELECT event_type, ts::DATE AS d, sum(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, d, round(CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END, 4) AS trend FROM s WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
q("forecast", lambda t: ordered.forecast(t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v")), "d", "v", 7, series=["event_type"]))
q("sequential_sprt", lambda t: ordered.sequential_sprt(t.events.select("event_id", "user_id", (F.col("event_type") == "purchase").alias("won")), "won", "event_id", 0.15, 0.3, partition_by=["user_id"]).groupBy("decision").agg(F.count("*").alias("n")))

# scalars
q("clean_whitespace", lambda t: scalars.clean_whitespace(t.part.select("p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" ")).alias("s")), "s", lowercase=True), "SELECT p_partkey, lower(p_name) AS s FROM part")
q("replace_text", lambda t: scalars.replace_text(t.part.select("p_partkey", "p_brand"), "p_brand", r"Brand#(\d+)", r"B\1", True), "SELECT p_partkey, regexp_replace(p_brand, 'Brand#(\\d+)', 'B\\1', 'g') AS p_brand FROM part")
q("extract_pattern", lambda t: scalars.extract_pattern(t.part.select("p_partkey", "p_brand"), "p_brand", r"#(\d)$", as_="d"), "SELECT p_partkey, p_brand, regexp_extract(p_brand, '#(\\d)$', 1) AS d FROM part")
q("split_column", lambda t: scalars.split_column(t.part.select("p_partkey", "p_name"), "p_name", " ", 3), "SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS p_name_1, string_split(p_name, ' ')[2] AS p_name_2, string_split(p_name, ' ')[3] AS p_name_3 FROM part")
q("extract_date_parts", lambda t: scalars.extract_date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", ["year", "quarter", "month", "week", "day", "dayofweek", "hour"]), "SELECT o_orderkey, o_orderdate, year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter, month(o_orderdate)::INT AS o_orderdate_month, week(o_orderdate)::INT AS o_orderdate_week, day(o_orderdate)::INT AS o_orderdate_day, isodow(o_orderdate)::INT AS o_orderdate_dayofweek, hour(o_orderdate)::INT AS o_orderdate_hour FROM orders")
q("date_snap", lambda t: scalars.date_snap(scalars.date_snap(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "week"), "o_orderdate", "quarter", "end", "q_end"), "SELECT o_orderkey, o_orderdate, date_trunc('week', o_orderdate)::DATE AS snapped_date, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS q_end FROM orders")
q("fiscal_year_parts", lambda t: scalars.fiscal_year_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 7), "SELECT o_orderkey, o_orderdate, (year(o_orderdate) + (month(o_orderdate) >= 7)::INT)::INT AS fy_year, ((month(o_orderdate) + 5) % 12 // 3 + 1)::INT AS fy_quarter, ((month(o_orderdate) + 5) % 12 + 1)::INT AS fy_month FROM orders")
q("business_days_between", lambda t: scalars.business_days_between(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40 - 15).cast("int")).alias("b")), "a", "b"), "SELECT o_orderkey, a, b, (SELECT count(*) FROM generate_series(least(a, b)::TIMESTAMP, greatest(a, b)::TIMESTAMP, INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6)::INT AS bdays FROM (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 40 - 15)::INT AS b FROM orders)")
q("convert_units", lambda t: r(scalars.convert_units(scalars.convert_units(t.part.select("p_partkey", F.col("p_retailprice").alias("f")), "f", "F", "C", "c"), "f", "mi", "km", "km")), "SELECT p_partkey, round(p_retailprice, 6) AS f, round((p_retailprice - 32) * 5 / 9, 6) AS c, round(p_retailprice * 1.609344, 6) AS km FROM part")
q("convert_units_pro", lambda t: r(scalars.convert_units_pro(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "lb", "kg")), "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, round(p_retailprice * 0.45359237, 6) AS p_retailprice_kg FROM part")
_MAIL = "CASE WHEN p_size % 3 = 0 THEN ' Ab.C' || p_partkey || '@Example.COM ' WHEN p_size % 3 = 1 THEN 'no at sign' END"
q("validate_email", lambda t: scalars.validate_email(t.part.select("p_partkey", F.expr(_MAIL).alias("m")), "m"), f"SELECT p_partkey, {_MAIL} AS m, p_size % 3 = 0 AS email_valid, CASE WHEN p_size % 3 = 0 THEN lower(trim({_MAIL})) END AS email_normalized FROM part")
q("validate_iban", lambda t: scalars.validate_iban(t.part.select("p_partkey", F.when(F.col("p_size") < 20, "DE89 3704 0044 0532 0130 00").when(F.col("p_size") < 40, "GB82WEST12345698765433").alias("iban")), "iban").select("p_partkey", "iban_valid", "iban_country"), "SELECT p_partkey, p_size < 20 AS iban_valid, CASE WHEN p_size < 20 THEN 'DE' END AS iban_country FROM part")
q("normalize_phone", lambda t: scalars.normalize_phone(t.part.select("p_partkey", F.when(F.col("p_size") < 20, "(212) 555-01" + "99").when(F.col("p_size") < 30, "+49 30 123456").otherwise("12").alias("p")), "p"), "SELECT p_partkey, CASE WHEN p_size < 20 THEN '(212) 555-0199' WHEN p_size < 30 THEN '+49 30 123456' ELSE '12' END AS p, CASE WHEN p_size < 20 THEN '+12125550199' WHEN p_size < 30 THEN '+4930123456' END AS phone_e164, p_size < 30 AS phone_e164_valid FROM part")
q("timezone_resolve", lambda t: scalars.timezone_resolve(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "utc").when(F.col("c_custkey") % 3 == 1, "nowhere").otherwise("Etc/GMT+5").alias("z")), "z").select("c_custkey", "tz_valid", "tz_offset_minutes"), "SELECT c_custkey, c_custkey % 3 <> 1 AS tz_valid, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE -300 END::INT AS tz_offset_minutes FROM customer")
q("hipaa_deidentify", lambda t: scalars.hipaa_deidentify(t.part.select("p_partkey", "p_name", F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("zip"), (F.col("p_size") * 2).alias("age")), ["p_name"], "zip", "age"), "SELECT p_partkey, lpad(p_partkey::VARCHAR, 5, '0')[1:3] AS zip, CASE WHEN p_size * 2 >= 90 THEN '90+' ELSE (p_size * 2)::VARCHAR END AS age FROM part")
_NUMBERS = "concat('mail a.b+', p_partkey, '@x.org, call (555) 123-', lpad(cast(p_partkey % 10000 as string), 4, '0'), ' or +49 555.123.4567 or 5551234567, ssn 123-45-6789, card 4111 1111-1111 ', lpad(cast(p_partkey % 10000 as string), 4, '0'), ', order 123456789012')"
q("pii_redact", lambda t: scalars.pii_redact(t.part.select("p_partkey", F.expr(_NUMBERS).alias("s")), ["s"]), "SELECT p_partkey, 'mail [REDACTED], call [REDACTED] or [REDACTED] or [REDACTED], ssn [REDACTED], card [REDACTED], order 123456789012' AS s FROM part")
_PII_SQL = "text"
for _p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d(?:[ -]?\d){12,15}\b", r"(?:\+\d{1,3}[ .-]?\(?|\b1[ .-]?\(?|\(|\b)\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}\b"):
    _PII_SQL = f"regexp_replace({_PII_SQL}, '{_p}', '[REDACTED]', 'g')"
q("pii_redact_documents", lambda t: scalars.pii_redact(t.documents.select("doc_id", "text"), ["text"]).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest")), f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {_PII_SQL} AS x FROM documents)")
q("pseudonymize_seeded", lambda t: scalars.pseudonymize_seeded(t.customer.select("c_custkey", "c_name"), ["c_name"], "seed"))
q("salt_hash", lambda t: scalars.salt_hash(t.customer.select("c_custkey", "c_name"), ["c_name"], "pepper", 12), "SELECT c_custkey, sha256('pepper' || c_name)[1:12] AS c_name FROM customer")
q("country_lookup", lambda t: scalars.country_lookup(t.customer.select("c_custkey", "c_nationkey"), t.nation.select(F.substring("n_name", 8, 2).alias("alpha2"), F.col("n_name").alias("alpha3"), F.col("n_nationkey").alias("numeric"), F.lower("n_name").alias("name"), F.col("n_regionkey").alias("region")), "c_nationkey").select("c_custkey", "country_alpha3"), "SELECT c_custkey, n_name AS country_alpha3 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")

# text
q("tokenize", lambda t: text.tokenize(t.documents.select("doc_id", "text"), "text").select("doc_id", F.size("tokens").alias("n")), r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::INT AS n FROM documents")
q("tokenize_ngrams", lambda t: text.tokenize(t.part.select("p_partkey", "p_name"), "p_name", "ngram"), "SELECT p_partkey, p_name, CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE [] END AS tokens FROM (SELECT *, string_split(lower(p_name), ' ') AS w FROM part)")
q("keyword_rake", lambda t: r(text.keyword_rake_yake(t.documents, "text", "doc_id", topK=3)))
q("keyword_yake", lambda t: r(text.keyword_rake_yake(t.documents, "text", "doc_id", "yake", 3)))
q("tfidf", lambda t: r(text.tfidf(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey", 2), 5).drop("rank"), "WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), tf AS (SELECT p_partkey, w, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT w, count(*) AS d FROM tf GROUP BY 1), x AS (SELECT p_partkey, w, tf * (ln((1 + (SELECT count(*) FROM part)) / (1 + d)) + 1) AS x FROM tf JOIN d USING (w)) SELECT p_partkey, w AS term, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 5) AS tfidf FROM x")
q("sentiment_lexicon", lambda t: r(text.sentiment_lexicon(t.part, t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn("valence", F.length("word") - 5.5), "p_name", "p_partkey").select("p_partkey", "compound")), "WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), s AS (SELECT p_partkey, sum(length(w) - 5.5)::DOUBLE AS s FROM w GROUP BY 1) SELECT p_partkey, round(s / sqrt(s * s + 15), 6) AS compound FROM s")
q(
    "language_detect",
    lambda t: text.language_detect(t.documents.select("doc_id", "text"), "text", profile=text.language_profile(t.documents.where("crc32(cast(doc_id as string)) % 4 <> 2"), "text", "lang")).select("doc_id", "language"),
    r"""WITH d AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, lang, substr(t, unnest(generate_series(1, length(t) - 2)), 3) AS g FROM d WHERE t <> '  '),
        crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1))))) % 4 AS fold FROM documents),
        c AS (SELECT lang, g, count(*) AS n FROM g JOIN crc USING (doc_id) WHERE fold <> 2 GROUP BY lang, g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) <= 20000),
        v AS (SELECT count(DISTINCT g) AS v FROM c), s AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
        p AS (SELECT lang, a.g, ln((coalesce(n, 0) + 0.5) / (total + 0.5 * v)) AS p FROM (SELECT DISTINCT g FROM c) a CROSS JOIN s CROSS JOIN v LEFT JOIN c USING (lang, g)),
        h AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g),
        x AS (SELECT doc_id, p.lang, sum(n * p) AS score FROM h JOIN p ON p.g = h.g GROUP BY ALL)
        SELECT documents.doc_id, b.lang AS language FROM documents LEFT JOIN (SELECT doc_id, lang FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1) b USING (doc_id)""",
)
q("lda_topics", lambda t: text.lda_topics(t.documents.select("doc_id", "text"), "text", 3).groupBy("topic").agg(F.count("*").alias("n")))

# nested
q("array_length", lambda t: nested.array_length(t.embeddings.select("vec_id", "embedding"), "embedding").drop("embedding"), "SELECT vec_id, len(embedding)::INT AS length FROM embeddings")
q("unnest_array", lambda t: nested.unnest_array(t.part.select("p_partkey", F.split("p_name", " ").alias("w")), "w"), "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
q("flatten_array", lambda t: nested.flatten_array(t.part.select("p_partkey", F.array(F.split("p_name", " "), F.array("p_brand")).alias("w")), "w"), "SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_brand]) AS w FROM part")
q("json_extract", lambda t: nested.json_extract(nested.json_extract(t.events.select("event_id", "props"), "props", "$.k", "k", True), "props", "$.k", "j"), "SELECT event_id, props, props ->> '$.k' AS k, (props -> '$.k')::VARCHAR AS j FROM events")
q("vector_similarity", lambda t: r(nested.vector_similarity(t.embeddings.alias("a").join(t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id"), "embedding", "e2").select("vec_id", "similarity")), "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id - 1")
q("vector_arithmetic", lambda t: nested.vector_arithmetic(nested.vector_arithmetic(t.embeddings, "embedding", "scalar_multiply", scalar=2.0), "vector_result", "magnitude", outputColumn="m").select("vec_id", F.round("m", 6).alias("m")), "SELECT vec_id, round(2 * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS m FROM embeddings")
q("matrix_transpose", lambda t: nested.matrix_transpose(t.part.select("p_partkey", F.array(F.array(F.col("p_size"), F.lit(1)), F.array(F.lit(2), F.lit(3))).alias("m")), nestedListColumn="m").drop("m"), "SELECT p_partkey, [[p_size, 2], [1, 3]] AS transposed FROM part")

# quality
q("check_report", lambda t: r(quality.check_report(t.part, "between", "p_size", min=5, max=30)), "SELECT 'between' AS name, count(*) AS total, count(*) FILTER (p_size NOT BETWEEN 5 AND 30) AS violations, round(count(*) FILTER (p_size NOT BETWEEN 5 AND 30) / count(*), 6) AS fraction FROM part")
q("check_data_unique", lambda t: quality.check_report(t.orders, "unique", "o_custkey").drop("fraction"), "SELECT 'unique' AS name, count(*) AS total, count(*) FILTER (n > 1) AS violations FROM (SELECT count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
q("quarantine", lambda t: quality.quarantine(t.orders, "expression", expression="o_totalprice < 400000"), "SELECT * FROM orders WHERE NOT o_totalprice < 400000")
q("expectations", lambda t: r(quality.expectations(t.orders, [{"type": "unique", "column": "o_orderkey"}, {"type": "not_null", "column": "o_custkey"}, {"type": "in", "column": "o_orderstatus", "values": ["F", "O"]}, {"type": "cardinality_between", "column": "o_orderpriority", "min": 1, "max": 4}])), "SELECT 'unique' AS rule, 'o_orderkey' AS \"column\", true AS passed, 0.0::DOUBLE AS observed UNION ALL SELECT 'not_null', 'o_custkey', true, 0.0 UNION ALL SELECT 'in', 'o_orderstatus', false, count(*) FILTER (o_orderstatus = 'P')::DOUBLE FROM orders UNION ALL SELECT 'cardinality_between', 'o_orderpriority', false, count(DISTINCT o_orderpriority)::DOUBLE FROM orders")
q("outliers_iqr", lambda t: quality.outliers_iqr(t.events.select("event_id", "value"), "value"), "SELECT event_id, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)")
q("psi_drift", lambda t: r(quality.psi_drift(t.events.withColumn("half", F.when(F.dayofmonth("ts") < 16, "a").otherwise("b")), "value", "half")), "WITH e AS (SELECT value AS v, day(ts) < 16 AS base FROM events), q AS (SELECT quantile_cont(v, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS q FROM e WHERE base), b AS (SELECT len([x FOR x IN q IF v > x]) AS bin, base FROM e, q), c AS (SELECT bin, greatest(count(*) FILTER (base) / sum(count(*) FILTER (base)) OVER (), 1e-9) AS x, greatest(count(*) FILTER (NOT base) / sum(count(*) FILTER (NOT base)) OVER (), 1e-9) AS y FROM b GROUP BY bin), p AS (SELECT sum((y - x) * ln(y / x)) AS psi FROM c) SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS level FROM p")
q("outliers_isolation_forest", lambda t: quality.outliers_isolation_forest(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], n_estimators=20).groupBy("is_outlier").agg(F.count("*").alias("n")))
q("column_lineage_report", lambda t: r(quality.column_lineage_report(t.supplier).select("column", "distinct", "nulls", "mean"), 4), "SELECT 's_suppkey' AS \"column\", count(DISTINCT s_suppkey) AS \"distinct\", count(*) - count(s_suppkey) AS nulls, round(avg(s_suppkey), 4) AS mean FROM supplier UNION ALL SELECT 's_name', count(DISTINCT s_name), count(*) - count(s_name), NULL FROM supplier UNION ALL SELECT 's_nationkey', count(DISTINCT s_nationkey), count(*) - count(s_nationkey), round(avg(s_nationkey), 4) FROM supplier UNION ALL SELECT 's_acctbal', count(DISTINCT s_acctbal), count(*) - count(s_acctbal), round(avg(s_acctbal), 4) FROM supplier")
q("provenance_certificate", lambda t: quality.provenance_certificate(t.orders, "me", "orders").select("issuer", "dataset", "columns", "rows"), "SELECT 'me' AS issuer, 'orders' AS dataset, 6 AS columns, count(*) AS rows FROM orders")
q("schema_gate", lambda t: quality.schema_gate(t.customer.select("c_custkey", "c_name"), "c_name", {"c_custkey": "bigint"}), "SELECT c_custkey, c_name FROM customer")
q("golden_row_assert", lambda t: quality.golden_row_assert(t.supplier, t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("s_name").alias("column"), F.when(F.col("s_suppkey") % 5 < 4, F.col("s_name")).otherwise("x").alias("value")), "s_suppkey"), "SELECT s_suppkey::VARCHAR AS id, 's_name' AS \"column\", 'x' AS expected, s_name AS actual, 'differs' AS problem FROM supplier WHERE s_suppkey % 5 = 4")
q("pipeline_snapshot_test", lambda t: quality.pipeline_snapshot_test(t.customer, {"rows": t.customer.count(), "columns": t.customer.columns}, 10).select("rows", "passed"), "SELECT count(*) AS rows, true AS passed FROM customer")

# scaling
_C = "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal"
q("scale_standard", lambda t: r(scaling.scale_standard(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])), _C + ", round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal_scaled FROM customer")
q("scale_minmax", lambda t: r(scaling.scale_minmax(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], 0, 10)), _C + ", round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 10, 6) AS c_acctbal_minmax FROM customer")
q("scale_robust", lambda t: r(scaling.scale_robust(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])), _C + ", round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS c_acctbal_robust FROM customer, (SELECT quantile_cont(c_acctbal, [.25, .5, .75]) AS q FROM customer)")
q("polynomial_features", lambda t: r(scaling.polynomial_features(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), 4), "SELECT p_partkey, p_size, round(p_retailprice, 4) AS p_retailprice, pow(p_size, 2)::DOUBLE AS p_size_pow2, round(pow(p_retailprice, 2), 4) AS p_retailprice_pow2, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part")
q("yeo_johnson", lambda t: r(scaling.yeo_johnson(t.events.select("event_id", "value"), ["value"]), 2))
q("impute_mean_median_mode", lambda t: scaling.impute_mean_median_mode(t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("n"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("s")), ["n", "s"]), "WITH p AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS n, CASE WHEN p_size > 10 THEN p_type END AS s FROM part) SELECT p_partkey, coalesce(n::DOUBLE, (SELECT median(n)::DOUBLE FROM p)) AS n, coalesce(s, (SELECT s FROM p WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s FROM p")
q("impute_knn", lambda t: r(scaling.impute_knn(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("b"), F.col("c_nationkey").cast("double").alias("n"), F.col("c_custkey").cast("double").alias("c")), ["b", "n", "c"], "c_custkey"), 4),
  """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS b, c_nationkey::DOUBLE AS n, c_custkey::DOUBLE AS c FROM customer),
     p AS (SELECT q.c_custkey, w.b FROM x q JOIN x w ON q.b IS NULL AND w.b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q.c_custkey ORDER BY (q.n - w.n) ** 2 + (q.c - w.c) ** 2, w.c_custkey) <= 5),
     m AS (SELECT c_custkey, avg(b) AS b FROM p GROUP BY c_custkey)
     SELECT c_custkey, round(coalesce(x.b, m.b), 4) AS b, n, c FROM x LEFT JOIN m USING (c_custkey)""")
q("impute_mice", lambda t: r(scaling.impute_mice(t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice")).alias("b"), F.col("p_size").cast("double").alias("n"), F.col("p_partkey").cast("double").alias("k")), ["b", "n", "k"]), 1))

# statistics
_MOM = "WITH g AS (SELECT {g}::VARCHAR AS g, count(*) AS n, avg({v}) AS m, var_samp({v}) AS v FROM {t} WHERE {w} GROUP BY 1), a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g LIMIT 1 OFFSET 1)"
_M2 = _MOM.format(g="l_linestatus", v="l_quantity", t="lineitem", w="true")
q("t_test", lambda t: r(statistics.t_test(t.lineitem, "l_quantity", "l_linestatus").drop("p_value"), 5), _M2 + " SELECT a.g AS g1, b.g AS g2, a.n AS n1, b.n AS n2, round(a.m, 5) AS mean1, round(b.m, 5) AS mean2, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS statistic, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 5) AS df FROM a, b")
q("anova", lambda t: r(statistics.anova(t.orders, "o_totalprice", "o_orderpriority").select("f", "eta_squared", "df_between", "df_within")), "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm FROM g), s AS (SELECT sum(n * pow(m - gm, 2)) AS b, sum((n - 1) * v) AS w, count(*) - 1 AS db, (sum(n) - count(*))::BIGINT AS dw FROM t) SELECT round((b / db) / (w / dw), 6) AS f, round(b / (b + w), 6) AS eta_squared, db AS df_between, dw AS df_within FROM s")
q("chi_square", lambda t: r(statistics.chi_square(t.orders, "o_orderstatus", "o_orderpriority").select("chi2", "dof", "n", "cramers_v")), "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c), s AS (SELECT sum(pow(o - e, 2) / e) AS x, any_value(n)::BIGINT AS n, count(DISTINCT r) AS rs, count(DISTINCT c) AS cs FROM e) SELECT round(x, 6) AS chi2, (rs - 1) * (cs - 1) AS dof, n, round(sqrt(x / (n * (least(rs, cs) - 1))), 6) AS cramers_v FROM s")
q("effect_size", lambda t: r(statistics.effect_size(t.lineitem, "l_quantity", "l_linestatus")), _M2 + ", d AS (SELECT a.g AS g1, b.g AS g2, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d, 1 - 3 / (4 * (a.n + b.n) - 9) AS c, (a.m - b.m) / sqrt(b.v) AS gd FROM a, b) SELECT g1, g2, round(d, 6) AS cohen_d, round(d * c, 6) AS hedges_g, round(gd, 6) AS glass_delta, CASE WHEN abs(d) < .2 THEN 'negligible' WHEN abs(d) < .5 THEN 'small' WHEN abs(d) < .8 THEN 'medium' ELSE 'large' END AS label FROM d")
q("mann_whitney", lambda t: r(statistics.mann_whitney(t.part.where("p_type in ('ECONOMY', 'SMALL')"), "p_size", "p_type").select("u", "n1", "n2", "median1", "median2", "rank_biserial")), "WITH x AS (SELECT p_type AS g, p_size AS x, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r FROM part WHERE p_type IN ('ECONOMY', 'SMALL')), s AS (SELECT sum(r) FILTER (g = 'ECONOMY') AS r1, (count(*) FILTER (g = 'ECONOMY'))::DOUBLE AS n1, (count(*) FILTER (g = 'SMALL'))::DOUBLE AS n2, median(x) FILTER (g = 'ECONOMY')::DOUBLE AS m1, median(x) FILTER (g = 'SMALL')::DOUBLE AS m2 FROM x) SELECT round(r1 - n1 * (n1 + 1) / 2, 6) AS u, n1, n2, m1 AS median1, m2 AS median2, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS rank_biserial FROM s")
q("ks_test", lambda t: r(statistics.ks_test(t.part.where("p_type in ('ECONOMY', 'SMALL')"), "p_size", "p_type").select("statistic", "n1", "n2")), "WITH c AS (SELECT p_size, count(*) FILTER (p_type = 'ECONOMY') AS a, count(*) FILTER (p_type = 'SMALL') AS b FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY 1), d AS (SELECT abs(sum(a) OVER (ORDER BY p_size) / sum(a) OVER () - sum(b) OVER (ORDER BY p_size) / sum(b) OVER ()) AS d, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c) SELECT round(max(d), 6) AS statistic, any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2 FROM d")
q("bootstrap_ci", lambda t: statistics.bootstrap_ci(t.events, "value", n_iter=200).select(F.round("estimate", 6).alias("estimate")), "SELECT round(avg(value), 6) AS estimate FROM events")
q("bootstrap_ci_median", lambda t: statistics.bootstrap_ci(t.part, "p_size", "median", n_iter=50).select(F.round("estimate", 6).alias("estimate")), "SELECT round(median(p_size::DOUBLE), 6) AS estimate FROM part")
q("multiple_comparison_correction", lambda t: r(statistics.multiple_comparison_correction(t.supplier.select("s_suppkey", F.least(F.lit(1.0), (F.col("s_suppkey") + 1) * (F.col("s_suppkey") + 1) / 21000).alias("p")), "p")), "WITH p AS (SELECT s_suppkey, least(1, (s_suppkey + 1) * (s_suppkey + 1) / 21000) AS p, row_number() OVER (ORDER BY s_suppkey) AS k, count(*) OVER () AS m FROM supplier) SELECT s_suppkey, round(p, 6) AS p, round(least(1, min(p * m / k) OVER (ORDER BY p DESC)), 6) AS p_adjusted, least(1, min(p * m / k) OVER (ORDER BY p DESC)) <= 0.05 AS significant FROM p")
q("kaplan_meier", lambda t: r(statistics.kaplan_meier(t.part.withColumn("e", F.col("p_retailprice") > 950), "p_size", "e", "p_type").drop("lower", "upper")), _KM.format("SELECT p_type AS g, p_size::DOUBLE AS time, (p_retailprice > 950)::INT AS e FROM part", "g AS p_type,", ""))
q("log_rank_test", lambda t: r(statistics.log_rank_test(t.part.withColumn("e", F.col("p_retailprice") > 950), "p_size", "e", "p_type")))
q("cox_proportional_hazards", lambda t: r(statistics.cox_proportional_hazards(t.part.withColumn("e", F.col("p_size") % 2 == 0), "p_size", "e", ["p_retailprice"]), 4))
q("beta_binomial_posterior", lambda t: r(statistics.beta_binomial_posterior(t.events.withColumn("n", F.lit(1)).withColumn("s", (F.col("value") > 100).cast("int")), "event_type", "s", "n").select("event_type", "alpha", "beta", "mean")), "SELECT event_type, (count(*) FILTER (value > 100) + 1)::DOUBLE AS alpha, (count(*) FILTER (value <= 100) + 1)::DOUBLE AS beta, round((count(*) FILTER (value > 100) + 1) / (count(*) + 2), 6) AS mean FROM events GROUP BY 1")
q("conjugate_normal", lambda t: r(statistics.conjugate_normal(t.events, "event_type", "value").select("event_type", "n", "posterior_mean", "posterior_variance")), "SELECT event_type, count(value) AS n, round((sum(value) / 1) / (1 / 100 + count(value)), 6) AS posterior_mean, round(1 / (1 / 100 + count(value)), 6) AS posterior_variance FROM events GROUP BY 1")
q("bayes_factor", lambda t: r(statistics.bayes_factor(t.events.withColumn("n", F.lit(1)).withColumn("s", (F.col("value") > 100).cast("int")), "s", "n", 0.1, 0.12).select("log_bf10"), 4), "SELECT round(count(*) FILTER (value > 100) * ln(0.12 / 0.1) + count(*) FILTER (value <= 100) * ln(0.88 / 0.9), 4) AS log_bf10 FROM events")
q("bayesian_regression", lambda t: r(statistics.bayesian_regression(t.lineitem, "l_extendedprice", ["l_quantity"]), 1))
q("delta_method_ratio", lambda t: r(statistics.delta_method_ratio(t.lineitem, "l_returnflag", "l_discount", "l_tax").select("l_returnflag", "n", "ratio", "std_error")), "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_discount) AS a, avg(l_tax) AS b, var_samp(l_discount) AS va, var_samp(l_tax) AS vb, covar_samp(l_discount, l_tax) AS c FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round(a / b, 6) AS ratio, round(sqrt((va - 2 * (a / b) * c + pow(a / b, 2) * vb) / (n * b * b)), 6) AS std_error FROM g")
q("best_bayesian_ab", lambda t: statistics.best_bayesian_ab(t.events.withColumn("won", F.col("value") > 100), "event_type", "won", 5000).select("variant", "conversions", "n"), "SELECT event_type AS variant, count(*) FILTER (value > 100) AS conversions, count(*) AS n FROM events GROUP BY 1")
q("diff_in_diff", lambda t: r(statistics.diff_in_diff(t.orders.withColumn("treated", F.col("o_orderstatus") == "F").withColumn("post", F.year("o_orderdate") > 1998), "o_totalprice", "treated", "post").where("term = 'treated_x_post'").select("estimate"), 2), "WITH m AS (SELECT o_orderstatus = 'F' AS t, year(o_orderdate) > 1998 AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT round(sum(CASE WHEN t = p THEN m ELSE -m END), 2) AS estimate FROM m")
q("instrumental_variables", lambda t: r(statistics.instrumental_variables(t.lineitem, "l_extendedprice", "l_quantity", ["l_linenumber"]).where("term = 'l_quantity'").select("estimate"), 0))
q("regression_discontinuity", lambda t: r(statistics.regression_discontinuity(t.part, "p_retailprice", "p_size", 25, 10).select("jump", "n_left", "n_right"), 4), "WITH x AS (SELECT p_retailprice AS y, p_size - 25 AS x FROM part WHERE abs(p_size - 25) <= 10) SELECT round(regr_intercept(y, x) FILTER (x >= 0) - regr_intercept(y, x) FILTER (x < 0), 4) AS jump, count(*) FILTER (x < 0) AS n_left, count(*) FILTER (x >= 0) AS n_right FROM x")
q("propensity_score_matching", lambda t: statistics.propensity_score_matching(t.customer.withColumn("y", (F.col("c_acctbal") > 7000).cast("int")).withColumn("x", F.col("c_nationkey") + F.col("c_acctbal") / 5000), "c_custkey", "y", ["c_nationkey"]).select("treated", "control", F.round("treated_score", 6).alias("treated_score"), F.round("control_score", 6).alias("control_score")))
q("synthetic_control", lambda t: r(statistics.synthetic_control(t.events.groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(F.sum("value").alias("v")), "event_type", "d", "v", "purchase", 20).select("time", "observed"), 4), "SELECT day(ts)::INT AS time, round(sum(value), 4) AS observed FROM events WHERE event_type = 'purchase' GROUP BY 1")

# models
q("linear_regression", lambda t: r(models.linear_regression(t.lineitem, "l_extendedprice", ["l_quantity"], coefficients=True).select("term", "coefficient"), 2), "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2) FROM lineitem")
q("logistic_regression", lambda t: models.logistic_regression(t.part.withColumn("y", (F.col("p_size") + F.col("p_partkey") % 11 > 30).cast("int")), "p_partkey", "y", ["p_size"]).groupBy("predicted_class").agg(F.count("*").alias("n")))
q("glm_logit", lambda t: r(models.glm_logit(t.part.withColumn("y", (F.col("p_size") + F.col("p_partkey") % 11 > 30).cast("int")), "y", ["p_size"]).select("term", "estimate"), 3))
q("glm_probit", lambda t: r(models.glm_probit(t.part.withColumn("y", (F.col("p_size") + F.col("p_partkey") % 11 > 30).cast("int")), "y", ["p_size"]).select("term", "estimate"), 3))
q("glm_poisson", lambda t: r(models.glm_poisson(t.lineitem, "l_linenumber", ["l_tax"]).select("term", "estimate"), 3))
q("pca", lambda t: r(models.pca(t.lineitem, "l_orderkey", ["l_quantity", "l_extendedprice", "l_tax"], ratios=True), 4))
q("kmeans", lambda t: models.kmeans(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], 3, report=True).select("size"))
q(
    "dbscan",
    lambda t: models.dbscan(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey", ["c_acctbal", "c_nationkey"], 0.06, 5).select("c_custkey", "cluster"),
    """WITH RECURSIVE p AS (SELECT c_custkey AS k, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
       e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.06 ** 2),
       c AS (SELECT a AS k FROM e GROUP BY a HAVING count(*) >= 5),
       l AS (SELECT a, b FROM e WHERE a IN (FROM c) AND b IN (FROM c)),
       w AS (SELECT k AS a, k AS b FROM c UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
       n AS (SELECT b AS k, min(a) AS label FROM w GROUP BY b),
       d AS (SELECT e.a AS k, min(label) AS label FROM e JOIN n ON e.b = n.k WHERE e.a NOT IN (FROM c) GROUP BY e.a)
       SELECT c_custkey, coalesce(n.label, d.label, -1) AS cluster FROM customer LEFT JOIN n ON n.k = c_custkey LEFT JOIN d ON d.k = c_custkey""",
)
q("semantic_cluster", lambda t: models.semantic_cluster(t.embeddings, "vec_id", "embedding", 4).select("vec_id", "cluster"))
q("semantic_cluster_bisecting", lambda t: models.semantic_cluster(t.embeddings, "vec_id", "embedding", 4, linkage="bisecting").groupBy("cluster").agg(F.count("*").alias("n")))
q("permutation_importance", lambda t: models.permutation_importance(t.part.withColumn("y", F.col("p_size") * 2.0), "y", ["p_size", "p_retailprice"], "regression", 1).select("feature", "rank"))
q("partial_dependence", lambda t: models.partial_dependence(t.part.withColumn("y", F.col("p_size") * 2.0), "y", ["p_size", "p_retailprice"], "p_size", "regression", 5).select("value"))
_SC = "SELECT toxic AS y, (doc_id * 7919 % 101) / 100 AS p FROM labels"


def _scores(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.col("toxic").alias("y"), ((F.col("doc_id") * 7919 % 101) / 100).alias("p"))


q("model_metrics", lambda t: r(models.model_metrics(_scores(t).withColumn("c", (F.col("p") > 0.5).cast("int")), "y", "c").where("metric = 'accuracy'")), f"SELECT 'accuracy' AS metric, round(avg(((p > 0.5)::INT = y)::INT), 6) AS value FROM ({_SC})")
q("model_metrics_regression", lambda t: r(models.model_metrics(t.orders.select("o_totalprice", F.lit(150000.0).alias("guess")), "o_totalprice", "guess", "regression"), 4), "SELECT 'rmse' AS metric, round(sqrt(avg(pow(o_totalprice - 150000, 2))), 4) AS value FROM orders UNION ALL SELECT 'mae', round(avg(abs(o_totalprice - 150000)), 4) FROM orders UNION ALL SELECT 'r2', round(1 - sum(pow(o_totalprice - 150000, 2)) / (var_pop(o_totalprice) * count(*)), 4) FROM orders")
_RC = f"WITH s AS ({_SC}), c AS (SELECT p AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM s GROUP BY 1), k AS (SELECT threshold, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS P, sum(b) OVER () AS N FROM c WINDOW w AS (ORDER BY threshold DESC))"
q("roc_curve", lambda t: r(models.roc_curve(_scores(t), "y", "p").drop("auc")), _RC + " SELECT round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr, threshold FROM k UNION ALL SELECT 0, 0, 1.01")
q("pr_curve", lambda t: r(models.pr_curve(_scores(t), "y", "p").drop("average_precision")), _RC + " SELECT round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall, threshold FROM k")
q("calibration_curve", lambda t: r(models.calibration_curve(_scores(t), "y", "p").drop("brier")), f"SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed FROM ({_SC}) GROUP BY 1")
q("gain_chart", lambda t: models.gain_chart(_scores(t), "y", "p", "doc_id", points=10).select(F.round("gain", 6).alias("gain")), "WITH x AS (SELECT toxic AS y, row_number() OVER (ORDER BY (doc_id * 7919 % 101) DESC, doc_id) AS rn, count(*) OVER () AS n, sum(toxic) OVER () AS p FROM labels), b AS (SELECT ceil(rn * 10 / n) AS b, sum(y) AS y, max(p) AS p FROM x GROUP BY 1) SELECT round(sum(y) OVER (ORDER BY b) / p, 6) AS gain FROM b")
q("lift_chart", lambda t: r(models.lift_chart(_scores(t), "y", "p", "doc_id", 5).select("bucket", "n", "positives")), "WITH x AS (SELECT toxic AS y, row_number() OVER (ORDER BY (doc_id * 7919 % 101) DESC, doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT ceil(rn * 5 / n)::INT AS bucket, count(*) AS n, sum(y)::BIGINT AS positives FROM x GROUP BY 1")

# charts
q("histogram", lambda t: r(charts.histogram(t.events, "value", 10)), "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(9, floor((value - lo) / (hi - lo) * 10))::INT AS bin, count(*) AS c FROM events, e GROUP BY 1) SELECT g.i::INT AS bin, round(lo + g.i * (hi - lo) / 10, 6) AS lower, round(lo + (g.i + 1) * (hi - lo) / 10, 6) AS upper, coalesce(c, 0) AS count FROM e, range(10) g(i) LEFT JOIN b ON b.bin = g.i")
q("chart_bar_counts", lambda t: charts.chart_data(t.orders, "bar_counts", "o_orderpriority"), "SELECT o_orderpriority AS label, count(*) AS count FROM orders GROUP BY 1")
q("chart_percent_bar", lambda t: r(charts.chart_data(t.orders, "percent_bar", "o_orderpriority", hue="o_orderstatus")), "SELECT o_orderpriority AS label, o_orderstatus AS hue, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS value FROM orders GROUP BY 1, 2")
q("chart_heatmap", lambda t: charts.chart_data(t.part, "heatmap", "p_type", "p_size"), "SELECT p_type AS x, p_size AS y, count(*) AS count FROM part GROUP BY 1, 2")
q("chart_hexbin", lambda t: charts.chart_data(t.part, "hexbin", "p_size", "p_retailprice", bins=8).agg(F.sum("count").alias("n")), "SELECT count(*)::BIGINT AS n FROM part")
q("pareto_chart", lambda t: r(charts.pareto_chart(t.orders, "o_orderpriority", "o_totalprice", 3), 2), "WITH s AS (SELECT o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1 ORDER BY value DESC LIMIT 3) SELECT label, round(value, 2) AS value, round(100 * sum(value) OVER (ORDER BY value DESC) / sum(value) OVER (), 2) AS cumulative_percent FROM s")
q("funnel_chart", lambda t: r(charts.funnel_chart(t.supplier, "s_name", "s_suppkey", ["s_suppkey"]), 4), "SELECT s_name AS stage, s_suppkey::DOUBLE AS value, round(100 * s_suppkey / nullif(lag(s_suppkey) OVER (ORDER BY s_suppkey), 0), 4) AS percent_of_previous FROM supplier")
q("waterfall_chart", lambda t: r(charts.waterfall_chart(t.supplier, "s_name", "s_nationkey", ["s_suppkey"])), "SELECT row_number() OVER (ORDER BY s_suppkey)::INT AS position, s_name AS label, s_nationkey::DOUBLE AS value, (sum(s_nationkey) OVER (ORDER BY s_suppkey) - s_nationkey)::DOUBLE AS start, (sum(s_nationkey) OVER (ORDER BY s_suppkey))::DOUBLE AS \"end\" FROM supplier UNION ALL SELECT (count(*) + 1)::INT, 'Total', sum(s_nationkey)::DOUBLE, 0, sum(s_nationkey)::DOUBLE FROM supplier")
q("mosaic_marimekko", lambda t: r(charts.mosaic_marimekko(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice").drop("value")), "WITH c AS (SELECT o_orderstatus AS row, o_orderpriority AS \"column\", sum(o_totalprice) AS v FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2) SELECT row, \"column\", round(sum(v) OVER (PARTITION BY \"column\") / sum(v) OVER (), 6) AS column_share, round(v / sum(v) OVER (PARTITION BY \"column\"), 6) AS row_share FROM c")
q("pie_donut", lambda t: r(charts.pie_donut(t.customer, "c_mktsegment", "c_acctbal"), 4), "SELECT c_mktsegment AS label, round(sum(c_acctbal), 4) AS value, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 4) AS share FROM customer GROUP BY 1")
q("treemap", lambda t: r(charts.treemap(t.customer, "c_mktsegment", "c_acctbal", "c_nationkey").select("label", "color"), 4), "SELECT c_mktsegment AS label, round(avg(c_nationkey), 4) AS color FROM customer GROUP BY 1")
q("calendar_heatmap", lambda t: r(charts.calendar_heatmap(t.orders, "o_orderdate", "o_totalprice", 1996), 2), "SELECT o_orderdate::DATE AS date, round(sum(o_totalprice), 2) AS value, week(o_orderdate::DATE)::INT AS week, isodow(o_orderdate::DATE)::INT AS weekday FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_orderdate::DATE")
q("chord_diagram", lambda t: r(charts.chord_diagram(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice").select("source", "target", "value", "source_total"), 2), "SELECT o_orderstatus AS source, o_orderpriority AS target, round(sum(o_totalprice), 2) AS value, round(sum(sum(o_totalprice)) OVER (PARTITION BY o_orderstatus), 2) AS source_total FROM orders GROUP BY 1, 2")
q("sankey_flow", lambda t: charts.sankey_flow(t.customer.select(F.col("c_mktsegment").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"), F.lit(1).alias("v")), "a", "b", "v").select("source", "target", "value", "source_level", "target_level"), "SELECT c_mktsegment AS source, 'n' || c_nationkey AS target, count(*)::DOUBLE AS value, 0 AS source_level, 1 AS target_level FROM customer GROUP BY 1, 2")
q("network_graph", lambda t: charts.network_graph(t.orders, "o_orderstatus", "o_orderpriority", communityDetection=False).select("node", "degree"), "SELECT o_orderstatus AS node, count(DISTINCT o_orderpriority) AS degree FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(DISTINCT o_orderstatus) FROM orders GROUP BY 1")
q("network_communities", lambda t: charts.network_graph(t.lineitem, "l_suppkey", "l_partkey", rounds=4))
q("box_plot", lambda t: charts.box_plot(t.events, "value", "event_type").select("group", "n", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), "outliers"), "WITH q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b, count(*) AS n FROM events GROUP BY 1) SELECT g AS \"group\", n, round(a, 6) AS q1, round(m, 6) AS median, count(*) FILTER (value NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outliers FROM events JOIN q ON event_type = g GROUP BY g, n, a, m, b")
q("ecdf_plot", lambda t: r(charts.ecdf_plot(t.part, "p_size", "p_type")), "WITH c AS (SELECT p_type AS g, p_size::DOUBLE AS x, count(*) AS n FROM part GROUP BY 1, 2) SELECT g AS \"group\", x, round(sum(n) OVER (PARTITION BY g ORDER BY x) / sum(n) OVER (PARTITION BY g), 6) AS cumulative_share FROM c")
q("density_plot", lambda t: charts.density_plot(t.events, "value", "event_type", 20).groupBy("group").agg(F.count("*").alias("n")), "SELECT event_type AS \"group\", 20::BIGINT AS n FROM events GROUP BY 1")
q("violin_plot", lambda t: charts.violin_plot(t.part, "p_retailprice", "p_type").groupBy("group").agg(F.count("*").alias("n")), "SELECT p_type AS \"group\", 100::BIGINT AS n FROM part GROUP BY 1")
q("ridge_plot", lambda t: charts.ridge_plot(t.part, "p_retailprice", "p_type").groupBy("group").agg(F.count("*").alias("n")), "SELECT p_type AS \"group\", 100::BIGINT AS n FROM part GROUP BY 1")
q("qq_plot", lambda t: charts.qq_plot(t.events, "value", 4).select("p", F.round("sample", 6).alias("sample")), "SELECT p, round(s, 6) AS sample FROM (SELECT unnest([.125::DOUBLE, .375, .625, .875]) AS p, unnest(quantile_cont(value, [.125, .375, .625, .875])) AS s FROM events)")
q("horizon_chart", lambda t: r(charts.horizon_chart(t.events.withColumn("d", F.to_date("ts")), "d", "event_type", "value").select("date", "group", "value", "deviation")), "WITH s AS (SELECT ts::DATE AS date, event_type AS g, avg(value) AS v FROM events GROUP BY 1, 2) SELECT date, g AS \"group\", round(v, 6) AS value, round(v - (SELECT median(v) FROM s), 6) AS deviation FROM s")
q("stream_graph", lambda t: r(charts.stream_graph(t.events.withColumn("d", F.to_date("ts")), "d", "event_type", "value"), 4), "WITH c AS (SELECT ts::DATE AS d, event_type AS g, sum(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT d.d, g.g, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT d FROM c) d CROSS JOIN (SELECT DISTINCT g FROM c) g LEFT JOIN c ON c.d = d.d AND c.g = g.g), u AS (SELECT *, sum(v) OVER (PARTITION BY d ORDER BY g) - sum(v) OVER (PARTITION BY d) / 2 AS u FROM x) SELECT d AS date, g AS \"group\", round(v, 4) AS value, round(u, 4) AS upper, round(u - v, 4) AS lower FROM u")
q("candlestick_chart", lambda t: charts.ohlc(t.events, "ts", "value", "day", ["event_type"]), "SELECT event_type, date_trunc('day', ts) AS time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2")

# tables
q("profile", lambda t: r(tables.profile(t.orders).select("column", "rows", "nulls", "distinct", "mean"), 4), "SELECT c AS \"column\", (SELECT count(*) FROM orders) AS rows, 0::BIGINT AS nulls, d AS \"distinct\", round(m, 4) AS mean FROM (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, avg(o_orderkey) AS m FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), avg(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), NULL FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), avg(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), NULL FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), NULL FROM orders)")
q("top_values", lambda t: tables.top_values(t.part, 3, ["p_type", "p_brand"]), "SELECT c AS \"column\", v AS value, n AS count, row_number() OVER (PARTITION BY c ORDER BY n DESC, v)::INT AS rank FROM (SELECT 'p_type' AS c, p_type AS v, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2) QUALIFY rank <= 3")
q("detect_types", lambda t: tables.detect_types(t.part.select(F.concat("p_partkey", F.lit("@x.org")).alias("a"), F.col("p_size").cast("string").alias("b"))).where("rank = 1").select("column", "type", "score"), "SELECT 'a' AS \"column\", 'email' AS type, 1.0::DOUBLE AS score UNION ALL SELECT 'b', 'integer', 1.0")
q("diff_keyed", lambda t: tables.diff_keyed(t.supplier.select("s_suppkey", "s_name").where("s_suppkey % 5 > 0"), t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 7, "X").otherwise(F.col("s_name")).alias("s_name")).where("s_suppkey % 5 < 4"), "s_suppkey").select("s_suppkey", "change"), "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN 'dropped' WHEN s_suppkey % 5 = 0 THEN 'added' ELSE 'changed' END AS change FROM supplier WHERE s_suppkey % 5 IN (0, 4) OR s_suppkey % 10 = 7")
q("diff_unkeyed", lambda t: tables.diff_unkeyed(t.supplier.select("s_suppkey", "s_name").where("s_suppkey % 5 > 0"), t.supplier.select("s_suppkey", "s_name").where("s_suppkey % 5 < 4")), "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 4 THEN 'dropped' ELSE 'added' END AS change FROM supplier WHERE s_suppkey % 5 IN (0, 4)")
q("schema_drift", lambda t: tables.schema_drift(t.orders.withColumn("x", F.lit(1)), t.orders.drop("o_orderstatus")).select("column", "change"))
q("row_count_anomaly", lambda t: tables.row_count_anomaly(t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")), "d", "n").select("d", "n", "is_anomaly"), "WITH r AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1), m AS (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS s, count(n) OVER w AS c FROM r WINDOW w AS (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT d, n, coalesce(c >= 3 AND abs(n - m) >= 0.1 * m AND (abs(n - m) / nullif(s, 0) >= 2 OR (s = 0 AND n <> m)), false) AS is_anomaly FROM m")
q("freshness", lambda t: tables.freshness(t.events.groupBy("user_id").agg(F.max("ts").alias("last")), "last", 86400, now="2024-01-31 00:00:00").select("user_id", "status"), "SELECT user_id, CASE WHEN a > 86400 THEN 'stale' WHEN a > 69120 THEN 'due' ELSE 'fresh' END AS status FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) AS a FROM events GROUP BY 1)")
q("row_lineage", lambda t: tables.lineage_aggregate(t.orders.select("o_orderkey", "o_custkey").withColumn("row_id", F.col("o_orderkey")), ["o_custkey"], [{"fn": "count", "as": "n"}]), "SELECT o_custkey, count(*) AS n, list_sort(list(o_orderkey)) AS source_rows FROM orders GROUP BY 1")
q("overview", lambda t: tables.overview(t.orders).select("operator"))

# geo
_P = "SELECT p_partkey, (p_partkey * 37 % 160 - 80)::DOUBLE AS a, (p_partkey * 53 % 340 - 170)::DOUBLE AS b FROM part"


def _points(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_partkey") * 37 % 160 - 80).cast("double").alias("a"), (F.col("p_partkey") * 53 % 340 - 170).cast("double").alias("b"))


q("geo_distance", lambda t: r(geo.geo_distance(_points(t).withColumns({"c": F.lit(48.0), "d": F.lit(2.0)}), "a", "b", "c", "d").select("p_partkey", "distance_m"), 2), f"SELECT p_partkey, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(48 - a) / 2), 2) + cos(radians(a)) * cos(radians(48)) * pow(sin(radians(2 - b) / 2), 2)))), 2) AS distance_m FROM ({_P})")
q("vincenty_distance", lambda t: r(geo.vincenty_distance(_points(t).withColumns({"c": F.lit(48.0), "d": F.lit(2.0)}), "a", "b", "c", "d", outputBearing=True).select("p_partkey", "distance_m"), 0))
q("convert_coordinates", lambda t: r(geo.convert_coordinates(geo.convert_coordinates(_points(t), "geographic", "cartesian3d", ["a", "b"]), "cartesian3d", "geographic", ["coord_x", "coord_y", "coord_z"], "g_").select("p_partkey", "g_lat", "g_lon"), 4), f"SELECT p_partkey, a AS g_lat, b AS g_lon FROM ({_P})")
q("geohash_cell", lambda t: geo.geohash_cell(_points(t), "a", "b", 5))
q("crs_transform", lambda t: r(geo.crs_transform(_points(t), "b", "a").select("p_partkey", "x_proj", "y_proj"), 3), f"SELECT p_partkey, round(radians(b) * 6378137, 3) AS x_proj, round(6378137 * ln(tan(pi() / 4 + radians(a) / 2)), 3) AS y_proj FROM ({_P})")


def _boxes(t: Tables) -> DataFrame:
    x0, y0 = F.col("n_nationkey") * 12.0 - 170.25, F.lit(-60.25)
    ring = F.array(*(F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in ((0, 0), (10, 0), (10, 120), (0, 120), (0, 0))))
    return t.nation.select("n_nationkey", F.array(ring).alias("box"))


q("parse_geometry", lambda t: geo.parse_geometry(t.part.select("p_partkey", F.expr("'POINT (' || p_size || ' ' || p_partkey || ')'").alias("w")), "w").select("p_partkey", F.col("geometry")[0][0]["x"].alias("x"), "geometry_type", "is_valid"), "SELECT p_partkey, p_size::DOUBLE AS x, 'POINT' AS geometry_type, true AS is_valid FROM part")
q("spatial_join", lambda t: geo.spatial_join(_points(t).withColumn("pt", F.array(F.array(F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))), _boxes(t), "pt", "box", cell=10.0).select("p_partkey", "n_nationkey"), f"SELECT p_partkey, n_nationkey FROM ({_P}), nation WHERE b > n_nationkey * 12 - 170.25 AND b < n_nationkey * 12 - 160.25 AND a > -60.25 AND a < 59.75")
q("map_match", lambda t: geo.map_match(_points(t), t.nation.select("n_nationkey", (F.col("n_nationkey") * 7.0 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lon")), "p_partkey", "a", "b", "lat", "lon", "n_nationkey").select("p_partkey", F.round("matched_distance_m", 0).alias("m")), f"SELECT p_partkey, round(min(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(n_nationkey * 7 - 80 - a) / 2), 2) + cos(radians(a)) * cos(radians(n_nationkey * 7 - 80)) * pow(sin(radians(n_nationkey * 13 - 160 - b) / 2), 2))))), 0) AS m FROM ({_P}), nation GROUP BY 1")
q("reverse_geocode", lambda t: geo.reverse_geocode(_points(t), t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 7.0 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lon"), F.col("n_name").alias("country")), "p_partkey", "a", "b").groupBy("country").agg(F.count("*").alias("n")))
q("boundary_lookup", lambda t: geo.boundary_lookup(t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("code")), _boxes(t).select(F.col("n_nationkey").cast("string").alias("code"), F.col("box").alias("geometry")), "text", "code", output_column="area").select("s_suppkey", F.col("area")[0][0]["x"].alias("x")), "SELECT s_suppkey, s_nationkey * 12 - 170.25::DOUBLE AS x FROM supplier")
