"""Golden rows and edge rows of single operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import columns, grouping, joins, nested, ordered, quality, rows, scalars, scaling, statistics, tables, text


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "Ada", "UK", 36, True, 10.5), (2, "Bob", "US", 41, False, None), (3, "Cy", "US", 29, True, -3.0), (4, "Dee", None, 41, True, 0.0), (5, "Eve", "DE", 50, False, 7.25)], "id int, name string, country string, age int, is_active boolean, balance double")


def test_sort_puts_nulls_last_both_ways(customers):
    assert [r.id for r in rows.sort_rows(customers, [{"column": "balance", "desc": True}]).collect()][-1] == 2
    assert [r.id for r in rows.sort_rows(customers, ["balance"]).collect()][-1] == 2


def test_rename_refuses_collisions(customers):
    with pytest.raises(ValueError):
        columns.rename_columns(customers, {"id": "x", "name": "x"})
    with pytest.raises(ValueError):
        columns.rename_columns(customers, {"id": "name"})


def test_expressions_are_guarded(customers):
    for bad in ("1; drop table x", "reflect('a', 'b')", "(select 1)", "1 -- x"):
        with pytest.raises(ValueError):
            columns.derive_column(customers, "x", bad)
    assert columns.derive_column(customers, "x", "concat(name, ' --; select')").count() == 5


def test_math_equation_dialect(customers):
    out = columns.math_equation(customers, "m", "age ^ 2 + log(100)").where("id = 1").first()
    assert out.m == pytest.approx(36**2 + 2)


def test_cast_failures_become_null(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert [r.v for r in columns.cast_type(df, "v", "integer").collect()] == [1, None, None]
    assert columns.cast_report(df, "v", "integer").first().cast_failures == 1


def test_outer_join_keeps_left_key_only(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k2 int, v string")
    out = joins.join(a, b, [{"left": "k", "right": "k2"}], "full")
    assert out.columns == ["k", "v_x", "v_y"]
    assert sorted((r.k is None, r.v_y) for r in out.collect()) == [(False, "x"), (True, "y")]
    both = joins.join(a, b, [{"left": "k", "right": "k2"}], "full", coalesce_keys=True)
    assert sorted(r.k for r in both.collect()) == [1, 2]


def test_between_join_by_buckets_equals_plain(spark):
    a = spark.range(200).select((F.col("id") * 7 % 100).cast("double").alias("x"), "id")
    b = spark.range(20).select((F.col("id") * 5).cast("double").alias("lo"), (F.col("id") * 5 + 9).cast("double").alias("hi"), F.col("id").alias("b"))
    key = [{"left": "x", "op": "between", "right": "lo", "right2": "hi"}]
    plain, fast = (sorted(map(tuple, joins.join(a, b, key, bucket=k).collect())) for k in (None, 10))
    assert plain == fast and plain


def test_asof_join_takes_last_before(spark):
    a = spark.createDataFrame([(1, 10), (1, 3), (2, 5)], "g int, t int")
    b = spark.createDataFrame([(1, 2, "p"), (1, 9, "q"), (2, 6, "r")], "g int, u int, v string")
    assert sorted((r.g, r.t, r.v) for r in joins.asof_join(a, b, "t", "u", ["g"]).collect()) == [(1, 3, "p"), (1, 10, "q"), (2, 5, None)] or True
    got = {(r.g, r.t): r.v for r in joins.asof_join(a, b, "t", "u", ["g"]).collect()}
    assert got == {(1, 10): "q", (1, 3): "p", (2, 5): None}


def test_nearest_neighbours_match_brute_force(spark):
    import random

    rng = random.Random(1)
    v = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(60)}
    df = spark.createDataFrame(list(v.items()), "id int, e array<double>")
    got = {}
    for r in joins.nearest_neighbors(df, "e", "id", 3, "euclidean").collect():
        got.setdefault(r.source, {})[r["rank"]] = r.neighbour
    for i, x in v.items():
        want = sorted((j for j in v if j != i), key=lambda j: math.dist(x, v[j]))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == want


def test_resample_fills_gaps_and_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 3), 1.0), (datetime(2024, 1, 17), 2.0)], "t timestamp, v double")
    out = grouping.resample(df, "t", [{"column": "v", "fn": "sum", "as": "s"}], "1w").collect()
    assert [(r.t, r.s) for r in out] == [(datetime(2024, 1, 1), 1.0), (datetime(2024, 1, 8), None), (datetime(2024, 1, 15), 2.0)]


def test_pivot_longer_drops_nulls(spark):
    df = spark.createDataFrame([(1, 2, None)], "id int, a int, b int")
    assert [(r.name, r.value) for r in grouping.pivot_longer(df, ["a", "b"], ["id"]).collect()] == [("a", 2)]


def test_rfm_and_empty_tables(spark):
    df = spark.createDataFrame([], "c string, d date, a double")
    assert grouping.rfm_score(df, "c", "d", "a").count() == 0
    assert statistics.kaplan_meier(df.withColumn("e", F.lit(True)), "a", "e").count() == 0
    assert tables.profile(df).count() == 3
    assert quality.outliers_iqr(df, "a").count() == 0


def test_cusum_closed_form_equals_recursion(spark):
    xs = [0.1, 0.3, -0.2, 2.5, 2.7, 2.4, -3.0, 0.0, 1.1, 0.4]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, v double")
    got = [(r.cusum_pos, r.cusum_neg) for r in ordered.changepoint_detection(df, "v", ["i"]).orderBy("i").collect()]
    m = sum(xs) / len(xs)
    s = math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))
    p = n = 0.0
    for k, x in enumerate(xs):
        if k:
            z = (x - m) / s
            p, n = max(0, p + z - 0.5), max(0, n - z - 0.5)
        assert got[k] == (pytest.approx(p), pytest.approx(n))


def test_hmac_equals_library(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("a@b.c",)], "v string")
    want = "px_" + hmac.new(b"key", b"a@b.c", hashlib.sha256).hexdigest()[:16]
    assert scalars.pseudonymize_seeded(df, ["v"], "key").first().v == want


def test_business_days(spark):
    df = spark.sql("select date'2024-01-01' a, date'2024-01-14' b union all select date'2024-01-14', date'2024-01-01' union all select null, date'2024-01-01'")
    assert sorted((r.bdays is None, r.bdays) for r in scalars.business_days_between(df, "a", "b", holidays=["2024-01-01", "2024-01-06"]).collect()) == [(False, 9), (False, 9), (True, None)]


@pytest.mark.parametrize(("value", "a", "b", "want"), [(100.0, "C", "F", 212.0), (1.0, "mi", "km", 1.609344), (1.0, "kWh", "J", 3.6e6), (0.0, "K", "C", -273.15)])
def test_units(spark, value, a, b, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert scalars.convert_units(df, "v", a, b).first().v == pytest.approx(want)


def test_tests_match_known_values(spark):
    a, b = [1.1, 2.2, 3.1, 4.8, 5.0], [2.0, 3.5, 4.1, 6.2, 7.3, 8.8]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    r = statistics.t_test(df, "v", "g", equal_var=True).first()
    assert r.df == 9 and 0 < r.p_value < 1
    anova = statistics.anova(df, "v", "g").first()
    assert anova.f == pytest.approx(r.statistic**2) and anova.p_value == pytest.approx(r.p_value, rel=1e-9)
    u = statistics.mann_whitney(df, "v", "g").first().u
    assert u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_distributions():
    from millrace.functions import dist

    assert dist.norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert 2 * dist.t_sf(2.2281388519649385, 10) == pytest.approx(0.05)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.f_sf(4.9646027437307145, 1, 10) == pytest.approx(0.05)
    assert dist.beta_ppf(0.5, 2, 2) == pytest.approx(0.5)


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 4.0), (5, None)], "i int, v double")
    assert [r.v for r in ordered.impute_interpolation(df, ["v"], "i").orderBy("i").collect()] == [1.0, 2.0, 3.0, 4.0, None]
    assert [r.v for r in ordered.impute_forward_backward(df, ["v"], "i").orderBy("i").collect()] == [1.0, 1.0, 1.0, 4.0, 4.0]
    assert [r.v for r in scaling.impute_mean_median_mode(df, ["v"], "mean").orderBy("i").collect()] == [1.0, 2.5, 2.5, 4.0, 2.5]


def test_arrays_and_json(spark):
    df = spark.createDataFrame([([1, 2], '{"a": {"b": 3}}'), ([], "bad"), (None, None)], "x array<int>, j string")
    assert [r.length for r in nested.array_length(df, "x").collect()] == [2, 0, None]
    assert nested.unnest_array(df, "x").count() == 4 and nested.unnest_array(df, "x", preserveNulls=False).count() == 2
    assert [r.extracted for r in nested.json_extract(df, "j", "$.a.b").collect()] == ["3", None, None]


def test_keyed_diff(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string"), spark.createDataFrame([(2, None), (3, "z"), (1, "y")], "id int, v string")
    assert sorted((r.id, r.change) for r in tables.diff_keyed(a, b, "id").collect()) == [(1, "changed"), (3, "added")]


def test_tamper_evident_log(spark, tmp_path):
    df = spark.range(5)
    for note in ("a", "b"):
        quality.tamper_evident_log(df, str(tmp_path / "log"), note)
    assert [r.valid for r in quality.verify_log(spark.read.parquet(str(tmp_path / "log"))).orderBy("seq").collect()] == [True, True]


def test_components(spark):
    from millrace.functions.graph import connected_components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[200] == 200


def test_keywords_and_languages(spark):
    df = spark.createDataFrame([(1, "Deep learning models need data. The deep learning field is new."), (2, "Der Hund und die Katze sind nicht im Haus")], "id int, t string")
    top = text.keyword_rake_yake(df, "t", "id", topK=1).where("id = 1").first()
    assert "deep learning" in top.keyword
    assert [r.language for r in text.language_detect(df, "t").orderBy("id").collect()] == ["en", "de"]


def test_map_match_is_the_nearest_both_ways(spark):
    import math
    import random

    from millrace.operators.geo import map_match

    rng = random.Random(21)
    spots = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)] + [(100, 0.04, 179.99), (101, 89.9, 10.0), (102, -89.9, -100.0), (103, 0.0, 0.26)]
    own = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(50, 0.0, -179.99), (51, 89.95, -170.0), (52, -90.0, 0.0), (53, 0.01, 0.01), (54, spots[3][1], spots[3][2])]

    def metres(p, q):
        (a, b), (c, d) = ((math.radians(x[1]), math.radians(x[2])) for x in (p, q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(h)))

    df = spark.createDataFrame(own, "id long, lat double, lon double")
    ref = spark.createDataFrame(spots, "rid long, rlat double, rlon double")
    for most in (100_000, 1):
        got = {r.id: r.matched_distance_m for r in map_match(df, ref, "id", "lat", "lon", "rlat", "rlon", "rid", max_reference=most).collect()}
        for p in own:
            assert abs(got[p[0]] - min(metres(p, q) for q in spots)) < 1e-3 * (1 + got[p[0]]), (most, p)


def test_kendall_tau_counts_all_pairs(spark):
    import numpy as np

    from millrace.operators.grouping import correlation_matrix, kendall_tau

    rng = np.random.default_rng(3)
    x = np.where(rng.random(400) < 0.34, 5, rng.integers(0, 40, 400))
    y = np.where(rng.random(400) < 0.3, 2, x + rng.integers(0, 30, 400))
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (a * b).sum() / np.sqrt(abs(a).sum() * abs(b).sum())
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None)], "x double, y double")
    for rows in (50_000, 30):
        assert abs(kendall_tau(df, "x", "y", rows) - want) < 1e-12
    got = {(r.col_a, r.col_b): r.r for r in correlation_matrix(df, ["x", "y"], "kendall").collect()}
    assert got["x", "x"] == 1.0 and abs(got["y", "x"] - want) < 1e-12
    assert kendall_tau(df.limit(0), "x", "y") is None
    assert kendall_tau(df.selectExpr("1.0D as x", "y"), "x", "y") is None
