"""Models on MLlib, and their evaluation."""

from __future__ import annotations

from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dist
from millrace.functions.expressions import num, with_stats
from millrace.functions.graph import connected_components
from millrace.plans.registry import operator
from millrace.scratch import settle


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Rows that are complete in the columns, with them as a vector."""
    cast = df.withColumns({f"__f{i}": num(c) for i, c in enumerate(columns)})
    names = [f"__f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol=out).transform(cast.dropna(subset=names)).drop(*names)


def _rejoin(df: DataFrame, key: str, scored: DataFrame, new: list[str]) -> DataFrame:
    """Rows that were left out get NULLs."""
    return df.join(scored.select(F.col(key).alias("__k"), *new), df[key] == F.col("__k"), "left").drop("__k")


@operator()
def linear_regression(df: DataFrame, y: str, x_columns: list[str], fit_intercept: bool = True, predicted_column: str = "predicted", residual_column: str = "residual", coefficients: bool = False) -> DataFrame:
    """Rows with prediction and residual, NULL where a column is; or (term, coefficient, r2). Ordinary least squares by the normal equations, one pass."""
    from pyspark.ml.regression import LinearRegression

    rows = assemble(df.withColumn("__y", num(y)).dropna(subset=["__y"]), x_columns)
    model = LinearRegression(featuresCol="features", labelCol="__y", fitIntercept=fit_intercept, solver="normal").fit(rows)
    terms = ([("intercept", float(model.intercept))] if fit_intercept else []) + [(c, float(v)) for c, v in zip(x_columns, model.coefficients, strict=True)]
    if coefficients:
        return df.sparkSession.createDataFrame([(t, v, float(model.summary.r2)) for t, v in terms], "term string, coefficient double, r2 double")
    fitted = sum((num(c) * float(v) for c, v in zip(x_columns, model.coefficients, strict=True)), F.lit(float(model.intercept)))
    return df.withColumn(predicted_column, fitted).withColumn(residual_column, num(y) - F.col(predicted_column))


def logistic_model(rows: DataFrame, label: str, regularization: str = "l2", c: float = 1.0):
    from pyspark.ml.classification import LogisticRegression

    n = max(1, rows.count())
    penalty = 0.0 if regularization == "none" else 1 / (c * n)
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=penalty, elasticNetParam=1.0 if regularization == "l1" else 0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)


@operator()
def logistic_regression(df: DataFrame, key: str, targetColumn: str, featureColumns: list[str], regularization: str = "l2", c: float = 1.0, predictedClassColumn: str = "predicted_class", predictedProbaColumn: str = "predicted_proba", coefficients: bool = False) -> DataFrame:
    """Binary fit (classes in text order): class and probability of the second class, or (term, coefficient)."""
    spark = df.sparkSession
    classes = [r[0] for r in df.select(F.col(targetColumn).cast("string")).where(F.col(targetColumn).isNotNull()).distinct().orderBy(F.col(targetColumn).cast("string")).limit(3).collect()]
    if len(classes) != 2:
        raise ValueError("the target needs two classes")
    rows = assemble(df.where(F.col(targetColumn).isNotNull()).withColumn("__y", (F.col(targetColumn).cast("string") == classes[1]).cast("double")), featureColumns).persist()
    model = logistic_model(rows, "__y", regularization, c)
    if coefficients:
        return spark.createDataFrame([("intercept", float(model.intercept)), *((n, float(v)) for n, v in zip(featureColumns, model.coefficients, strict=True))], "term string, coefficient double")
    scored = model.transform(assemble(df, featureColumns)).select(key, vector_to_array("probability")[1].alias(predictedProbaColumn))
    scored = scored.withColumn(predictedClassColumn, F.when(F.col(predictedProbaColumn) >= 0.5, classes[1]).otherwise(classes[0]))
    return _rejoin(df, key, scored, [predictedClassColumn, predictedProbaColumn])


def _glm(df: DataFrame, target: str, features: list[str], family: str, link: str) -> DataFrame:
    """(term, estimate, std_error, z, p_value, lower, upper, n, deviance, aic)."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = assemble(df.withColumn("__y", num(F.col(target).cast("double"))).dropna(subset=["__y"]), features)
    m = GeneralizedLinearRegression(family=family, link=link, labelCol="__y", maxIter=100, tol=1e-10).fit(rows)
    s = m.summary
    se, names = list(s.coefficientStandardErrors), [*features, "intercept"]
    est = [*map(float, m.coefficients), float(m.intercept)]
    out = [(n, e, float(v), e / v if v else None, 2 * dist.norm_cdf(-abs(e / v)) if v else None, e - 1.959964 * v, e + 1.959964 * v, int(s.numInstances), float(s.deviance), float(s.aic)) for n, e, v in zip(names, est, se, strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, z double, p_value double, lower double, upper double, n long, deviance double, aic double")


@operator()
def glm_logit(df: DataFrame, targetColumn: str, featureColumns: list[str]) -> DataFrame:
    return _glm(df, targetColumn, featureColumns, "binomial", "logit")


@operator()
def glm_probit(df: DataFrame, targetColumn: str, featureColumns: list[str]) -> DataFrame:
    return _glm(df, targetColumn, featureColumns, "binomial", "probit")


@operator()
def glm_poisson(df: DataFrame, targetColumn: str, featureColumns: list[str]) -> DataFrame:
    return _glm(df, targetColumn, featureColumns, "poisson", "log")


def _standard(rows: DataFrame, scale: bool) -> DataFrame:
    from pyspark.ml.feature import StandardScaler

    if not scale:
        return rows.withColumn("scaled", F.col("features"))
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(rows).transform(rows)


@operator()
def pca(df: DataFrame, key: str, columns: list[str], n_components: int = 2, scale: bool = True, ratios: bool = False) -> DataFrame:
    """PC1..PCk, NULL for incomplete rows; or (component, variance_ratio). Each component's largest loading is positive."""
    from pyspark.ml.feature import PCA

    rows = _standard(assemble(df, columns), scale).persist()
    model = PCA(k=n_components, inputCol="scaled", outputCol="pc").fit(rows)
    if ratios:
        return df.sparkSession.createDataFrame([(f"PC{i + 1}", float(v)) for i, v in enumerate(model.explainedVariance)], "component string, variance_ratio double")
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, i]).argmax(), i] >= 0 else -1.0 for i in range(n_components)]
    pcs = model.transform(rows).select(key, *((vector_to_array("pc")[i] * signs[i]).alias(f"PC{i + 1}") for i in range(n_components)))
    return _rejoin(df, key, pcs, [f"PC{i + 1}" for i in range(n_components)])


@operator()
def kmeans(df: DataFrame, key: str, columns: list[str], k: int = 4, scale: bool = True, seed: int = 42, output_column: str = "cluster", report: bool = False) -> DataFrame:
    """Cluster of each row, NULL for incomplete ones; or (cluster, size, inertia)."""
    from pyspark.ml.clustering import KMeans

    rows = _standard(assemble(df, columns), scale).persist()
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol=output_column).fit(rows)
    scored = model.transform(rows)
    if report:
        return scored.groupBy(F.col(output_column).alias("cluster")).agg(F.count(F.lit(1)).alias("size")).withColumn("inertia", F.lit(float(model.summary.trainingCost)))
    return _rejoin(df, key, scored, [output_column])


#: Halvings of a cell's side after which single points are compared.
MOST_HALVINGS = 16


def _square_gap(lo: str, hi: str, lo2: str, hi2: str, far: bool) -> Column:
    """Square of the least (or greatest) distance between two boxes given by their corners."""
    sides = F.arrays_zip(*(F.col(c).alias(f"c{i}") for i, c in enumerate((lo, hi, lo2, hi2))))
    if far:
        one = lambda x: F.greatest(x["c1"] - x["c2"], x["c3"] - x["c0"])
    else:
        one = lambda x: F.greatest(x["c0"] - x["c3"], x["c2"] - x["c1"], F.lit(0.0))
    return F.aggregate(sides, F.lit(0.0), lambda s, x: s + one(x) * one(x))


def _boxes(points: DataFrame, by: list[str], d: int) -> DataFrame:
    """The corners of the points of each group."""
    low, high = ([f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in range(d)] for f, n in ((F.min, "l"), (F.max, "h")))
    return points.groupBy(*by).agg(*low, *high).select(*by, F.array(*(f"l{i}" for i in range(d))).alias("lo"), F.array(*(f"h{i}" for i in range(d))).alias("hi"))


def _cell_pairs(cells: DataFrame, eps: float, d: int) -> DataFrame:
    """(cid, other) of different cells whose boxes come within eps, both ways; cells meet over buckets of twice eps in the first three columns."""
    dims = min(3, d)
    bucket = [F.floor(F.get("lo", F.lit(i)) / (2 * eps)) for i in range(dims)]
    steps = F.explode(F.array(*(F.array(*(F.lit(o) for o in step)) for step in product((-1, 0, 1), repeat=dims))))
    a = cells.select("cid", "lo", "hi", F.array(*bucket).alias("bucket"))
    b = cells.select(F.col("cid").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.array(*bucket).alias("at"), steps.alias("step")).withColumn("bucket", F.zip_with("at", "step", lambda x, y: x + y))
    return a.join(b, "bucket").where("cid <> other").where(_square_gap("lo", "hi", "lo2", "hi2", False) <= eps * eps).select("cid", "other")


def _linked(cores: DataFrame, pairs: DataFrame, eps: float, side: float, d: int) -> DataFrame:
    """(cid, other) of the pairs of cells that hold two core points within eps.

    Boxes of core points decide: wholly within eps, or wholly apart. What neither holds for is halved, both cells' parts, and
    in the end single points are compared, so that two crowded cells meet by a few boxes and never point by point.
    """
    limit = eps * eps
    near, far = (_square_gap("lo", "hi", "lo2", "hi2", x) for x in (False, True))
    box = _boxes(cores.withColumn("part", F.array().cast("array<double>")), ["cid", "part"], d)
    open_pairs = pairs.select("cid", F.array().cast("array<double>").alias("part"), "other", F.array().cast("array<double>").alias("part2"))
    done = None
    for level in range(1, MOST_HALVINGS + 2):
        other = box.select(F.col("cid").alias("other"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        judged = settle(open_pairs.join(box, ["cid", "part"]).join(other, ["other", "part2"]).where(near <= limit).withColumn("sure", far <= limit), "dbscan-boxes")
        sure = judged.where("sure").select("cid", "other").distinct()
        done = sure if done is None else done.unionByName(sure)
        unsure = settle(judged.where("not sure").join(sure, ["cid", "other"], "left_anti").select("cid", "part", "other", "part2"), "dbscan-unsure")
        if not unsure.limit(1).count() or level > MOST_HALVINGS:
            break
        cells = unsure.select("cid").unionByName(unsure.select(F.col("other").alias("cid"))).distinct()
        step = side / 2**level
        at = lambda s: F.transform("v", lambda x: F.floor(x / s).cast("double"))
        parent = F.array().cast("array<double>") if level == 1 else at(2 * step)
        part = at(step) if level < MOST_HALVINGS else F.col("v")
        inside = cores.join(cells, "cid", "left_semi").select("cid", "v", parent.alias("parent"), part.alias("part"))
        split = settle(_boxes(inside, ["cid", "parent", "part"], d), "dbscan-parts")
        one = split.select("cid", F.col("parent").alias("part"), F.col("part").alias("new"))
        two = split.select(F.col("cid").alias("other"), F.col("parent").alias("part2"), F.col("part").alias("new2"))
        open_pairs = unsure.join(one, ["cid", "part"]).join(two, ["other", "part2"]).select("cid", F.col("new").alias("part"), "other", F.col("new2").alias("part2"))
        box = split.select("cid", "part", "lo", "hi")
    return done


@operator()
def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 0.5, min_samples: int = 5, scale: bool = True, output_column: str = "cluster") -> DataFrame:
    """Density clusters named by the least key of their core points, -1 for noise, NULL for rows with a missing or infinite value.

    Points fall into cells whose diagonal is eps. All points of a cell with min_samples points are cores, uncounted; only
    points of sparser cells are compared with the points of cells around. Cores of one cell belong together, so cells are what
    is joined into clusters, by boxes around their cores. A border point goes to the cluster of the least name. Labels have
    the key's type; repeated keys are rows of their own.
    """
    d, own = len(columns), settle(df.withColumn("__row", F.monotonically_increasing_id()), "dbscan-rows")
    values = [num(c) for c in columns]
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    complete = own.where(whole)
    stats = {f"m{i}": F.mean(v) for i, v in enumerate(values)} | {f"s{i}": F.stddev_pop(v) for i, v in enumerate(values)}
    base = with_stats(complete, **{f"__{k}": v for k, v in stats.items()})
    unit = lambda i, v: (v - F.col(f"__m{i}")) / F.when(F.coalesce(f"__s{i}", F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__s{i}")) if scale else v
    side = float(eps) / d**0.5 * (1 - 1e-9)
    pts = settle(base.select(F.col("__row").alias("row"), F.col(key).alias("k"), F.array(*(unit(i, v) for i, v in enumerate(values))).alias("v")).withColumn("cell", F.transform("v", lambda x: F.floor(x / side))), "dbscan-points")
    sizes = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = _boxes(pts, ["cell"], d).join(sizes, "cell")
    cells = settle(settle(cells, "dbscan-cells").select(F.monotonically_increasing_id().alias("cid"), "*"), "dbscan-cells")
    pts = settle(pts.join(cells.select("cell", "cid", (F.col("n") >= min_samples).alias("dense")), "cell").select("row", "k", "v", "cid", "dense"), "dbscan-points")
    pairs = settle(_cell_pairs(cells, float(eps), d), "dbscan-pairs")

    sparse = pts.where("not dense").select("row", "cid", F.col("v").alias("x"))
    around = pairs.unionByName(cells.select("cid", F.col("cid").alias("other")))
    gap = F.aggregate(F.zip_with("x", "v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
    asked = sparse.join(around, "cid").select("row", "x", "other")
    hits = asked.join(pts.select(F.col("cid").alias("other"), "v"), "other").where(gap <= float(eps * eps)).groupBy("row", "other").agg(F.count(F.lit(1)).alias("n"))
    hits = settle(hits, "dbscan-hits")
    counted = hits.groupBy("row").agg((F.sum("n") >= min_samples).alias("core"))
    pts = settle(pts.join(counted, "row", "left").withColumn("core", F.col("dense") | F.coalesce("core", F.lit(False))), "dbscan-cores")
    cores = pts.where("core")

    links = _linked(cores.select("cid", "v"), pairs.where("cid < other"), float(eps), side, d)
    comp = connected_components(links, "cid", "other").withColumnRenamed("node", "cid")
    held = cores.groupBy("cid").agg(F.min("k").alias("least")).join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    label = held.join(held.groupBy("component").agg(F.min("least").alias("label")), "component").select("cid", "label")
    label = settle(label, "dbscan-labels")

    border = pts.where("not core").select("row", F.col("v").alias("x"))
    dense = cells.where(F.col("n") >= min_samples).select(F.col("cid").alias("other"))
    by_cell = hits.join(border.select("row"), "row", "left_semi").join(dense, "other", "left_semi").select("row", "other")
    by_point = border.join(hits.select("row", "other"), "row").join(cores.where("not dense").select(F.col("cid").alias("other"), "v"), "other").where(gap <= float(eps * eps)).select("row", "other")
    edge = by_cell.unionByName(by_point).join(label.withColumnRenamed("cid", "other"), "other").groupBy("row").agg(F.min("label").alias("__label"))
    inner = cores.join(label, "cid").select("row", F.col("label").alias("__label"))
    found = inner.unionByName(edge).withColumnRenamed("row", "__row")
    noise = F.lit(-1).cast(df.schema[key].dataType)
    return own.join(found, "__row", "left").withColumn(output_column, F.when(whole, F.coalesce("__label", noise))).drop("__row", "__label")


@operator()
def semantic_cluster(df: DataFrame, key: str, embedding_column: str, n_clusters: int = 8, seed: int = 42, output_column: str = "cluster", linkage: str = "single") -> DataFrame:
    """Clusters by cosine distance, numbered from 0; NULL for rows without a vector, with a gap in it or of length zero.

    single: agglomerative clustering with single linkage, exact, from a minimum spanning tree (``linkage.single_linkage``);
    fewer rows than clusters are an error. bisecting: bisecting k-means, a top-down hierarchy.
    """
    if linkage == "single":
        from millrace.operators.linkage import single_linkage

        return single_linkage(df, key, embedding_column, n_clusters, output_column)
    if linkage != "bisecting":
        raise ValueError(f"linkage {linkage!r} is neither single nor bisecting")
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(embedding_column).isNotNull()).withColumn("features", array_to_vector(F.col(embedding_column).cast("array<double>"))).persist()
    scored = BisectingKMeans(k=n_clusters, seed=seed, distanceMeasure="cosine", predictionCol=output_column).fit(rows).transform(rows)
    return _rejoin(df, key, scored, [output_column])


def _booster(df: DataFrame, target: str, features: list[str], task: str, seed: int):
    """(rows, model, score(column of predictions) as a column, task)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor

    few = df.select(target).distinct().limit(21).count() <= 20
    numeric = dict(df.dtypes)[target] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)[target].startswith("decimal")
    kind = task if task != "auto" else ("classification" if few or not numeric else "regression")
    if kind == "regression":
        rows = assemble(df.withColumn("__y", num(target)).dropna(subset=["__y"]), features)
        return rows, GBTRegressor(labelCol="__y", featuresCol="features", maxIter=20, seed=seed).fit(rows), kind
    classes = df.select(F.col(target).cast("string").alias("c")).dropna().groupBy("c").count().orderBy("c").collect()
    ids = F.create_map(*(x for i, r in enumerate(classes) for x in (F.lit(r.c), F.lit(float(i)))))
    rows = assemble(df.where(F.col(target).isNotNull()).withColumn("__y", F.element_at(ids, F.col(target).cast("string"))), features)
    return rows, RandomForestClassifier(labelCol="__y", featuresCol="features", numTrees=30, seed=seed).fit(rows), kind


def _shuffle_column(rows: DataFrame, features: list[str], at: int, seed: int) -> DataFrame:
    """The feature vector with one value taken from another row: values and rows are paired by their ranks in two random orders."""
    from pyspark.ml.functions import array_to_vector

    v = rows.withColumn("__a", vector_to_array("features"))
    part = F.pmod(F.xxhash64(F.lit(seed), "__a", F.monotonically_increasing_id()), F.lit(64))
    v = v.withColumn("__p", part)
    w = lambda s: Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(s), "__a", "__y"))
    v = v.withColumn("__r", F.row_number().over(w(seed)))
    other = v.select("__p", F.row_number().over(w(seed + 7919)).alias("__r"), F.get("__a", F.lit(at)).alias("__new"))
    mixed = v.join(other, ["__p", "__r"])
    return mixed.withColumn("features", array_to_vector(F.transform(F.col("__a"), lambda x, i: F.when(i == at, F.col("__new")).otherwise(x)))).select("features", "__y")


@operator()
def permutation_importance(df: DataFrame, target: str, features: list[str], task: str = "auto", n_repeats: int = 3, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std, rank): the fall of r2 or accuracy when a feature is shuffled."""
    import statistics

    rows, model, kind = _booster(df, target, features, task, seed)
    rows = rows.select("features", "__y").persist()

    def score(x: DataFrame) -> float:
        p = model.transform(x)
        if kind == "regression":
            return p.agg(1 - F.sum(F.pow(F.col("__y") - F.col("prediction"), 2)) / F.nullif(F.var_pop("__y") * F.count(F.lit(1)), F.lit(0.0))).first()[0] or 0.0
        return p.agg(F.mean((F.col("__y") == F.col("prediction")).cast("double"))).first()[0] or 0.0

    base = score(rows)
    out = []
    for i, f in enumerate(features):
        falls = [base - score(_shuffle_column(rows, features, i, seed + r)) for r in range(n_repeats)]
        out.append((f, statistics.fmean(falls), statistics.pstdev(falls)))
    out.sort(key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(*x, i + 1) for i, x in enumerate(out)], "feature string, importance_mean double, importance_std double, rank int")


@operator()
def partial_dependence(df: DataFrame, target: str, features: list[str], explain_feature: str, task: str = "auto", grid_resolution: int = 10, seed: int = 42) -> DataFrame:
    """(value, mean_prediction) over a quantile grid of one feature, averaged over all rows; of classes, the last one's probability."""
    from pyspark.ml.functions import array_to_vector

    rows, model, kind = _booster(df, target, features, task, seed)
    at = features.index(explain_feature)
    grid = df.agg(F.array_sort(F.array_distinct(F.percentile(num(explain_feature), F.array(*(F.lit(i / (grid_resolution - 1)) for i in range(grid_resolution)))))).alias("g"))
    values = grid.first()["g"] or []  # at most grid_resolution numbers
    points = rows.select(vector_to_array("features").alias("a"), F.explode(F.array(*(F.lit(float(v)) for v in values)).cast("array<double>")).alias("value"))
    x = points.withColumn("features", array_to_vector(F.transform("a", lambda v, i: F.when(i == at, F.col("value")).otherwise(v))))
    p = model.transform(x)
    out = F.col("prediction") if kind == "regression" else F.element_at(vector_to_array("probability"), -1)
    return p.groupBy("value").agg(F.mean(out).alias("mean_prediction")).orderBy("value")


def _ranked_scores(df: DataFrame, actual: str, score: str, positive: str) -> DataFrame:
    """(threshold, tp, fp, P, N): counts at each distinct score, cumulated from the highest. Rows are counted first."""
    hit = F.col(actual).cast("string") == positive
    rows = df.select(num(score).alias("threshold"), hit.alias("h")).dropna()
    c = rows.groupBy("threshold").agg(F.count_if("h").alias("p"), F.count_if(~F.col("h")).alias("n"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    tot = rows.agg(F.count_if("h").alias("P"), F.count_if(~F.col("h")).alias("N"))
    return c.select("threshold", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp")).crossJoin(F.broadcast(tot))


def auc(df: DataFrame, actual: str, score: str, positive: str = "1") -> DataFrame:
    """(auc), by average ranks."""
    from millrace.operators.grouping import average_rank

    rows = df.select(num(score).alias("s"), (F.col(actual).cast("string") == positive).alias("h")).dropna()
    r = average_rank(rows, "s", "r").agg(F.sum(F.when(F.col("h"), F.col("r"))).alias("r"), F.count_if("h").cast("double").alias("p"), F.count_if(~F.col("h")).cast("double").alias("n"))
    return r.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


@operator()
def roc_curve(df: DataFrame, actual: str, probability: str, positive_label: str = "1") -> DataFrame:
    """(fpr, tpr, threshold, auc), all points, from (0, 0) at threshold 1.01 on."""
    c = _ranked_scores(df, actual, probability, positive_label)
    pts = c.select(F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"), "threshold")
    start = df.sparkSession.createDataFrame([(0.0, 0.0, 1.01)], "fpr double, tpr double, threshold double")
    return start.unionByName(pts).crossJoin(F.broadcast(auc(df, actual, probability, positive_label))).orderBy(F.desc("threshold"))


@operator()
def pr_curve(df: DataFrame, actualColumn: str, probaColumn: str, positive_label: str = "1") -> DataFrame:
    """(precision, recall, threshold, average_precision)."""
    c = _ranked_scores(df, actualColumn, probaColumn, positive_label).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", "P"))
    gain = F.col("recall") - F.coalesce(F.lag("recall").over(Window.orderBy(F.desc("threshold"))), F.lit(0.0))
    c = c.withColumn("__g", gain)
    return c.select("precision", "recall", "threshold").crossJoin(F.broadcast(c.agg(F.sum(F.col("__g") * F.col("precision")).alias("average_precision")))).orderBy(F.desc("threshold"))


@operator()
def model_metrics(df: DataFrame, actual: str, predicted: str, task: str = "auto", probability_column: str | None = None, positive_label: str = "1") -> DataFrame:
    """(metric, value): rmse, mae, r2; or accuracy, macro precision, recall and f1, and with probabilities auc and log_loss. auto: numbers with more than 20 values are regression."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    numeric = dict(df.dtypes)[actual] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)[actual].startswith("decimal")
    if task == "regression" or task == "auto" and numeric and rows.select(actual).distinct().limit(21).count() > 20:
        e = num(actual) - num(predicted)
        m = rows.agg(F.sqrt(F.mean(e * e)).alias("rmse"), F.mean(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(num(actual)) * F.count(F.lit(1)))).alias("r2"))
        return m.unpivot([], ["rmse", "mae", "r2"], "metric", "value")
    c = rows.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = c.select(F.col("a").alias("k"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("pred"), F.col("n").alias("act")).unionByName(c.select(F.col("p").alias("k"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("act"))).groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("act").alias("act"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    pr, rc = zero(F.try_divide("tp", "pred")), zero(F.try_divide("tp", "act"))
    f1 = zero(F.try_divide(2 * pr * rc, pr + rc))
    m = per.agg((F.sum("tp") / F.sum("act")).alias("accuracy"), F.mean(pr).alias("precision_macro"), F.mean(rc).alias("recall_macro"), F.mean(f1).alias("f1_macro"))
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]
    if probability_column:
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), num(probability_column)))
        h = F.col(actual).cast("string") == positive_label
        m = m.crossJoin(auc(rows, actual, probability_column, positive_label)).crossJoin(rows.agg((-F.mean(F.when(h, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss")))
        names += ["auc", "log_loss"]
    return m.unpivot([], names, "metric", "value")


@operator()
def calibration_curve(df: DataFrame, actualColumn: str, probaColumn: str, bins: int = 10, strategy: str = "uniform", positive_label: str = "1") -> DataFrame:
    """(bin, n, mean_predicted, observed, brier)."""
    rows = df.select((F.col(actualColumn).cast("string") == positive_label).cast("double").alias("y"), num(probaColumn).alias("p")).dropna()
    if strategy == "uniform":
        b = rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int"))
    else:
        edges = rows.agg(F.percentile("p", F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("q"))
        b = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("q", lambda q: F.col("p") > q)))
    brier = rows.agg(F.mean(F.pow(F.col("y") - F.col("p"), 2)).alias("brier"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.mean("p").alias("mean_predicted"), F.mean("y").alias("observed")).crossJoin(F.broadcast(brier)).orderBy("bin")


def _by_score(df: DataFrame, actual: str, score: str, key: str, positive: str) -> DataFrame:
    """Rows numbered by falling score (ties by key), without one task for all."""
    from millrace.operators.rows import numbered

    rows = df.select(F.col(key).alias("k"), (F.col(actual).cast("string") == positive).cast("int").alias("y"), num(score).alias("p")).dropna()
    return numbered(rows, [{"column": "p", "desc": True}, "k"], "rn").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))))


@operator()
def gain_chart(df: DataFrame, actualColumn: str, probaColumn: str, key: str, positive_label: str = "1", points: int = 100) -> DataFrame:
    """(population, gain): share of positives among the highest-scored share of rows, at whole percents."""
    rows = _by_score(df, actualColumn, probaColumn, key, positive_label).withColumn("b", F.ceil(F.col("rn") * points / F.col("n")))
    c = rows.groupBy("b").agg(F.sum("y").alias("y"), F.max("pos").alias("pos"), (F.max("rn") / F.max("n")).alias("population"))
    return c.select("population", F.try_divide(F.sum("y").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), F.col("pos")).alias("gain")).orderBy("population")


@operator()
def lift_chart(df: DataFrame, actualColumn: str, probaColumn: str, key: str, buckets: int = 10, positive_label: str = "1") -> DataFrame:
    """(bucket, n, positives, lift, cumulative_lift) of buckets that end at row int(b n / k)."""
    rows = _by_score(df, actualColumn, probaColumn, key, positive_label).withColumn("bucket", F.ceil(F.col("rn") * buckets / F.col("n")).cast("int"))
    c = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.max(F.col("pos") / F.col("n")).alias("base"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("bucket", "n", "positives", F.try_divide(F.col("positives") / F.col("n"), F.col("base")).alias("lift"), F.try_divide(F.sum("positives").over(w) / F.sum("n").over(w), F.col("base")).alias("cumulative_lift")).orderBy("bucket")

