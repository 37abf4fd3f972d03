"""Arrays, vectors, matrices and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import finite
from millrace.operators.joins import distance
from millrace.plans.registry import operator


@operator(columns=("column",))
def array_length(df: DataFrame, column: str, outputColumn: str = "length") -> DataFrame:
    """0 for an empty array, NULL for NULL."""
    return df.withColumn(outputColumn, F.array_size(column))


@operator(columns=("column",))
def unnest_array(df: DataFrame, column: str, outputColumn: str | None = None, preserveNulls: bool = True) -> DataFrame:
    """A row for each element; with preserveNulls a NULL or empty array is one row with NULL."""
    fn = F.explode_outer if preserveNulls else F.explode
    return df.select(*(c for c in df.columns if c != column), fn(column).alias(outputColumn or column))


def _depth(kind: T.DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


@operator(columns=("arrayColumn",))
def flatten_array(df: DataFrame, arrayColumn: str, mode: str = "flatten_one_level", outputColumn: str | None = None, keepEmpty: bool = False) -> DataFrame:
    """One level, all levels (at most 8), or a row for each element."""
    out, c = outputColumn or arrayColumn, F.col(arrayColumn)
    depth = _depth(df.schema[arrayColumn].dataType)
    if mode == "unnest_to_rows":
        return df.withColumn(out, (F.explode_outer if keepEmpty else F.explode)(c))
    for _ in range(min(1, depth - 1) if mode == "flatten_one_level" else min(8, depth - 1)):
        c = F.flatten(c)
    return df.withColumn(out, c)


@operator(columns=("column",))
def json_extract(df: DataFrame, column: str, path: str = "$", outputColumn: str = "extracted", asText: bool = False) -> DataFrame:
    """The value at a JSON path, as JSON text or with asText as plain text; malformed JSON gives NULL."""
    if not path.startswith("$"):
        raise ValueError("a path starts with $")
    text = F.get_json_object(F.col(column), path)
    if asText:
        return df.withColumn(outputColumn, text)
    return df.withColumn(outputColumn, F.to_json(F.try_variant_get(F.try_parse_json(F.col(column)), path, "variant")))


@operator(columns=("leftColumn", "rightColumn"))
def vector_similarity(df: DataFrame, leftColumn: str, rightColumn: str, metric: str = "cosine", outputColumn: str = "similarity") -> DataFrame:
    """cosine, dot, or the euclidean or manhattan distance; NULL if a vector is NULL or a cosine has no length."""
    d = distance(F.col(leftColumn), F.col(rightColumn), metric)
    return df.withColumn(outputColumn, finite(1 - d if metric == "cosine" else -d if metric == "dot" else d))


@operator(columns=("leftColumn",))
def vector_arithmetic(df: DataFrame, leftColumn: str, op: str = "add", rightColumn: str | None = None, scalar: float = 1.0, outputColumn: str = "vector_result") -> DataFrame:
    """Element by element up to the shorter length, or with a number, or the unit vector or length."""
    a = F.transform(F.col(leftColumn), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    if op == "magnitude":
        c = size
    elif op == "normalize_l2":
        c = F.transform(a, lambda x: F.try_divide(x, size))
    elif op.startswith("scalar_"):
        c = F.transform(a, lambda x: x * float(scalar) if op == "scalar_multiply" else x + float(scalar))
    else:
        b = F.transform(F.col(rightColumn), lambda x: x.cast("double"))
        n = F.least(F.size(a), F.size(b))
        fn = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: F.try_divide(x, y)}[op]
        c = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), fn)
    return df.withColumn(outputColumn, c)


@operator()
def matrix_transpose(df: DataFrame, mode: str = "nested_list", nestedListColumn: str | None = None, outputColumn: str = "transposed", valueColumns: list[str] | None = None, indexColumn: str | None = None, max_rows: int = 1_000) -> DataFrame:
    """A nested list in each row, or the grid of value columns (at most max_rows rows, which become columns)."""
    if mode == "nested_list":
        m = F.col(nestedListColumn)
        cells = F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda i: F.transform(m, lambda r: F.get(r, i))))
        return df.withColumn(outputColumn, cells)
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    long = df.select(F.col(indexColumn).cast("string").alias("__i"), *(F.col(c).cast("double").alias(c) for c in valueColumns)).unpivot("__i", valueColumns, "column", "__v")
    return long.groupBy("column").pivot("__i").agg(F.first("__v"))
