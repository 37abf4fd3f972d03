"""Projections and the shape of columns."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import NAME, finite, math_expr, num, place, safe_expr, with_stats
from millrace.plans.lineage import by_expression, computed, constant, origin, per_column
from millrace.plans.registry import operator

BASE_TYPES = {"string": "string", "integer": "bigint", "double": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}
#: Storage of the semantic types; those not listed are strings with a tag in the column's metadata.
META_TYPES = {"percentage": "decimal(9,6)", "currency": "decimal(18,4)", "bignum": "decimal(38,0)", "index": "bigint", "scientific": "double"}
TAGGED = ("decimal_string", "hex", "uuid", "email", "url", "ip", "phone", "country", "color", "timezone", "json")


def spark_type(name: str) -> str:
    found = BASE_TYPES.get(name) or META_TYPES.get(name) or ("string" if name in TAGGED else None)
    if not found:
        raise ValueError(f"unknown type {name}")
    return found


@operator(columns=("columns",))
def select_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Listed columns in listed order; an empty list passes all."""
    return df.select(*columns) if columns else df


@operator(columns=("order",))
def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """Listed columns first, the rest behind in input order."""
    return df.select(*order, *(c for c in df.columns if c not in order))


def _rules(df: DataFrame, mapping: list[dict] | dict[str, str]) -> dict[str, str]:
    """Column -> new name, of the columns that there are."""
    rules = {k.lower(): v for k, v in (mapping.items() if isinstance(mapping, dict) else ((m["from"], m["to"]) for m in mapping))}
    return {c: rules[c.lower()] for c in df.columns if c.lower() in rules}


@operator(lineage=lambda inputs, p, outputs: {new: origin("df", old, "rename") for old, new in _rules(inputs["df"], p["mapping"]).items()})
def rename_columns(df: DataFrame, mapping: list[dict] | dict[str, str]) -> DataFrame:
    """Batch rename, all rules at once, so that names can be swapped; two rules with one target, or a target that another column has, are errors."""
    rules = _rules(df, mapping)
    out = [rules.get(c, c) for c in df.columns]
    if len(set(out)) < len(out) and len(set(df.columns)) == len(out):
        raise ValueError("two columns would have one name")
    return df.toDF(*out)


@operator(lineage=constant("name", "defaultValue"))
def add_column(df: DataFrame, name: str, columnType: str = "string", defaultValue=None, position: str = "end", reference: str | None = None) -> DataFrame:
    """A typed constant, or a typed NULL."""
    return place(df, name, F.lit(defaultValue).cast(spark_type(columnType)), position, reference)


@operator(lineage=constant("name", "template"))
def add_runtime_column(df: DataFrame, name: str, template: str, columnType: str = "string", position: str = "end", now: datetime | None = None, variables: dict | None = None) -> DataFrame:
    """A constant rendered once for each run from a {{ }} template; times are UTC."""
    from millrace.plans.templates import render

    text = render(template, now or datetime.now(UTC), variables or {})
    return place(df, name, F.lit(text).cast(spark_type(columnType)), position)


@operator(lineage=by_expression("name", "expression", safe_expr))
def derive_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A column from a SQL expression."""
    if not NAME.match(name):
        raise ValueError(f"bad column name {name!r}")
    return df.withColumn(name, safe_expr(expression))


@operator(lineage=by_expression("resultName", "equation", math_expr))
def math_equation(df: DataFrame, resultName: str, equation: str, position: str = "end", reference: str | None = None) -> DataFrame:
    """A column from an equation in which ^ is a power and log has base 10; NaN and infinities become NULL."""
    return place(df, resultName, finite(math_expr(equation).cast("double")), position, reference)


@operator(columns=("column",), lineage=per_column("column", "cast"))
def cast_type(df: DataFrame, column: str, targetType: str = "string", strict: bool = False) -> DataFrame:
    """Cast in place to a base or semantic type; what cannot be cast becomes NULL, or with strict an error."""
    c, kind = F.col(column), spark_type(targetType)
    return df.withColumn(column, c.cast(kind) if strict else c.try_cast(kind)).withMetadata(column, {"semantic": targetType})


@operator(columns=("column",))
def cast_report(df: DataFrame, column: str, targetType: str = "string") -> DataFrame:
    """(total, source_null, source_non_null, cast_failures) of a cast."""
    c = F.col(column)
    failed = c.isNotNull() & c.try_cast(spark_type(targetType)).isNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(c.isNull()).alias("source_null"), F.count(c).alias("source_non_null"), F.count_if(failed).alias("cast_failures"))


@operator(columns=("columns",), lineage=computed("as_", "columns", transform="coalesce"))
def coalesce_columns(df: DataFrame, columns: list[str], as_: str, drop: bool = False) -> DataFrame:
    """The first value that is not NULL."""
    out = df.withColumn(as_, F.coalesce(*columns))
    return out.drop(*(c for c in columns if c != as_)) if drop else out


@operator(lineage=computed("outputColumn", "fields", transform="struct"))
def pack_struct(df: DataFrame, outputColumn: str, fields: list) -> DataFrame:
    """Columns as one struct; the columns stay."""
    pairs = [(f, f) if isinstance(f, str) else (f["column"], f.get("name", f["column"])) for f in fields]
    return df.withColumn(outputColumn, F.struct(*(F.col(c).alias(n) for c, n in pairs)))


@operator(columns=("column",), lineage=lambda inputs, p, outputs: {p["outputPrefix"] + f: origin("df", p["column"], "field", f) for f in p["fields"]})
def unpack_struct(df: DataFrame, column: str, fields: list[str], outputPrefix: str = "") -> DataFrame:
    """Struct fields as columns; the struct goes."""
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(outputPrefix + f) for f in fields))


@operator()
def passthrough(df: DataFrame) -> DataFrame:
    return df


@operator(columns=("column",), lineage=per_column("column", "upper"))
def upper_string(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.upper(column))


@operator(columns=("column",), lineage=per_column("column", "round"))
def round_to_n(df: DataFrame, column: str, decimals: int = 2) -> DataFrame:
    return df.withColumn(column, F.round(column, decimals))


@operator(columns=("column",), lineage=computed("output_column", "column", transform="zscore"))
def zscore(df: DataFrame, column: str, output_column: str = "z_score") -> DataFrame:
    """(x - mean) / sample deviation; 0 where the deviation is 0 or NULL."""
    s = with_stats(df, __m=F.mean(num(column)), __s=F.stddev_samp(num(column)))
    z = F.when(F.coalesce("__s", F.lit(0.0)) == 0, F.lit(0.0)).otherwise((num(column) - F.col("__m")) / F.col("__s"))
    return s.withColumn(output_column, z).drop("__m", "__s")


@operator()
def coerce_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become NULL."""
    kinds = dict(df.dtypes)
    return df.select(*(finite(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


@operator()
def nan_report(df: DataFrame) -> DataFrame:
    """(column, nan, inf) counts of the floating columns."""
    cols = [c for c, t in df.dtypes if t in ("double", "float")]
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(F.isnan(c)).alias("nan"), F.count_if(F.abs(F.col(c)) == float("inf")).alias("inf")) for c in cols]
    return df.agg(F.array(*counts).alias("x")).select(F.inline("x")) if cols else df.sparkSession.createDataFrame([], "column string, nan long, inf long")
