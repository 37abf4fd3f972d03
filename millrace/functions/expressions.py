"""Column expressions that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DENIED = re.compile(r";|--|/\*|\b(reflect|java_method|try_reflect|select|insert|update|delete|drop|create|alter|attach|copy|load|call)\b", re.I)
NAME = re.compile(r"^[A-Za-z_][\w ]*$")


def safe_expr(text: str) -> Column:
    """A scalar SQL expression; statements, comments, subqueries and reflection are refused."""
    if not text or not text.strip() or DENIED.search(re.sub(r"'(?:[^']|'')*'", "''", text)):
        raise ValueError(f"expression not allowed: {text!r}")
    return F.expr(text)


def math_expr(text: str) -> Column:
    """An equation in which ^ is a power and log has base 10."""
    if DENIED.search(text):
        raise ValueError(f"expression not allowed: {text!r}")
    text = re.sub(r"\blog\s*\(", "log10(", text, flags=re.I)
    operand = r"(?:\w+(?:\.\w+)?\s*\([^()]*\)|\([^()]*\)|[\w.]+)"
    while "^" in text:
        new = re.sub(rf"({operand})\s*\^\s*(-?{operand})(?!\s*\^)", r"power(\1, \2)", text, count=1)
        if new == text:
            raise ValueError(f"cannot read the power in {text!r}")
        text = new
    return F.expr(text)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def num(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def names(text: str | list[str]) -> list[str]:
    """A comma-separated list, or a list."""
    return [x.strip() for x in text.split(",") if x.strip()] if isinstance(text, str) else list(text)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def order(by: list) -> list[Column]:
    """Order keys: names, or {column, desc}; NULLs are last both ways."""
    out = []
    for x in by:
        c, desc = (x, False) if isinstance(x, str) else (x["column"], x.get("desc") or str(x.get("direction", "")).lower() == "desc")
        out.append(F.desc_nulls_last(c) if desc else F.asc_nulls_last(c))
    return out


def window(partition_by: list[str] | None = None, order_by: list | None = None):
    w = Window.partitionBy(*(partition_by or []))
    return w.orderBy(*order(order_by)) if order_by else w


def place(df: DataFrame, name: str, c: Column, position: str = "end", reference: str | None = None) -> DataFrame:
    """Add a column at the start, the end, or before or after another."""
    rest = [x for x in df.columns if x != name]
    at = {"start": 0, "end": len(rest)}.get(position)
    if at is None:
        if reference not in rest:
            raise ValueError(f"no column {reference}")
        at = rest.index(reference) + (position == "after")
    return df.select(*(F.col(f"`{x}`") for x in rest[:at]), c.alias(name), *(F.col(f"`{x}`") for x in rest[at:]))


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """Every row beside one row of aggregates over the whole table."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in stats.items()))))


def percentile(c: str | Column, q: float | list[float]) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(num(c), q if not isinstance(q, list) else F.array(*(F.lit(float(x)) for x in q)))


def row_hash(df: DataFrame) -> Column:
    """Hash of all values of a row, whatever the order of columns."""
    return F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
