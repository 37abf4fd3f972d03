"""Shared by the text operators: ASCII words and Arrow batches."""

from __future__ import annotations

import contextlib
import functools
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; Java and Python read the pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    """bytes.split() cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.split() if text else []


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(column: str) -> Column:
    """UTF-8 bytes: Arrow hands them to Python without decoding."""
    return F.col(column).cast("binary")


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Small slices of the batches with their columns as Python lists, so that long texts do not pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, [c.to_pylist() for c in part.columns]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs that run meanwhile hand Python at most ``rows`` rows at once (10,000 are usual), so that neither side holds thousands of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def one_row_for(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def extras_apart(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of (docs, ..., *_col) that return docs' own columns: columns that no *_col parameter names are called otherwise while fn works, so that none clashes with fn's own."""
    known = inspect.signature(fn)

    @functools.wraps(fn)
    def wrapped(docs: DataFrame, *args, **kw) -> DataFrame:
        bound = known.bind(docs, *args, **kw)
        bound.apply_defaults()
        used = {v for k, v in bound.arguments.items() if k.endswith("_col")}
        named = {c: c if c in used else f"extra_{i}_of_docs" for i, c in enumerate(docs.columns)}
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        out = fn(docs.select(*(quoted(c).alias(n) for c, n in named.items())), *args, **kw)
        return out.select(*(quoted(n).alias(c) for c, n in named.items()))

    return wrapped
