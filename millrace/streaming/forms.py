"""Operators over unbounded tables: watermarks bound what is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.grouping import aggregate
from millrace.operators.quality import expectations


def windowed(df: DataFrame, time_column: str, size: str, aggregations: list[dict], slide: str | None = None, by: list[str] | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding aggregates; rows later than the watermark are dropped."""
    w = F.window(time_column, size, slide) if slide else F.window(time_column, size)
    out = df.withWatermark(time_column, lateness).groupBy(w.alias("window"), *(by or [])).agg(*(aggregate(a) for a in aggregations))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))


def sessions(df: DataFrame, time_column: str, user_column: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user, session_start, session_end, events) of activity without a pause of ``gap``."""
    out = df.withWatermark(time_column, lateness).groupBy(F.session_window(time_column, gap).alias("s"), F.col(user_column)).agg(F.count(F.lit(1)).alias("events"))
    return out.select(user_column, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def deduplicate(df: DataFrame, keys: list[str], time_column: str, lateness: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark(keys)


def page_hinkley(df: DataFrame, key_column: str, time_column: str, value_column: str, threshold: float = 50.0, delta: float = 0.005) -> DataFrame:
    """(key, time, value, ph_stat, drift): the drift statistic of each sensor, kept in state across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, cum, least = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = []
        for x in pd.concat(list(frames)).sort_values(time_column).itertuples(index=False):
            v = getattr(x, value_column)
            if v is None or v != v:
                continue
            n, total = n + 1, total + v
            cum += v - total / n - delta
            least = min(least, cum)
            rows.append((key[0], getattr(x, time_column), v, cum - least, cum - least > threshold))
        state.update((n, total, cum, least))
        yield pd.DataFrame(rows, columns=["key", "time", "value", "ph_stat", "drift"])

    kind = dict(df.dtypes)[key_column]
    rows = df.select(key_column, time_column, F.col(value_column).cast("double").alias(value_column))
    return rows.groupBy(key_column).applyInPandasWithState(step, f"key {kind}, time timestamp, value double, ph_stat double, drift boolean", "n long, total double, cum double, least double", "append", "NoTimeout")


def sprt(df: DataFrame, key_column: str, time_column: str, converted_column: str, p0: float, p1: float, alpha: float = 0.05, beta: float = 0.2) -> DataFrame:
    """(key, n, llr, decision) after each batch; a decision once made stays."""
    import math

    up, down = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    a, b = math.log(p1 / p0), math.log((1 - p1) / (1 - p0))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, llr, decision = state.get if state.exists else (0, 0.0, "continue")
        for x in pd.concat(list(frames)).sort_values(time_column)[converted_column]:
            n, llr = n + 1, llr + (a if x else b)
            if decision == "continue":
                decision = "accept_h1" if llr >= up else "accept_h0" if llr <= down else decision
        state.update((n, llr, decision))
        yield pd.DataFrame([(key[0], n, llr, decision)], columns=["key", "n", "llr", "decision"])

    kind = dict(df.dtypes)[key_column]
    return df.select(key_column, time_column, F.col(converted_column).cast("boolean").alias(converted_column)).groupBy(key_column).applyInPandasWithState(step, f"key {kind}, n long, llr double, decision string", "n long, llr double, decision string", "update", "NoTimeout")


def expect_each_batch(df: DataFrame, rules: list[dict], sink: Callable[[DataFrame, int], None], results: str, quarantine: Callable[[DataFrame, int], None] | None = None):
    """A writer that checks every micro-batch; results are appended as Parquet, and a batch that fails goes to ``quarantine`` instead of ``sink``."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        found = expectations(batch, rules).withColumn("epoch", F.lit(epoch))
        found.write.mode("append").parquet(results)
        failed = found.where("not passed").limit(1).count() > 0
        (quarantine if failed and quarantine else sink)(batch, epoch)
        batch.unpersist()

    return df.writeStream.foreachBatch(each)


def lookup(stream: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A stream against a static table."""
    return stream.join(table, on, how)


def interval_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, within: str, lateness: str = "10 minutes") -> DataFrame:
    """Rows of two streams with one key, the right one at most ``within`` after the left one."""
    a, b = left.withWatermark(left_time, lateness).alias("a"), right.withWatermark(right_time, lateness).alias("b")
    t, u = F.col(f"a.{left_time}"), F.col(f"b.{right_time}")
    joined = a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & (u >= t) & (u <= t + F.expr(f"interval {within}")))
    return joined.select("a.*", *(F.col(f"b.{c}").alias(c if c not in left.columns else f"{c}_r") for c in right.columns if c != on))
