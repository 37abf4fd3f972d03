"""Exact substring deduplication as a depth-limited radix sort of suffixes.

Suffixes are put in groups of equal first ``length`` bytes by most-significant-digit passes; a group that is down to one member
is finished and never looked at again, and the groups of several members after the last pass are exactly the windows
that are repeated. Few passes are enough, because the digits are chosen by content:

1. the *anchor* of a suffix, the least-hashed ``gram``-byte piece that lies inside its window. Neighbouring suffixes share
   anchors, so a run of them (a cell) travels as one row. Cells whose anchor is met once are finished; cells that
   cover equal strings are finished as repeated.
2. the same for the cells that are left, cut finer by the anchors under four hash orders, all of which must recur in place.
3. for what is left then, the window itself, one row a suffix, by 128 bits of hash.

Rows count before they are joined, so a passage that a third of all documents share is one row a task in a pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import as_bytes, extras_apart
from millrace.scratch import settle

LENGTH, GRAM, FINE, SEGMENT = 200, 96, 4, 1 << 19
_POS = np.uint64((1 << 20) - 1)
_U = np.uint64


@lru_cache(maxsize=4)
def _tables(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of an odd base and of its inverse, modulo 2**64."""
    rng = np.random.default_rng(1000 + k)
    base = int(rng.integers(1 << 62, dtype=np.uint64)) * 2 + 1
    inverse = pow(base, -1, 1 << 64)

    def powers(b: int) -> np.ndarray:
        out = np.full(SEGMENT + 4096, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return rng.integers(1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1), powers(base), powers(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Rolling:
    """Hashes of any substring of a piece of text, from prefix sums."""

    def __init__(self, data: np.ndarray, k: int = 0) -> None:
        value, power, self.inverse = _tables(k)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least(keys: np.ndarray, width: int, n: int) -> np.ndarray:
    """Minimum of keys[i : i + width] for i < n."""
    padded = np.full(-(-len(keys) // width) * width, ~_U(0))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def cells(text: bytes, length: int, gram: int, orders: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchors, string, first, last) for the runs of window starts that share their anchors under the given number of hash orders.

    Of equally least pieces the last one counts, so anchors depend on the window's bytes alone. A segment of the text at a time.
    """
    width = length - gram + 1
    for base in range(0, max(0, len(text) - length + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8)[base : base + SEGMENT + length - 1]
        n, m = len(data) - length + 1, len(data) - gram + 1
        rolling = _Rolling(data)
        grams = rolling(slice(0, m), slice(gram, gram + m))
        back = _POS - np.arange(m, dtype=np.uint64)
        places = []
        for k in range(orders):
            rank = grams if k == 0 else _mix(grams ^ _U(0xD6E8FEB86659FD93 * k & (2**64 - 1)))
            places.append((_POS - (_least((rank & ~_POS) | back, width, n) & _POS)).astype(np.int64))
        change = np.diff(places[0]) != 0
        for at in places[1:]:
            change |= np.diff(at) != 0
        cut = np.flatnonzero(change) + 1
        first, last = np.r_[0, cut], np.r_[cut - 1, n - 1]
        main = places[0][first]
        anchors = grams[main]
        for at in places[1:]:
            anchors = _mix(anchors ^ (grams[at[first]] + (at[first] - main).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))
        shape = (last - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (main - first).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
        yield anchors, _mix(rolling(first, last + length) ^ shape), first + base, last + base


def window_hashes(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, hash, other hash) of the windows of the given runs, a segment at a time."""
    for base in range(0, len(text) - length + 1, SEGMENT):
        mine = (first >= base) & (first < base + SEGMENT)
        if mine.any():
            data = np.frombuffer(text, np.uint8)[base : base + SEGMENT + length - 1]
            at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[mine] - base, last[mine] - base, strict=True)])
            yield at + base, _Rolling(data, 1)(at, at + length), _Rolling(data, 2)(at, at + length)


def _cell_rows(length: int, gram: int, orders: int):
    """Batches (rid, text) or (rid, text, runs): all cells, or those inside the runs."""
    names = ["anchor", "string", "rid", "first", "last"]

    def pack(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            held, size = [], 0
            for i in range(batch.num_rows):
                if batch.num_columns > 2:
                    lo, hi = _ends(batch.column(2)[i].as_py())
                for a, s, f, e in cells(batch.column(1)[i].as_py(), length, gram, orders):
                    if batch.num_columns > 2:
                        at = np.searchsorted(lo, f, side="right") - 1
                        inside = (at >= 0) & (e <= hi[np.maximum(at, 0)])
                        a, s, f, e = a[inside], s[inside], f[inside], e[inside]
                    held.append((a.view(np.int64), s.view(np.int64), np.full(len(a), ids[i]), f.astype(np.int32), e.astype(np.int32)))
                    size += len(a)
                if size > 100_000:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    return run


def _ends(runs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    out = np.array(sorted({(r["first"], r["last"]) for r in runs}), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                for start, a, b in window_hashes(batch.column(1)[i].as_py(), *_ends(batch.column(2)[i].as_py()), length):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), ids[i])), pa.array(start.astype(np.int32))], names=["a", "b", "rid", "first"])

    return run


def _judge(rows: DataFrame) -> DataFrame:
    """Cells met more than once: (rid, first, last, whole, open).

    whole: another cell covers the same string. open: its windows have to be looked at one digit further, because the cell is
    alone with its string, or because it is the one that stands for its string where such a cell has the same anchors.
    """
    met = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    alive = settle(rows.join(met, "anchor"), "suffix-alive")
    classes = settle(alive.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first")).alias("one")), "suffix-classes")
    mixed = classes.groupBy("anchor").agg(F.min("n").alias("least")).where("least = 1").select("anchor", F.lit(True).alias("mixed"))
    judged = alive.join(classes.join(mixed, "anchor", "left"), ["anchor", "string"])
    return settle(judged.select("rid", "first", "last", (F.col("n") > 1).alias("whole"), F.expr("mixed is not null and one.rid = rid and one.first = first").alias("open")), "suffix-judged")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs(rid, text binary) -> (rid, runs array<struct<first, last>>): starts of all windows that occur more than once."""
    texts = docs.where(F.octet_length("text") >= length).select("rid", "text")
    row = "anchor long, string long, rid long, first int, last int"
    listed = lambda judged: judged.where("open").groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    coarse = _judge(texts.mapInArrow(_cell_rows(length, gram, 1), row))
    fine = _judge(texts.join(listed(coarse), "rid").select("rid", "text", "runs").mapInArrow(_cell_rows(length, gram, FINE), row))
    windows = texts.join(listed(fine), "rid").select("rid", "text", "runs").mapInArrow(_window_rows(length), "a long, b long, rid long, first int")
    windows = settle(windows, "suffix-windows")
    same = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    single = windows.join(same, ["a", "b"]).select("rid", "first", F.col("first").alias("last"))
    runs = coarse.where("whole").select("rid", "first", "last").unionByName(fine.where("whole").select("rid", "first", "last")).unionByName(single)
    return settle(runs.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "suffix-runs")


def _removed(text: bytes, runs: list[dict] | None, length: int) -> np.ndarray | None:
    if not runs:
        return None
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, np.array([r["first"] for r in runs]), 1)
    np.add.at(edge, np.array([r["last"] + length for r in runs]), -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, report: bool) -> DataFrame:
    text = F.coalesce(as_bytes(text_col), F.lit(b""))
    ident = F.xxhash64(F.col(id_col).cast("string"), text)
    runs = repeated_runs(docs.select(ident.alias("rid"), text.alias("text")), length, gram)
    others = [c for c in docs.columns if c != text_col]
    kinds = [docs.schema[c] for c in others]
    kinds += [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] if report else [T.StructField(text_col, T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, found = part.column(len(others)).to_pylist(), part.column(len(others) + 1).to_pylist()
                rows = []
                for t, r in zip(texts, found, strict=True):
                    gone = _removed(t or b"", r, length)
                    if gone is None:
                        rows.append((len(t or b""), 0, 0, t))
                    else:
                        rows.append((len(t), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)), np.frombuffer(t, np.uint8)[~gone].tobytes()))
                if report:
                    new = [pa.array([x[k] for x in rows], pa.int64()) for k in range(3)] + [pa.array([hashlib.sha256(x[3] or b"").hexdigest() for x in rows], pa.string())]
                else:
                    new = [pa.array([None if x[3] is None else x[3].decode("utf-8", "ignore") for x in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(others))), *new], names=[f.name for f in kinds])

    named = docs.withColumn("__rid", ident)
    joined = named.join(runs.select(F.col("rid").alias("__of"), F.col("runs").alias("__runs")), F.col("__rid") == F.col("__of"), "left")
    return joined.select(*others, as_bytes(text_col).alias("__text"), "__runs").mapInArrow(cut, T.StructType(kinds))


@extras_apart
def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without the bytes that any ``length``-byte string found in two or more places covers, first place included.

    Strings are judged on the input. Bytes of a character that is cut are dropped from the text. Null texts stay null,
    texts shorter than ``length`` stay as they are; rows are documents of their own, so a repeated row loses all that
    a window covers; null ids are fine; an empty table gives an empty table; long texts are read in segments, whole.
    """
    return _apply(docs, id_col, text_col, length, gram, report=False).select(*docs.columns)


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what is removed from each row; kept bytes are hashed as they are."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _apply(only, "doc_id", "text", length, gram, report=True)
