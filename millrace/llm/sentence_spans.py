"""Substring deduplication by sliding sentence spans.

From every sentence on, the run of ``span`` consecutive sentences is hashed; it goes on until it holds ``at_least`` words. If fewer
sentences already hold ``enough`` words, that shorter run is hashed too, and a text that is shorter than a run is one run. All hashes
meet in one global aggregate, which keeps for each the first occurrence, by document and place; sentences that any later
occurrence covers are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import as_bytes, extras_apart, rows_of
from millrace.scratch import settle

SPAN, ENOUGH, AT_LEAST = 3, 30, 10
# a single mark before the blank, so that a run of marks is passed once
_SENTENCE = re.compile(rb"[^\n]*?[.!?](?=[ \t\r\n]|\Z)[ \t\r]*|[^\n]+|\n")


def sentences(text: bytes) -> list[bytes]:
    """Pieces that join to the text again: sentences with the blanks behind them, and line ends."""
    return _SENTENCE.findall(text)


def spans(parts: list[bytes], span: int, enough: int, at_least: int) -> list[tuple[int, int, bytes]]:
    """(first, last, key) of each run, as indices of ``parts``; texts of fewer than at_least words have none."""
    said = [(i, w) for i, w in ((i, x.lower().split()) for i, x in enumerate(parts)) if w]
    out = []

    def add(k: int, end: int) -> None:
        key = hashlib.blake2b(b" ".join(w for _, ws in said[k:end] for w in ws), digest_size=16).digest()
        out.append((said[k][0], said[end - 1][0], key))

    for k in range(len(said)):
        words, early = 0, False
        for end in range(k + 1, len(said) + 1):
            words += len(said[end - 1][1])
            if end - k >= span and words >= at_least:
                add(k, end)
                break
            if not early and words >= enough:
                early = True
                add(k, end)
        else:
            if k == 0 and words >= at_least and not (early and len(said) == 1):
                add(0, len(said))
    return out


def _apply(docs: DataFrame, id_col: str, text_col: str, span: int, enough: int, at_least: int, report: bool) -> DataFrame:
    text = as_bytes(text_col)
    ident = F.xxhash64(text)  # tells rows apart together with the id
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, texts) in rows_of(batches):
            owner, key, first, last = [], [], [], []
            for i, t in enumerate(texts):
                for f, e, k in spans(sentences(t or b""), span, enough, at_least):
                    owner.append(i)
                    key.append(k)
                    first.append(f)
                    last.append(e)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), part.column(0).take(at), part.column(1).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["key", "rid", "doc_id", "first", "last"])

    rows = docs.select(ident.alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(find, f"key binary, rid long, doc_id {kind}, first int, last int")
    rows = settle(rows, "span-keys")
    place = F.struct("doc_id", "rid", "first")
    # which keys recur is asked first, by nothing but the keys; places are compared among the rows of those
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    repeats = settle(rows.join(again, "key"), "span-repeats")
    origins = repeats.groupBy("key").agg(F.min(place).alias("origin"))
    later = repeats.join(origins, "key").where(~F.struct("doc_id", "rid", "first").eqNullSafe(F.col("origin"))).select("doc_id", "rid", "first", "last")
    lost = settle(later.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "span-runs")
    others = [c for c in docs.columns if c != text_col]
    kinds = [docs.schema[c] for c in others]
    kinds += [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] if report else [T.StructField(text_col, T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t, runs in zip(part.column(len(others)).to_pylist(), part.column(len(others) + 1).to_pylist(), strict=True):
                    parts = sentences(t or b"")
                    gone = {i for r in runs or () for i in range(r["first"], r["last"] + 1) if parts[i].strip()}
                    kept = b"".join(x for i, x in enumerate(parts) if i not in gone) if gone else t
                    rows.append((sum(1 for x in parts if x.strip()), len(gone), kept))
                if report:
                    new = [pa.array([x[k] for x in rows], pa.int64()) for k in range(2)] + [pa.array([hashlib.sha256(x[2] or b"").hexdigest() for x in rows])]
                else:
                    new = [pa.array([x[2] for x in rows], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(others))), *new], names=[f.name for f in kinds])

    lost = lost.select(F.col("doc_id").alias("__of"), F.col("rid").alias("__rid"), F.col("runs").alias("__runs"))
    joined = docs.join(lost, (ident == F.col("__rid")) & F.col(id_col).eqNullSafe(F.col("__of")), "left")
    return joined.select(*others, as_bytes(text_col).alias("__text"), "__runs").mapInArrow(cut, T.StructType(kinds))


@extras_apart
def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, enough: int = ENOUGH, at_least: int = AT_LEAST) -> DataFrame:
    """``docs`` without the sentences that lie in a repeated run of sentences, except in its first occurrence.

    Sentences end at . ! ? before white space, or at a line end; runs are compared lower-cased (A-Z) and with white space
    as one space. The first occurrence is that with the least id, then place. Null texts stay null; rows that
    repeat one another in every respect share their places, so the first occurrence stays in each; null ids come
    first; an empty table gives an empty table; long texts are read whole.
    """
    return _apply(docs, id_col, text_col, span, enough, at_least, report=False).select(*docs.columns)


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, enough: int = ENOUGH, at_least: int = AT_LEAST) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept_sha256) of what is removed from each row."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _apply(only, "doc_id", "text", span, enough, at_least, report=True)
