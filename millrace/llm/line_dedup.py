"""Line deduplication: two Bloom filters find the suspected repeats, an exact shuffle settles them.

Tasks set the bits of their line keys in a once-seen filter and, where a bit is met again, in a twice-seen filter.
Both are merged by segments on Spark (a bit that is once-seen in two tasks becomes twice-seen). The merged twice-seen
filter is the only thing broadcast. It gets 8 bits a line, counted first, up to 2**MOST_BITS bits (128 MB). A filter
that fills up beyond that only sends more lines to the exact step: results do not depend on it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import as_bytes, extras_apart, rows_of
from millrace.scratch import settle

MIN_CHARS, MIN_DOCS, LEAST_BITS, MOST_BITS, SEGMENT = 20, 3, 16, 30, 1 << 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and A-Z lower-cased; None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars:
        return None
    return key if key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars else None


def _keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in (text or b"").split(b"\n")]


def _bits(keys: list[bytes], log2_bits: int) -> np.ndarray:
    """Two bit positions for each key, as an (n, 2) array; log2_bits is 32 at most."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    mask = np.uint64((1 << log2_bits) - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask], axis=1).astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] & (128 >> (at & 7)).astype(np.uint8) != 0


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def filter_bits(docs: DataFrame, text_col: str) -> int:
    """Logarithm of the filter's size: 8 bits for each line of the documents, within LEAST_BITS and MOST_BITS."""
    text = F.col(text_col)
    lines = docs.agg(F.sum((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))).first()[0] or 0
    return max(LEAST_BITS, min(MOST_BITS, (8 * lines).bit_length()))


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, log2_bits: int) -> bytes:
    """The packed bits that two or more line keys set; a key counts once for each text."""
    width = max(8, min(SEGMENT, 1 << log2_bits)) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(max(1, (1 << log2_bits) // 8), np.uint8) for _ in range(2))
        for _, (texts,) in rows_of(batches):
            keys = [k for t in texts for k in set(_keys(t, min_chars)) - {None}]
            if keys:
                at, n = np.unique(_bits(keys, log2_bits).ravel(), return_counts=True)
                _set(twice, at[(n > 1) | _is_set(once, at)])
                _set(once, at)
        for k in np.flatnonzero(once.reshape(-1, width).any(axis=1)):
            cut = slice(k * width, (k + 1) * width)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "once": [_pack(once[cut])], "twice": [_pack(twice[cut])]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments come in order, so one is held at a time."""
        segment, once, twice = None, None, None
        for batch in batches:
            for k, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = _unpack(o), _unpack(t)
                if k == segment:
                    once, twice = once | o, twice | t | (once & o)
                    continue
                if segment is not None:
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": [_pack(twice)]})
                segment, once, twice = k, o, t
        if segment is not None:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": [_pack(twice)]})

    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    filled = docs.select(as_bytes(text_col)).coalesce(tasks).mapInArrow(fill, "segment int, once binary, twice binary")
    merged = filled.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(max(1, (1 << log2_bits) // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row.segment * width : (row.segment + 1) * width] = _unpack(row.twice)
    return out.tobytes()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, log2_bits: int | None = None) -> DataFrame:
    """(id, keys array<binary>): for each document the 128-bit keys of lines that it has to lose."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    log2_bits = filter_bits(docs, text_col) if log2_bits is None else log2_bits
    seen = spark.sparkContext.broadcast(twice_seen(docs, text_col, min_chars, log2_bits))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(seen.value, np.uint8)
        for part, (_, texts) in rows_of(batches):
            owner, keys = [], []
            for i, t in enumerate(texts):
                own = set(_keys(t, min_chars)) - {None}
                owner += [i] * len(own)
                keys += own
            if not keys:
                continue
            at = _bits(keys, log2_bits)
            hit = np.flatnonzero(_is_set(filt, at).all(axis=1))
            ids = part.column(0).take(pa.array([owner[k] for k in hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([hashlib.blake2b(keys[k], digest_size=16).digest() for k in hit], pa.binary())], names=["doc_id", "key"])

    suspects = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).where("doc_id is not null")
    suspects = settle(suspects.mapInArrow(suspect, f"doc_id {kind}, key binary"), "line-suspects")
    common = suspects.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("key", "last")
    lost = suspects.join(common, "key").where("doc_id <> last").select("doc_id", "key").distinct()
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _apply(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, log2_bits: int | None, digest: bool) -> DataFrame:
    lost = repeated_lines(docs, id_col, text_col, min_chars, min_docs, log2_bits).select(F.col("doc_id").alias("__id"), F.col("keys").alias("__keys"))
    joined = docs.join(lost, docs[id_col] == lost["__id"], "left").drop("__id")
    others = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in others]
    own = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())] if digest else [T.StructField(text_col, T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, keys = part.column(len(others)).to_pylist(), part.column(len(others) + 1).to_pylist()
                lines, dropped, kept = [], [], []
                for t, lose in zip(texts, keys, strict=True):
                    all_lines = (t or b"").split(b"\n")
                    lines.append(len(all_lines))
                    if lose:
                        lose = set(lose)
                        stay = [x for x in all_lines if (k := line_key(x, min_chars)) is None or hashlib.blake2b(k, digest_size=16).digest() not in lose]
                        dropped.append(len(all_lines) - len(stay))
                        kept.append(b"\n".join(stay))
                    else:
                        dropped.append(0)
                        kept.append(t)
                if digest:
                    new = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x or b"").hexdigest() for x in kept], pa.string())]
                else:
                    new = [pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(others))), *new], names=[*others, *(f.name for f in own)])

    ready = joined.select(*others, as_bytes(text_col).alias("__text"), "__keys")
    return ready.mapInArrow(cut, T.StructType([T.StructField(f.name, f.dataType) for f in fields] + own))


@extras_apart
def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, log2_bits: int | None = None) -> DataFrame:
    """``docs`` without the lines whose key (stripped, A-Z lower-cased, at least min_chars code points) is found in
    at least min_docs documents, except in the largest id that holds it. Other lines and columns stay as they are.

    Null texts stay null; an empty text is one empty line; rows with a null id keep their text and count for no
    line; rows that share an id are one document; an empty table gives an empty table. Long texts are read whole.
    """
    return _apply(docs, id_col, text_col, min_chars, min_docs, log2_bits, digest=False).select(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, log2_bits: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of what drop_repeated_lines does to each row."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _apply(only, "doc_id", "text", min_chars, min_docs, log2_bits, digest=True)
