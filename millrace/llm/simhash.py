"""SimHash near-duplicates through a covering family of bit masks.

Every position of the 64-bit fingerprint belongs to one of seven groups, and mask number v keeps the groups whose
label has an odd inner product with v. Two differing positions always leave some v under which both are
masked out, so fingerprints at 2 or fewer bits agree on at least one of the seven masked values: no link is missed.

Inside a masked value, fingerprints are not paired. Each one names the points at 0 or 1 bits from it; two
fingerprints are within 2 bits exactly when they name a common point, so the members of a point are linked to
its least member. Work is linear in the members of a bucket, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.graph import connected_components
from millrace.llm.common import as_bytes, extras_apart, rows_of, words
from millrace.scratch import settle

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
_LABELS = [i % (2 ** (RADIUS + 1) - 1) + 1 for i in range(BITS)]
#: Bits that mask v leaves out.
FREE = {v: [i for i in range(BITS) if (_LABELS[i] & v).bit_count() % 2 == 0] for v in range(1, 2 ** (RADIUS + 1))}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hash bits, as a signed 64-bit number; 0 without words."""
    w = words(text.lower()) if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _text_md5(text_col: str) -> Column:
    return F.md5(F.coalesce(as_bytes(text_col), F.lit(b"")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, fp long). Null and word-less texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, texts) in rows_of(batches):
            fps = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fps], names=["doc_id", "text_md5", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), _text_md5(text_col).alias("text_md5"), as_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text_md5 string, fp long")


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """(node, component) over distinct fingerprints (column fp) that are linked to some other one."""
    masks = [F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(~sum(1 << i for i in FREE[v]) & (2**64 - 1)))).alias("masked")) for v in FREE]
    table = fps.select("fp", F.explode(F.array(*masks)).alias("t")).select("fp", "t.v", "t.masked")
    crowded = table.groupBy("v", "masked").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("v", "masked")
    members = table.join(crowded, ["v", "masked"])
    free = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in FREE[v])) for v in FREE))
    points = members.select("fp", F.explode(F.element_at(free, F.col("v"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    points = settle(points, "simhash-points")
    shared = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("point", "least")
    links = points.join(shared, "point").where("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst")).distinct()
    return connected_components(links)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_md5, fp, group, component_id) of every row; rows of one component share ``group``."""
    marked = settle(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = linked_fingerprints(fps.select("fp")).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    linked = settle(linked.join(fps, "fp"), "simhash-linked")
    least = linked.groupBy("group").agg(F.min("first").alias("component_id"))
    final = fps.join(linked.join(least, "group").select("fp", "group", "component_id"), "fp", "left")
    final = final.select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(final, "fp").select("doc_id", "text_md5", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; other columns are not read.

    Fingerprints at 2 or fewer differing bits are linked; component_id is the smallest doc_id that can be reached,
    the document's own included. Null, empty and word-less texts have fingerprint zero and are linked like any
    other; a null id is reached by no one, so a component of such rows alone has a null component_id; repeated rows are all returned; an
    empty table gives no rows. Long texts are hashed whole.
    """
    return _placed(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@extras_apart
def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: that with the smallest id. Columns and their order are kept.

    A null id comes after all others: such rows go as copies of rows that stay, and of a component without ids the text with
    the least MD5 stays. Rows that repeat a kept id, or a kept text without id, all stay.
    """
    placed = settle(_placed(docs, id_col, text_col), "simhash-placed")
    bare = placed.where("component_id is null").groupBy("group").agg(F.min("text_md5").alias("kept"))
    lost = placed.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select("doc_id", "text_md5")
    lost = lost.unionByName(placed.where("component_id is null").join(bare, "group").where("text_md5 <> kept").select("doc_id", "text_md5"))
    lost = lost.select(F.col("doc_id").alias("__lost_id"), F.col("text_md5").alias("__lost_md5")).distinct()
    same = (_text_md5(text_col) == F.col("__lost_md5")) & F.col(id_col).eqNullSafe(F.col("__lost_id"))
    return docs.join(lost, same, "left_anti").select(*docs.columns)
