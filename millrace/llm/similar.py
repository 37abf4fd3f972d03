"""Near-duplicates by exact Jaccard similarity of word shingles, without a fingerprint's misses.

A text is its set of hashed shingles of five words. In any fixed order of shingles, two sets of similarity 0.8 share one
among the first n - ceil(0.8 n) + 1 of each, so texts meet in these prefixes and no pair is missed. The order puts
shingles that are frequent in a sample of texts last, which keeps the buckets small; the sample decides nothing else.

Members of small buckets are all compared. In large ones members are first compared with one pivot a round, and what is
still in another component than most of its bucket with all the bucket's members. A set's parity map has a bit or two for
each of its shingles; two sets differ by at least as many shingles as their maps by bits, so only pairs whose maps differ
little are compared as whole texts, by their exact similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.graph import connected_components
from millrace.llm.common import as_bytes, extras_apart, rows_of, small_batches, words
from millrace.scratch import settle

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Buckets up to SMALL are compared in full; PIVOTS rounds come before that in others. Neither changes the result.
SMALL, PIVOTS = 16, 3
ORDER_TEXTS, ORDER_SHINGLES = 4_000, 100_000
#: Up to this many keys (16 bytes each) of texts to compare are broadcast, so that texts are not shuffled for them.
MOST_KEYS = 1_000_000
#: Pairs a written partition holds, where Spark made more partitions than that.
PAIRS_PER_FILE = 20_000


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``shingle`` words; of all words if there are fewer, none without words."""
    w = words(text.lower()) if text else []
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - shingle + 1)
    out = np.full(n, SEED, np.uint64)
    for k in range(min(shingle, len(w))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix(found: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of the set, one of which any set of that similarity shares. ``frequent``: most frequent last."""
    if not len(found):
        return found
    size = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    if len(frequent):
        by = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent, found, sorter=by), len(frequent) - 1)
        rank = np.where(frequent[by[at]] == found, by[at] + 1, 0)
        found = found[np.argsort(rank, kind="stable")]
    return found[:size]


def parity(found: np.ndarray) -> np.ndarray:
    """A map of as many bits as there are shingles, up to the next power of two (64 at least), as longs: a bit is 1 if an odd number of shingles falls on it."""
    bits = 64
    while bits < len(found):
        bits *= 2
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _bits_apart(a: Column, b: Column) -> Column:
    """How many bits two parity maps differ in, the longer one folded to half its length; NULL if that leaves other lengths."""

    def folded(x: Column, y: Column) -> Column:
        half = F.shiftright(F.size(x), 1)
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, x: n + x)


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.to_json(F.struct(F.col(id_col).cast("string").alias("i"), F.md5(F.col(text_col).cast("binary")).alias("t")), {"ignoreNullFields": "false"}).cast("binary")))


def _shingles(texts: DataFrame, key: str, shingle: int) -> DataFrame:
    """(key, found): the whole shingle set of each key's text. Rows that repeat a key give one set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for _, (keys, found) in rows_of(batches):
            new = {k: t for k, t in zip(keys, found, strict=True) if k not in seen}
            seen |= new.keys()
            sets = pa.array([shingle_set(t, shingle) for t in new.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), sets], names=[key, "found"])

    return texts.mapInArrow(run, f"{key} long, found array<long>")


def _frequent(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    share = max(1, docs.count() // ORDER_TEXTS)
    some = docs.select(F.xxhash64(text_col).alias("t"), as_bytes(text_col).alias("text")).where(F.pmod("t", F.lit(share)) == 0).dropDuplicates(["t"])
    often = _shingles(some, "t", shingle).select(F.explode("found").alias("s")).groupBy("s").count().where("count > 2")
    rows = often.orderBy(F.desc("count"), "s").limit(ORDER_SHINGLES).collect()
    return np.array([r.s for r in reversed(rows)], np.int64)


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, rkey, digest, n, bits, prefix) of every row; rows of equal sets share the digest. bits: the parity map."""
    kind = docs.schema[id_col].dataType.simpleString()
    frequent = _frequent(docs, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, texts) in rows_of(batches):
            sids, sizes, bits, heads = [], [], [], []
            for t in texts:
                found = shingle_set(t, shingle)
                sids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                bits.append(parity(found))
                heads.append(prefix(found, similarity, frequent))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))], names=["id", "rkey", "digest", "n", "bits", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("rkey"), as_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, rkey binary, digest binary, n long, bits array<long>, prefix array<long>")


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose whole shingle sets are that similar."""
    ends = lambda ps: ps.select(F.col("a").alias("sid")).unionByName(ps.select(F.col("b").alias("sid"))).distinct()
    sides = lambda ps, held, *cols: ps.join(held.select(F.col("sid").alias("a"), *(F.col(c).alias(f"{c}_a") for c in cols)), "a").join(held.select(F.col("sid").alias("b"), *(F.col(c).alias(f"{c}_b") for c in cols)), "b")
    pairs = settle(pairs.distinct(), "similar-pairs")
    at_most = pairs.count()
    files = at_most // PAIRS_PER_FILE + 8
    few = 2 * at_most <= MOST_KEYS
    heads = reps.select("sid", "n", "bits")
    heads = heads.join(F.broadcast(ends(pairs)), "sid") if few else heads
    # sets of that similarity differ by at most this many shingles
    able = _bits_apart(F.col("bits_a"), F.col("bits_b")) <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9
    pairs = settle(sides(pairs, heads, "n", "bits").where(F.coalesce(able, F.lit(True))).select("a", "b").coalesce(files), "similar-able")
    wanted = ends(pairs)
    wanted = settle(reps.select("rkey", "sid").join(F.broadcast(wanted) if few else wanted, "sid"), "similar-wanted")
    held = texts.join(F.broadcast(wanted) if wanted.count() <= MOST_KEYS else wanted, "rkey").select("sid", "text")
    sets = settle(_shingles(held, "sid", shingle), "similar-sets").dropDuplicates(["sid"])
    common = F.size(F.array_intersect("found_a", "found_b"))
    both = sides(pairs, sets, "found").where(common + 1e-9 >= similarity * (F.size("found_a") + F.size("found_b") - common))
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst")).coalesce(files)


def similar_sets(reps: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) over the sid that are linked to some other one. ``reps``: (sid, rkey, n, bits, prefix), one a set; ``texts``: (rkey, text)."""
    # dealt once, for the aggregate and for the join
    heads = reps.select("sid", F.explode("prefix").alias("token")).repartition("token")
    shared = heads.groupBy("token").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a < b").select("token")
    members = settle(heads.join(shared, "token"), "similar-shared")
    members = settle(members.join(reps.select("sid", "n"), "sid"), "similar-members")
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    few = members.join(sizes.where(f"m <= {SMALL}").select("token"), "token")
    many = members.join(sizes.where(f"m > {SMALL}").select("token"), "token")
    fits = F.least("a.n", "b.n") + 1e-9 >= similarity * F.greatest("a.n", "b.n")
    ends = [F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")]
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.sid") < F.col("b.sid")) & fits).select(*ends)
    links = settle(_confirmed(pairs, reps, texts, shingle, similarity), "similar-links")
    known = settle(connected_components(links), "similar-parts")
    crowded = not many.isEmpty()
    for turn in range(PIVOTS + 1 if crowded else 0):
        parts = known.select(F.col("node").alias("sid"), "component")
        now = settle(many.join(parts, "sid", "left").withColumn("component", F.coalesce("component", "sid")), "similar-crowd")
        by = now.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"), F.min_by(F.struct("sid", "n"), F.xxhash64("sid", F.lit(turn))).alias("p"))
        most = by.groupBy("token").agg(F.max(F.struct("m", "component", "p")).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
        rest = now.join(most.select("token", F.col("x.component").alias("main"), F.col("x.p").alias("p")), "token").where("component <> main")
        if rest.isEmpty():
            break
        if turn < PIVOTS:
            pairs = rest.select("sid", "n", "p").where(F.least("n", "p.n") + 1e-9 >= similarity * F.greatest("n", "p.n")).select(F.least("sid", "p.sid").alias("a"), F.greatest("sid", "p.sid").alias("b"))
        else:
            apart = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & fits
            pairs = rest.alias("a").join(now.alias("b"), apart & ((F.col("b.component") == F.col("a.main")) | (F.col("a.sid") < F.col("b.sid")))).select(*ends)
        links = settle(_confirmed(pairs, reps, texts, shingle, similarity), "similar-links")
        if not links.isEmpty():
            # what is known goes on as one edge a member, so only the new links take rounds
            joined = links.unionByName(known.select(F.col("node").alias("src"), F.col("component").alias("dst")))
            known = settle(connected_components(joined), "similar-parts")
    return known


@extras_apart
def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. Columns and their order are kept.

    Texts are linked when the Jaccard similarity of their shingle sets (words lower-cased, A-Z) is ``similarity`` or more.
    Texts without words are copies of one another. A null id comes after all others, so such a row goes only as
    a copy of a row that stays; rows that repeat a kept id and its shingles all stay; an empty table gives an empty table.
    """
    with small_batches(docs.sparkSession):
        marked = settle(_marked(docs, id_col, text_col, shingle, similarity), "similar-marked")
        texts = docs.select(_row_key(id_col, text_col).alias("rkey"), as_bytes(text_col).alias("text"))
        reps = marked.groupBy("digest").agg(F.min("rkey").alias("rkey"), *(F.first(c).alias(c) for c in ("n", "bits", "prefix")))
        reps = settle(reps.select(F.monotonically_increasing_id().alias("sid"), "*"), "similar-reps")
        linked = similar_sets(reps, texts, shingle, similarity).select(F.col("node").alias("sid"), "component")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "sid")
    placed = marked.select("id", "rkey", "digest").join(reps.select("digest", "sid"), "digest").join(linked, "sid", "left")
    placed = settle(placed.select("id", "rkey", "sid", F.coalesce("component", "sid").alias("component")), "similar-placed")
    stays = placed.groupBy("component").agg(F.min(rank).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
    lost = placed.join(stays, "component").where(~F.struct("id", "sid").eqNullSafe(F.struct("x.id", "x.sid"))).select(F.col("rkey").alias("__rkey"))
    lost = settle(lost.distinct(), "similar-lost")
    return docs.join(lost, _row_key(id_col, text_col) == F.col("__rkey"), "left_anti").select(*docs.columns)
