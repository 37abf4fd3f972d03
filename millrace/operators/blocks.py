"""Pairs of rows by blocks: rows are packed into blocks of bounded bytes, and a task holds one block of queries while blocks of the other side pass by.

Nothing is shuffled but the packed rows and what is found. Blocks meet in a product of the two block tables, so that the
arithmetic is quadratic, but memory is not: products are taken for CHUNK queries at a time.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import settle

#: Bytes of a block's numbers and rows of a block at most; queries in one product; bytes of queries that a task of distances holds.
BLOCK_BYTES, MOST_ROWS, CHUNK, HELD_BYTES = 2 << 20, 4_096, 512, 32 << 20
#: Blocks of queries up to which the base is not written, and of them in a task then.
FEW_BLOCKS, FEW_READS = 24, 8


def block_rows(dims: int | None) -> int:
    return max(16, min(MOST_ROWS, BLOCK_BYTES // (8 * max(dims or 1, 1))))


def packed(df: DataFrame, rows: int, trim=None) -> DataFrame:
    """(key, block): rows of df as Arrow streams of at most ``rows`` rows, cut by partitions; ``trim`` may leave out rows of a block."""

    def pack(batches):
        from pyspark import TaskContext

        at, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush(last):
            nonlocal at, held, n
            table = pa.Table.from_batches(held).combine_chunks()
            while table.num_rows >= rows or (last and table.num_rows):
                part, table = table.slice(0, rows).combine_chunks(), table.slice(rows)
                if trim:
                    part = trim(part)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["key", "block"])
                at += 1
            held, n = table.to_batches(), table.num_rows

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from flush(False)
        if n:
            yield from flush(True)

    return df.mapInArrow(pack, "key long, block binary")


def unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table[name]
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def matrix(v: pa.Array) -> np.ndarray:
    """Lists of one length, without NULLs, as rows of doubles."""
    size = np.unique(np.diff(v.offsets.to_numpy()))
    if len(size) > 1:
        raise ValueError(f"vectors of {size.min()} and of {size.max()} numbers")
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows, one number after the other, as SQL takes them."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _direct(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x to all of y, column by column: each is the same sum in the same order as for one pair."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        if metric in ("dot", "cosine"):
            out += np.multiply.outer(x[:, j], y[:, j])
            continue
        gap = np.abs(np.subtract.outer(x[:, j], y[:, j]))
        if metric in ("euclidean", "manhattan"):
            out += gap * gap if metric == "euclidean" else gap
        else:
            np.maximum(out, gap, out=out)
    if metric == "cosine":
        size = np.multiply.outer(np.sqrt(_sum(x * x)), np.sqrt(_sum(y * y)))
        return 1 - np.divide(out, size, out=np.full_like(out, np.nan), where=size != 0)
    return -out if metric == "dot" else np.sqrt(out) if metric == "euclidean" else out


def _trimmed(k: int):
    """Of equal vectors of a block only those with the least ids can be among anyone's k nearest: at most k rows of an id, and 2 k in all, as one id may be the query's own."""

    def trim(part: pa.Table) -> pa.Table:
        x = np.ascontiguousarray(matrix(column(part, "v")))
        if not x.size:
            return part
        group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        if group.max() + 1 == len(x):
            return part
        code = _codes(_labels(column(part, "id")))
        order = np.lexsort((code, group))
        order = order[_place(np.stack([group, code], 1)[order]) < k]
        order = order[_place(group[order][:, None]) < 2 * k]
        return part.take(pa.array(np.sort(order)))

    return trim


def _labels(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    out = np.empty(len(ids), object)
    out[:] = ids.to_pylist()
    return out


def _codes(labels: np.ndarray) -> np.ndarray:
    """Numbers in the order of the labels."""
    return labels if labels.dtype != object else np.unique(labels, return_inverse=True)[1].ravel()


def _place(keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal keys."""
    if not len(keys):
        return np.zeros(0, int)
    first = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(first, at, 0))


class _Side:
    """A block's vectors, and what its products need."""

    def __init__(self, table: pa.Table, metric: str):
        self.v, self.ids = matrix(column(table, "v")), column(table, "id")
        keep = np.ones(len(self.v), bool)
        with np.errstate(all="ignore"):
            self.squares = _sum(self.v * self.v)
            if metric == "cosine":  # vectors of length zero have no direction
                keep = self.squares > 0
                table, self.v, self.squares = table.filter(pa.array(keep)), self.v[keep], self.squares[keep]
                self.ids = column(table, "id")
            self.size = np.sqrt(self.squares)
            self.near = self.v / self.size[:, None] if metric == "cosine" else self.v
            self.low = self.near.astype(np.float32)
        self.labels = _labels(self.ids)
        get = lambda name: column(table, name).to_numpy(zero_copy_only=False) if name in table.column_names else None
        self.kind, self.limit = get("kind"), get("limit")


class _Best:
    """The k best rows so far of each query of a block.

    A product in single precision, with a bound on its error, says which pairs may be among them; where that are too many,
    one in double precision. Those pairs are computed exactly, so that equal vectors are equally far, and ties go to the least id.
    """

    def __init__(self, queries: _Side, k: int, metric: str, include_self: bool):
        self.q, self.k, self.metric, self.include_self = queries, k, metric, include_self
        self.score = np.full((len(queries.v), k), -np.inf)
        self.labels = np.zeros((len(queries.v), k), queries.labels.dtype)
        self.floor = -queries.limit if queries.limit is not None else np.full(len(queries.v), -np.inf)

    def _rough(self, part: slice, y: _Side, kind) -> tuple[np.ndarray, np.ndarray]:
        """(scores, bounds on their errors by query): cosine or product, or less the squared distance; exact distances of other metrics."""
        q, d = self.q, y.v.shape[1]
        if self.metric not in ("cosine", "dot", "euclidean"):
            return -_direct(q.v[part], y.v, self.metric), np.zeros(len(q.v[part]))
        a, b = (q.low[part], y.low) if kind == np.float32 else (q.near[part], y.near)
        out, eps, most = a @ b.T, (d + 8) * float(np.finfo(kind).eps), y.size.max()
        if self.metric == "cosine":
            return out, np.full(len(a), eps)
        if self.metric == "dot":
            return out, eps * q.size[part] * most
        out *= 2
        out -= q.squares[part].astype(kind)[:, None]
        out -= y.squares.astype(kind)[None]
        return out, eps * (q.size[part] + most) ** 2

    def _hits(self, part: slice, y: _Side, kind) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row of y) that may be among the best."""
        q = self.q
        rough, slack = self._rough(part, y, kind)
        if not np.isfinite(slack).all() or not np.isfinite(rough).all():
            rough = np.where(np.isfinite(rough), rough, np.inf)
            slack = np.where(np.isfinite(slack), slack, np.inf)
        if not self.include_self:
            own, other = (q.labels, y.labels) if q.kind is None else (q.kind, y.kind)
            rough[own[part][:, None] == other[None]] = -np.inf
        thr = np.maximum(self.score[part, -1], self.floor[part])
        at = -(thr * thr) if self.metric == "euclidean" else thr
        few = np.isneginf(self.score[part, -1])
        if few.any():
            some, k = rough[few], min(self.k, rough.shape[1])
            kth = some.max(1) if k == 1 else np.partition(some, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
            at[few] = np.maximum(at[few], kth - slack[few] if k == self.k else -np.inf)
        with np.errstate(all="ignore"):
            cut = at - slack - 1e-15 * np.abs(at)
        cut = np.where(np.isnan(cut), -np.inf, cut)
        # in the products' precision, downwards; what is left out is at -inf
        cut = np.maximum(cut, -float(np.finfo(rough.dtype).max))
        low = cut.astype(rough.dtype)
        low = np.where(low > cut, np.nextafter(low, -np.asarray(np.inf, rough.dtype)), low)
        rows = np.flatnonzero(rough.max(1) >= low)
        i, j = np.nonzero(rough[rows] >= low[rows][:, None])
        return rows[i] + part.start, j

    def _exact(self, i: np.ndarray, y: _Side, j: np.ndarray) -> np.ndarray:
        a, b = self.q.v[i], y.v[j]
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                return np.clip(_sum(a * b) / np.sqrt(self.q.squares[i] * y.squares[j]), -1, 1)
            if self.metric == "dot":
                return _sum(a * b)
            if self.metric == "euclidean":
                return -np.sqrt(_sum((a - b) * (a - b)))
            return -_sum(np.abs(a - b)) if self.metric == "manhattan" else -np.abs(a - b).max(1, initial=0)

    def meet(self, y: _Side) -> None:
        if not len(y.v) or not len(self.q.v):
            return
        if y.v.shape[1] != self.q.v.shape[1]:
            raise ValueError(f"vectors of {self.q.v.shape[1]} and of {y.v.shape[1]} numbers")
        for at in range(0, len(self.q.v), CHUNK):
            part = slice(at, min(at + CHUNK, len(self.q.v)))
            i, j = self._hits(part, y, np.float32 if self.metric in ("cosine", "euclidean") else np.float64)
            if len(i) > 8 * (self.k + 1) * CHUNK and self.metric in ("cosine", "euclidean"):
                i, j = self._hits(part, y, np.float64)
            for s in range(0, len(i), 1 << 14):
                self._take(i[s : s + (1 << 14)], y, j[s : s + (1 << 14)])

    def _take(self, i: np.ndarray, y: _Side, j: np.ndarray) -> None:
        score = self._exact(i, y, j)
        good = score >= np.maximum(self.score[i, -1], self.floor[i])
        if not self.include_self and self.q.kind is None:
            good &= (self.q.labels[i] != y.labels[j]).astype(bool)
        i, score, labels = i[good], score[good], y.labels[j[good]]
        if not len(i):
            return
        rows = np.unique(i)
        old, had = self.score[rows], ~np.isneginf(self.score[rows])
        i, score, labels = np.concatenate([rows[np.nonzero(had)[0]], i]), np.concatenate([old[had], score]), np.concatenate([self.labels[rows][had], labels])
        order = np.lexsort((_codes(labels), -score, i))
        place = _place(i[order][:, None])
        order, place = order[place < self.k], place[place < self.k]
        self.score[rows] = -np.inf
        self.score[i[order], place], self.labels[i[order], place] = score[order], labels[order]

    def found(self) -> pa.RecordBatch:
        i, place = np.nonzero(~np.isneginf(self.score))
        neighbour = self.labels[i, place]
        neighbour = pa.array(neighbour if neighbour.dtype != object else neighbour.tolist(), self.q.ids.type)
        return pa.RecordBatch.from_arrays([self.q.ids.take(pa.array(i)), neighbour, pa.array(self.score[i, place])], ["source", "neighbour", "score"])


def best_pairs(queries: DataFrame, base: DataFrame, k: int, metric: str, include_self: bool = False) -> DataFrame:
    """(source, neighbour, score): the k best rows of base(id, v) for each row of queries(id, v) in each share of the base.

    score: cosine similarity, product, or less the distance (euclidean, manhattan, chebyshev); larger is nearer. Without
    include_self, rows of the query's own id are left out, or, with a column ``kind`` on both sides, those of its kind. A
    column ``limit`` of the queries is the largest distance. Rows with a NULL id, a NULL vector, or a NULL or NaN in it neither
    ask nor answer; nor do vectors of length zero for the cosine. Vectors of different lengths are an error.
    """
    spark = base.sparkSession
    whole = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    queries, base = whole(queries), whole(base)
    kind = base.schema["id"].dataType.simpleString()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    asked, held = count(queries), count(base)
    rows = block_rows(max(asked.dims or 1, held.dims or 1))
    # dealt evenly but for some rows, so a block is cut a little larger than a partition should be
    blocks = lambda n: max(1, ceil(n / (rows * 0.9)))
    # copies: only where rows are left out by id
    trim = None if "kind" in base.columns else _trimmed(k)
    # each task's queries read the whole base: for few it is packed anew, for more it is written first
    parts, few = blocks(asked.n), blocks(asked.n) <= FEW_BLOCKS
    dealt = base if few and "kind" in base.columns else base.repartition(blocks(held.n))
    b = packed(dealt, rows, trim) if few else settle(packed(dealt, rows, trim), "base-blocks")
    q = packed(queries.repartition(ceil(parts / FEW_READS) if few else parts), rows).select(F.col("key").alias("asking"), F.col("block").alias("q"))
    shares = ceil(4 * spark.sparkContext.defaultParallelism / (1 if few else parts))
    pairs = b.coalesce(shares).hint("shuffle_replicate_nl").crossJoin(q).select("asking", "q", "key", "block")

    def best(batches):
        known: dict[int, _Best] = {}
        at, y = None, None
        for batch in batches:
            for asking, q, place, block in zip(*batch.columns, strict=True):
                key = asking.as_py()
                if place != at:
                    at, y = place, _Side(unpacked(block), metric)
                if key not in known:
                    known[key] = _Best(_Side(unpacked(q), metric), k, metric, include_self)
                known[key].meet(y)
        for one in known.values():
            yield one.found()

    return pairs.mapInArrow(best, f"source {kind}, neighbour {kind}, score double")


def all_distances(queries: DataFrame, base: DataFrame, metric: str, most: int = MOST_ROWS) -> DataFrame:
    """(a, b, distance) for every row of queries(id, v) and of base(id, v), however many there are.

    NULL where a vector is NULL or has a NULL in it, where lengths differ, and for the cosine of a vector of length zero. The
    base is not shuffled; a task holds the queries of one partition, packed, at most ``most`` in a block.
    """
    count = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    rows = block_rows(count.dims)
    double = lambda df: df.select("id", F.col("v").cast("array<double>").alias("v"))
    parts = ceil((count.n or 1) * 8 * max(count.dims or 1, 1) / HELD_BYTES)
    q = packed(double(queries).repartition(parts), max(1, min(rows, most))).select(F.col("key").alias("asking"), F.col("block").alias("q"))
    pairs = packed(double(base), rows).hint("shuffle_replicate_nl").crossJoin(q).select("asking", "q", "block")

    def measure(batches):
        key, x = None, None
        for batch in batches:
            for asking, q, block in zip(*batch.columns, strict=True):
                if asking != key:
                    key, x = asking, _Runs(unpacked(q))
                y = _Runs(unpacked(block))
                step = max(1, (1 << 18) // max(1, len(y.ids)))
                for at in range(0, len(x.ids), step):
                    part = slice(at, min(at + step, len(x.ids)))
                    d, known = x.distances(part, y, metric)
                    i, j = (pa.array(c.ravel()) for c in np.indices(d.shape))
                    yield pa.RecordBatch.from_arrays([x.ids[part].take(i), y.ids.take(j), pa.array(d.ravel(), mask=~known.ravel())], ["a", "b", "distance"])

    kinds = (df.schema["id"].dataType.simpleString() for df in (queries, base))
    return pairs.mapInArrow(measure, "a {}, b {}, distance double".format(*kinds))


class _Runs:
    """A block's vectors by length; those with a NULL in them have no place."""

    def __init__(self, table: pa.Table):
        v, self.ids = column(table, "v"), column(table, "id")
        if v.null_count or v.flatten().null_count or len(np.unique(np.diff(v.offsets.to_numpy()))) > 1:
            size = np.array([-1 if x is None or None in x else len(x) for x in v.to_pylist()], int)
            self.runs = {int(n): (at := np.flatnonzero(size == n), matrix(v.take(pa.array(at)))) for n in np.unique(size) if n >= 0}
        else:
            x = matrix(v)
            self.runs = {x.shape[1]: (np.arange(len(x)), x)}

    def distances(self, part: slice, y: _Runs, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """Distances of some rows to all rows of y, and which of them there are."""
        shape = (part.stop - part.start, len(y.ids))
        out, known = np.full(shape, np.nan), np.zeros(shape, bool)
        for n in self.runs.keys() & y.runs.keys():
            (i, u), (j, w) = self.runs[n], y.runs[n]
            some = slice(*np.searchsorted(i, [part.start, part.stop]))
            at = np.ix_(i[some] - part.start, j)
            with np.errstate(all="ignore"):
                out[at] = _direct(u[some], w, metric)
            known[at] = np.multiply.outer(np.sqrt(_sum(u[some] * u[some])), np.sqrt(_sum(w * w))) != 0 if metric == "cosine" else True
        return out, known
