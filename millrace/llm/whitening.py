"""PCA whitening of embeddings on MLlib's BlockMatrix.

Centred rows are numbered and cut into distributed blocks; the transpose times the blocks gives the scatter matrix, whose
eigenvectors the driver finds (one matrix of dimensions by dimensions); the blocks times the whitening matrix are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import settle

COMPONENTS = 32
#: Entries beyond this are clipped to it, so that whole numbers and their sums stay exact.
MOST_ENTRY = 2.0**40
#: The driver holds one matrix of these dimensions squared (128 MB).
MOST_DIMENSIONS = 4096
#: Blocks hold this many rows, or so many more that there are at most MOST_BLOCKS: MLlib's driver lists the blocks.
BLOCK, MOST_BLOCKS = 1024, 50_000


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x array<long>, row) of the usable vectors as a written table, rows numbered from 0 without gaps, and the dimension."""
    c = F.col(vector_col)
    usable = embeddings.select(F.col(id_col).alias("vec_id"), c.cast("array<double>").alias("c")).where(c.isNotNull() & (F.size(c) > 0)).where(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    common = usable.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS}")
    x = F.transform("c", lambda v: F.floor(64 * F.greatest(F.least(v, F.lit(MOST_ENTRY)), F.lit(-MOST_ENTRY))) + 1_000_000)
    parts = usable.where(F.size("c") == d).select("vec_id", x.alias("x"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    parts = settle(parts, "whitening-rows")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return parts.join(F.broadcast(starts), "part").select("vec_id", "x", (F.col("start") + F.col("at")).alias("row")), d


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(values: np.ndarray) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(values.reshape(-1)))


def sums(rows: DataFrame, column: str) -> tuple[int, list, list]:
    """(rows, sum by dimension, largest absolute value by dimension); sums of whole numbers are exact. A task returns a row a dimension."""
    whole = rows.schema[column].dataType.elementType.typeName() == "long"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                v = _matrix(batch.slice(at, 4096).column(0))
                add = [int(s) for s in v.sum(axis=0)] if whole else [float(s) for s in v.sum(axis=0)]
                top = np.abs(v).max(axis=0).astype(float)
                n += len(v)
                total, most = (add, top) if total is None else ([a + b for a, b in zip(total, add, strict=True)], np.maximum(most, top))
        if n:
            kind = pa.decimal128(38, 0) if whole else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(t) for t in total] if whole else total, kind), pa.array(most)], names=["dim", "n", "s", "most"])

    out = rows.select(column).mapInArrow(partial, f"dim int, n long, s {'decimal(38,0)' if whole else 'double'}, most double")
    got = out.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).orderBy("dim").collect()
    return (got[0].n if got else 0), [int(r.s) if whole else r.s for r in got], [r.most for r in got]


def centred(rows: DataFrame, n: int, total: list[int], most: list[float]) -> DataFrame:
    """(vec_id, row, centred array<double>, deviation) of whole numbers; n * x - S is exact, deviations beyond a long are NULL."""
    small = n * max(most, default=0) < 2.0**62

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(total, dtype=np.int64 if small else object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = _matrix(part.column(1))
                q = (v if small else v.astype(object)) * n - s
                f = q.astype(np.float64)
                size = (f * f).sum(axis=1)
                exact: list[int | None] = [None] * len(v)
                for i in np.nonzero(size < 2.0**64)[0]:
                    e = int((q[i] * q[i]).sum()) if size[i] < 2.0**62 else sum(int(k) ** 2 for k in q[i])
                    exact[i] = e if e < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _lists(f / n), pa.array(exact, pa.int64())], names=["vec_id", "row", "centred", "deviation"])

    return rows.select("vec_id", "x", "row").mapInArrow(work, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, row long, centred array<double>, deviation long")


def blocks(rows: DataFrame, column: str, n: int, d: int) -> BlockMatrix:
    """Numbered rows of an array column as distributed blocks; vectors are made on the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(max(BLOCK, -(-n // MOST_BLOCKS)), BLOCK)


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transpose times the matrix, for the driver. The middle dimension is split, otherwise every block would meet in the task of the result's only block."""
    java = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, max(1, m.numRows() // m.rowsPerBlock + 1))
    s = BlockMatrix(java, BLOCK, BLOCK).toLocalMatrix().toArray()
    return (s + s.T) / 2


def project(m: BlockMatrix, w: np.ndarray, spark) -> DataFrame:
    """(row, values): rows times the matrix w, which is one small BlockMatrix."""
    small = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(w)], ["index", "vector"])
    right = IndexedRowMatrix(small, *w.shape).toBlockMatrix(BLOCK, BLOCK)
    out = m.multiply(right).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", out._java_matrix_wrapper._java_model).select(F.col("index").alias("row"), vector_to_array("vector").alias("values"))


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, falling, their unit eigenvectors as columns, and the trace."""
    e, q = np.linalg.eigh(v)
    at = np.argsort(-e, kind="stable")[:k]
    return e[at], q[:, at], float(np.trace(v))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another
    dimension than the commonest (of two as common, the larger). Components without variance (eigenvalue not
    above rounding) have a NULL whitened value and do not count in identity_error, which is NULL if all are such; explained is
    then 0, or NULL if nothing varies at all. deviation is NULL where it exceeds a long. Repeated rows, ties and null ids are
    rows like any other, no usable vector gives no rows, other columns are not read.
    """
    spark = embeddings.sparkSession
    rows, d = whole_numbers(embeddings, id_col, vector_col)
    n, total, most = sums(rows, "x")
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    base = centred(rows, n, total, most)
    k = min(components, d)
    m = blocks(base, "centred", n, d)
    e, q, trace = eigen(scatter(m) / n, k)
    real = e > max(e[0], 0) * d * np.finfo(float).eps
    w = np.where(real, q / np.sqrt(np.where(real, e, 1)), 0)
    out = settle(project(m, w, spark), "whitening-projected")
    error = None
    if real.any():
        mean = np.array(sums(out, "values")[1]) / n
        z = out.select("row", F.zip_with("values", F.array(*(F.lit(float(x)) for x in mean)), lambda a, b: a - b).alias("z"))
        cov = scatter(blocks(z, "z", n, k)) / n
        error = float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max())
    share = [float(max(x, 0) / trace) if trace > 0 else None for x in e]
    column = lambda values, kind: F.array(*(F.lit(x).cast(kind) for x in values))
    wide = base.select("vec_id", "row", "deviation").join(out, "row")
    long = wide.select("vec_id", "deviation", F.posexplode("values").alias("i", "value"))
    at = lambda values, kind: F.element_at(column(values, kind), F.col("i") + 1)
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(at([bool(x) for x in real], "boolean"), F.col("value")).alias("whitened"), at(share, "double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
