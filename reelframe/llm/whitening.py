"""Whitening of embeddings: centred, decorrelated and scaled to unit variance along the leading principal components.

Method: Spark MLlib's BlockMatrix. The distinct vectors, as whole numbers, are numbered gaplessly, centred, and laid into
distributed blocks of rows; the transposed matrix times the matrix is the scatter, whose eigenvectors are found on the driver
(dims x dims numbers); a second multiplication by the whitening matrix projects all rows, and a third gives the covariance of the
result, which is compared with the identity. Rows are centred before they are multiplied, from exact integer sums, so an
offset common to all entries costs no digits.

Both products with a transpose split the inner dimension, so their work is spread over as many tasks as there are partitions;
only dims x dims sums meet. Equal vectors are one row of the matrix, and their copies meet the result again by a join that can
be split, however many there are.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out, and so is a row without id; vectors shorter
than the longest are filled up with zeros; repeated ids are rows of their own; extra columns are ignored. Components without
variance (an eigenvalue within rounding of zero) cannot be whitened and are left out, so equal vectors alone, a single vector
and an empty table give no rows. deviation is null where it exceeds a long. Entries must lie within +-2^40.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, widest

ROWS, ROW_BITS = 4096, 33
SCALE, OFFSET = 64, 1_000_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>): entries c as floor(SCALE * c) + OFFSET, for vectors whose entries are all finite numbers."""
    v = rows[vector_col].cast("array<double>")
    out = rows.select(rows[id_col].cast("long").alias("vec_id"), v.alias("v")).where("v is not null and vec_id is not null")
    out = out.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    width = widest(out)
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    return out.select("vec_id", F.transform(filled, lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def numbered(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(index, x) of a written table of distinct vectors, numbered gaplessly from 0, and their number."""
    counts = sorted((r["part"], r["n"]) for r in vectors.groupBy(F.shiftright("at", ROW_BITS).alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(int).tolist()
    offsets = vectors.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(counts, before)], "part long, start long")
    placed = vectors.withColumn("part", F.shiftright("at", ROW_BITS)).join(F.broadcast(offsets), "part")
    return placed.select((F.col("start") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("index"), "x"), before[-1]


def sums(vectors: DataFrame) -> list[int]:
    """Exact sums by dimension: one row of partial sums a partition, added up by dimension."""

    def run(batches):
        total = None
        for b in batches:
            x = whole_matrix(b.column(0))
            part = x.sum(axis=0)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    parts = vectors.select("x").mapInArrow(run, "s array<long>")
    found = parts.select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    return [r["s"] for r in sorted(found)]


def whole_matrix(column) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centred(rows: DataFrame, n: int, s: list[int]) -> DataFrame:
    """(index, c array<double>, deviation long): x - S / n, and the exact sum of (n x - S)^2."""

    def run(batches):
        shift = np.array(s, dtype=np.int64)
        for b in batches:
            z = whole_matrix(b.column(1)) * np.int64(n) - shift if b.num_rows else np.zeros((0, len(s)), np.int64)
            most = int(np.abs(z).max(initial=0))
            if most * most * len(s) < 1 << 63:
                squares = (z * z).sum(axis=1).tolist()
            else:
                squares = [t if t < 1 << 63 else None for t in (z.astype(object) ** 2).sum(axis=1).tolist()]
            c = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, len(s)), pa.int32()), pa.array((z / n).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), c, pa.array(squares, pa.int64())], names=["index", "c", "deviation"])

    return rows.mapInArrow(run, "index long, c array<double>, deviation long")


def blocks_of(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("c").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(ROWS, dims)


def gram(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times the matrix. The inner dimension is dealt over `splits` tasks, an argument that multiply() has in
    Scala and Java but not in Python; without it one task would get all blocks."""
    left, right = blocks.transpose(), blocks
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray()


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of the covariance, by falling eigenvalue; the largest entry of each is positive."""
    v = (scatter + scatter.T) / (2 * n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    good = e > max(float(np.trace(v)), 0.0) * len(v) * np.finfo(float).eps
    e, u = e[good], u[:, good]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) if u.size else u
    return u, e, float(np.trace(v))


def projected(blocks: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    sc = blocks.blocks.context
    one = sc.parallelize([((0, 0), Matrices.dense(*weights.shape, weights.ravel(order="F").tolist()))], 1)
    return blocks.multiply(BlockMatrix(one, blocks.colsPerBlock, weights.shape[1], *weights.shape))


def whiten(rows: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, up to `most`."""
    spark = rows.sparkSession
    given = whole(rows, id_col, vector_col)
    distinct = written(given.select("x").distinct().withColumn("at", F.monotonically_increasing_id()), "vectors")
    indexed, n = numbered(distinct)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    s = sums(distinct)
    middle = written(centred(indexed, n, s), "centred")
    blocks = blocks_of(middle, n, len(s))
    splits = max(1, min(-(-n // ROWS), 16 * spark.sparkContext.defaultParallelism))
    u, e, trace = components(gram(blocks, splits), n, most)
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    product = projected(blocks, u / np.sqrt(e))
    error = float(np.abs(gram(product, splits) / n - np.eye(len(e))).max())
    values = product.toIndexedRowMatrix().rows.map(lambda r: (int(r.index), [float(y) for y in r.vector.toArray()]))
    values = written(spark.createDataFrame(values, "index long, y array<double>", verifySchema=False), "projected")
    found = written(indexed.join(middle.select("index", "deviation"), "index").join(values, "index").drop("index"), "whitened")
    share = F.element_at(F.array(*(F.lit(float(x / trace)) for x in e)), F.col("component"))
    out = given.join(found.hint("merge"), "x").select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    out = out.withColumn("component", F.col("at") + 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
