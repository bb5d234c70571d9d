"""Shared parts of the two vector operators: usable vectors, classes of equal vectors, tiles of a bucket."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def comparable() -> Column:
    """Whether vec_id is given and v is a vector that is not null, not zero and holds only finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>): vectors that are not null, not zero and hold only finite components."""
    return rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v")).where(comparable())


def padded(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with all vectors as long as the longest, filled up with zeros."""
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(widest(rows)) - F.size("v"))))


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow list column as a matrix of doubles; vectors of other lengths than the longest are padded with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = width or int(lengths.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out, row = np.zeros((len(lengths), width)), np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def widest(rows: DataFrame) -> int:
    """The length of the longest vector v; 0 if there is none."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def tiled(members: DataFrame, queries: DataFrame, key: list[str], side: int) -> DataFrame:
    """Deals both sides of a bucket join into tiles of about side x side rows.

    members and queries carry the key columns; the result has the key, tile columns m and q, and the columns of
    both sides, one row a member (is_query false) or query (true). A bucket with n members gets ceil(n / side)
    member blocks; its queries go to each, in blocks of their own, so no task holds a crowded bucket. The table of
    bucket sizes is written first, so that Spark knows its size when it chooses between broadcast and shuffle.
    """
    salt = F.xxhash64(F.lit("tile"), "rep")
    m = members.groupBy(*key).agg(F.ceil(F.count("*") / side).alias("mb"))
    q = queries.groupBy(*key).agg(F.ceil(F.count("*") / side).alias("qb"))
    sizes = written(m.join(q, key), "sizes")
    own = members.join(sizes, key).withColumn("m", F.pmod(salt, "mb")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)))
    asked = queries.join(sizes, key).withColumn("q", F.pmod(salt, "qb")).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)))
    drop = ["mb", "qb"]
    return own.drop(*drop).withColumn("is_query", F.lit(False)).unionByName(asked.drop(*drop).withColumn("is_query", F.lit(True)), allowMissingColumns=True)
