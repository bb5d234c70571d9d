"""Shared helpers of the training-data operators.

Conventions: an operator takes a DataFrame and column names, selects the columns it needs (so other
columns, whatever their names, never matter), casts ids to long, and reads a null text as empty.
"""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = b" \t\n\r\x0b\x0c"
U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string not null): the only two columns that text operators look at."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured and Spark runs on one machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: later jobs prune columns and
    row groups, which a checkpoint cannot. The shuffle files of the write go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a frame made by written()."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def small_batches(batches, rows: int = 256):
    """Arrow batches cut to few rows, so that what numpy derives from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Row ranges of a batch whose text takes about `limit` bytes; a longer text is a range of its own."""
    lengths = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash, kept for the words seen lately; emptied when it holds `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        import xxhash

        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes, by doubling: H(2k) from two H(k)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    keys = np.random.default_rng(seed).integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)
    out, have, level, width = None, 0, mix(words ^ keys[0]), 1
    step = 1
    while True:
        if size & width:
            part = level[have : have + n]
            out = part.copy() if out is None else mix(out * keys[step] + part)
            have += width
        if have == size:
            return out
        level = mix(level[:-width] * keys[step + 1] + level[width:])
        width *= 2
        step += 2


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, have = np.arange(len(values), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at[:n]


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each node over edges (a, b).

    Alternates large-star and small-star steps until no edge changes; each step is two shuffles of the
    edges and ends in a checkpoint. Nodes without an edge are left out unless `nodes` names them.
    A hub's neighbours are linked to the hub's minimum, never to each other, so rows do not multiply.
    """
    spark = edges.sparkSession
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    flat = cut(flat)
    if flat.isEmpty():
        stars = flat
    else:
        before = None
        while True:
            both = flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = large.where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a")
            small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            flat = cut(small.where("a <> b").distinct())
            now = flat.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        stars = flat
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = out.unionByName(roots)
    if nodes is None:
        return out
    named = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return named.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
