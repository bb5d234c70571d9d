"""A table that a stream can write to again and again: upserts by key, swapped in by a manifest, each micro-batch once.

A table is a folder. `data/` holds immutable Parquet parts by bucket of the key; `manifests/version=N` is one JSON file that names the
live part of every bucket and the last micro-batch applied of every query. A batch writes new parts for the buckets it touches,
then the next manifest; only that makes them visible. So a replayed batch finds itself in the manifest and changes nothing, a batch
that dies in between leaves parts that no manifest names, and readers of one version never see half of another.

One writer at a time: a manifest that exists already makes a second writer fail instead of losing the first one's rows.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manage import upsert

MANIFEST = "parts map<string,string>, applied map<string,long>"


class DurableTable:
    """A keyed table under `path`. removed: a boolean column of changes that marks rows to take out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, removed: str | None = None):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.removed = spark, path.rstrip("/"), schema, keys, buckets, removed

    def create(self) -> DurableTable:
        """Writes the empty first version, unless the table is there already."""
        first = self.spark.createDataFrame([({}, {})], MANIFEST)
        first.coalesce(1).write.mode("ignore").json(f"{self.path}/manifests/version=0")
        return self

    def manifest(self) -> tuple[int, dict, dict]:
        rows = self.spark.read.schema(MANIFEST + ", version long").json(f"{self.path}/manifests").where("parts is not null")
        last = rows.agg(F.max(F.struct("version")).alias("v")).first()["v"]["version"]
        row = rows.where(F.col("version") == last).first()
        return last, row["parts"], row["applied"] or {}

    def read(self) -> DataFrame:
        """The live version, as it is now: later batches do not change what this frame reads."""
        return self.parts(self.manifest()[1])

    def parts(self, live: dict[str, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in sorted(live.values())])

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket_", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string"))

    def apply(self, changes: DataFrame, batch_id: int, query: str, order: str | None = None) -> bool:
        """Upserts a micro-batch; False if it had been applied before. order: of what a key has and of its changes the greatest by it
        stays, so a change that comes late takes nothing back; without it a key's one change counts."""
        version, live, applied = self.manifest()
        if batch_id <= applied.get(query, -1):
            return False
        fresh = self.bucketed(changes)
        touched = [r["bucket_"] for r in fresh.select("bucket_").distinct().collect()]  # at most `buckets` numbers
        if touched:
            before = self.parts({b: p for b, p in live.items() if b in touched})
            merged = self.latest(before, changes, order) if order else upsert(before, changes, self.keys, self.removed)
            merged = self.bucketed(merged).repartition("bucket_")
            token = f"data/{query}-{batch_id}-{uuid.uuid4().hex}"
            columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
            merged.select(*columns, "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{token}")
            written = self.spark.read.schema(f"{self.schema}, bucket_ string").parquet(f"{self.path}/{token}").select("bucket_").distinct().collect()
            there = {r["bucket_"] for r in written}
            live = {b: p for b, p in live.items() if b not in touched} | {b: f"{token}/bucket_={b}" for b in touched if b in there}
        self.swap(version + 1, live, applied | {query: batch_id})
        return True

    def latest(self, before: DataFrame, changes: DataFrame, order: str) -> DataFrame:
        flag = [self.removed] if self.removed else []
        rows = before.select("*", *[F.lit(False).alias(c) for c in flag]).unionByName(changes)
        fields = [F.col(c) for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(F.col(order).alias("at_"), F.struct(*fields).alias("row_"))).alias("m_")).select(*self.keys, "m_.row_.*")
        return last.where(~F.coalesce(F.col(self.removed), F.lit(False))).drop(self.removed) if self.removed else last

    def swap(self, version: int, live: dict, applied: dict) -> None:
        rows = self.spark.createDataFrame([(live, applied)], MANIFEST)
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/version={version}")

    def sink(self, query: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: every batch once, however often the stream starts again."""

        def take(batch: DataFrame, batch_id: int) -> None:
            kept = batch.persist()
            try:
                self.apply(kept, batch_id, query, order)
            finally:
                kept.unpersist()

        return take
