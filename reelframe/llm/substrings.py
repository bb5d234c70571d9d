"""Incremental substring de-duplication over a log-structured index of window fingerprints.

Method: the index is a list of immutable runs, each a table of window hashes bucketed and sorted by hash, and beside
them tables of segments (hash, segment digest, document, place), bucketed alike, that keep the first of equal ones. A new
batch is sorted into a run of its own and merge-joined, bucket by bucket and without a shuffle, with every earlier run;
hashes that meet are repeats. Their segments, old and new, are looked up: those equal in hash and digest (128 bits) hold the
same windows, and of unequal ones the windows themselves are compared (by a digest of 128 bits). FAN_IN runs of like size
are compacted into one, so a hash is rewritten once a level, and there are fewer than FAN_IN runs a level. A window's hash is that
of its anchor (see windows.py), so one segment serves all neighbouring windows that share an anchor.

An index lives in the warehouse under its name: a later call opens it again, and its documents are then de-duplicated
against all that earlier calls put in. What belongs to it is listed in a manifest, written last, so a call that fails
leaves the index as it was, and a call that is repeated gives the same rows. It takes one writer at a time.

Defined results: a null, empty or short text (fewer words than a window) is kept whole; words are removed if a
window that covers them has the same words as one that starts earlier (smaller doc_id, or same document);
a repeated row gets its document's result; a row without doc_id keeps its text; an empty table gives no rows.
"""
from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shuffle_partitions, texts, written
from .windows import removal, repeated_starts, segments

FAN_IN, BATCHES = 4, 5


class FingerprintIndex:
    """Sorted runs (h, n) and segments (h, sd, doc_id, at) in the warehouse. name: opens the index of that name if there is one."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.rows = spark, name or f"fingerprints_{uuid.uuid4().hex}", {}
        mine = self.found()
        self.made = max((k for _, k, _ in mine.values()), default=-1) + 1
        self.buckets = next((n for *_, n in mine.values()), buckets or shuffle_partitions(spark))  # all runs have as many, or they could not be merge-joined
        manifests = [t for t, (kind, *_) in mine.items() if kind == "manifest"]
        if manifests:
            self.rows = {r["name"]: r["rows"] for r in spark.table(max(manifests, key=lambda t: mine[t][1])).collect()}  # a few names a level
        self.committed = set(self.rows)

    def found(self) -> dict[str, tuple[str, int, int]]:
        """The tables of this index, listed or not: (kind, number, buckets) of each."""
        tables = [t.name for t in self.spark.catalog.listTables(pattern=f"{self.name}_*")]
        parsed = {t: re.fullmatch(rf"{self.name}_(runs|entries|manifest)_(\d+)_[0-9a-f]+_of_(\d+)", t) for t in tables}
        return {t: (m[1], int(m[2]), int(m[3])) for t, m in parsed.items() if m}

    def of(self, kind: str) -> list[str]:
        return [t for t in self.rows if t.startswith(f"{self.name}_{kind}_")]

    @property
    def runs(self) -> list[str]:
        return self.of("runs")

    @property
    def entries(self) -> list[str]:
        return self.of("entries")

    def table(self, kind: str) -> str:
        """A new name; its random part keeps clear of files that a failed write left without a table."""
        self.made += 1
        return f"{self.name}_{kind}_{self.made - 1}_{uuid.uuid4().hex[:8]}_of_{self.buckets}"

    def write(self, kind: str, dealt: DataFrame) -> str:
        """dealt is partitioned by h, so that a bucket is one file."""
        name = self.table(kind)
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(name)
        self.rows[name] = self.spark.table(name).count()
        return name

    def add(self, batch: DataFrame, commit: bool = True) -> DataFrame:
        """The hashes h of a batch that occur twice in it or in an earlier run; equal ones are combined before they are shuffled."""
        before = self.runs
        now = self.spark.table(self.write("runs", batch.groupBy("h").agg(F.count("*").alias("n"))))
        found = [now.where("n > 1").select("h")]
        found += [now.join(self.spark.table(old).hint("merge"), "h", "left_semi").select("h") for old in before]
        repeats = written(reduce(DataFrame.unionByName, found), "repeats")
        self.compact("runs", lambda rows: rows.groupBy("h").agg(F.sum("n").alias("n")))
        if commit:
            self.commit()
        return repeats

    def keep(self, entries: DataFrame) -> None:
        """Puts a batch's segments beside the runs: the first of equal ones, as later documents need no other."""
        self.write("entries", self.firsts(entries))
        self.compact("entries", self.firsts)

    def firsts(self, entries: DataFrame) -> DataFrame:
        least = entries.groupBy("h", "sd").agg(F.min(F.struct("doc_id", "at")).alias("first"))
        return least.select("h", "sd", "first.doc_id", "first.at").repartition(self.buckets, "h")

    def compact(self, kind: str, combine) -> None:
        """Merges FAN_IN tables of one level into one, as long as a level has as many."""
        while True:
            levels = {}
            for name in self.of(kind):
                levels.setdefault(level(self.rows[name]), []).append(name)
            full = next((names for names in levels.values() if len(names) >= FAN_IN), None)
            if full is None:
                return
            self.write(kind, combine(reduce(DataFrame.unionByName, map(self.spark.table, full))))
            for name in full:
                del self.rows[name]
                if name not in self.committed:  # the others stay until the manifest no longer names them
                    self.spark.sql(f"DROP TABLE {name}")

    def commit(self) -> None:
        """Makes what was added the index: a new manifest, after which tables that it does not name go."""
        manifest = self.table("manifest")
        self.spark.createDataFrame(list(self.rows.items()), "name string, rows long").coalesce(1).write.format("parquet").saveAsTable(manifest)
        self.committed = set(self.rows)
        for name in self.found().keys() - self.committed - {manifest}:
            self.spark.sql(f"DROP TABLE {name}")

    def lookup(self, hashes: DataFrame) -> DataFrame:
        """The kept segments of these hashes (distinct, written), which alone are shuffled."""
        met = [self.spark.table(t).join(hashes.hint("merge"), "h", "left_semi") for t in self.entries]
        return reduce(DataFrame.unionByName, met)

    def drop(self) -> None:
        for name in self.found():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.rows, self.committed = {}, set()


def level(rows: int) -> int:
    """Tables of one level differ in size by less than FAN_IN times."""
    out = 0
    while rows >= FAN_IN:
        rows, out = rows // FAN_IN, out + 1
    return out


def deduplicate(docs: DataFrame, size: int = 20, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, kept, n_words, n_removed, spans), one row a document of docs.

    index: one that stays; without it, an index of this call alone is made and dropped. history: the documents that
    earlier calls put into the index (with the same columns), whose ids must all be smaller. Of history only the texts
    that share an anchor with docs are shuffled. batches: how many the documents are taken in; BATCHES for an index of
    this call alone, else one, as earlier runs are read once a batch.

    Shuffled are: hashes (a seventh of the words), segments of docs once, windows of anchors with unequal segments, and the
    texts twice: to those windows, and to the removal.
    """
    spark, plain = docs.sparkSession, texts(docs, id_col, text_col)
    own = index or FingerprintIndex(spark)
    batches = batches or (BATCHES if index is None else 1)
    entries = segments(docs, size, id_col=id_col, text_col=text_col).withColumn("batch", F.pmod("doc_id", F.lit(batches)).cast("int"))
    entries = written(entries, "entries")
    try:
        again = [own.add(entries.where(F.col("batch") == k).select("h"), commit=False) for k in range(batches)]
        again = written(reduce(DataFrame.unionByName, again).distinct(), "again")
        # a join right above an aggregate could not be split where a hash is crowded
        found = written(entries.select("h", "sd", "doc_id", "at").join(again.hint("merge"), "h"), "repeated")
        if index is not None:
            if index.entries:
                found = found.unionByName(written(index.lookup(again), "earlier"))
            index.keep(entries)
            index.commit()
    finally:
        if index is None:
            own.drop()
    remove(entries)
    known = None if history is None else texts(history, id_col, text_col)
    return removal(plain, repeated_starts(plain, found, size, known), size)
