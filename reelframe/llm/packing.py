"""Best-fit packing of token sequences of at most `size` tokens.

Method: bulk-synchronous best-fit. Documents and gaps stand in one order by size. A superstep

* sorts: every document has a rank among those of its length, every gap one among those of its size;
* sweeps: going down the sizes, gaps are put on a stack and each document takes the top one, which is the smallest
  gap left that it fits (its successor). How deep the stack is before a size follows from running sums over the at
  most 2 * `size` sizes; with its rank, every document and gap knows the place on the stack that it takes or fills,
  and documents and gaps of one place, in order of size, alternate: a document's gap is the row before it. So a
  shuffle by place matches all of them at once, longest documents first;
* updates: conflicts are settled by rank, documents without a gap wait, gaps shrink.

First the longest documents open as many sequences as the volume needs, or as there are documents longer than half a
sequence. Steps repeat until all documents have a place; if a step places none, more sequences are opened. Where a
length has many more documents than there are gaps, equal ones go together. What is left in the end is cut into
sequences by its running sum, once that costs at most one sequence or a thousandth of all. The driver sees a few sums a
step, never documents, gaps or their sizes. Every step is written, so a lost executor costs a step's work at most. The
number of steps follows the number of documents in a sequence, not that of documents.

Defined results: a null or empty text is a document of one end token; only documents longer than `size` are
cut; repeated rows are packed as often as they occur; an empty table gives no rows.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import pieces
from .common import written

SALTS, LOSS = 256, 0.001


def ranked(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows plus rank_, from 0, among the rows of equal `by`. One shuffle, by (by, salt): a value that a third of the
    rows share is ranked in SALTS parts, whose counts give each part's first rank."""
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    counts = written(salted.groupBy(by, "salt_").agg(F.count("*").alias("n_")), name)
    before = Window.partitionBy(by).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(by, "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    nth = F.row_number().over(Window.partitionBy(by, "salt_").orderBy(*order))
    return salted.join(base.hint("merge"), [by, "salt_"]).select(*rows.columns, (F.col("base_") + nth - 1).alias("rank_"))


class Packing:
    """rows: the documents with their ranks; need: (length, n left, done), at most `size` rows; gaps: (sequence_id, gap)."""

    def __init__(self, rows: DataFrame, size: int, order: list[str]):
        self.size, self.columns, self.parts, self.opened, self.gaps, self.most = size, rows.columns, [], 0, None, size
        self.rows = written(ranked(rows, "length", order, "counts"), "ranked")
        self.need = written(self.rows.groupBy("length").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("done")), "need")

    def left(self):
        more = F.when(F.col("n") > 0, F.col("length"))
        return self.need.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * F.col("length")).alias("volume"), F.max(more).alias("longest"),
            F.sum(F.when(F.col("length") > self.size // 2, F.col("n")).otherwise(0)).alias("big"),
        ).first()

    def of(self, classes: DataFrame) -> DataFrame:
        """The documents whose length classes has, with its columns: `size` rows at most, so they are broadcast."""
        return self.rows.join(F.broadcast(classes), "length")

    def place(self, placed: DataFrame, need: DataFrame) -> None:
        self.parts.append(placed.select(*self.columns, "sequence_id", "offset"))
        self.need = need

    def open(self, left) -> None:
        """The longest documents begin sequences of their own."""
        more = max(left["big"], math.ceil(left["volume"] / self.size))
        before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        classes = self.need.withColumn("before", before).withColumn("taken", F.least("n", F.greatest(F.lit(0), F.lit(more) - F.col("before"))))
        classes = written(classes, "opening")
        new = self.of(classes.where("taken > 0")).where("rank_ >= done and rank_ < done + taken")
        new = new.withColumn("sequence_id", F.lit(self.opened) + F.col("before") + F.col("rank_") - F.col("done")).withColumn("offset", F.lit(0).cast("long"))
        new = written(new.select(*self.columns, "sequence_id", "offset"), "opened")
        fresh = new.select("sequence_id", (F.lit(self.size) - F.col("length")).cast("long").alias("gap")).where("gap > 0")
        self.gaps = fresh if self.gaps is None else self.gaps.unionByName(fresh)
        self.opened += min(more, left["n"])
        self.place(new, classes.select("length", (F.col("n") - F.col("taken")).alias("n"), (F.col("done") + F.col("taken")).alias("done")))

    def step(self) -> None:
        """One superstep: at most one document, or one run of equal documents, for each gap."""
        size = self.size
        gaps = ranked(self.gaps, "gap", ["sequence_id"], "gap_counts")
        counts = self.gaps.groupBy("gap").agg(F.count("*").alias("units"))
        total = F.sum(F.when(F.col("kind") == 0, F.col("units")).otherwise(0)).over(Window.partitionBy())
        none = F.lit(None).cast("long")
        both = counts.select(F.col("gap").alias("extent"), F.lit(0).alias("kind"), none.alias("length"), "units", none.alias("done"), F.lit(1).cast("long").alias("run"))
        both = both.unionByName(self.need.where("n > 0").select(none.alias("extent"), F.lit(1).alias("kind"), F.col("length").cast("long").alias("length"), F.col("n").alias("units"), "done", none.alias("run")))
        share = F.floor(F.col("units") / F.greatest(total, F.lit(1)))
        run = F.greatest(F.lit(1), F.least(share, F.floor(F.lit(size) / F.col("length")), F.lit(self.most))).cast("long")
        both = both.withColumn("run", F.coalesce("run", run)).withColumn("extent", F.coalesce("extent", F.col("run") * F.col("length"))).withColumn("n", F.col("units")).withColumn("units", F.floor(F.col("units") / F.col("run")))
        down = Window.orderBy(F.desc("extent"), "kind", "length")
        through = down.rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("at", F.row_number().over(down)).withColumn("sum", F.sum(F.when(F.col("kind") == 0, F.col("units")).otherwise(-F.col("units"))).over(through))
        both = both.withColumn("deep", F.col("sum") - F.least(F.lit(0), F.min("sum").over(through)))
        both = both.withColumn("deep", F.coalesce(F.lag("deep").over(down), F.lit(0))).withColumn("taken", F.when(F.col("kind") == 1, F.least("units", "deep")))
        sizes = written(both.select("kind", "extent", "length", "n", "run", "done", "at", "deep", "taken"), "sizes")

        here = sizes.where("kind = 0").select(F.col("extent").alias("gap"), "at", "deep")
        open_ = gaps.join(F.broadcast(here), "gap").select("sequence_id", "gap", "at", (F.col("deep") + F.col("rank_") + 1).alias("place"))
        wanted = sizes.where("taken > 0").select("length", "extent", "run", "done", "at", "deep", "taken")
        docs = self.of(wanted).where("rank_ >= done and rank_ < done + taken * run")
        nth = F.floor((F.col("rank_") - F.col("done")) / F.col("run"))
        docs = docs.select(*self.columns, "extent", "at", (F.col("deep") - nth).alias("place"), F.pmod(F.col("rank_") - F.col("done"), "run").alias("in_run"))
        rows = open_.unionByName(docs, allowMissingColumns=True)
        order = Window.partitionBy("place").orderBy("at", "in_run")
        latest = order.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select(
            *self.columns, "in_run", F.col("sequence_id").isNotNull().alias("is_gap"), F.lead("extent").over(order).alias("filled"),
            *[F.last(c, True).over(latest).alias(c) for c in ("sequence_id", "gap")],
        )
        rows = written(rows, "step")
        self.gaps = rows.where("is_gap").select("sequence_id", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")).where("gap > 0")
        placed = rows.where("not is_gap").withColumn("offset", F.lit(size) - F.col("gap") + F.col("in_run") * F.col("length"))
        gone = F.col("taken") * F.col("run")
        self.place(placed, sizes.where("kind = 1").select("length", (F.col("n") - gone).alias("n"), (F.col("done") + gone).alias("done")))

    def finish(self, left) -> None:
        """New sequences for all that is left, by its running sum: starts within a width of size - longest + 1 share one."""
        before = F.coalesce(F.sum(F.col("n") * F.col("length")).over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        classes = written(self.need.where("n > 0").withColumn("before", before), "rest")
        start = F.col("before") + (F.col("rank_") - F.col("done")) * F.col("length")
        rest = self.of(classes).where("rank_ >= done").withColumn("start_", start)
        rest = rest.withColumn("sequence_id", F.lit(self.opened) + F.floor(F.col("start_") / (self.size - left["longest"] + 1)))
        rest = rest.withColumn("offset", F.col("start_") - F.min("start_").over(Window.partitionBy("sequence_id")))
        self.parts.append(rest.select(*self.columns, "sequence_id", "offset"))

    def run(self) -> DataFrame:
        left = self.left()
        if left["n"]:
            self.open(left)
        while left["n"]:
            before, left = left["n"], self.left()
            if not left["n"]:
                break
            slow = left["n"] > 0.9 * before
            cost = math.ceil(left["volume"] / (self.size - left["longest"] + 1)) - math.ceil(left["volume"] / self.size)
            if slow and cost <= max(1, LOSS * self.opened):
                self.finish(left)
                break
            if left["n"] == before and self.most == 1:
                self.open(left)
                continue
            self.most = max(1, self.most // 2) if slow else self.most
            self.step()
        out = [p.select(*self.columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset")) for p in self.parts]
        empty = self.rows.limit(0).select(*self.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        return reduce(DataFrame.unionByName, out) if out else empty


def pack(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """rows with a `length` of 1 to `size`, plus sequence_id long and offset long. `order` makes ranks stable."""
    return Packing(rows, size, order).run()


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int | None = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document's pieces.

    Texts are read and encoded once; the pieces (a few integers each) are written and read again, so that
    neither ranking nor a lost executor encodes a text anew.
    """
    rows = written(pieces(docs, path, size, end_id), "pieces")
    return pack(rows, size, ["doc_id", "piece", "start", "ids_crc32"])
