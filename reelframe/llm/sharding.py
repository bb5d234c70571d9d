"""Minimax contiguous sharding of atomic groups, by DataFrame operations alone.

Method: minimax contiguous partition. Groups (equal texts) stand in a fixed order of their hash; the
smallest feasible shard capacity is found by binary search, a capacity being feasible if greedy filling needs
at most the given number of shards; the groups are cut there. Groups and their running sums stay in Spark.
The search looks at them through a summary of at most CELLS cells and refines the cells that cuts can fall
into until the answer is exact; each refinement is one aggregate over a sorted Parquet column. Among cuts
with that capacity the remaining shards are filled evenly.

Defined results: a null text counts as no bytes and is one group with the other nulls, apart from empty
texts; repeated rows are members of their group; fewer groups than shards leave shards empty; an empty
table gives no rows. A group is never split, so one that exceeds the mean sets the capacity.
"""
from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SALTS, BUCKETS, CELLS = 256, 4096, 1 << 16
GROUP = ["h", "text_crc32", "size", "empty"]


class Boundaries:
    """Group ends in order, seen from the driver through a summary of at most CELLS cells a refinement.

    A cell knows the least and the greatest end in a stretch of positions and their number. What a lookup needs
    beyond that is fetched by refining the cells it falls into, again to at most CELLS cells.
    """

    def __init__(self, groups: DataFrame):
        self.ends = groups.select("end")
        first = groups.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
        self.total, self.largest = first["total"] or 0, first["largest"] or 0
        self.cells = self.fetch([(0, self.total)])
        self.mins = [c[0] for c in self.cells]

    def fetch(self, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Cells (least end, greatest end, number) of the closed stretches, none across two of them."""
        each = max(2, CELLS // max(1, len(stretches)))
        which, cell = F.lit(-1), F.lit(0).cast("long")
        for i, (a, b) in enumerate(stretches):
            here = F.col("end").between(a, b)
            which = F.when(here, i).otherwise(which)
            cell = F.when(here, F.floor((F.col("end") - a) / max(1, -(-(b - a + 1) // each)))).otherwise(cell)
        inside = F.col("end").between(min(a for a, _ in stretches), max(b for _, b in stretches))
        found = self.ends.where(inside & (which >= 0)).groupBy(which.alias("s"), cell.alias("cell"))
        return sorted(tuple(r) for r in found.agg(F.min("end"), F.max("end"), F.count("*")).drop("s", "cell").collect())

    def refine(self, positions: list[tuple[int, int]]) -> None:
        """Refines every cell that overlaps one of the stretches and holds ends that are not known."""
        chosen = set()
        for a, b in positions:
            i = max(0, bisect.bisect_right(self.mins, a) - 1)
            while i < len(self.cells) and self.cells[i][0] <= b:
                if self.cells[i][2] > 2 and self.cells[i][1] > a:
                    chosen.add(i)
                i += 1
        stretches: list[list[int]] = []
        for i in sorted(chosen):
            if stretches and stretches[-1][2] == i - 1:
                stretches[-1][1:] = [self.cells[i][1], i]
            else:
                stretches.append([self.cells[i][0], self.cells[i][1], i])
        finer = self.fetch([(a, b) for a, b, _ in stretches]) if stretches else []
        self.cells = sorted([c for i, c in enumerate(self.cells) if i not in chosen] + finer)
        self.mins = [c[0] for c in self.cells]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the last end at or below x (0 if there is none)."""
        i = bisect.bisect_right(self.mins, x) - 1
        if i < 0:
            return 0, 0
        least, most, n = self.cells[i]
        return (most, most) if most <= x else (least, least if n <= 2 else x)

    def beside(self, x: int) -> tuple[int, int]:
        """The last end at or below x, and the first one above it (the total at most), both exact."""
        while self.floor(x)[0] != self.floor(x)[1]:
            self.refine([(x, x)])
        low = self.floor(x)[0]
        i = bisect.bisect_right(self.mins, x)
        inside = i and self.cells[i - 1][1] > x
        return low, self.cells[i - 1][1] if inside else self.cells[i][0] if i < len(self.cells) else self.total


def greedy(bounds: Boundaries, limit: int, shards: int, side: int) -> list[int]:
    """Ends that greedy filling reaches shard by shard, taking lookups' lower (0) or upper (1) bounds."""
    at, out = 0, []
    for _ in range(shards):
        at = bounds.total if at + limit >= bounds.total else bounds.floor(at + limit)[side]
        out.append(at)
    return out


def capacity(bounds: Boundaries, shards: int) -> int:
    """The smallest feasible capacity, by binary search: at least the mean and the largest group, at most their sum."""
    least = max(-(-bounds.total // shards), bounds.largest)

    def smallest(side: int) -> int:
        low, high = least, least + bounds.largest
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if greedy(bounds, middle, shards, side)[-1] >= bounds.total else (middle + 1, high)
        return low

    while True:
        sure, hoped = smallest(0), smallest(1)  # the answer lies between what unknown ends allow at best and at worst
        if sure == hoped:
            return sure
        low, high = greedy(bounds, hoped, shards, 0), greedy(bounds, sure, shards, 1)
        bounds.refine([(a + hoped, b + sure) for a, b in zip([0, *low], [0, *high])])


def cuts(bounds: Boundaries, limit: int, shards: int) -> list[int]:
    """Ends of all shards but the last: no shard above `limit`, the rest as even as the order allows."""
    earliest = [bounds.total]  # where at the earliest the last 0, 1, 2 ... shards can begin
    for _ in range(shards - 1):
        x = earliest[-1] - limit
        earliest.append(0 if x <= 0 else bounds.beside(x - 1)[1])
    out, at = [], 0
    for k in range(shards - 1, 0, -1):
        target = at + -(-(bounds.total - at) // (k + 1))
        low, high = bounds.beside(target) if target < bounds.total else (bounds.total, bounds.total)
        near = low if high - at > limit or (low > at and target - low <= high - target) else high
        at = min(max(near, earliest[k]), bounds.total)
        out.append(at)
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row a document.

    Texts are read once, to hashes and sizes; nothing that holds a text is shuffled. A group's rows are dealt
    over SALTS parts, so one text that a third of all rows share is not one task's work.
    """
    text = docs[text_col].cast("string")
    rows = written(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            text.isNull().alias("empty"),
        ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")),
        "sizes",
    )
    parts = rows.groupBy(*GROUP, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*GROUP).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = written(parts, "parts")
    groups = parts.groupBy(*GROUP).agg(F.sum("n").alias("rows")).withColumn("bytes", F.col("rows") * F.col("size"))
    groups = groups.withColumn("bucket", F.shiftrightunsigned(F.col("h"), 52).cast("int"))
    running = Window.partitionBy("bucket").orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("end_", F.sum("bytes").over(running)).withColumn("rows_", F.sum("rows").over(running))
    # at most BUCKETS rows: their running sums give each bucket's offset
    totals = written(groups, "groups")
    offsets = totals.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("bucket", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b"), F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("r"))
    ordered = totals.join(F.broadcast(offsets), "bucket").select(
        *GROUP, "bytes", (F.col("end_") + F.col("b")).alias("end"), (F.col("rows_") + F.col("r") - F.col("rows")).alias("rows_before")
    )
    ordered = written(ordered.sortWithinPartitions("end"), "ordered")
    bounds = Boundaries(ordered)
    ends = cuts(bounds, capacity(bounds, shards), shards) if bounds.total else []
    shard = sum((F.when(F.col("end") > x, 1).otherwise(0) for x in ends), F.lit(0)).cast("int")
    placed = ordered.withColumn("shard", shard)
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))  # at most `shards` rows
    placed = placed.join(F.broadcast(firsts), "shard").select(*GROUP, "shard", (F.col("rows_before") - F.col("first")).alias("base"))
    slots = parts.join(placed, GROUP).select(*GROUP, "salt", "shard", (F.col("base") + F.col("within")).alias("base"))
    rank = F.row_number().over(Window.partitionBy(*GROUP, "salt").orderBy("doc_id"))
    out = rows.join(slots, [*GROUP, "salt"]).withColumn("slot", F.col("base") + rank - 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
