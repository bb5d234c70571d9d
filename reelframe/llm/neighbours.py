"""Approximate nearest neighbours by inner product, with multiprobe p-stable hashing.

Method: vectors are lifted to one length (one more component, after Bachrach et al.), so the largest inner product
is the least Euclidean distance. Each of TABLES tables hashes by k functions floor((a.x + b) / w), a normal and
made orthogonal within a table; k follows the number of vectors, so that buckets stay small as the table grows. A
query visits its own bucket and VISITS - 1 perturbed ones in the order of their estimated success: the expected sum
of squared distances to the boundaries that a perturbation crosses, for the query's boundaries in ascending order
(Lv et al.). Only members of visited buckets are met; candidates of all tables are merged and ranked by the exact
inner product in double precision.

Equal vectors are one class. A task gets the buckets whose first functions agree, and matches members to visits by
sorted bucket keys; crowded groups are dealt in tiles of bounded size. A tile returns each query's n + 1 best, and of
those only what reaches the query's (2n + 2)-th best of a sample (an eighth of the vectors, SAMPLE at most): that many vectors are at least as
near, so what is less near is not wanted. No bucket is capped and none is one task's work.

Defined results: vectors that are null, zero or hold a null, NaN or infinite component take no part; shorter vectors
count as padded with zeros; ties go to the smaller vec_id; fewer candidates than asked give fewer rows; an empty
table gives no rows. Rows that share a vec_id are copies of one vector: give ids once.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, written
from .vectors import matrix, tiled, usable, widest

TABLES, WIDTH, VISITS, SIDE, SAMPLE, PAIRS = 48, 2.0, 30, 2048, 16_384, 400_000


def functions_for(n: int) -> int:
    """Hash functions a table: 8 for 2,000 vectors, and 9 more for each factor of a million."""
    return max(4, round(0.45 * math.log2(max(n, 2)) + 3))


def prefix_for(n: int, hashes: int) -> int:
    """How many functions choose a task: each has about three cells that matter."""
    return min(hashes, max(1, round(math.log(max(1.0, n / SIDE), 3))))


class Hashes:
    """All tables' functions. Bucket and task keys are sums of each function's cell times an odd number, so that a move of one cell adds or takes that number."""

    def __init__(self, dims: int, tables: int, hashes: int, prefix: int, w: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.w = tables, hashes, w
        own = [np.concatenate([np.linalg.qr(rng.standard_normal((dims, min(dims, hashes - at))))[0] for at in range(0, hashes, dims)], axis=1) for _ in range(tables)]
        self.directions = np.concatenate(own, axis=1) * math.sqrt(dims)
        self.shift = rng.random(tables * hashes) * w
        self.bucket = rng.integers(1, 1 << 63, tables * hashes, dtype=np.uint64) | U64(1)
        self.task = np.where(np.arange(tables * hashes) % hashes < prefix, rng.integers(1, 1 << 63, tables * hashes, dtype=np.uint64) | U64(1), U64(0))
        self.table = rng.integers(1, 1 << 63, tables, dtype=np.uint64)

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = (points @ self.directions + self.shift) / self.w
        cell = np.floor(value)
        return cell.astype(np.int64).view(np.uint64), value - cell

    def keys(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket key, task key) of each row and table."""
        shape = (len(cells), self.tables, self.hashes)
        bucket, task = ((cells * by).reshape(shape).sum(axis=2, dtype=np.uint64) for by in (self.bucket, self.task))
        return bucket + self.table, task + self.table

    def visits(self, points: np.ndarray, template: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket keys, task keys), rows x tables x visits: the own bucket, then those of the template."""
        cells, inside = self.cells(points)
        shape = (len(points), self.tables, 2 * self.hashes)
        gaps = np.concatenate([inside.reshape(len(points), self.tables, -1), 1 - inside.reshape(len(points), self.tables, -1)], axis=2)
        near = np.argsort(gaps, axis=2, kind="stable")
        out = []
        for own, by in zip(self.keys(cells), (self.bucket, self.task)):
            by = by.reshape(self.tables, self.hashes)
            moves = np.take_along_axis(np.broadcast_to(np.concatenate([U64(0) - by, by], axis=1), shape), near, axis=2)
            out.append(np.stack([own + (moves[:, :, list(x)].sum(axis=2, dtype=np.uint64) if x else U64(0)) for x in template], axis=2))
        return out[0], out[1]


def template(hashes: int, visits: int) -> list[tuple[int, ...]]:
    """The `visits` perturbation sets of least expected score, as ranks of boundaries in ascending order of distance.

    Shift and expand; the j-th nearest and the j-th farthest boundary belong to one function, so a set that has both
    is passed over.
    """
    m = hashes
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    scores = near + [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    heap, out = [(scores[0], (0,))], [()]
    while heap and len(out) < visits:
        score, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - c not in chosen for c in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - scores[last] + scores[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (score + scores[last + 1], chosen + (last + 1,)))
    return out


def lifted(points: np.ndarray, scale: float, query: bool) -> np.ndarray:
    """Members, in units of the longest vector, get the component that makes them unit vectors; queries are scaled to length one."""
    size = np.sqrt((points**2).sum(axis=1))
    if query:
        return np.column_stack([points / np.where(size > 0, size, 1.0)[:, None], np.zeros(len(points))])
    return np.column_stack([points / scale, np.sqrt(np.maximum(0.0, 1 - (size / scale) ** 2))])


def member_rows(classes: DataFrame, make, scale: float, width: int, kind: str) -> DataFrame:
    """(g long, bucket long, rep, v): one row a class and table."""

    def run(batches):
        own = make()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                bucket, task = own.keys(own.cells(lifted(matrix(part.column(1), width), scale, False))[0])
                row = pa.array(np.repeat(np.arange(part.num_rows), own.tables))
                yield pa.RecordBatch.from_arrays([pa.array(task.ravel().view(np.int64)), pa.array(bucket.ravel().view(np.int64)), part.column(0).take(row), part.column(1).take(row)], names=["g", "bucket", "rep", "v"])

    return classes.select("rep", "v").mapInArrow(run, f"g long, bucket long, rep long, v {kind}")


def query_rows(asked: DataFrame, make, scale: float, width: int, kind: str, visits: int, sample: np.ndarray, n: int) -> DataFrame:
    """(g long, buckets array<long>, bound double, rep, v): one row a query and task, with the buckets to visit there."""

    def run(batches):
        own = make()
        sets = template(own.hashes, visits)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                points = matrix(part.column(1), width)
                bucket, task = (x.reshape(-1) for x in own.visits(lifted(points, scale, True), sets))
                near = points @ sample.T
                bound = np.partition(near, -2 * n, axis=1)[:, -2 * n] if near.shape[1] >= 2 * n else np.full(len(points), -np.inf)
                row = np.repeat(np.arange(len(points)), own.tables * len(sets))
                order = np.lexsort((bucket, task, row))
                bucket, task, row = bucket[order], task[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(bucket.view(np.int64)))
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task[first].view(np.int64)), lists, pa.array(bound[row[first]]), part.column(0).take(take), part.column(1).take(take)],
                    names=["g", "buckets", "bound", "rep", "v"],
                )

    return asked.select("rep", "v").mapInArrow(run, f"g long, buckets array<long>, bound double, rep long, v {kind}")


def met(bucket: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high): members sorted by bucket, and the stretch of them that each visit meets."""
    order = np.argsort(bucket, kind="stable")
    asked = lists.flatten().to_numpy(zero_copy_only=False)
    return order, np.searchsorted(bucket[order], asked, "left"), np.searchsorted(bucket[order], asked, "right")


def best_of(n: int, width: int):
    """A function of a tile: (query_id, rep, score), each query's n best of the members that its visits meet."""

    def best(key, group):
        is_query = group["is_query"].combine_chunks()
        ours, asked = group.filter(pc.invert(is_query)), group.filter(is_query)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if ours.num_rows and asked.num_rows:
            rep, query = ours["rep"].to_numpy(), asked["rep"].to_numpy()
            points, wanted, bound = matrix(ours["v"], width), matrix(asked["v"], width), asked["bound"].to_numpy()
            lists = asked["buckets"].combine_chunks()
            order, low, high = met(ours["bucket"].to_numpy(), lists)
            each = np.repeat(np.arange(len(query)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            found = high - low
            each, low, found = each[found > 0], low[found > 0], found[found > 0]
            ends, at = np.cumsum(found), 0
            last = np.append(np.flatnonzero(each[1:] != each[:-1]), len(each) - 1) if len(each) else []  # a query's visits stay together
            for stop in last:
                if ends[stop] - (ends[at - 1] if at else 0) < PAIRS and stop != last[-1]:
                    continue
                size, start = found[at : stop + 1], low[at : stop + 1]
                q = np.repeat(each[at : stop + 1], size)
                m = order[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
                score = np.concatenate([np.einsum("ik,ik->i", wanted[q[s : s + PAIRS]], points[m[s : s + PAIRS]]) for s in range(0, len(q), PAIRS)])
                good = score >= bound[q] - 1e-9 * (1 + np.abs(bound[q]))
                q, m, score = q[good], m[good], score[good]
                rank = np.lexsort((rep[m], -score, q))
                q, m, score = q[rank], m[rank], score[rank]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                few = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < n
                out.append((query[q[few]], rep[m[few]], score[few]))
                at = stop + 1
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table({"query_id": pa.array(columns[0]), "rep": pa.array(columns[1]), "score": pa.array(columns[2])})

    return best


def count_met(n: int, width: int):
    """A function of a tile: (query_id, rep) of all that a query meets, to measure how much the tables prune."""

    def pairs(key, group):
        is_query = group["is_query"].combine_chunks()
        ours, asked = group.filter(pc.invert(is_query)), group.filter(is_query)
        lists = asked["buckets"].combine_chunks()
        order, low, high = met(ours["bucket"].to_numpy(), lists)
        each = np.repeat(asked["rep"].to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        m = order[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange((high - low).sum())]
        return pa.table({"query_id": pa.array(np.repeat(each, high - low)), "rep": pa.array(ours["rep"].to_numpy()[m])})

    return pairs


def tiles_of(classes: DataFrame, asked: DataFrame, kind: str, n: int, tables: int, hashes: int | None, w: float, visits: int) -> tuple[DataFrame, int]:
    """The tiles of members and visiting queries, and the vectors' length. classes and asked: (rep, v)."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    total, scale = classes.agg(F.count("*"), F.max(norm)).first()
    width = max(widest(classes), widest(asked))
    k = hashes or functions_for(total)
    make = lambda prefix=prefix_for(total, k): Hashes(width + 1, tables, k, prefix, w)
    few = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(0.125, 0.9 * SAMPLE / total))).limit(SAMPLE)
    sample = matrix(few.select("v").toArrow()["v"], width)
    members = member_rows(classes.select("rep", F.col("v").cast(kind).alias("v")), make, scale, width, kind)
    probes = query_rows(asked.select("rep", F.col("v").cast(kind).alias("v")), make, scale, width, kind, visits, sample, n + 1)
    return tiled(members, probes, ["g"], SIDE).select("g", "m", "q", "is_query", "rep", "v", "bucket", "buckets", "bound"), width


def search(rows: DataFrame, queries: DataFrame, n: int = 20, tables: int = TABLES, hashes: int | None = None, w: float = WIDTH, visits: int = VISITS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's n nearest of all rows but itself, by inner product.

    w is in units of the projections' deviation. `queries` has the columns of `rows`.
    """
    good = written(usable(rows, id_col, vector_col), "usable")
    one = lambda d: d.groupBy("vec_id").agg(F.min("v").alias("v"))  # noqa: E731  of vectors that share an id the least one takes part
    asked = written(one(usable(queries, id_col, vector_col)).select(F.col("vec_id").alias("rep"), "v"), "asked")
    # a class keeps its n + 1 smallest ids: no query can need more of them
    first = F.row_number().over(Window.partitionBy("v", "part").orderBy("vec_id"))
    kept = one(good).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", first).where(F.col("r") <= n + 1)
    kept = kept.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, n + 1).alias("ids"))
    classes = written(kept.select("v", F.element_at("ids", 1).alias("rep"), "ids"), "classes")
    if classes.isEmpty() or asked.isEmpty():
        return good.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as they are
    tiles, width = tiles_of(classes.select("rep", "v"), asked, kind, n, tables, hashes, w, visits)
    found = tiles.groupBy("g", "m", "q").applyInArrow(best_of(n + 1, width), "query_id long, rep long, score double")
    found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n + 1)
    expanded = found.join(classes.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return expanded.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def share_met(rows: DataFrame, queries: DataFrame, n: int = 20, tables: int = TABLES, hashes: int | None = None, w: float = WIDTH, visits: int = VISITS, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of (query, vector) pairs that meet in any visited bucket: what search compares exactly."""
    good = written(usable(rows, id_col, vector_col).select(F.col("vec_id").alias("rep"), "v"), "usable")
    asked = written(usable(queries, id_col, vector_col).select(F.col("vec_id").alias("rep"), "v"), "asked")
    tiles, width = tiles_of(good, asked, "array<double>", n, tables, hashes, w, visits)
    pairs = tiles.groupBy("g", "m", "q").applyInArrow(count_met(n, width), "query_id long, rep long").distinct().count()
    return pairs / (good.count() * asked.count())
