"""Near-duplicate vectors by product quantisation.

Method: vectors are scaled to length one and put into coarse inverted lists; what remains after the list's
centroid is cut into subspaces and coded by the nearest of 256 centroids each. Each vector looks into the lists
of its nearest centroids; distances to the codes are sums of table lookups (asymmetric: the query is not
coded); what comes near the threshold is compared exactly, by cosine in double precision.

Equal vectors are one class from the start. A pair is looked for from its smaller class's side alone, so links
are symmetric. A list is dealt in tiles of bounded size; a tile returns link counts and a spanning forest of its
links, never all pairs. Centroids are fitted on at most SAMPLE vectors; all vectors are indexed and compared.

Defined results: vectors that are null, zero or hold a null, NaN or infinite component have no links and are
kept; rows with equal vectors link with each other; repeated rows count as vectors; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .vectors import comparable, matrix, padded, tiled, usable

SAMPLE, SUBSPACES, CODES, PROBES, SIDE, MOST_LISTS = 20_000, 8, 256, 8, 2048, 4096


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm on a sample; empty centroids are set to random points."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        label = nearest(points, centroids)
        counts = np.bincount(label, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.integers(0, len(points), len(centroids))])
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The nearest centroid of each point, or its n nearest."""
    half = (centroids**2).sum(axis=1) / 2
    out = []
    for at in range(0, len(points), 4096):
        far = half - points[at : at + 4096] @ centroids.T
        out.append(far.argmin(axis=1) if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0,) if n == 1 else (0, n), dtype=np.int64)


def fit(unit: DataFrame, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(coarse centroids, centroids of each residual subspace) from at most SAMPLE vectors, the least by a hash of the id."""
    sample = unit.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * SAMPLE / total))).limit(SAMPLE) if total > SAMPLE else unit
    points = matrix(sample.select("v").toArrow()["v"])
    lists = int(min(MOST_LISTS, max(1, round(total**0.5))))
    coarse = kmeans(points, lists)
    residual = points - coarse[nearest(points, coarse)]
    return coarse, [kmeans(part, CODES) for part in np.array_split(residual, min(SUBSPACES, points.shape[1]), axis=1)]


def encode(unit: DataFrame, model, probes: int) -> DataFrame:
    """unit's columns plus list, codes binary and probes array: the inverted-list entry and where to look."""
    coarse, sub = model
    names = unit.columns

    def run(batches):
        for b in batches:
            points = matrix(b.column(names.index("v")))
            near = nearest(points, coarse, max(2, min(probes, len(coarse)))) if len(coarse) > 1 else np.zeros((len(points), 1), dtype=np.int64)
            parts = np.array_split(points - coarse[near[:, 0]], len(sub), axis=1)
            codes = np.stack([nearest(p, c) for p, c in zip(parts, sub)], axis=1).astype(np.uint8) if len(points) else np.zeros((0, len(sub)), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                names=[*names, "list", "codes", "probes"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema)
    return unit.mapInArrow(run, f"{schema}, list int, codes binary, probes array<int>")


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Links x and y in a forest of one level: every row's label is the least row of its group."""
    while (label[x] != label[y]).any():
        a, b = label[x], label[y]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def links(classes: DataFrame, threshold: float, probes: int, total: int) -> DataFrame:
    """(kind, a, b): kind 0: class a has b links to vectors of other classes, in one tile; kind 1: a and b are linked.

    classes: rep long, copies long, v array<double>, one row for each different vector.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    model = fit(classes.select("rep", F.transform("v", lambda x: x / norm).alias("v")), total)
    coarse, sub = model
    shared = classes.sparkSession.sparkContext.broadcast(model)  # at most MOST_LISTS and SUBSPACES * CODES centroids
    unit = classes.select("rep", "copies", F.col("v").alias("raw"), F.transform("v", lambda x: x / norm).alias("v"))
    entries = written(encode(unit, model, probes), "entries")
    members = entries.select("list", "rep", "copies", "raw", "codes")
    queries = entries.select(F.explode("probes").alias("list"), "rep", "copies", "raw")
    tiles = tiled(members, queries, ["list"], SIDE).select("list", "m", "q", "is_query", "rep", "copies", "raw", "codes")

    def compare(key, group):
        coarse, sub = shared.value
        asked = group["is_query"].to_numpy(zero_copy_only=False)
        rep, copies, raw = group["rep"].to_numpy(), group["copies"].to_numpy(), matrix(group["raw"].combine_chunks())
        own, ask = np.flatnonzero(~asked), np.flatnonzero(asked)
        if not len(own) or not len(ask):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        scaled = raw / np.abs(raw).max(axis=1)[:, None]
        unit = scaled / np.sqrt((scaled**2).sum(axis=1))[:, None]
        centre = coarse[key[0].as_py()]
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in group["codes"].combine_chunks().filter(pa.array(~asked)).to_pylist()])
        decoded = np.concatenate([c[codes[:, j]] for j, c in enumerate(sub)], axis=1)
        slack = np.sqrt(((unit[own] - centre - decoded) ** 2).sum(axis=1)).max()  # how far a code is from its vector, at most
        reach = (np.sqrt(max(0.0, 2 - 2 * threshold)) + slack) ** 2 + 1e-9
        count, label = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        for at in range(0, len(ask), 256):
            q = ask[at : at + 256]
            far = np.zeros((len(q), len(own)))
            for j, (part, c) in enumerate(zip(np.array_split(unit[q] - centre, len(sub), axis=1), sub)):
                table = (part**2).sum(axis=1)[:, None] - 2 * part @ c.T + (c**2).sum(axis=1)[None, :]
                far += table[:, codes[:, j]]
            i, j = np.nonzero((far <= reach) & (rep[q][:, None] < rep[own][None, :]))
            for s in range(0, len(i), 20_000):
                x, y = q[i[s : s + 20_000]], own[j[s : s + 20_000]]
                close = (unit[x] * unit[y]).sum(axis=1) >= threshold
                x, y = x[close], y[close]
                np.add.at(count, x, copies[y])
                np.add.at(count, y, copies[x])
                unite(label, x, y)
        some = np.flatnonzero(count)
        joined = np.flatnonzero(label != np.arange(len(rep)))
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(joined), np.int32)])
        a, b = np.concatenate([rep[some], rep[joined]]), np.concatenate([count[some], rep[label[joined]]])
        return pa.table({"kind": pa.array(kind), "a": pa.array(a), "b": pa.array(b)})

    return tiles.groupBy("list", "m", "q").applyInArrow(compare, "kind int, a long, b long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector, whatever its id: classes of equal vectors have numbers of their own."""
    good = written(padded(usable(rows, id_col, vector_col)), "usable")
    classes = good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    every = rows.select(rows[id_col].cast("long").alias("vec_id"))
    if not total:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(links(classes.select("rep", "copies", "v"), threshold, probes, total), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    parts = components(found.where("kind = 1").select("a", "b"))
    named = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select(
        "v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part")
    )
    named = written(named, "named")
    least = written(named.groupBy("part").agg(F.min("first").alias("component_id")), "least")
    members = good.join(named.join(least, "part").select("v", "n_links", "component_id"), "v").select("vec_id", "n_links", "component_id")
    bad = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v")).where(~comparable())
    out = members.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
