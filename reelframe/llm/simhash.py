"""SimHash fingerprints and exact near-duplicate links by covering locality-sensitive hashing.

Method: covering LSH. Every fingerprint bit i gets a nonzero (radius + 1)-bit code; for each nonzero vector v
of that length, mask v keeps the bits whose code has odd overlap with v. The codes of at most `radius`
differing bits span at most `radius` dimensions, so some v is orthogonal to all of them: its mask keeps none
of the differing bits, and the pair shares that table's key. No pair within the radius is missed.

Only distinct fingerprints enter the tables, so copies cost nothing. A key that more than BUCKET fingerprints
share is not paired up: each of its fingerprints is also written under itself and under each fingerprint one
flipped unmasked bit away; two fingerprints within distance 2 share one of these centres, and all that share
a centre are within distance 2, so they are linked to the centre's least member (radius 2; exact, no pairs).

Defined results: a null text and a text without words have fingerprint zero and link like any other; a tie of
set and unset gives bit 0; repeated rows share one fingerprint; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, components, cut, small_batches, texts, written

SEED, BUCKET = 42, 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, A-Z in lower case, joined by one space; of all words if they are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found) - words + 1
    hashed = xxhash.xxh64_intdigest
    if n <= 0:
        return np.array([hashed(b" ".join(found), SEED)] if found else [], dtype=np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint for each stretch of hashes: a bit is set if over half the stretch sets it."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    out = np.zeros(len(ends), dtype=np.uint64)
    full = sizes > 0
    if full.any():
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts[full])
            out[full] |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long: the 64 bits as a signed integer). No shuffle."""

    def run(batches):
        for b in small_batches(batches, 512):
            for start, end in by_bytes(b, "text", 4 << 20):
                part = b.slice(start, end - start)
                each = [shingle_hashes(t, words) for t in part.column(1).to_pylist()]
                found = majority(np.concatenate(each), np.cumsum([len(x) for x in each]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def masks(radius: int) -> list[int]:
    """The covering bit masks: 2^(radius + 1) - 1 of them, as signed 64-bit integers."""
    codes = [1 + i % ((1 << radius + 1) - 1) for i in range(64)]
    full = [sum(1 << i for i, c in enumerate(codes) if bin(c & v).count("1") % 2) for v in range(1, 1 << radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a long, b long): pairs of different fingerprints within the radius; of a crowded key, enough of them
    to connect all that are within the radius. `prints` has distinct values in its column fingerprint."""
    if radius not in (0, 2):
        raise ValueError("crowded keys are resolved exactly for radius 0 and 2")
    keyed = prints.select(
        "fingerprint",
        F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("mask", "key"),
    )
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = F.col("n") > BUCKET
    shared = written(keyed.join(sizes.hint("merge"), ["mask", "key"]), "keys")
    few = shared.where(~crowded).select("mask", "key", "fingerprint")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    paired = few.withColumnRenamed("fingerprint", "a").join(few.withColumnRenamed("fingerprint", "b"), ["mask", "key"])
    paired = paired.where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = shared.where(crowded).select("mask", "fingerprint")
    if radius:
        ball = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
        mask = F.element_at(F.array(*map(F.lit, masks(radius))), (F.col("mask") + 1).cast("int"))
        flips = F.filter(ball, lambda x: x.bitwiseAND(mask) == 0)
        many = many.withColumn("centre", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fingerprint")))))
    else:
        many = many.withColumn("centre", F.col("fingerprint"))
    least = many.groupBy("mask", "centre").agg(F.min("fingerprint").alias("least"), F.count("*").alias("n")).where("n > 1")
    starred = many.join(least, ["mask", "centre"]).where(F.col("fingerprint") > F.col("least"))
    return paired.unionByName(starred.select(F.col("least").alias("a"), F.col("fingerprint").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint string of 16 hex digits, component_id): documents whose fingerprints link up.

    Shuffles 16 bytes a document, then distinct fingerprints times the number of masks; texts stay put.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fingerprint"), radius))
    # a component's id is the least document of all its fingerprints
    member = classes.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    member = cut(member)
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = member.join(smallest, "component").select("fingerprint", "component_id")
    out = prints.join(member, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
