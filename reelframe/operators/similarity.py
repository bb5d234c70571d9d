"""Similar texts without comparing all pairs: q-gram prefix filter, then the exact similarity of what is left.

The similarity is Ratcliff/Obershelp's, 2 M / (n + m) for M matched characters of texts of n and m characters. The matched
characters are a common subsequence, so a similarity of t leaves at most (1 - t)(n + m) characters that only one text has.
A character that a text lacks or has in addition breaks at most q, or q - 1, of its q-grams; so texts of that similarity share
at least ((2q - 1) t / 2 - (q - 1)) (n + m) - (q - 1) of them, repeats included, and none is shorter than t / (2 - t) of the
other. Two sets that share at least T elements share one among the first G - T + 1 of their G elements in any common order:
only these prefixes meet, within a group and length bound. Grams are ordered by a hash, so no counting pass is needed.

Texts too short for that bound to promise a shared q-gram meet over single characters, by the same bound with q = 1.
Equal texts are one text. No pair at or above the threshold is lost, and texts are never joined by their group alone.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import Matched

MOST_GRAM = 5


def shared_grams(q: int, threshold: float, total: float) -> int:
    """The least number of q-grams that texts of `total` characters together share at this similarity."""
    return math.ceil(((2 * q - 1) * threshold / 2 - (q - 1)) * total - (q - 1) - 1e-9)


def gram_size(threshold: float) -> int:
    """The longest grams, up to MOST_GRAM, of which texts of 40 characters still share one."""
    return max((q for q in range(2, MOST_GRAM + 1) if shared_grams(q, threshold, 80) >= 1), default=1)


def least_total(n: int, threshold: float) -> float:
    """Characters of a text of n characters and the shortest text that can be so similar to it."""
    return 2 * n / (2 - threshold)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers scattered over all 64 bits, the same for the same number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix(text: str, q: int, threshold: float) -> np.ndarray:
    """The grams by which a text may meet another one, as hashes; the k-th repeat of a gram is a gram of its own. Grams that share
    a hash count as one gram with repeats, which can only let more texts meet."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(letters) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(q):
        grams = mixed(grams + letters[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    grams = np.sort(grams)
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    repeat = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    need = max(1, shared_grams(q, threshold, least_total(len(letters), threshold)))
    return np.sort(mixed(grams + mixed(repeat.astype(np.uint64)))).view(np.int64)[: max(0, n - need + 1)]


def met_by(texts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, id, n, q, gram): a row for each gram of a text's prefixes."""
    size, own = gram_size(threshold), [*keys, "id"]
    described = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("text").to_pylist()
            lengths = [len(t) for t in found]
            few = [shared_grams(size, threshold, least_total(n, threshold)) < 1 and size > 1 for n in lengths]
            for q, chosen in ((size, range(len(found))), (1, np.flatnonzero(few))):
                at = pa.array(np.fromiter(chosen, np.int64))
                grams = [prefix(found[i], q, threshold) for i in chosen]
                ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])))
                columns = [b.column(c).take(at) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([lengths[i] for i in chosen], pa.int32()), pa.array([q] * len(grams), pa.int32()), lists], names=[*own, "n", "q", "grams"])

    rows = texts.select(*own, "text").mapInArrow(run, f"{described}, n int, q int, grams array<long>")
    return rows.select(*own, "n", "q", F.explode("grams").alias("gram"))


def upper_bound(a: str, b: str) -> float:
    """No less than the similarity: twice the characters that both have, repeats included, over all."""
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def at_least(threshold: float):
    """An Arrow function of two texts: their similarity, or null where it is below the threshold. Most pairs end at the bound."""

    @F.pandas_udf(DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            r = 1.0 if x == y else None
            if r is None and upper_bound(x, y) >= threshold:
                r = Matched(x, y).at_least(threshold)
            out.append(r if r is not None and r >= threshold else None)
        return pd.Series(out, dtype="float64")

    return similarity


def distinct_texts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, id, text): the different texts of each group; id is a hash of 8 bytes. Texts that share one meet whatever either meets,
    and are told apart by their similarity, so none is lost."""
    return rows.select(*keys, F.col(text).alias("text")).where("text is not null").distinct().withColumn("id", F.xxhash64("text"))


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], text: str, threshold: float) -> DataFrame:
    """(keys, left_text, right_text, similarity): all pairs of different texts of a group, one of either side, whose similarity
    is at least `threshold`, which must be above 0.

    Similarity is not symmetric in every case; it is taken from the left text to the right one. Two empty texts are equal.
    """
    a, b = distinct_texts(left, keys, text), distinct_texts(right, keys, text)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # four bytes of a gram and its size travel as one number: it can only let more texts meet
    half = F.shiftright("gram", 32).cast("int").bitwiseXOR(F.col("q")).alias("gram")
    x = met_by(a, keys, threshold).select(*keys, F.col("id").alias("left_id"), F.col("n").alias("left_n"), half)
    y = met_by(b, keys, threshold).select(*keys, F.col("id").alias("right_id"), F.col("n").alias("right_n"), half)
    met = x.join(y, [*keys, "gram"]).where((F.col("right_n") >= F.col("left_n") * low - 1e-9) & (F.col("right_n") <= F.col("left_n") * high + 1e-9))
    pairs = met.select(*keys, "left_id", "right_id").distinct()
    empty = a.where("text = ''").select(*keys, F.col("id").alias("left_id")).join(b.where("text = ''").select(*keys, F.col("id").alias("right_id")), keys)
    pairs = pairs.unionByName(empty)
    full = pairs.join(a.withColumnsRenamed({"id": "left_id", "text": "left_text"}), [*keys, "left_id"]).join(b.withColumnsRenamed({"id": "right_id", "text": "right_text"}), [*keys, "right_id"])
    return full.withColumn("similarity", at_least(threshold)("left_text", "right_text")).where("similarity is not null").select(*keys, "left_text", "right_text", "similarity")
