"""Quality classification by the perplexity of an interpolated modified Kneser-Ney n-gram model.

Method: n-grams of words are counted over all trusted text. The top order keeps counts, lower orders
continuation counts; each order has three discounts from its counts of counts, and probabilities are
interpolated down to the uniform distribution over the training words and one unknown word. A document's perplexity is
compared with a quantile of the trusted documents of its language.

An n-gram is sent to the task of its context's shortest ending that is not frequent, so whatever is counted over one of
these contexts meets in one task, and frequent words are spread by the words before them. A task's n-grams travel in
blocks of a few bytes a word, a share of the contexts (SLICES) at a time: first the trusted texts, which give the
discounts and the shared n-grams (those with frequent or empty contexts, summed over tasks as rows), then all texts, which
are counted and scored in the same tasks. The model is never written as a whole.

Defined results: a null or empty text has no perplexity and is rejected; a language without trusted text is
held against the quantile of all trusted text; without any trusted text every document with text is kept;
repeated rows are scored each; a null lang is a language of its own.
"""
from __future__ import annotations

import pickle
from functools import reduce
from itertools import pairwise
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, U64, by_bytes, mix, remove, shuffle_partitions, written

ORDER, QUANTILE, SLACK = 5, 0.99, 1.1
HELD_OUT = 5
#: Shares of the contexts that are worked off one after the other.
SLICES = 6
#: Words that a task turns into blocks at a time, and about as many that one of the counting tasks gets.
WORDS = 1 << 20
#: Shared n-grams that are broadcast (12 bytes each); the others are joined with the tasks that need them.
KNOWN = 1 << 22
#: Trusted ids that are broadcast (8 bytes each); more are met in a sort-merge join.
IDS = 1 << 21
ROOT = U64(0x9E3779B97F4A7C15)


def drop_first(g: str) -> Column:
    """The suffix of an n-gram, words of 8 bytes each."""
    return F.substr(g, F.lit(9))


def drop_last(g: str) -> Column:
    """Its context."""
    return F.substr(g, F.lit(1), (F.octet_length(g) - 8).cast("int"))


def discounts(t1: float, t2: float, t3: float, t4: float) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    y = t1 / (t1 + 2 * t2) if t1 + 2 * t2 else 0.0
    raw = [1 - 2 * y * t2 / t1 if t1 else 0.5, 2 - 3 * y * t3 / t2 if t2 else 1.0, 3 - 4 * y * t4 / t3 if t3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))


def packed(found: np.ndarray) -> pa.Array:
    """Rows of word hashes as binary values."""
    n, order = found.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 8 * order), pa.py_buffer(np.ascontiguousarray(found))])


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context that `word` stands before."""
    return mix(context * U64(0xD6E8FEB86659FD93) + word)


def ended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of the n-gram of a context and its last word."""
    return mix(context * U64(0xC2B2AE3D27D4EB4F) + (word ^ ROOT))


def context_hash(before: list[np.ndarray], n: int) -> np.ndarray:
    """The hash of contexts, from their words, nearest first."""
    return reduce(longer, before, np.full(n, ROOT))


def at_of(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class Hashes:
    """48-bit hashes of the words of texts laid end to end: a polynomial over a word's bytes, from differences of one running sum."""

    def __init__(self):
        self.of_byte = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.space = np.zeros(256, dtype=bool)
        self.space[list(ASCII_SPACE)] = True
        self.base = int(self.of_byte[0]) | 1
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes, and how many words each text has."""
        column = column.cast(pa.binary())
        edges = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        if edges[-1] == edges[0]:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(column), dtype=np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]]
        edges = edges.astype(np.int64) - edges[0]
        if len(self.up) <= len(data):
            self.up, self.down = self.powers(self.base, 2 * len(data)), self.powers(self.back, 2 * len(data))
        gap = np.ones(len(data) + 1, dtype=bool)  # a byte that is in no word, and the end
        gap[:-1] = self.space[data]
        begins = ~gap[:-1]
        begins[1:] &= gap[:-2]
        ends = ~gap[:-1] & gap[1:]
        cuts = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]
        begins[cuts], ends[cuts - 1] = ~gap[cuts], ~gap[cuts - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=sums[1:])
        h = mix((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64)) >> U64(16)
        return np.maximum(h, U64(1)), np.diff(np.searchsorted(begins, edges))


def spans(batches, order: int):
    """(row, trusted, word hashes, place of each word, its text) of about WORDS words at a time, from rows (row, trusted,
    text); zeros stand before each text's words."""
    hashes, parts, held = Hashes(), [], 0

    def joined():
        rows, trusted, found, sizes = (np.concatenate(x) for x in zip(*parts))
        at = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.arange(len(at)) + (at + 1) * (order - 1)
        words = np.zeros(len(at) + len(sizes) * (order - 1), dtype=np.uint64)
        words[ends] = found
        return rows.view(np.uint64), trusted, words, ends, at

    for b in batches:
        for start, end in by_bytes(b, "text"):
            part = b.slice(start, end - start)
            found, sizes = hashes.of(part.column(2))
            parts.append((part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), found, sizes))
            held += len(found)
            if held >= WORDS:
                yield joined()
                parts, held = [], 0
    if held:
        yield joined()


def frequent_contexts(texts: DataFrame, order: int) -> tuple[list[np.ndarray], int, int]:
    """For 1 to order - 2 words the sorted hashes of frequent contexts (a 200th of all words, in large corpora at least a
    5,000th), and the number of words, all and trusted ones. Each task names what is frequent in it; whoever is frequent
    is so with fewer words too."""

    def run(batches):
        for _, trusted, words, ends, at in spans(batches, order):
            h, here = np.full(len(ends), ROOT), ends
            own = int(trusted[at].sum())
            rows = [(np.zeros(2, dtype=np.int32), np.array([0, 1], dtype=np.uint64), np.array([len(ends) - own, own]))]
            for depth in range(1, order - 1):
                h = longer(h, words[here - depth])
                found, place, n = np.unique(h, return_inverse=True, return_counts=True)
                often = n >= max(2, len(ends) / 20_000)
                rows.append((np.full(often.sum(), depth, dtype=np.int32), found[often], n[often]))
                h, here = h[often[place]], here[often[place]]
            depth, h, n = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(h.view(np.int64)), pa.array(n)], names=["depth", "h", "n"])

    named = written(texts.mapInArrow(run, "depth int, h long, n long").groupBy("depth", "h").agg(F.sum("n").alias("n")), "often")
    total = {r["h"]: r["n"] for r in named.where("depth = 0").collect()}
    n = sum(total.values())
    share = min(1 / 200, max(1 / 5_000, 2 * WORDS / max(n, 1)))
    hot = named.where((F.col("depth") > 0) & (F.col("n") >= share * n)).collect()
    remove(named)
    return [np.sort(np.array([r["h"] for r in hot if r["depth"] == d], dtype=np.int64).view(np.uint64)) for d in range(1, order - 1)], n, total.get(1, 0)


def depths(words: np.ndarray, ends: np.ndarray, hot: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the length of its context's shortest ending that is not frequent, and that ending's hash."""
    deep, keys = np.full(len(ends), order - 1, dtype=np.int8), np.zeros(len(ends), dtype=np.uint64)
    left, h = np.arange(len(ends)), np.full(len(ends), ROOT)
    for depth in range(1, order):
        h = longer(h, words[ends[left] - depth])
        go = at_of(h, hot[depth - 1])[1] if depth < order - 1 else np.zeros(len(h), dtype=bool)
        deep[left[~go]], keys[left[~go]] = depth, h[~go]
        left, h = left[go], h[go]
    return deep, keys


def dumped(arrays: list[np.ndarray]) -> tuple[bytes, int]:
    """Arrays in their narrowest types, byte planes apart, compressed; and the size before."""
    out = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max())))
        out.append((a.dtype.str, a.view(np.uint8).reshape(len(a), -1).T.tobytes()))
    plain = pickle.dumps(out)
    return pa.compress(plain, codec="zstd", asbytes=True), len(plain)


def undumped(data: bytes, size: int) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel())
    return out


def blocks(texts: DataFrame, order: int, hot: list[np.ndarray], slices: int, parts: int, this: int) -> DataFrame:
    """(part int, data binary, size int, g binary, n long): the n-grams of one slice in blocks, one for each task that
    they go to and WORDS words. g and n are for rows that are added for the task."""

    def run(batches):
        for rows, trusted, words, ends, at in spans(batches, order):
            deep, keys = depths(words, ends, hot, order)
            bucket = (keys % U64(slices * parts)).astype(np.int64)
            mine = np.flatnonzero(bucket % slices == this)
            # like contexts stand together, which packs well
            nearest = [words[ends[mine] - j] >> U64(26) for j in (1, min(2, order - 1))]
            mine = mine[np.argsort((bucket[mine] // slices).astype(np.uint64) << U64(44) | nearest[0] << U64(22) | nearest[1], kind="stable")]
            part = bucket[mine] // slices
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for start, end in pairwise(edges):
                own = mine[start:end]
                used, named = np.unique(np.concatenate([words[ends[own] - j] for j in range(order)]), return_inverse=True)
                texts_, places = np.unique(at[own], return_inverse=True)
                data, size = dumped([np.diff(used, prepend=U64(0)), rows[texts_], trusted[texts_], places, deep[own], *np.split(named, order)])
                yield pa.RecordBatch.from_arrays([pa.array([int(part[start])], pa.int32()), pa.array([data], pa.binary()), pa.array([size], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.int64())], names=["part", "data", "size", "g", "n"])

    return texts.mapInArrow(run, "part int, data binary, size int, g binary, n long")


class Grams:
    """The n-grams of a task: words by code (0: the last word, 1: the one before), and codes of contexts and n-grams by length."""

    def __init__(self, batches, order: int):
        found, self.added = [], {}
        for b in batches:
            for data, size, g, n in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if data is not None:
                    found.append(undumped(data, size))
                    found[-1][0] = np.cumsum(found[-1][0], dtype=np.uint64)
                else:
                    self.added.setdefault(len(g) // 8, []).append((g, n))
        self.order, self.n = order, sum(len(x[3]) for x in found)
        if not self.n:
            return
        self.words, self.rows = np.unique(np.concatenate([x[0] for x in found])), np.unique(np.concatenate([x[1] for x in found]))
        own = [np.searchsorted(self.rows, x[1]) for x in found]
        trusted = np.zeros(len(self.rows), dtype=bool)
        for x, rows in zip(found, own):
            trusted[rows] = x[2] > 0
        self.row = np.concatenate([rows[x[3]] for x, rows in zip(found, own)])
        self.trusted = np.flatnonzero(trusted[self.row])
        self.deep = np.concatenate([x[4] for x in found]).astype(np.int64)
        place = [np.searchsorted(self.words, x[0]) for x in found]
        self.word = [np.concatenate([p[x[5 + j]] for x, p in zip(found, place)]) for j in range(order)]
        self.context = [np.zeros(self.n, dtype=np.int64)]
        for j in range(1, order):
            self.context.append(self.pair(self.context[-1], self.word[j]))
        self.gram = [None, *(self.pair(c, self.word[0]) for c in self.context)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * len(self.words) + b)[0]

    def counted(self) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """By order: the adjusted counts of n-grams with contexts of this task alone; and places of different (k + 1)-grams that
        count for shared k-grams."""
        counts, shared = {self.order: np.bincount(self.gram[-1][self.trusted], minlength=self.gram[-1].max() + 1)}, {}
        for k in range(self.order - 1, 0, -1):
            first = self.firsts(k + 1, self.trusted)
            deep = self.deep[first]
            counts[k] = np.bincount(self.gram[k][first[deep < k]], minlength=self.gram[k].max() + 1)
            shared[k] = first[deep == k]
        return counts, shared

    def firsts(self, k: int, items: np.ndarray) -> np.ndarray:
        """One place for each different k-gram among items."""
        place = np.full(self.gram[k].max() + 1, -1)
        place[self.gram[k][items]] = items
        return place[place >= 0]

    def hashes(self, k: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the context and of the k-gram at items."""
        c = context_hash([self.words[self.word[j][items]] for j in range(1, k)], len(items))
        return c, ended(c, self.words[self.word[0][items]])


def count_grams(placed: DataFrame, order: int) -> DataFrame:
    """(k int, g binary, n long, t int): partial counts of shared n-grams; for t from 1 to 4 (g null) how many others have count t."""

    def run(batches):
        grams = Grams(batches, order)
        if not grams.n:
            return
        counts, shared = grams.counted()
        rows = [(k, t, int((c == t).sum())) for k, c in counts.items() for t in (1, 2, 3, 4)]
        k, t, n = zip(*rows)
        names = ["k", "g", "n", "t"]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array(n, pa.int64()), pa.array(t, pa.int32())], names=names)
        for k, items in shared.items():
            _, first, n = np.unique(grams.gram[k][items], return_index=True, return_counts=True)
            g = np.stack([grams.words[grams.word[j][items[first]]] for j in range(k - 1, -1, -1)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, dtype=np.int32)), packed(g), pa.array(n), pa.nulls(len(n), pa.int32())], names=names)

    return placed.mapInArrow(run, "k int, g binary, n long, t int")


def sorted_counts(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams, given as rows of words, and their counts."""
    k = grams.shape[1]
    h = ended(context_hash([grams[:, k - 1 - j] for j in range(1, k)], len(grams)), grams[:, k - 1])
    order = np.argsort(h)
    return h[order], counts[order].astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)


def train(texts: DataFrame, order: int, hot: list[np.ndarray], slices: int, parts: int) -> tuple[dict, DataFrame | None]:
    """What the tasks need of the model beside their own counts: discounts, the number of symbols, totals of frequent contexts, the
    most frequent shared n-grams; and (g, n) of the other shared n-grams, if any."""
    found = [written(count_grams(blocks(texts, order, hot, slices, parts, i).repartitionById(parts, "part"), order), "counts") for i in range(slices)]
    partial = reduce(DataFrame.unionByName, found)
    t = {(r["k"], r["t"]): r["n"] for r in partial.where("g is null").groupBy("k", "t").agg(F.sum("n").alias("n")).collect()}
    shared = {}
    for k in range(order - 1, 0, -1):
        rows = partial.where((F.col("k") == k) & F.col("g").isNotNull()).select("g", "n")
        if k + 1 in shared:
            rows = rows.unionByName(shared[k + 1].select(drop_first("g").alias("g"), F.lit(1).cast("long").alias("n")))
        shared[k] = written(rows.groupBy("g").agg(F.sum("n").alias("n")), "shared")
    for x in found:
        remove(x)
    cuts, contexts = {}, {}
    for k in range(1, order + 1):
        own = shared[k].agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"t{i}") for i in (1, 2, 3, 4)]).first() if k < order else [0] * 4
        cuts[k] = discounts(*[float(t.get((k, i + 1), 0) + own[i]) for i in range(4)])
    for k, rows in shared.items():
        cut = F.when(F.col("n") == 1, cuts[k][0]).when(F.col("n") == 2, cuts[k][1]).otherwise(cuts[k][2])
        ends = rows.groupBy(drop_last("g").alias("c")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")).collect()  # frequent ones only
        words = np.frombuffer(b"".join(r["c"] for r in ends), dtype=np.uint64).reshape(len(ends), k - 1)
        h = context_hash([words[:, k - 1 - j] for j in range(1, k)], len(ends))
        by = np.argsort(h)
        contexts[k] = h[by], np.array([float(r["total"]) for r in ends])[by], np.array([float(r["cut"]) for r in ends])[by]
    symbols = shared[1].count() + 1
    everything = reduce(DataFrame.unionByName, shared.values())
    least, n = 1, 0
    for r in everything.groupBy("n").count().orderBy(F.desc("n")).collect():  # different counts are few
        n += r["count"]
        if n > KNOWN:
            least = r["n"] + 1
            break
    known = {}
    for k, rows in shared.items():
        top = rows.where(F.col("n") >= least).toArrow()
        words = [np.frombuffer(x.buffers()[2], dtype=np.uint64)[x.offset * k : (x.offset + len(x)) * k] for x in top["g"].chunks if len(x)]
        known[k] = sorted_counts(np.concatenate([np.zeros(0, dtype=np.uint64), *words]).reshape(-1, k), top["n"].to_numpy())
    rest = everything.where(F.col("n") < least) if least > 1 else None
    return {"cuts": cuts, "contexts": contexts, "symbols": symbols, "known": known, "shared": list(shared.values())}, rest


def asked(texts: DataFrame, order: int, hot: list[np.ndarray], slices: int, parts: int, this: int, known) -> DataFrame:
    """(part int, g binary): the shared n-grams that a slice's tasks need and that are not among the known."""

    def run(batches):
        for _, _, words, ends, _ in spans(batches, order):
            deep, keys = depths(words, ends, hot, order)
            bucket = (keys % U64(slices * parts)).astype(np.int64)
            mine = np.flatnonzero(bucket % slices == this)
            for k in range(1, order):
                own = mine[deep[mine] >= k]
                h = ended(context_hash([words[ends[own] - j] for j in range(1, k)], len(own)), words[ends[own]])
                new = ~at_of(h, known.value[k][0])[1]
                own, h = own[new], h[new]
                part = bucket[own] // slices
                first = np.unique(mix(h + part.astype(np.uint64)), return_index=True)[1]
                g = np.stack([words[ends[own[first]] - j] for j in range(k - 1, -1, -1)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), packed(g)], names=["part", "g"])

    return texts.mapInArrow(run, "part int, g binary").distinct()


def score_grams(placed: DataFrame, order: int, model: dict, known) -> DataFrame:
    """(row long, n long, log double): words and their log probabilities, summed by text, of each task."""
    cuts, contexts, symbols = model["cuts"], model["contexts"], model["symbols"]

    def run(batches):
        grams = Grams(batches, order)
        if not grams.n:
            return
        counts, _ = grams.counted()
        added = {k: sorted_counts(np.frombuffer(b"".join(g for g, _ in rows), dtype=np.uint64).reshape(-1, k), np.array([n for _, n in rows])) for k, rows in grams.added.items()}
        p = np.full(grams.n, 1 / symbols)
        for k in range(1, order + 1):
            cut = np.array([0.0, *cuts[k]])
            # n-grams of this task alone
            first = grams.firsts(k, grams.trusted)
            n = counts[k][grams.gram[k][first]]
            own = grams.context[k - 1][first]
            size = grams.context[k - 1].max() + 1
            total, less = np.bincount(own, weights=n, minlength=size)[grams.context[k - 1]], np.bincount(own, weights=cut[np.minimum(n, 3)], minlength=size)[grams.context[k - 1]]
            n = counts[k][grams.gram[k]]
            far = np.flatnonzero(grams.deep >= k)
            if len(far):  # shared ones
                _, one, place = np.unique(grams.gram[k][far], return_index=True, return_inverse=True)
                c, h = grams.hashes(k, far[one])
                found = np.zeros(len(one), dtype=np.int64)
                for table in (known.value[k], added.get(k, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))):
                    at, there = at_of(h, table[0])
                    found[there] = table[1][at[there]]
                at, there = at_of(c, contexts[k][0])
                ends = np.zeros((2, len(one)))
                ends[:, there] = np.stack(contexts[k][1:])[:, at[there]]
                n[far], total[far], less[far] = found[place], ends[0][place], ends[1][place]
            seen = np.maximum(total, 1)
            p = np.where(total > 0, (n - cut[np.minimum(n, 3)]) / seen + less / seen * p, p)
        n, log = np.bincount(grams.row, minlength=len(grams.rows)), np.bincount(grams.row, weights=np.log(p), minlength=len(grams.rows))
        yield pa.RecordBatch.from_arrays([pa.array(grams.rows.view(np.int64)), pa.array(n), pa.array(log)], names=["row", "n", "log"])

    return placed.mapInArrow(run, "row long, n long, log double")


def score_words(docs: DataFrame, training: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, perplexity double), a row for each row of docs, by the model of documents whose doc_id is in `training`. The
    perplexity of the words is given per byte of their text, the unit that SLACK is meant for. `order` is 2 at least."""
    spark = docs.sparkSession
    keyed = columns(docs, id_col, text_col, lang_col).withColumn("row", F.xxhash64("doc_id", "lang", F.col("text").isNull(), "text"))
    size = F.octet_length(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")))
    training = training.withColumn("trusted", F.lit(True)).hint("broadcast" if training.count() <= IDS else "merge")
    texts = keyed.where("text is not null").join(training, "doc_id", "left").select("row", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    hot, words, own = frequent_contexts(texts, order)
    tasks = lambda slices, n: max(shuffle_partitions(spark), ceil(n / slices / WORDS))
    first = max(1, ceil(SLICES * own / max(words, 1)))
    model, rest = train(texts.where("trusted"), order, hot, first, tasks(first, own))
    known = spark.sparkContext.broadcast(model.pop("known"))
    spent, sums, parts = model.pop("shared"), [], tasks(SLICES, words)
    for i in range(SLICES):
        rows = blocks(texts, order, hot, SLICES, parts, i)
        if rest is not None:
            needed = asked(texts, order, hot, SLICES, parts, i, known).join(rest.hint("merge"), "g")
            rows = rows.unionByName(needed.select("part", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("int").alias("size"), "g", "n"))
        scored = score_grams(rows.repartitionById(parts, "part"), order, model, known)
        sums.append(written(scored.groupBy("row").agg(F.sum("n").alias("n"), F.sum("log").alias("log")), "sums"))
    for x in spent:
        remove(x)
    known.unpersist()
    total = reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("n").alias("n"), F.sum("log").alias("log"))
    # equal rows share a key, and their logs are summed
    alike = keyed.where("text is not null").groupBy("row").agg(F.count("*").alias("alike"))
    out = keyed.select("doc_id", "lang", "row", size.alias("bytes")).join(total.join(alike, "row").hint("merge"), "row", "left")
    out = written(out.select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("log") / F.col("alike") / F.col("bytes"))).alias("perplexity")), "scores")
    for x in sums:
        remove(x)
    return out


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for every document; `trusted` has ids in its first column.

    Trusted documents whose id's crc32 is divisible by HELD_OUT set the thresholds: texts that a model was trained
    on look better to it than they are. The model is trained on all the others (on all, if that leaves none).
    threshold: the quantile of the held-out documents' perplexities in the document's language, times `slack`.
    """
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    held = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0
    training, judges = ids.where(~held), ids.where(held)
    if training.isEmpty() or judges.isEmpty():
        training = judges = ids
    scores = score_words(docs, training, order, id_col, text_col, lang_col)
    good = scores.join(judges, "doc_id", "left_semi").where("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000) * slack
    limits = good.groupBy("lang").agg(at.alias("own"))
    overall = good.agg(at.alias("all")).first()["all"]
    out = scores.join(limits.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
