"""Word windows: content-selected anchors, and the removal of words in windows that occur earlier.

A window is `size` consecutive words. Its anchor is the leftmost of its GRAM-word runs with the least hash
(its minimiser), so equal windows have equal anchors at equal places, whatever surrounds them, and
neighbouring windows mostly share one. A window can only be repeated if its anchor's hash is. The windows that
share an anchor cover a stretch of words, the anchor's segment.

Words are `[^\\x20\\x09-\\x0D]+`, compared unchanged; windows are compared by a 128-bit BLAKE2b digest of their words.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, by_bytes, mix, sliding_argmin, small_batches, texts, window_hashes, written

GRAM, SEED, WIDEST, SLOTS = 8, 7, 262, 1 << 20


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class Words:
    """The words of many texts end to end: their hashes, and where each text begins and ends."""

    def __init__(self, known: WordHashes, texts: list[str]):
        split_ = [split(t) for t in texts]
        self.counts = np.array([len(w) for w in split_], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *[known.of(w) for w in split_]])

    def anchored(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of all windows that lie in one text, each one's anchor, every gram's hash), all as places end to end."""
        grams = window_hashes(self.hashes, GRAM, SEED)
        at = sliding_argmin(grams, size - GRAM + 1)
        inside = np.repeat(self.ends, self.counts)[: len(at)]
        starts = np.flatnonzero(np.arange(len(at)) + size <= inside)
        return starts, at[starts], grams


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def segments(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h long, sd long, doc_id, at long): one row for each anchor.

    h: the anchor's hash. sd: a digest of the stretch of words that its windows cover, and of the anchor's place in
    it, so rows equal in (h, sd) cover the same words. at packs the anchor's place, how far before it the first
    window starts, and the number of windows, 8 bits each for the last two. No shuffle.
    """
    if not GRAM <= size <= WIDEST:
        raise ValueError(f"windows have {GRAM} to {WIDEST} words")
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def run(batches):
        known = WordHashes()
        for b in small_batches(batches, 1024):
            for start, end in by_bytes(b, "text"):
                part = b.slice(start, end - start)
                words = Words(known, part.column(1).to_pylist())
                starts, at, grams = words.anchored(size)
                if not len(starts):
                    continue
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                place, from_ = at[first], starts[first]
                n = np.diff(np.concatenate([first, [len(at)]]))
                till = from_ + n - 1 + size
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * powers(len(words.hashes), base))])
                digest = (total[till] - total[from_]) * powers(len(words.hashes), inverse)[from_]
                digest = mix(mix(digest) + (n << 8 | place - from_).astype(np.uint64))
                doc = np.searchsorted(words.ends, place, side="right")
                own = place - words.starts[doc]
                columns = [
                    pa.array(grams[place].view(np.int64)), pa.array(digest.view(np.int64)),
                    pa.array(part.column(0).to_numpy(zero_copy_only=False)[doc]), pa.array(own << 16 | place - from_ << 8 | n),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "sd", "doc_id", "at"])

    known_ids = texts(docs, id_col, text_col).where("doc_id is not null")
    return known_ids.mapInArrow(run, "h long, sd long, doc_id long, at long")


def halves(digests: list[bytes]) -> np.ndarray:
    """16-byte digests as two columns of integers."""
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def digest_words(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def candidate_windows(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(d1, d2, doc_id, pos): digests of the windows whose anchor is one of the document's `places`
    (doc_id, places array<long>, as packed by segments)."""

    def run(batches):
        for b in small_batches(batches, 1024):
            for text, doc, chosen in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2)):
                at = chosen.values.to_numpy()
                n, first = at & 255, (at >> 16) - (at >> 8 & 255)
                starts = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
                words = split(text)
                starts = starts[(starts >= 0) & (starts + size <= len(words))]
                if not len(starts):
                    continue
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate([[0], ends[:-1] + 1])
                found = [digest_words(line[x:y]) for x, y in zip(begins[starts].tolist(), ends[starts + size - 1].tolist())]
                d = halves(found)
                for k in range(0, len(starts), 50_000):
                    s = slice(k, k + 50_000)
                    one = pa.array(np.full(len(starts[s]), doc))
                    yield pa.RecordBatch.from_arrays([pa.array(d[s, 0]), pa.array(d[s, 1]), one, pa.array(starts[s].astype(np.int32))], names=["d1", "d2", "doc_id", "pos"])

    joined = docs.join(places.hint("merge"), "doc_id").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "d1 long, d2 long, doc_id long, pos int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, start int, n int): windows (a written table) whose digest also starts earlier.

    First occurrences come from a combined aggregate, so a window that a third of the documents share is a few rows a
    task; they are written before the join back, which can then be split wherever a digest is crowded.
    """
    firsts = windows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("d1", "d2", "first"), "firsts")
    later = windows.join(firsts.hint("merge"), ["d1", "d2"]).where(F.struct("doc_id", "pos") > F.col("first"))
    return later.select("doc_id", F.col("pos").alias("start"), F.lit(1).alias("n"))


def classes_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, heads) of segments with a repeated anchor. Segments equal in (h, sd) are a class; runs (doc_id, start, n): in
    all but a class's first, every window also starts earlier. heads (doc_id, at): where an anchor has more than one
    class, each class's first segment, which starts no later than any other of its class; only these can still hold
    windows that start earlier elsewhere."""
    classes = found.groupBy("h", "sd").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    copies = found.join(classes.where("n > 1").select("h", "sd", "first").hint("merge"), ["h", "sd"])
    copies = copies.where(F.struct("doc_id", "at") > F.col("first"))
    runs = copies.select(
        "doc_id", (F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))).cast("int").alias("start"), F.col("at").bitwiseAND(F.lit(255)).cast("int").alias("n")
    )
    several = written(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "several")
    heads = classes.join(several.hint("merge"), "h", "left_semi").select(F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at"))
    return runs, heads


def places_of(heads: DataFrame) -> DataFrame:
    return written(heads.groupBy("doc_id").agg(F.collect_list("at").alias("places")), "places")


def met_by(places: DataFrame, history: DataFrame) -> DataFrame:
    """The rows of history (doc_id, text) whose document may be in places. Ids are dealt over SLOTS numbers, so what is
    broadcast has at most that many rows; a number that two ids share costs a needless text."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = places.select(slot).distinct()
    return history.select("*", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")


def repeated_starts(docs: DataFrame, found: DataFrame, size: int, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, starts array<struct<start int, n int>>): runs of windows of docs (doc_id, text) that also start earlier.

    found: segments with a repeated anchor, of docs and of history, whose ids are all smaller. Windows themselves are
    compared only for the heads of unequal classes.
    """
    runs, heads = classes_of(found)
    places = places_of(heads)
    if history is not None:
        earlier = F.col("doc_id") < F.lit(docs.agg(F.min("doc_id")).first()[0]).cast("long")
        docs = docs.unionByName(met_by(places.where(earlier), history.where(earlier)))
    windows = written(candidate_windows(docs, places, size), "windows")
    return starts_of(runs.unionByName(repeated_windows(windows)))


def starts_of(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))


def removal(docs: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, kept, n_words, n_removed, spans) of every row of (doc_id, text): kept has the words outside
    the windows, joined by one space; spans are the removed stretches [from, to) in words."""

    def run(batches):
        for b in small_batches(batches, 512):
            kept_, words_, removed_, spans_ = [], [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = split(text)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.array([(r["start"], r["start"] + r["n"] - 1 + size) for r in starts or []], dtype=np.int64).reshape(-1, 2)
                at = at[at[:, 1] <= len(words)]
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                gone = np.cumsum(edge)[:-1] > 0
                keep = [w for w, g in zip(words, gone.tolist()) if not g] if len(at) else words
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept_.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
                words_.append(len(words))
                removed_.append(int(gone.sum()))
                spans_.append([{"from": int(x), "to": int(y)} for x, y in zip(turn[::2], turn[1::2])])
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept_, pa.string()), pa.array(words_, pa.int64()), pa.array(removed_, pa.int64()), pa.array(spans_, kind)],
                names=["doc_id", "kept", "n_words", "n_removed", "spans"],
            )

    joined = docs.join(starts.hint("merge"), "doc_id", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, spans array<struct<from:int,to:int>>")


def digest_of(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
