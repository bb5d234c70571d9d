"""De-duplication of long passages with sparse suffix arrays.

Method: suffixes are kept only at content-selected minimiser positions (a position in 22 for windows of 50
words), and of those the ones whose first GRAM words occur twice. They are sorted by their text over range partitions.
What a suffix shares with its sorted neighbours bounds how far a repeat can reach to the right; the match with an
earlier suffix of its group is then extended word by word to the right and to the left, and all windows inside it are
repeats. Windows that a neighbour might still share, but that no extension settled, are compared exactly by the digest
of their words, wherever their occurrences ended up.

Defined results: as in substrings.py, with windows of `size` words: of a passage that occurs more than once the
earliest occurrence stays, words of later ones are removed.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, small_batches, texts, written
from .windows import GRAM, classes_of, digest_words, halves, places_of, removal, repeated_windows, segments, split, starts_of

BLOCK = 4096


def common(a: list[bytes], b: list[bytes]) -> int:
    """The number of words that two lists begin with alike."""
    if a == b:
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def suffix_rows(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(suffix, lead, doc_id, place, before, n): the words from each place on, at most `size`, and the `before` words
    that its first window has before it. places: (doc_id, places array<long>, as packed by segments)."""

    def run(batches):
        for b in small_batches(batches, 512):
            rows: list[tuple] = []
            for doc, text, chosen in zip(*(c.to_pylist() for c in b.columns)):
                words = split(text)
                for at in chosen:
                    place, before, n = at >> 16, at >> 8 & 255, at & 255
                    if place + GRAM <= len(words):  # rows may share an id
                        rows.append((b" ".join(words[place : place + size]), b" ".join(words[max(0, place - before) : place]), doc, place, min(before, place), n))
            for k in range(0, len(rows), 4096):
                columns = zip(*rows[k : k + 4096])
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["suffix", "lead", "doc_id", "place", "before", "n"])

    joined = docs.join(places.hint("merge"), "doc_id").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "suffix binary, lead binary, doc_id long, place long, before int, n int")


class Suffix:
    """A sorted suffix. A window is named by p, the number of its words before the place."""

    def __init__(self, suffix: bytes, lead: bytes, doc: int, place: int, before: int, n: int, size: int):
        self.words, self.lead, self.key, self.size = suffix.split(b" "), lead.split(b" ")[::-1] if lead else [], (doc, place), size
        self.left = {p for p in range(before - n + 1, before + 1) if size - p <= len(self.words)}  # windows that may still be repeats

    def settle(self, other: Suffix) -> range:
        """Extends the match with an earlier suffix to both sides; the windows inside it."""
        found = range(self.size - common(self.words, other.words), common(self.lead, other.lead) + 1)
        found = range(max([found.start, *([min(self.left)] if self.left else [])]), min([found.stop, *([max(self.left) + 1] if self.left else [])]))
        self.left.difference_update(found)
        return found

    def bound(self, reach: int) -> None:
        """Drops windows that need more words to the right than any neighbour shares."""
        self.left = {p for p in self.left if self.size - p <= reach}

    def window(self, p: int) -> bytes:
        return b" ".join(self.lead[:p][::-1] + self.words[: self.size - p])


def swept(block: list[Suffix], whole: bool) -> tuple[list[tuple], list[tuple]]:
    """(runs, windows) of a block of sorted suffixes with one beginning: runs (doc_id, start, n) that are repeats, and
    windows (doc_id, start, digest) to be compared. whole: no suffix with this beginning lies outside the block."""
    runs, first = [], min(block, key=lambda s: s.key)
    near = [common(a.words, b.words) for a, b in zip(block, block[1:])]
    for i, s in enumerate(block):
        if whole or 0 < i < len(block) - 1:
            s.bound(max([0, *near[max(0, i - 1) : i + 1]]))
        for other in (first, *block[max(0, i - 1) : i], *block[i + 1 : i + 2]):
            if s.left and other.key < s.key:
                found = s.settle(other)
                if len(found):
                    runs.append((s.key[0], s.key[1] - found.stop + 1, len(found)))
    rest = [s for s in block if s.left]
    if whole and len(rest) < 2:
        return runs, []
    return runs, [(s.key[0], s.key[1] - p, digest_words(s.window(p))) for s in rest for p in s.left]


def compared(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, start, n, d1, d2): of sorted suffixes, the runs of windows that are repeats (d1 null), and windows to be compared."""
    order = ["suffix", "doc_id", "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def out(runs, windows):
        digests = halves([w[2] for w in windows])
        none = [None] * len(runs)
        columns = [[r[0] for r in runs] + [w[0] for w in windows], [r[1] for r in runs] + [w[1] for w in windows], [r[2] for r in runs] + [1] * len(windows), none + digests[:, 0].tolist(), none + digests[:, 1].tolist()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "n", "d1", "d2"])

    def run(batches):
        block: list[Suffix] = []
        inner = False  # the block's first suffix is the first with its beginning
        runs, windows = [], []
        for b in small_batches(batches, 4096):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                s = Suffix(*row, size)
                other = bool(block) and block[-1].words[:GRAM] != s.words[:GRAM]
                if other or len(block) >= BLOCK:
                    more = swept(block, inner and other)
                    runs, windows, block, inner = runs + more[0], windows + more[1], [], other
                    if len(runs) + len(windows) > 20_000:
                        yield out(runs, windows)
                        runs, windows = [], []
                block.append(s)
        if block:
            more = swept(block, False)
            runs, windows = runs + more[0], windows + more[1]
        yield out(runs, windows)

    return ordered.select("suffix", "lead", "doc_id", "place", "before", "n").mapInArrow(run, "doc_id long, start int, n int, d1 long, d2 long")


def deduplicate(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_words, n_removed, spans), one row a document.

    Suffixes whose first GRAM words occur once drop out before any text is attached, and copies of one segment are
    combined, so a passage that a third of the documents share is sorted once; a beginning in very many contexts is
    split by the rest of the suffix and by document, and held BLOCK suffixes at a time.
    """
    plain = texts(docs, id_col, text_col)
    every = written(segments(docs, size, id_col, text_col), "places")
    again = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    found = written(every.join(again.hint("merge"), "h", "left_semi"), "repeated")
    remove(every)
    copies, heads = classes_of(found)
    rows = written(suffix_rows(plain, places_of(heads), size), "suffixes")
    result = written(compared(rows, size), "compared")
    remove(rows)
    windows = written(result.where("d1 is not null").select("d1", "d2", "doc_id", F.col("start").alias("pos")), "windows")
    runs = copies.unionByName(result.where("d1 is null").select("doc_id", "start", "n")).unionByName(repeated_windows(windows))
    return removal(plain, starts_of(runs), size)
