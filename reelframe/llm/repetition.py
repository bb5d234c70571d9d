"""Quality rules by repetition: how many characters of a text lie in repeated lines and repeated word n-grams.

Method: the words of many texts stand end to end as integers, one rolling hash a window and n-gram length is computed in
numpy, and one sort a length finds the windows that occur again in their own text. Every pair of windows that shares a
hash is compared word by word, so hashes only propose. Characters covered are counted once, however many windows cover them.

Coverage counts later occurrences: the first occurrence of an n-gram or line is text that a reader needs. A text is
rejected if one of LIMITS is passed (published thresholds for pre-training corpora: repeated lines 0.3 of the lines and 0.2
of the characters; repeated 5- to 10-grams 0.15 down to 0.10 of the characters). Limits are parameters.

Defined results: a null text is an empty one, has no words and fails the base rule; repeated rows give repeated results;
extra columns are ignored; an empty table gives no rows. Whole texts are read, and nothing is shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bytes, mix, small_batches, texts, window_hashes

SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
LIMITS = {"dup_lines": 0.3, "dup_line_chars": 0.2, 5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


class Pieces:
    """Words or lines of many texts end to end. ids: equal pieces have equal numbers; sizes: code points; doc: the text."""

    def __init__(self, lists: pa.ListArray, keep: str):
        flat, doc = lists.flatten(), pc.list_parent_indices(lists)
        good = pc.match_substring_regex(flat, keep)
        coded = flat.filter(good).dictionary_encode()
        self.n, self.doc = len(lists), doc.filter(good).to_numpy().astype(np.int64)
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.sizes = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)[self.ids] if len(coded) else self.ids
        self.counts = np.bincount(self.doc, minlength=self.n)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        ends, total = np.cumsum(self.counts), np.concatenate([[0], np.cumsum(values)])
        return total[ends] - total[ends - self.counts]

    def repeated(self, size: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, first) of the windows of `size` words among these starts that lie in one text and occur in it at least
        twice; first is the place where the same words start first in the same text."""
        starts = among[among + size <= len(self.ids)]
        starts = starts[self.doc[starts] == self.doc[starts + size - 1]]
        if not len(starts):
            return starts, starts
        hashes = mix(window_hashes(self.ids.astype(U64), size, size)[starts] + mix(self.doc[starts].astype(U64) + U64(1)))
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
        first = starts[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        shared = ~new | np.concatenate([~new[1:], [False]])
        there, first = starts[order][shared], first[shared]
        same = self.doc[there] == self.doc[first]
        for k in range(size):
            same &= self.ids[there + k] == self.ids[first + k]
        return (there, first) if same.all() else self.compared(starts, size)

    def compared(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """repeated() by the words themselves: the way for batches in which two different windows share a hash."""
        rows = np.column_stack([self.doc[starts], *(self.ids[starts + k] for k in range(size))])
        _, at, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = at.reshape(-1)
        first = np.full(len(counts), np.iinfo(np.int64).max)
        np.minimum.at(first, at, starts)
        return starts[counts[at] > 1], first[at][counts[at] > 1]

    def covered(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Which words lie in a window that begins at one of starts."""
        edge = np.bincount(starts, minlength=len(self.ids) + 1) - np.bincount(starts + size, minlength=len(self.ids) + 1)
        return np.cumsum(edge)[:-1] > 0


def measured(found: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """The measures of each text. A longer window can only be repeated where a shorter one is, so lengths go upwards and
    each one hashes what the one before it left."""
    words, lines = Pieces(pc.ascii_split_whitespace(found), WORD), Pieces(pc.split_pattern(found, "\n"), WORD)
    chars, later = words.per_text(words.sizes), np.zeros(len(lines.ids), bool)
    there, first = lines.repeated(1, np.arange(len(lines.ids)))
    later[there[there > first]] = True
    repeats, line_chars = lines.per_text(later), lines.per_text(lines.sizes)
    out = {
        "n_words": words.counts, "word_chars": chars, "n_symbols": pc.count_substring_regex(found, SYMBOLS).to_numpy().astype(np.int64), "n_dup_lines": repeats,
        "dup_lines": repeats / np.maximum(lines.counts, 1), "dup_line_chars": lines.per_text(np.where(later, lines.sizes, 0)) / np.maximum(line_chars, 1),
    }
    left, shares = np.arange(len(words.ids)), {}
    for size in sorted({*lengths, WINDOW}):
        left, first = words.repeated(size, left)
        again = words.covered(left[left > first], size)
        shares[size] = words.per_text(np.where(again, words.sizes, 0)) / np.maximum(chars, 1)
        if size == WINDOW:
            out["n_repeat_words"] = words.per_text(words.covered(left, size))
    out["dup_ngram_chars"] = np.array([shares[n] for n in lengths]).reshape(len(lengths), len(found))
    return out


COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("dup_lines", "double"), ("dup_line_chars", "double")]


def coverage(docs: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_lines, dup_line_chars, dup_ngram_chars):
    counts, and shares from 0 to 1; dup_ngram_chars has one share for each of `lengths`, in their order."""

    def run(batches):
        for b in small_batches(batches, 1024):
            for start, end in by_bytes(b, "text"):
                part = b.slice(start, end - start)
                got = measured(part.column(1), lengths)
                shares = pa.array(got["dup_ngram_chars"].T.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c, _ in COLUMNS), shares], names=["doc_id", *(c for c, _ in COLUMNS), "dup_ngram_chars"])

    schema = ", ".join(["doc_id long", *(f"{c} {kind}" for c, kind in COLUMNS), "dup_ngram_chars array<double>"])
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def filter_rules(docs: DataFrame, limits: dict | None = None, least_words: int = 20, most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """coverage() with base_failed (under least_words words, or over most_repeated per cent of the words in repeated windows),
    broken (the rules of `limits` that the text breaks) and kept (no rule broken and base_failed false)."""
    limits = limits or LIMITS
    lengths = [k for k in limits if isinstance(k, int)]
    rows = coverage(docs, lengths, id_col, text_col)
    rules = [F.when(F.col(k) > limits[k], F.lit(k)) for k in limits if isinstance(k, str)]
    rules += [F.when(F.col("dup_ngram_chars")[at] > limits[n], F.lit(f"{n}_grams")) for at, n in enumerate(lengths)]
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = rows.withColumn("base_failed", failed).withColumn("broken", F.array_compact(F.array(*rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
