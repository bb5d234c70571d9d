"""Language identification with language-bitmask n-gram filters.

Method: a bit-sliced Bloom filter. Each of its SLOTS positions holds a bitmask of languages; a letter trigram
sets its languages' bits at K positions, and the AND of those K masks returns all languages that contain the
trigram at once. A text's hits are counted per language, corrected for the filter's false positives (a
language's fill to the power K), and the largest share of explained trigrams decides.

A trigram belongs to a language if it makes up at least LEAST of that language's trigrams and at least RATIO of
its largest share in any language; so a language has at most 1 / LEAST trigrams, and the filter's size is fixed.

Defined results: a null text or one without letters is `und` with score 0; so is every text if nothing could be
learned; a text whose trigrams are all unknown gets the most frequent learned language with score 0; equal
shares go to the language with more training text, then by name; a null lang trains nothing.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bytes, mix, small_batches

SLOTS, K, LEAST, RATIO = 1 << 20, 3, 1e-6, 0.2
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, 0 for what is no letter, two 0 after each text; and each text's end."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("\n\n".join([*low, "", ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in low), np.int64, len(low)))
    return np.where(letters()[raw], raw, 0), ends


def trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, packed trigrams) around each letter: its two neighbours, 0 where they are no letters."""
    at = np.flatnonzero(points)
    padded = np.concatenate([[0], points, [0]]).astype(np.uint64)
    return at, padded[at] << U64(42) | padded[at + 1] << U64(21) | padded[at + 2]


def count_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, _ = codes(texts)
    at = np.flatnonzero(points)
    alphabet, index = np.unique(points, return_inverse=True)
    size = len(alphabet)
    if size > 160:
        return np.unique(trigrams(points)[1], return_counts=True)
    padded = np.concatenate([[0], index, [0]])
    packed = (padded[at] * size + padded[at + 1]) * size + padded[at + 2]
    counts = np.bincount(packed, minlength=1)
    found = np.flatnonzero(counts)
    alphabet = alphabet.astype(np.uint64)
    return alphabet[found // size // size] << U64(42) | alphabet[found // size % size] << U64(21) | alphabet[found % size], counts[found]


def slots(grams: np.ndarray) -> list[np.ndarray]:
    one = mix(grams + U64(0x9E3779B97F4A7C15))
    two = mix(one) | U64(1)
    return [((one + U64(i) * two) >> U64(44)).astype(np.int64) for i in range(K)]


class Filter:
    """masks: SLOTS x words of 64 languages; rates: each language's false-positive rate."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = np.array([(masks[:, i // 64] >> U64(i % 64) & U64(1)).mean() for i in range(len(languages))])
        self.rates = fill**K

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        points, ends = codes(texts)
        at, grams = trigrams(points)
        ends = np.searchsorted(at, ends)
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        if not self.languages or not len(at):
            return [("und" if not k or not self.languages else self.languages[0], 0.0) for k in n]
        places = slots(grams)
        share = np.zeros((len(texts), len(self.languages)))
        full = n > 0
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            mask = column[places[0]]
            for p in places[1:]:
                mask = mask & column[p]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits = np.add.reduceat((mask >> U64(i % 64) & U64(1)).astype(np.int32), starts[full])
                rate = self.rates[i]
                share[full, i] = np.clip((hits / n[full] - rate) / max(1 - rate, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        return [(self.languages[b], float(share[i, b])) if n[i] else ("und", 0.0) for i, b in enumerate(best)]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Filter:
    """Counts the trigrams of all rows with a language and builds the filter.

    Each task sums its own batches per language before the shuffle. To the driver come the languages' totals and
    the filter's set positions, at most SLOTS.
    """

    def run(batches):
        for b in small_batches(batches, 1024):
            for start, end in by_bytes(b, "text", 4 << 20):
                part = b.slice(start, end - start)
                by = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, group in by.items():
                    grams, counts = count_trigrams(group)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    if languages:
        spark = docs.sparkSession
        sizes = spark.createDataFrame([(x, totals[x], i) for i, x in enumerate(languages)], "lang string, total long, i int")
        shares = counts.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= LEAST)
        most = shares.groupBy("gram").agg(F.max("share").alias("most"))
        chosen = shares.join(most, "gram").where(F.col("share") >= RATIO * F.col("most"))

        def place(batches):
            for b in batches:
                grams = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                i = b.column(1).to_numpy(zero_copy_only=False)
                bit = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
                for at in slots(grams):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((i // 64).astype(np.int32)), pa.array(bit)], names=["slot", "word", "mask"])

        marked = chosen.select("gram", "i").mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
        got = marked.toArrow()
        masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    counts.unpersist()
    return Filter(languages, masks)


def predict(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """docs' columns plus lang_pred and score. The filter is broadcast: SLOTS masks whatever the input. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))
    columns = docs.columns
    where = columns.index(text_col)

    def run(batches):
        own = Filter(*shared.value)
        for b in small_batches(batches, 512):
            out = []
            text = b.column(where).to_pylist()
            lengths = np.cumsum([len(t or "") for t in text])
            cuts = np.unique(np.concatenate([[0], np.searchsorted(lengths, np.arange(1 << 20, lengths[-1], 1 << 20)), [len(text)]]))
            for a, z in zip(cuts, cuts[1:]):
                out += own.predict([t or "" for t in text[a:z]])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[*columns, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents outside fold 0, predicted for all.

    A document's fold is crc32(id as text) mod `folds`; a null id is in no fold and is not held out.
    """
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % folds == 0, F.lit(False))
    model = learn(docs.where(~held), lang_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held.alias("held_out"), docs[text_col].cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
