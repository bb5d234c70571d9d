"""BPE encoding and decoding with the rank tables of a public tokenizer file.

Method: contiguous rank array. A word holds its parts and the ranks of its adjacent parts in two short
arrays; the smallest rank is found by a scan, its boundary is deleted, and the two neighbouring ranks are
refreshed, until no pair has a rank. `WordBpe` runs this for many words at once: one numpy row a word. A
word of more than LONG parts goes through a heap of ranks instead, as repeated scans would take
quadratic time; both give the same merges (smallest rank first, leftmost of ties).

Defined results: a null text is encoded as an empty one; an empty text has no ids and decodes to "".
Special token strings in a text are encoded as their ids. Repeated rows give repeated results.
"""
from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, texts

LONG = 64


class WordBpe:
    """Encoder and decoder of one tokenizer file whose words end in a suffix and whose white space is dropped.

    Nothing outside a white-space-delimited chunk changes the chunk's ids, so ids are remembered by chunk;
    the memory is emptied when it holds `memory` chunks.
    """

    def __init__(self, path: str, memory: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in {**vocab, **self.special}.items():
            self.tokens[i] = token
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.none = len(pairs)
        self.tables = rank_tables(keys, self.none)
        self.memory, self.chunks = memory, {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of adjacent parts; `none` where the pair has no merge."""
        key = left.astype(np.int64) << 20 | right
        out = np.full(len(key), self.none, dtype=np.int32)
        for factor, keys, ranks in self.tables:
            at = key * factor >> 43 & (len(keys) - 1)
            np.copyto(out, ranks[at], where=keys[at] == key)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words of at most LONG bytes, laid end to end, and each word's count.

        Contiguous rank arrays, a column a word: a cell holds rank * LONG + place, so the smallest cell of a
        column is its leftmost smallest rank.
        """
        n, lengths = len(words), np.array([len(w) for w in words])
        width = int(lengths.max())
        parts = np.full((width + 1, n), -1, dtype=np.int32)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        column = np.repeat(np.arange(n), lengths)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        parts[row, column] = self.first[flat]
        parts[lengths - 1, np.arange(n)] = self.last[flat[np.cumsum(lengths) - 1]]
        none, place = self.none * LONG, np.arange(width, dtype=np.int32)[:, None]
        ranks = np.full((width + 1, n), none + LONG, dtype=np.int32)
        ranks[:-1] = self.rank(parts[:-1].ravel(), parts[1:].ravel()).reshape(width, n) * LONG + place
        index, done = np.arange(n), np.full((width, n), -1, dtype=np.int32)
        while True:
            best = ranks.min(axis=0)
            going = best < none
            if not going.all():
                over = ~going
                done[: len(parts) - 1, index[over]] = parts[:-1, over]
                index, parts, ranks, best = index[going], parts[:, going], ranks[:, going], best[going]
            if not len(index):
                break
            at, rows = best % LONG, np.arange(len(index))
            parts[at, rows] = self.merged[best // LONG]
            # delete the boundary: what stands right of it moves one place left
            right = place[: len(parts) - 1] > at
            parts[:-1] = np.where(right, parts[1:], parts[:-1])
            parts[-1] = -1
            ranks[:-1] = np.where(right, ranks[1:] - 1, ranks[:-1])
            ranks[-1] = none + LONG
            # refresh the two ranks beside it
            ranks[at, rows] = self.rank(parts[at, rows], parts[at + 1, rows]) * LONG + at
            left = np.flatnonzero(at)
            before = at[left] - 1
            ranks[before, left] = self.rank(parts[before, left], parts[at[left], left]) * LONG + before
            tall = int((parts >= 0).any(axis=1).sum())
            parts, ranks = parts[: tall + 1], ranks[: tall + 1]
        kept = done.T >= 0
        return done.T[kept], kept.sum(axis=1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word: heap of (rank, place) over a linked list of parts."""
        raw = np.frombuffer(word, dtype=np.uint8)
        parts = self.first[raw].tolist()
        parts[-1] = int(self.last[raw[-1]])
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(found) if r != self.none]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                r = int(self.rank(np.array([parts[i]]), np.array([parts[j]]))[0])
                if r != self.none:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p in parts if p >= 0], dtype=np.int32)

    def learn(self, chunks: set[str]) -> None:
        """Adds chunks (lower case, NFC) to the memory: each is split into words, and all words are merged together."""
        known, composed, new = self.chunks, [], set()
        for chunk in chunks:
            if chunk.isalpha():
                new.add(chunk)
                continue
            head = chunk[:-1]
            words = [head, chunk[-1]] if chunk[-1] in ",.;:!?" and head.isalpha() else self.words(chunk)
            composed.append((chunk, words))
            new.update([w for w in words if w not in known])
        words = sorted(new, key=len)
        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > LONG]
        for i in long:
            known[words[i]] = self.merge_long(raw[i]).tobytes()
        if long:
            words, raw = zip(*[(w, r) for w, r in zip(words, raw) if len(r) <= LONG]) if len(long) < len(raw) else ((), ())
        for at in range(0, len(words), 2048):
            ids, count = self.merge(raw[at : at + 2048])
            blob, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            known.update(zip(words[at : at + 2048], [blob[i:j] for i, j in zip([0, *ends], ends)]))
        for chunk, parts in composed:
            known[chunk] = b"".join([known[w] for w in parts])

    def split(self, text: str) -> list[str]:
        """White-space-delimited chunks, lower case and NFC; a special token is a chunk marked by a leading NUL."""
        if self.specials and self.specials.search(text):
            return [c for i, part in enumerate(self.specials.split(text)) for c in (["\0" + part] if i % 2 else self.split_plain(part))]
        return self.split_plain(text)

    @staticmethod
    def split_plain(text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()  # no final-sigma rule
        if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):  # str.split takes these for white space
            return [c for c in regex.split(r"\p{White_Space}+", text) if c]
        return text.split()

    def encode_bytes(self, batch: list[str], group: int = 1_000_000) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; about `group` characters are split at once."""
        out, at = [], 0
        while at < len(batch):
            split, size = [], 0
            while at < len(batch) and (not split or size + len(batch[at]) <= group):
                size += len(batch[at])
                split.append(self.split(batch[at]))
                at += 1
            if len(self.chunks) > self.memory:
                self.chunks.clear()
            new = set()
            for chunks in split:
                new.update(chunks)
            new.difference_update(self.chunks)
            special = {c for c in new if c[0] == "\0" and c[1:] in self.special}
            for c in special:
                self.chunks[c] = np.array([self.special[c[1:]]], dtype="<u4").tobytes()
            self.learn(new - special if special else new)
            out += [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text or ""])[0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space: the file names no decoder. Unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i < len(tokens) and tokens[i]])


def rank_tables(keys: np.ndarray, none: int) -> list[tuple]:
    """Hash tables of pair -> rank: the first has a key a slot; keys whose slot is taken go to the next table."""
    out, ranks, factor = [], np.arange(len(keys), dtype=np.int32), 0x9E3779B97F4A7C15
    while len(keys):
        multiplier = np.uint64(factor).astype(np.int64)
        at = keys * multiplier >> 43 & ((1 << 19) - 1)
        slot_keys, slot_ranks = np.full(1 << 19, -1, dtype=np.int64), np.full(1 << 19, none, dtype=np.int32)
        slots, first = np.unique(at, return_index=True)
        slot_keys[slots], slot_ranks[slots] = keys[first], ranks[first]
        out.append((multiplier, slot_keys, slot_ranks))
        rest = np.ones(len(keys), dtype=bool)
        rest[first] = False
        keys, ranks, factor = keys[rest], ranks[rest], (factor * 0xD1342543DE82EF95 | 1) & (2**64 - 1)
    return out


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself, or the next free code from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shift = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}
    return [chr(shift.get(b, b)) for b in range(256)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each whole text's token ids. No shuffle."""

    def run(batches):
        bpe = WordBpe(path)
        for b in small_batches(batches):
            ids = [np.frombuffer(x, dtype="<i4") for x in bpe.encode_bytes(b.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, "<i4"), *ids]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the token strings of each row's ids; null ids give an empty text. No shuffle."""

    def run(batches):
        bpe = WordBpe(path)
        for b in small_batches(batches):
            out = [bpe.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text in one pass, as digests: encodes, decodes the ids, keeps neither."""

    def run(batches):
        bpe = WordBpe(path)
        numbers = [str(i) for i in range(len(bpe.tokens))]
        for b in small_batches(batches):
            count, of_ids, of_text = [], [], []
            for raw in bpe.encode_bytes(b.column(1).to_pylist()):
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                count.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join(map(bpe.tokens.__getitem__, ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def pieces(docs: DataFrame, path: str, size: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, then `end_id`, cut into pieces of `size`."""

    def run(batches):
        bpe = WordBpe(path)
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for b in small_batches(batches):
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), bpe.encode_bytes(b.column(1).to_pylist())):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
