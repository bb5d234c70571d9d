"""The prefix trie against a brute-force version: ties, nulls, long and turnless conversations, many copies."""
import hashlib
import random
import zlib

import pytest

from reelframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path string, n long, k1 int"


def brute(rows, grafts):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if grafts else 0
        built[c] = tuple(own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]) if grafts else tuple(turns)
    nodes = {s[:d] for s in built.values() for d in range(len(s) + 1)}
    out = set()
    for p in nodes:
        members = [c for c, s in built.items() if s[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        count = {q: sum(s[: len(q)] == q for s in built.values()) for q in below}
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(x[:-1] == q and x for x in below) for q in below)
        saved = sum((count[q] - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c, s in built.items() if s == p)))
        above = min(c for c, s in built.items() if s[: len(p) - 1] == p[:-1]) if p else None
        out.add((min(members), len(p), above, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(nodes)


def conversations():
    r, rows = random.Random(5), []
    for c in range(60):
        for t in range(r.randrange(1, 9)):
            rows.append((c * 7, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ü" * 3, None, "", "long " * 40])))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(30) for t in range(4)]
    rows += [(2000 + c, t, "user", "deep" if t < 66 + c or c < 2 else f"{c}") for c in range(4) for t in range(75)]
    rows += [(3000, None, "user", "first"), (3000, 0, "user", "second"), (3001, 5, "b", "tie"), (3001, 5, "a", "tie"), (3001, 5, "a", "tie"), (-250, 0, "user", "below zero"), (-200, 0, "user", "zero")]
    rows += [(3101, 0, "user", "gone when its first turns are cut"), (None, 1, "user", "nobody's"), (8000, 0, "user:x", "y"), (8001, 0, "user", ":xy")]
    return [(*x, "d", "p", 1, 2) for x in rows]


def collected(df):
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()]


@pytest.mark.parametrize("grafts", [True, False])
def test_trie_equals_brute_force(spark, grafts):
    rows = conversations()
    got = collected(trie.conversations_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), grafts))
    want, n = brute(rows, grafts)
    assert len(got) == n and set(got) == want


@pytest.mark.parametrize("block", [1, 3])
def test_pieces_of_any_length_give_the_same_trie(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", 1)
    rows = [x for x in conversations() if x[0] is not None and x[0] < 2000 or x[0] == 3001]
    got = collected(trie.conversations_trie(spark.createDataFrame(rows, SCHEMA), True))
    want, n = brute(rows, True)
    assert len(got) == n and set(got) == want


def test_turnless_and_empty(spark):
    one = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    rows = [(one, 0, "user", "cut", "d", "p", 1, 2)]
    assert collected(trie.conversations_trie(spark.createDataFrame(rows, SCHEMA), True)) == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]
    empty = trie.conversations_trie(spark.createDataFrame([], SCHEMA), True)
    assert empty.count() == 0 and empty.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
