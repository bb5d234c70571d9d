"""Repetition rules against a brute-force version, with awkward rows."""
import collections
import random
import re

import pyarrow as pa
import pytest

from reelframe.llm import repetition

WORDS = r"[^\x20\x09-\x0D]+"


def brute(text, lengths):
    found, out = re.findall(WORDS, text), {}
    lines, seen, again = [x for x in text.split("\n") if re.search(WORDS, x)], set(), []
    for x in lines:
        again += [x] if x in seen else []
        seen.add(x)
    chars = sum(map(len, found))
    out = {"n_words": len(found), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(again)}
    out |= {"dup_lines": len(again) / max(len(lines), 1), "dup_line_chars": sum(map(len, again)) / max(sum(map(len, lines)), 1)}
    shares = []
    for n in sorted({*lengths, 8}):
        grams = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]
        count, seen, later, every = collections.Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            later |= set(range(i, i + n)) if g in seen else set()
            every |= set(range(i, i + n)) if count[g] > 1 else set()
            seen.add(g)
        shares += [sum(len(found[i]) for i in later) / max(chars, 1)] if n in lengths else []
        out |= {"n_repeat_words": len(every)} if n == 8 else {}
    return out | {"dup_ngram_chars": shares}


def made_up():
    r = random.Random(3)
    some = lambda n, k: " ".join(f"é{r.randrange(k)}" for _ in range(n))
    out = ["", None, "x", "\t \n", "one two three", "same line here\n" * 5, "a b " * 60, "a\n a\na\n\n a", "# * $ % & | < > ok", some(400, 30), some(30, 400), "q" * 5000, " word word x\x1cy"]
    passage = some(12, 1000)
    out += [some(50, 900) + " " + passage + " " + some(50, 900) + " " + passage, " ".join([passage] * 3) + " " + some(9, 9), some(30_000, 50)]
    return out + [" ".join(r.choice(["ab", "cd", "ef"]) for _ in range(n)) for n in range(4, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1, 0.5) for i, t in enumerate(made_up())]
    return spark.createDataFrame(rows, "doc_id long, text string, broken string, kept string, n_words int, dup_lines double").repartition(3)


def test_measures_equal_brute_force(docs):
    lengths = [5, 6, 7, 8, 9, 10]
    got = {r["doc_id"]: r for r in repetition.coverage(docs, lengths).collect()}
    for i, t in enumerate(made_up()):
        assert {k: got[i][k] for k in brute(t or "", lengths)} == brute(t or "", lengths), i


def test_verdicts(docs):
    limits, lengths = repetition.LIMITS, [5, 6, 7, 8, 9, 10]
    rows = repetition.filter_rules(docs.unionByName(docs)).collect()
    assert len(rows) == 2 * len(made_up())
    for r in rows:
        want = brute(made_up()[r["doc_id"]] or "", lengths)
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        broken = [k for k in ("dup_lines", "dup_line_chars") if want[k] > limits[k]] + [f"{n}_grams" for n, x in zip(lengths, want["dup_ngram_chars"]) if x > limits[n]]
        assert (r["base_failed"], r["broken"], r["kept"]) == (base, broken, not base and not broken)
    assert {r["kept"] for r in rows} == {True, False}
    assert repetition.filter_rules(docs.limit(0)).count() == 0


def test_colliding_hashes_are_compared_by_words(monkeypatch):
    texts = pa.array([t or "" for t in made_up()[9:16]])
    want = repetition.measured(texts, [5, 10])
    monkeypatch.setattr(repetition, "mix", lambda x: x & repetition.U64(7))
    got = repetition.measured(texts, [5, 10])
    assert all((got[k] == want[k]).all() for k in want)
