"""The q-gram filter join against all pairs."""
import random
from difflib import SequenceMatcher

import pytest

from reelframe.operators import drafts, findings, similarity


def texts(seed, n):
    r = random.Random(seed)
    base = ["the door opens slowly and nobody is there to see it", "அவன் வந்தான் பிறகு போனான்", "a", "ab", "", "aaaaaaaaaaaaaaaaaaaa", "no", "yes we can", "x" * 300 + " middle " + "y" * 300]
    out = list(base)
    while len(out) < n:
        t = list(r.choice(base[:8]) + r.choice(["", " again", " and again it went on"]))
        for _ in range(r.randrange(5)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randrange(2)] = r.choice(["", "z", "é", " "])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.72, 0.7, 0.5])
def test_no_pair_is_lost(spark, threshold):
    left = [(k, t) for k in (1, 2) for t in texts(k, 60)] + [(1, None), (3, "alone")]
    right = [(k, t) for k in (1, 2) for t in texts(k + 10, 60)] + [(2, None), (4, "alone")]
    want = {(k, a, b) for k, a in left for j, b in right if k == j and a is not None and b is not None and SequenceMatcher(None, a, b).ratio() >= threshold}
    frames = [spark.createDataFrame(x, "script_id int, text string").repartition(3) for x in (left, right)]
    rows = similarity.similar_pairs(*frames, ["script_id"], "text", threshold).collect()
    assert len(rows) == len(want) and {(r["script_id"], r["left_text"], r["right_text"]) for r in rows} == want
    assert all(r["similarity"] == SequenceMatcher(None, r["left_text"], r["right_text"]).ratio() for r in rows)


def test_bounds_hold():
    for t in (0.5, 0.7, 0.72, 0.85, 0.95):
        for a in texts(3, 40):
            for b in texts(4, 40):
                r = SequenceMatcher(None, a, b).ratio() if a or b else 1.0
                if r < t or not a or not b:
                    continue
                assert similarity.upper_bound(a, b) >= r
                q = similarity.gram_size(t)
                for size in (1, q):
                    if similarity.shared_grams(size, t, len(a) + len(b)) >= 1:
                        assert set(similarity.prefix(a, size, t)) & set(similarity.prefix(b, size, t))


def test_pairs_of_unlike_lines_do_not_meet(spark):
    """A group of 400 unlike lines and 400 quotes, of which 20 are nearly lines: nearly all of 160,000 pairs never meet."""
    r = random.Random(1)
    line = lambda: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(12))
    lines = [line() for _ in range(400)]
    quotes = [x[:-1] + "!" for x in lines[:20]] + [line() for _ in range(380)]
    a, b = (similarity.distinct_texts(spark.createDataFrame([(1, t) for t in x], "k int, text string"), ["k"], "text") for x in (quotes, lines))
    met = similarity.met_by(a, ["k"], 0.95).join(similarity.met_by(b, ["k"], 0.95).withColumnRenamed("id", "other"), ["k", "q", "gram"]).select("id", "other").distinct()
    assert 20 <= met.count() < 400


def test_states_and_carried_equal_all_pairs(spark):
    lines, quotes = texts(21, 50), [*texts(22, 50), "opens slowly and", "nobody is", "  ", None, "door opens  slowly", "\nyes we can"]
    elements = spark.createDataFrame([("s", t) for t in lines] + [("t", "nothing here")], "script_id string, text string")
    found = spark.createDataFrame([("s", i, q) for i, q in enumerate(quotes)] + [("t", 0, quotes[0])], "script_id string, finding_index int, evidence_quote string")
    got = {(r["script_id"], r["finding_index"]): r["status"] for r in drafts.finding_states(found, elements).collect()}
    state = lambda q, ls: "unknown" if not (q or "").strip(" ") else "still_present" if any(q in x or SequenceMatcher(None, q, x).ratio() >= drafts.SAME_LINE for x in ls) else "addressed"
    assert got == {**{("s", i): state(q, lines) for i, q in enumerate(quotes)}, ("t", 0): state(quotes[0], ["nothing here"])}
    new = spark.createDataFrame([("s", i, q) for i, q in enumerate(texts(23, 40))], "script_id string, finding_index int, issue string")
    old = elements.withColumnRenamed("text", "issue")
    best = {i: max(SequenceMatcher(None, q.lower(), x.lower()).ratio() if q or x else 1.0 for x in lines) for i, q in enumerate(texts(23, 40))}
    got = {r["finding_index"]: (r["best"], r["carried"]) for r in drafts.carried(old, new, ["script_id"], "finding_index", "issue").collect()}
    assert got == {i: (b, True) if b >= drafts.SAME_ISSUE else (None, False) for i, b in best.items()}


def test_contained_takes_the_rarest_word(spark):
    bodies = [(1, i, f"every body has the words and one number{i} of its own") for i in range(30)]
    quotes = [(1, 0, "words and one number7 of its"), (1, 1, "words and other number7 of its"), (1, 2, "has the words and one num"), (1, 3, "own"), (1, 4, "one number29"), (2, 5, "has the words and one"), (1, 6, "")]
    q, b = spark.createDataFrame(quotes, "k int, id int, q string"), spark.createDataFrame(bodies, "k int, seq int, body string")
    for keys in (["k"], []):
        got = {r["id"]: r["found_at"] for r in findings.contained(q, b, keys, "q", "body", "id", "seq").collect()}
        assert got == {0: 7, 2: 0, 3: 0, 4: 29} | ({} if keys else {5: 0})
