"""Versioned edits, gates and retries, drafts and ideas, on small tables and against simulations."""
import random

import pytest

from reelframe.operators import drafts, findings, manage

LOG = "script_id string, seq long, op string, edit_seq int, scene_number int, replacements array<struct<old:string,new:string>>"
ELEMENTS = "script_id string, scene_number int, element_index int, text string"


def simulated(elements, log):
    """One script at a time, as a writer would see it: the texts after each entry, and what each entry did."""
    after, did = {}, {}
    for script in sorted({x[0] for x in elements}):
        first = {(s, i): t for k, s, i, t in elements if k == script}
        now, done, undone = dict(first), [], []
        for _, seq, op, edit, scene, pairs in sorted((x for x in log if x[0] == script), key=lambda x: x[1]):
            def swap(scene, pairs):
                ok = []
                for old, new in pairs:
                    same = [k for k in now if k[0] == scene and now[k] == old]
                    if len(same) == 1:
                        now[same[0]] = new
                        ok.append((old, new))
                return ok

            if op == "edit":
                applied = swap(scene, pairs)
                done, undone = [*done, (edit, scene, applied)], []
                did[script, seq] = (op, edit, len(applied), len(pairs) - len(applied))
            elif op == "reset":
                now, done, undone = dict(first), [], []
            else:
                source, to = (done, undone) if op == "undo" else (undone, done)
                if source:
                    edit, scene, applied = entry = source.pop()
                    to.append(entry)
                    ok = swap(scene, [(b, a) for a, b in applied] if op == "undo" else applied)
                    did[script, seq] = (op, edit, len(ok), len(applied) - len(ok))
            after[script, seq] = dict(now)
        after[script, None] = now
    return after, did


def scripts():
    r = random.Random(6)
    texts = [f"{c}{c}{c} {n} " + c * 9 for n, c in enumerate("abcdefgh")]  # unlike enough never to be taken for one another
    elements = [(k, s, i, r.choice(texts)) for k in ("x", "y", "z") for s in (1, 2) for i in range(4)]
    log, n = [], 0
    for k in ("x", "y", "z"):
        for seq in range(60):
            op = r.choices(["edit", "undo", "redo", "reset"], [5, 4, 3, 0.4])[0]
            n += op == "edit"
            pairs = [(r.choice(texts), r.choice(texts)) for _ in range(r.randrange(1, 3))] if op == "edit" else None
            log.append((k, seq * 10, op, n if pairs else None, r.choice([1, 2]) if pairs else None, pairs))
    return elements, log


def test_versions_equal_a_simulation(spark):
    elements, log = scripts()
    told = drafts.history(spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(log, LOG).repartition(4)).cache()
    table = drafts.versions(told)
    after, did = simulated(elements, log)
    for seq in (None, 0, 90, 250, 333, 590):
        got = {(r["script_id"], r["scene_number"], r["element_index"]): r["text"] for r in drafts.as_of(table, seq).collect()}
        for k in ("x", "y", "z"):
            last = seq if seq is None else max(s for x, s in ((x, s) for x, s in after if s is not None) if x == k and s <= seq)
            assert {(s, i): t for (j, s, i), t in got.items() if j == k} == after[k, last]
    got = {(r["script_id"], r["seq"]): (r["op"], r["target"], r["restored"], r["failed"]) for r in drafts.changes(told).where("op <> 'reset'").collect()}
    assert got == did and any(v[3] for v in did.values())
    rows = table.collect()
    assert all(r["to_seq"] is None or r["from_seq"] is None or r["from_seq"] < r["to_seq"] for r in rows)


def test_edits_in_force(spark):
    _, log = scripts()
    want = set()
    for k in ("x", "y", "z"):
        done, undone = [], []
        for _, _, op, edit, _, _ in (x for x in log if x[0] == k):
            if op == "edit":
                done, undone = [*done, edit], []
            elif op == "undo" and done:
                undone.append(done.pop())
            elif op == "redo" and undone:
                done.append(undone.pop())
            elif op == "reset":
                done, undone = [], []
        want |= {(k, e) for e in done}
    assert {tuple(r) for r in drafts.effective_log(spark.createDataFrame(log, LOG).repartition(5)).collect()} == want


def test_undo_never_guesses(spark):
    elements = spark.createDataFrame([("s", 1, 0, "I am so very tired of this"), ("s", 1, 1, "No.")], ELEMENTS)
    log = spark.createDataFrame([("s", 1, "edit", 1, 1, [("I am so very tired of it", "Enough."), ("nothing like this", "x")]), ("s", 2, "edit", 2, 1, [("No.", "Enough.")]), ("s", 3, "undo", None, None, None), ("s", 4, "undo", None, None, None), ("s", 5, "undo", None, None, None), ("s", 6, "redo", None, None, None)], LOG)
    told = drafts.history(elements, log)
    got = [(r["seq"], r["op"], r["target"], r["restored"], r["failed"]) for r in drafts.changes(told).orderBy("seq").collect()]
    assert got == [(1, "edit", 1, 1, 1), (2, "edit", 2, 1, 0), (3, "undo", 2, 0, 1), (4, "undo", 1, 0, 1), (6, "redo", 1, 0, 1)]
    assert {r["element_index"]: r["text"] for r in drafts.as_of(drafts.versions(told)).collect()} == {0: "Enough.", 1: "Enough."}


NEEDS = [("coverage", "overview"), ("genre", "coverage"), ("logline", "coverage"), ("reads", "overview")]


@pytest.mark.parametrize("needs, failed, want", [
    (NEEDS, {"overview"}, {"overview", "coverage", "genre", "logline", "reads"}), (NEEDS, {"coverage"}, {"coverage", "genre", "logline"}), (NEEDS, {"genre"}, {"genre"}), (NEEDS, set(), set()),
    ([("a", "b"), ("b", "c"), ("c", "a")], {"c"}, {"a", "b", "c"}), ([(f"n{i}", f"n{i + 1}") for i in range(30)], {"n30"}, {f"n{i}" for i in range(31)}),
])
def test_gates_close_all_the_way(spark, needs, failed, want):
    names = sorted({c for x in needs for c in x})
    outcomes = spark.createDataFrame([("s", c, "failed" if c in failed else "ok") for c in names] + [("t", c, "ok") for c in names], "script_id string, category string, outcome string")
    got = findings.close_gates(outcomes, spark.createDataFrame(needs, "category string, requires string")).where("outcome = 'failed'").collect()
    assert {(r["script_id"], r["category"]) for r in got} == {("s", c) for c in want}


def test_gates_close_across_what_was_not_run(spark):
    outcomes = spark.createDataFrame([("s", "overview", "failed"), ("s", "genre", "ok")], "script_id string, category string, outcome string")
    assert findings.close_gates(outcomes, spark.createDataFrame(NEEDS, "category string, requires string")).where("outcome = 'ok'").count() == 0


def test_retries_take_along_what_they_need(spark):
    outcomes = spark.createDataFrame([("s", "genre", "failed"), ("s", "coverage", "ok"), ("t", "coverage", "failed"), ("t", "genre", "failed"), ("u", "theme", "failed"), ("v", "genre", "ok")], "script_id string, category string, outcome string")
    along = spark.createDataFrame([("genre", "coverage"), ("logline", "coverage")], "category string, requires string")
    assert {tuple(r) for r in findings.retries(outcomes, along).collect()} == {("s", "genre", "failed"), ("s", "coverage", "needed"), ("t", "coverage", "failed"), ("t", "genre", "failed"), ("u", "theme", "failed")}


def test_uploads_are_the_next_drafts(spark):
    table = spark.createDataFrame([("s", "draft-1", "a.txt", 1.0, True), ("t", "draft-1", "b.txt", 1.0, True)], "script_id string, draft_name string, source_filename string, created_at double, active boolean")
    new = spark.createDataFrame([("s", "d.txt", 3.0), ("s", "c.txt", 2.0), ("n", "e.txt", 2.0)], "script_id string, source_filename string, created_at double")
    stages = spark.createDataFrame([("s", "parse", "complete", "x"), ("s", "chat", "complete", "x"), ("n", "parse", "complete", None), ("t", "parse", "complete", "x")], "script_id string, stage string, status string, detail string")
    kept = []
    after, reset = drafts.upload(table, new, stages, lambda d: kept.extend(tuple(r) for r in d.collect()))
    assert sorted(kept) == [("n", "original"), ("s", "draft-1")]
    assert {(r["script_id"], r["draft_name"], r["source_filename"], r["active"]) for r in after.collect()} == {("s", "draft-1", "a.txt", False), ("s", "draft-2", "c.txt", False), ("s", "draft-3", "d.txt", True), ("t", "draft-1", "b.txt", True), ("n", "draft-1", "e.txt", True)}
    assert {tuple(r) for r in reset.collect()} == {("s", "parse", "pending", None), ("s", "chat", "pending", None), ("n", "parse", "pending", None), ("t", "parse", "complete", "x")}


def test_ideas_graduate_with_their_talk(spark):
    cards = spark.createDataFrame([(1, "a page", "hook"), (2, None, "other")], "idea_id int, content string, logline string")
    talk = spark.createDataFrame([(1, "a", "hi"), (1, "b", "yo"), (2, "a", "later"), (3, "c", "stays")], "idea_id int, session_id string, text string")
    moves = spark.createDataFrame([(1, "film"), (2, "film"), (9, "blank")], "idea_id int, project string")
    premises, sessions = manage.graduated(cards, talk, moves)
    assert {(r["project"], r["content"], r["logline"]) for r in premises.collect()} == {("film", "a page", "hook"), ("film", "", "other"), ("blank", "", None)}
    assert {(r["project"], r["session_id"], r["text"]) for r in sessions.collect()} == {("film", "a", "later"), ("film", "b", "yo")}
