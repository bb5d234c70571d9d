"""What passes, chat turns and reports are put together from: small cases."""
from pyspark.sql import functions as F

from reelframe.operators import context, findings, models
from reelframe.sources import export


def test_ledger_from_a_pass(spark):
    class Fake:
        def __init__(self, fast):
            pass

        def chat_json(self, system, user, schema):
            assert "Candidates:\n(none)" in user
            return {"ledger": [{"setup": " the gun ", "status": "paid", "payoff_scenes": [9]}, {"setup": "  ", "status": "paid"}, {"setup": "the letter", "status": "?", "setup_scenes": [2]}, {"note": "no setup"}]}

    overview = models.overviews(spark.createDataFrame([("s", 2, "then"), ("s", 1, "first"), ("s", 3, "")], "script_id string, scene_number int, summary string"))
    assert overview.first()["text"] == "Scene 1: first\nScene 2: then"
    empty = spark.createDataFrame([], "script_id string, seeds string")
    answers = models.run_pass(models.ledger_input(overview, empty), models.PASSES["setup_payoff"], Fake, ["script_id"], wait=0.0)
    got = [(r["setup"], r["kind"], r["setup_scenes"], r["payoff_scenes"], r["status"]) for r in models.ledger_entries(answers).orderBy("queue_rank").collect()]
    assert got == [("the letter", "other", [2], None, "dangling"), ("the gun", "other", [], [9], "paid")]


def test_only_asked_for_with_something_to_ask(spark):
    overview = spark.createDataFrame([("a", "x"), ("b", "y")], "script_id string, text string")
    coverage = spark.createDataFrame([("a", "", None), ("b", " two meet ", "Comedy")], "script_id string, logline string, genre string")
    assert [tuple(r) for r in models.logline_input(coverage, overview).collect()] == [("b", "Logline: two meet\n\ny")]
    table = spark.createDataFrame([("drama", 0, "stakes"), ("comedy", 1, "jokes")], "genre string, order int, conventions string")
    got = {r["script_id"]: r["text"] for r in models.genre_input(coverage, overview, table).collect()}
    assert got == {"a": "Conventions of drama: stakes\n\nx", "b": "Conventions of comedy: jokes\n\ny"}
    nobody = spark.createDataFrame([], "script_id string, character string, cast_rank int")
    assert models.reads_input(overview, nobody).count() == 0


def test_failed_reads_are_left_out(spark):
    e = spark.createDataFrame([("s", 1, 0, "action", "the red door opens slowly")], "script_id string, scene_number int, element_index int, type string, text string")
    rows = spark.createDataFrame([("s", 0, "failed", None), ("s", 1, None, ("RAVI", "kind", None, None, "red door opens", None))], "script_id string, item_index int, error string, answer struct<character:string,how_reads:string,apparent_intent:string,gap:string,evidence_quote:string,scene_refs:array<int>>")
    got = models.verified_reads(rows, e).collect()
    assert [(r["character"], r["verification"]["status"], r["verification"]["matched_scene"]) for r in got] == [("RAVI", "verified", 1)]
    assert findings.verification_summary(models.verified_reads(rows, e)).first()["verified"] == 1


def test_quotes_are_made_safe(spark):
    df = spark.createDataFrame([(0, " a "), (None, "b" * 5000), (3, "  "), (4, None)], "n int, t string")
    got = [r[0] for r in df.select(context.quoted(F.col("n"), F.col("t"))).collect()]
    assert tuple(got[0]) == (1, "a") and got[1][0] is None and len(got[1][1]) == 4000 and got[2] is None and got[3] is None


def test_replies_own_up(spark):
    text = "Look at scene 7 again, that is where it turns."
    replies = spark.createDataFrame([("s", 1, 1, "q", text), ("s", 2, 2, "q", "Scene 1 works. Shall we?"), ("t", 3, 3, "r", "Fine.")], "script_id string, text_id int, seq int, session_id string, text string")
    scenes = spark.createDataFrame([("s", 1)], "script_id string, scene_number int")
    got = {r["text_id"]: r["text"] for r in context.finished_replies(replies, scenes, ["And then?"], "seq").collect()}
    assert got == {1: text + "\n\n(I named scene 7, but this script has no such scene. Which one do you mean?)", 2: "Scene 1 works. Shall we?", 3: "Fine.\n\nAnd then?"}


def test_report_of_a_script_without_findings(spark):
    none = spark.createDataFrame([], "script_id string, finding_index int, category string, severity string, issue string, evidence_quote string")
    figures = spark.createDataFrame([("s", 3, 2.5)], "script_id string, scene_count int, runtime_minutes double")
    assert export.markdown_report(none, figures).first()["markdown"] == "# Report\n\nScenes: 3\nMinutes: 2.5\n\n"
    dials = spark.createDataFrame([("s", "RAVI", "warmth", 4, None)], "script_id string, character string, trait string, score int, note string")
    assert export.markdown_report(none, figures, dials=dials).first()["markdown"].endswith("## Dials\n- RAVI, warmth: 4 of 10")


def test_answers_of_several_chunks_are_numbered_through(spark):
    class Reads:
        """Two reads a text: of the first word, quoting the text, and of the second."""

        def __init__(self, fast):
            pass

        def chat_json(self, system, user, schema):
            return {"reads": [{"character": user.split()[0], "evidence_quote": user, "scene_refs": [1]}, {"character": user.split()[1], "evidence_quote": "nobody ever said this at all", "scene_refs": [1]}]}

    lines = ["anna waits at the door", "ravi opens it very slowly", "meera says nothing at all"]
    elements = spark.createDataFrame([("s", 1, i, "action", t) for i, t in enumerate(lines)], "script_id string, scene_number int, element_index int, type string, text string")
    rows = elements.withColumn("chunk", 2 - elements["element_index"])
    for asked, keys, names in ((rows.repartition(3), ["script_id", "element_index"], ["meera", "says", "ravi", "opens", "anna", "waits"]), (elements.repartition(3), ["script_id", "element_index"], ["anna", "waits", "ravi", "opens", "meera", "says"])):
        answers = models.run_pass(asked, models.PASSES["reads"], Reads, keys, wait=0.0)
        assert [(r["item_index"], r["answer"]["character"]) for r in answers.orderBy("item_index").collect()] == list(enumerate(names))
        got = models.verified_reads(answers, elements).collect()
        assert len(got) == 6 and {r["character"]: r["verification"]["status"] for r in got} == {n: "verified" if i % 2 == 0 else "not_found" for i, n in enumerate(names)}
    assert [r["character"] for r in models.coverage_of(answers).collect()] == ["anna"]


def test_level_entries_keep_one_order(spark):
    rows = [("s", 5, f"setup {i % 7}", "other", [i], [i] if i % 2 else None, "dangling", f"n{i}") for i in range(40)]
    schema = "script_id string, entry_index int, setup string, kind string, setup_scenes array<int>, payoff_scenes array<int>, status string, note string"
    runs = [sorted(tuple(map(str, r)) for r in findings.ledger(spark.createDataFrame(rows, schema).repartition(n)).collect()) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 12
