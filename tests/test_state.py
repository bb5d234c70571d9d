"""Names, drafts, filters, progress and the watch folder, on small tables worked out by hand."""
import pytest
from pyspark.sql import functions as F

from reelframe.operators import context, drafts, manage, memory, models
from reelframe.streaming import jobs


def test_names_are_the_first_free_ones(spark):
    uploads = spark.createDataFrame([("act.txt", 1), ("act.md", 2), ("act.pdf", 3), ("act_2.txt", 4), ("new.txt", 5)], "filename string, arrived int")
    taken = spark.createDataFrame([("act",), ("act_3",), ("other_2",)], "project string")
    got = {r["arrived"]: r["project"] for r in manage.unique_names(uploads, taken).collect()}
    assert got == {1: "act_4", 2: "act_5", 3: "act_6", 4: "act_2", 5: "new"}
    assert {r["project"] for r in manage.unique_names(uploads.where("arrived < 4")).collect()} == {"act", "act_2", "act_3"}


def test_filters(spark):
    rows = spark.createDataFrame([(1, "open", "main", False, "x"), (2, "open", "bit", None, " "), (3, "done", "main", False, None), (4, "open", "main", True, "y")], "id int, status string, importance string, suppressed boolean, text string")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(manage.shown(rows, "open")) == [1, 2] and ids(manage.shown(rows, None, "main")) == [1, 3] and ids(manage.with_text(rows)) == [1, 4]


def test_activation_saves_first_and_resets_what_is_derived(spark):
    table = lambda rows: spark.createDataFrame(rows, "script_id string, text string")
    working, draft, saved = {"elements": table([("a", "old"), ("b", "stays")])}, {"elements": table([("a", "new")])}, []
    stages = spark.createDataFrame([("a", "parse", "complete", "x"), ("a", "analyze", "complete", "x"), ("b", "analyze", "complete", "x")], "script_id string, stage string, status string, detail string")
    now, after = manage.activated(working, draft, stages, ["analyze"], lambda t: saved.append(t["elements"].count()))
    assert saved == [2] and {tuple(r) for r in now["elements"].collect()} == {("a", "new"), ("b", "stays")}
    assert {(r["script_id"], r["stage"], r["status"]) for r in after.collect()} == {("a", "parse", "complete"), ("a", "analyze", "pending"), ("b", "analyze", "complete")}


def test_observations_are_noted_once(spark):
    states = spark.createDataFrame([("w", "detail_level", "deep", 0.8, True), ("w", "directness", "direct", 0.9, True), ("v", "directness", "gentle", 0.5, False)], "writer string, dimension string, value string, confidence double, gated boolean")
    known = spark.createDataFrame([("w", "directness")], "writer string, dimension string")
    assert [(r["dimension"], r["text"]) for r in memory.gated_observations(states, known).collect()] == [("detail_level", "Prefers deep on detail level")]


def test_progress_counts_answers_and_errors(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "bad"), (3, "b", None)], "id int, answer string, error string")
    seen, counts = models.with_progress(rows, "answers")
    assert seen.count() == 3 and counts.get == {"answered": 2, "failed": 1}


def test_halving_keeps_the_order():
    def call(part):
        if len(part) > 1 or part == [3]:
            raise ValueError("no")
        return [part[0] * 10]

    assert [(p, f, bool(e)) for p, f, e in models.with_halving([1, 2, 3, 4], call)] == [([1], [10], False), ([2], [20], False), ([3], [], True), ([4], [40], False)]


def test_leading_cast(spark):
    rows = spark.createDataFrame([("s", n % k, str(k)) for n in range(12) for k in (1, 3, 12)], "script_id string, scene_number int, character string")
    assert [(r["character"], r["scenes"]) for r in context.leading_cast(rows, 2).orderBy("cast_rank").collect()] == [("12", 12), ("3", 3)]


def test_repetition_ratio_of_words(spark):
    text = "a b c d " * 15 + "e f"
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    rows = spark.createDataFrame([(text,), ("too short",), ("",), (None,)], "text string")
    got = [r["ratio"] for r in context.repetition_ratios(rows, F.col("text")).collect()]
    assert got[0] == pytest.approx(1 - len(set(grams)) / len(grams)) and got[1:] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("aside", [True, False])
def test_a_failing_batch_is_put_aside_or_ends_the_stream(spark, tmp_path, aside):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fountain").write_text("INT. ROOM - DAY\n\nShe waits.\n")

    def handle(tables, n):
        raise RuntimeError("no disk")

    run = jobs.watch(spark, str(folder), str(tmp_path / "archive"), str(tmp_path / "checkpoint"), handle, once=True, quarantine=str(tmp_path / "aside") if aside else None)
    if aside:
        run.awaitTermination()
        assert [r["error"] for r in spark.read.parquet(str(tmp_path / "aside")).collect()] == ["RuntimeError: no disk"]
    else:
        with pytest.raises(Exception, match="no disk"):
            run.awaitTermination()


def test_years_are_no_page_numbers(spark):
    from reelframe.sources.screenplay import pdf_lines

    rows = [("s", 1, float(20 * i), float(20 * i + 10), 72.0, 600.0, t) for i, t in enumerate(["INT. ROOM - DAY", "1999", "12", "7."])]
    boxes = spark.createDataFrame(rows, "script_id string, page int, top double, bottom double, x0 double, page_width double, text string")
    assert [r["raw"] for r in pdf_lines(boxes).orderBy("line_no").collect()] == ["INT. ROOM - DAY", "1999"]


def test_previous_draft(spark):
    rows = spark.createDataFrame([("s", "b", 2), ("s", "a", 1)], "script_id string, draft_name string, created_at int")
    assert {r["draft_name"]: r["previous"] for r in drafts.previous_draft(rows).collect()} == {"a": None, "b": "a"}
