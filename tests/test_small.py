"""Small operators, readers and writers by hand, and a watch folder of mixed formats."""
import json

from pyspark.sql import functions as F

from reelframe.operators import context, manage, models, rules
from reelframe.sources import export, json_files
from reelframe.streaming import jobs


def rows(d, *c):
    return [tuple(r) for r in (d.select(*c) if c else d).collect()]


def test_fuzzy_rank(spark):
    labels = spark.createDataFrame([(x,) for x in ("Open Script", "Script", "Stop", "Export Report", "scene postcard", "zzz")], "label string")
    got = {r["label"]: r["match_score"] for r in context.fuzzy_rank(labels, "script", "label").collect()}
    assert set(got) == {"Open Script", "Script"} and got["Script"] > got["Open Script"] > 90
    subsequence = {r["label"]: r["match_score"] for r in context.fuzzy_rank(labels, "ExRt", "label").collect()}
    assert set(subsequence) == {"Export Report"} and 0 < subsequence["Export Report"] < 100


def test_newest_first(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("d", 2.0), ("c", 2.0), ("e", None)], "id string, ts double")
    assert [r[0] for r in rows(manage.newest_first(d, "ts", "id"), "id")] == ["b", "c", "d", "a", "e"]


def test_the_model_is_the_first_that_is_named():
    assert models.resolved_model("x", "y", ["z"]) == "x" and models.resolved_model(None, "y", ["z"]) == "y" and models.resolved_model("", None, ["z", "w"]) == "z" and models.resolved_model(None, None, []) is None


def test_rule_fragments(spark):
    d = spark.createDataFrame([("b", "scene", "Late in", ("O", "W"), "Enter late.", "talk"), ("a", "scene", "Early out", (None, None), "Leave early.", "walks"), ("c", "theme", "One", ("O", None), "D.", "S.")], "id string, taxonomy_level string, name string, source struct<originator:string,work:string>, definition string, detection_signal string")
    got = dict(rows(rules.fragment(d)))
    assert got == {"scene": "- Early out: Leave early. Look for: walks\n- Late in (O, W): Enter late. Look for: talk", "theme": "- One (O): D. Look for: S."}


def test_snapshots_replace_only_their_draft(spark, tmp_path):
    e = lambda *x: spark.createDataFrame([(t,) for t in x], "text string")
    home = str(tmp_path / "drafts")
    export.snapshot({"elements": e("one", "two"), "notes": e("n")}, home, "draft-1")
    export.snapshot({"elements": e("other")}, home, "draft-2")
    export.snapshot({"elements": e("again")}, home, "draft-1")
    assert sorted(rows(spark.read.parquet(f"{home}/elements"), "text", "draft_name")) == [("again", "draft-1"), ("other", "draft-2")]
    assert rows(spark.read.parquet(f"{home}/notes"), "text") == [("n",)]


def test_json_readers(spark, tmp_path):
    for name, content in {
        "p1.json": {"project_name": "b", "title": "Beta", "drafts": [{"name": "draft-1", "created_at": 2.0}], "stages": {"parse": {"status": "complete"}}}, "p2.json": {"project_name": "a", "title": "Alpha", "unknown": 1}, "p3.json": "{broken",
    }.items():
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
    got = json_files.read_projects(spark, str(tmp_path / "p*.json"))
    assert rows(got, "title", "project_name", F.col("stages")["parse"]["status"], F.get("drafts", F.lit(0))["name"]) == [("Alpha", "a", None, None), ("Beta", "b", "complete", "draft-1")]
    (tmp_path / "r1.json").write_text(json.dumps([{"id": "x", "name": "X", "taxonomy_level": "scene"}, {"id": "y", "name": "Y"}]))
    (tmp_path / "r2.json").write_text(json.dumps([{"id": "z", "requires": ["k"]}]))
    assert sorted(rows(json_files.read_rules(spark, str(tmp_path / "r*.json")), "id", "name")) == [("x", "X"), ("y", "Y"), ("z", None)]
    cards = json_files.read_documents(spark, str(tmp_path / "p*.json"), "title string, drafts array<struct<name:string>>")
    assert cards.count() == 2 and set(cards.columns) == {"path", "title", "drafts"}


FDX = '<?xml version="1.0"?><FinalDraft Version="1"><Content><Paragraph Type="Scene Heading"><Text>INT. HALL - DAY</Text></Paragraph><Paragraph Type="Character"><Text>ANNA</Text></Paragraph><Paragraph Type="Dialogue"><Text>Here.</Text></Paragraph></Content></FinalDraft>'


def test_watch_takes_final_draft_files_and_sets_bad_ones_aside(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fountain").write_text("INT. A - DAY\n\nBOB\nHi.\n")
    (folder / "b.fdx").write_text(FDX)
    (folder / "c.fdx").write_text("not xml at all")
    seen = []
    start = lambda: jobs.watch(spark, str(folder), str(tmp_path / "done"), str(tmp_path / "cp"), lambda t, n: seen.extend(rows(t["elements"], "type", "text", "character")), once=True, quarantine=str(tmp_path / "bad"))
    start().awaitTermination()
    assert sorted(seen, key=str) == sorted([("scene_heading", "INT. A - DAY", None), ("character", "BOB", "BOB"), ("dialogue", "Hi.", "BOB"), ("scene_heading", "INT. HALL - DAY", None), ("character", "ANNA", "ANNA"), ("dialogue", "Here.", "ANNA")], key=str)
    assert rows(spark.read.parquet(str(tmp_path / "bad")), "source_filename", "error") == [("c.fdx", "not a Final Draft document")]
    (folder / "d.fountain").write_text("INT. B - DAY\n")
    start().awaitTermination()
    assert ("scene_heading", "INT. B - DAY", None) in seen and len(seen) == 7
