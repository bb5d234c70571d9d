"""Operators on the inline script and on small tables, with rows worked out by hand."""
import json

import pytest
from pyspark.sql import functions as F

from reelframe.operators import context, craft, drafts, findings, graph, manage, memory, models, stats, structure, tracks
from reelframe.sources import export, json_files
from reelframe.streaming import jobs


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stats(parsed):
    got = {r["character"]: r for r in stats.character_stats(parsed["elements"]).collect()}
    assert (got["RAVI"]["lines"], got["RAVI"]["words"], got["RAVI"]["scenes"]) == (3, 7, 2)
    assert got["MEERA"]["words"] == 7 and got["Old Man"]["share_pct"] == 22.2
    assert stats.report(parsed["elements"], parsed["scenes"]).first()["scene_count"] == 3


def test_structure(parsed):
    pages = structure.page_positions(structure.scene_lines(parsed["elements"]), parsed["scenes"])
    acts = structure.acts(pages)
    assert acts.count() == 3 and sum(len(r["scene_numbers"]) for r in acts.collect()) == 3
    arc = {r["character"]: r for r in structure.character_arc(parsed["presence"], parsed["scenes"], parsed["elements"]).collect()}
    assert arc["RAVI"]["scene_count"] == 2 and arc["RAVI"]["appears_throughout"]


def test_quiet_gap_counts_absent_scenes(spark):
    df = spark.createDataFrame([("s", "A", n) for n in (1, 2, 5, 7)], "script_id string, character string, scene_number int")
    assert rows(structure.quiet_gaps(df, ["script_id", "character"], "scene_number"), "after", "absent") == [(2, 2)]


def test_graph(parsed):
    assert rows(graph.cooccurrence(parsed["presence"], ["script_id", "scene_number"], "character", "scene_number"), "a", "b", "scenes") == [("MEERA", "RAVI", [1])]
    assert rows(graph.props(parsed["elements"], parsed["presence"]), "phrase", "containers") == [("GOLD WATCH", 2)]
    assert rows(graph.promises(parsed["elements"]), "character", "matched") == [("RAVI", "I'll tell")]
    assert rows(graph.trait_mentions(parsed["presence"], parsed["elements"]), "character", "kind") == [("RAVI", "age")]
    assert graph.character_index(parsed["presence"], parsed["elements"]).where("character = 'RAVI'").first()["scene_dialogue_counts"] == {1: 1, 3: 2}


def scenes_of(spark, times):
    return spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(times)], "script_id string, scene_number int, time_of_day string")


def test_time_flip_needs_no_marker(spark):
    df = scenes_of(spark, ["NIGHT", "DAY", "CONTINUOUS", "NIGHT", "MORNING"])
    assert [r[0] for r in rows(craft.time_flips(df), "scene_number")] == [2, 5]
    assert [r[0] for r in rows(craft.time_flips(df, df.where("scene_number = 1")), "scene_number")] == [5]


def test_craft(parsed):
    lines = craft.first_lines(parsed["elements"])
    assert rows(craft.on_the_nose(lines), "speaker") == [("Old Man",)]
    pace = craft.scene_pace(parsed["elements"])
    assert all(0 <= r["pace_score"] <= 100 for r in pace.collect()) and craft.drags(pace).count() <= 4
    rules = {r["rule"] for r in craft.formatting(parsed["elements"], parsed["scenes"]).collect()}
    assert "scene_heading_missing_int_ext" in rules and "character_not_capitalized_on_first_appearance" in rules


def test_similar_voices_share_a_scene(spark):
    said = [("s", 1, i, who, "we should go home before the storm arrives") for i, who in enumerate(["A", "B"] * 3)] + [("s", 2, i, "C", "we should go home before the storm arrives") for i in range(3)]
    df = spark.createDataFrame(said, "script_id string, scene_number int, element_index int, speaker string, text string")
    shared = graph.cooccurrence(df.withColumnRenamed("speaker", "character"), ["script_id", "scene_number"], "character")
    assert rows(craft.similar_voices(craft.fingerprints(df, ["scene_number", "element_index"]), shared), "a", "b", "similarity") == [("A", "B", pytest.approx(1.0))]


def test_name_variants_equal_all_pairs(spark):
    import random

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
            line = new
        return line[-1]

    r = random.Random(3)
    names = sorted({"".join(r.choice("AB") for _ in range(r.randint(1, 7))) for _ in range(60)})

    def like(a, b):
        short, long = sorted((a, b), key=len)
        return edits(a, b) <= 2 or (len(short) >= 4 and len(long) - len(short) <= 3 and long.startswith(short))

    want = {(a, b) for a in names for b in names if a < b and like(a, b)}
    df = spark.createDataFrame([("s", n) for n in names], "script_id string, character string")
    assert set(rows(craft.name_variants(df, ["script_id"], "character"), "a", "b")) == want


def test_verification(spark, parsed):
    found = spark.createDataFrame(
        [("s1", 1, [1], "You always say that"), ("s1", 2, [2], "I'll tell you tomorrow."), ("s1", 3, [9], "You always say that"), ("s1", 4, [1], "No you"), ("s1", 5, [1], None),
         ("s1", 6, [1], "Ravi 30s unshaven stares at the golden watch"), ("s1", 7, [1], "Nothing like this was ever said"), ("s1", 8, [], "You always say that")],
        "script_id string, finding_index int, scene_refs array<int>, evidence_quote string")
    got = {r["finding_index"]: r["verification"] for r in findings.verify(found, parsed["elements"]).collect()}
    assert [got[i]["status"] for i in range(1, 9)] == ["verified", "verified", "scene_not_found", "no_quote", "no_quote", "verified", "not_found", "verified"]
    assert got[2]["matched_scene"] == 1 and got[2]["note"] and got[6]["confidence"] < 1
    assert findings.verification_summary(findings.verify(found, parsed["elements"])).first()["no_quote"] == 2


def test_edits_undo_and_alignment(spark):
    lines = spark.createDataFrame([("s", 1, i, "action", t) for i, t in enumerate(["one two three", "same", "same", "last line here"])], "script_id string, scene_number int, element_index int, type string, text string")
    edits = spark.createDataFrame([("s", 1, 1, [("same", "x"), ("one two three", "ONE"), ("last line her", "END"), ("", "y")])], "script_id string, edit_seq int, scene_number int, replacements array<struct<old:string,new:string>>")
    assert [r[0] for r in rows(drafts.apply_edits(lines, edits).orderBy("element_index"), "text")] == ["ONE", "same", "same", "END"]
    log = spark.createDataFrame([("s", 1, "edit", 1), ("s", 2, "edit", 2), ("s", 3, "undo", None), ("s", 4, "undo", None), ("s", 5, "redo", None), ("s", 6, "undo", None), ("s", 7, "edit", 3), ("s", 8, "redo", None)], "script_id string, seq int, op string, edit_seq int")
    assert [r[0] for r in rows(drafts.effective_log(log), "edit_seq")] == [3]
    new = lines.where("element_index <> 1").withColumn("text", F.upper("text"))
    assert drafts.line_alignment(lines, new, ["script_id", "scene_number"], "element_index").count() == 4


def test_drafts(parsed):
    new = {"scenes": parsed["scenes"], "elements": parsed["elements"].where("text <> 'Done.'")}
    got = dict(rows(drafts.scene_diff(parsed, new), "scene_number", "change"))
    assert got == {1: "unchanged", 2: "unchanged", 3: "changed"}


def test_profile_flips_and_gates(spark):
    say = ["be brief", "be brief", "go deeper", "go deeper", "go deeper", "go deeper"]
    turns = spark.createDataFrame([("w", i, t, False) for i, t in enumerate(say)], "writer string, seq int, text string, was_probed boolean")
    got = memory.profiles(turns).first()
    assert (got["value"], got["pos"], got["neg"]) == ("deep", 4, 2) and got["gated"]


def test_profile_stream_equals_batch(spark, tmp_path):
    say = ["be brief", "no, that won't work", "go deeper please", "okay", "be brief", "tell me straight"]
    (tmp_path / "in").mkdir()
    for i, t in enumerate(say):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"writer": "w", "seq": i, "text": t, "was_probed": False}))
    schema = "writer string, seq int, text string, was_probed boolean"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = jobs.profiles_of_stream(stream).writeStream.outputMode("update").format("memory").queryName("profiles").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    want = set(rows(memory.profiles(spark.read.schema(schema).json(str(tmp_path / "in"))), "dimension", "value", "pos", "neg"))
    assert set(rows(spark.table("profiles"), "dimension", "value", "pos", "neg")) == want


def test_watch_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fountain").write_text("INT. A - DAY\n\nBOB\nHi.\n")
    (folder / "skip.doc").write_text("x")
    seen = []
    q = jobs.watch(spark, str(folder), str(tmp_path / "done"), str(tmp_path / "cp"), lambda t, n: seen.extend(rows(t["elements"], "type")), once=True)
    q.awaitTermination(120)
    assert sorted(r[0] for r in seen) == ["character", "dialogue", "scene_heading"]


def test_stalls(spark):
    df = spark.createDataFrame([("a", "parse", "running", "", 0.0), ("a", "parse", "running", "", 100.0), ("b", "parse", "complete", "", 0.0)], "script_id string, stage string, status string, detail string, ts double")
    assert rows(jobs.stalled(df, 2000.0), "script_id") == [("a",)]


def test_model_pass_halves_failing_chunks(spark):
    class Fake:
        def __init__(self, fast):
            self.fast = fast

        def chat_json(self, system, user, schema):
            if "BAD" in user:
                raise ValueError("bad input")
            return {"findings": [{"category": "dialogue", "issue": user[:5], "severity": "low", "scene_refs": [1]}]}

    df = spark.createDataFrame([("s", i, "BAD" if i == 2 else f"text{i}", 0) for i in range(4)], "script_id string, n int, text string, chunk int")
    out = models.run_pass(df, models.PASSES["dialogue"], Fake, ["script_id", "n"], wait=0.0)
    assert out.where("error is null").count() == 2 and out.where("error is not null").count() == 1
    assert models.resolve_categories("theme, dialogue") == ["dialogue", "theme"] and len(models.resolve_categories(None)) == 12
    assert models.items('```json\n{"findings": [{"a": 1}]}```', "findings") == [{"a": 1}]


def test_reply_cleaning(spark):
    first = "The scene opens too slowly for what it has to do."
    text = f"{first} More.\n\n____\n\nWhat about it? And who is it for then?\n\n{first} Again.\n<im_end|>\nThis needs subtitles. Keep this.__"
    got = spark.createDataFrame([(text,)], "t string").select(context.cleaned_reply(F.col("t"))).first()[0]
    assert got.count("opens too slowly") == 1 and "im_end" not in got and "subtitles" not in got and not got.endswith("_")


def test_character_refs(spark):
    names = spark.createDataFrame([("s", "SIDDHARTH", [1]), ("s", "GOON_TWO", [2]), ("s", "DOCTOR", [3])], "script_id string, name string, scenes array<int>")
    texts = spark.createDataFrame([("s", 1, "what about siddhu"), ("s", 2, "the goon again"), ("s", 3, "ask the doc"), ("s", 4, "a b"), ("s", 5, "")], "script_id string, text_id int, text string")
    assert set(rows(context.character_refs(texts, names), "text_id", "name", "tier")) == {(1, "SIDDHARTH", 4), (2, "GOON_TWO", 2), (3, "DOCTOR", 3)}
    assert dict(rows(context.referenced_scenes(texts, names), "text_id", "scenes"))[2] == [2]


def test_queue_overlay_and_names(spark):
    df = spark.createDataFrame([("s", 1, "low", [1]), ("s", 2, "high", [2]), ("s", 3, "major", [])], "script_id string, finding_index int, severity string, scene_refs array<int>")
    assert [r[0] for r in rows(findings.fix_queue(df).orderBy("queue_rank"), "finding_index")] == [2, 3, 1]
    up = spark.createDataFrame([("my film.txt", 1), ("my film.md", 2), ("other.txt", 3)], "filename string, arrived int")
    assert [r[0] for r in rows(manage.unique_names(up).orderBy("arrived"), "project")] == ["my_film", "my_film_2", "other"]


def test_tracks_and_report(parsed, spark):
    index = graph.character_index(parsed["presence"], parsed["elements"])
    partners = graph.top_partners(graph.cooccurrence(parsed["presence"], ["script_id", "scene_number"], "character"), ["script_id"])
    out = tracks.character_tracks(index, graph.timeline(parsed["scenes"], parsed["elements"]), partners)
    assert rows(out.orderBy("track_rank"), "character")[0] == ("RAVI",)
    assert export.script_json(parsed).count() == 1


def test_json_sources(spark, tmp_path, parsed):
    export.script_json(parsed).select("value").coalesce(1).write.text(str(tmp_path / "j"))
    (tmp_path / "j" / "bad.txt").write_text("{not json")
    again = json_files.read_scripts(spark, str(tmp_path / "j" / "*.txt"))
    assert again["elements"].where("scene_number > 0").count() == parsed["elements"].where("scene_number > 0").count()
    (tmp_path / "r").mkdir()
    for n in "ab":
        (tmp_path / "r" / f"{n}.json").write_text(json.dumps([{"id": "same", "name": n}]))
    with pytest.raises(Exception, match="duplicate rule id"):
        json_files.read_rules(spark, str(tmp_path / "r")).collect()


def test_short_entries_are_found_in_what_was_said(spark):
    from reelframe.operators import findings

    entries = spark.createDataFrame([(1, "Brief"), (2, "two words"), (3, "没有空格的文字"), (4, "absent"), (5, "ab"), (6, "three whole words"), (7, "q😀"), (8, "x" * 50)], "item_id long, text string")
    existing = spark.createDataFrame([(1, "A brief\nnote of two words."), (2, "这里没有空格的文字。"), (3, "cab, q😀! " + "X" * 40), (4, "the three whole words here")], "seq long, text string")
    assert [r["item_id"] for r in findings.not_yet_said(entries, existing, [], "item_id", "text").collect()] == [4]
