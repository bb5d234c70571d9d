from pyspark.sql import functions as F

from reelframe.functions import lines as L
from reelframe.sources import export, screenplay


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def elements(parsed, scene):
    return rows(parsed["elements"].where(f"scene_number = {scene}").orderBy("element_index"), "type", "text", "character")


def test_scenes(parsed):
    found = rows(parsed["scenes"].orderBy("scene_number"), "scene_number", "int_ext", "location", "time_of_day")
    assert found == [(1, "INT", "KITCHEN", "NIGHT"), (2, "EXT", "STREET", "DAY"), (3, None, "THE ROOF", None)]


def test_title_page(parsed):
    assert rows(parsed["scripts"], "title", "author", "parse_confidence") == [("The Long Wait", "A. Writer", "medium")]


def test_dialogue_blocks(parsed):
    assert elements(parsed, 1)[2:] == [
        ("character", "RAVI", "RAVI"), ("parenthetical", "(softly)", "RAVI"), ("dialogue", "I'll tell you tomorrow.", "RAVI"),
        ("character", "MEERA (O.S.)", "MEERA"), ("dialogue", "You always say that?", "MEERA"), ("dialogue", "No you don't.", "MEERA"), ("transition", "CUT TO:", None),
    ]


def test_forced_syntax_markers_and_closing(parsed):
    assert elements(parsed, 2)[2:] == [("character", "Old Man", "Old Man"), ("dialogue", "I am so tired.", "Old Man"), ("transition", "TWO DAYS LATER", None)]
    assert elements(parsed, 3) == [
        ("scene_heading", "THE ROOF", None), ("shot", "ANGLE ON the sky.", None), ("character", "RAVI", "RAVI"), ("dialogue", "la la", "RAVI"),
        ("dialogue", "Done.", "RAVI"), ("transition", "FADE OUT.", None), ("transition", "THE END", None),
    ]


def test_round_trip_of_all_formats(spark, parsed):
    want = rows(parsed["elements"].where("scene_number <> 3").orderBy("scene_number", "element_index"), "scene_number", "type", "text", "character")
    for form, parse in (("fountain", screenplay.parse), ("fdx", screenplay.parse_fdx)):
        text = export.export(parsed["elements"].where("scene_number <> 3"), parsed["scripts"], form).withColumn("source_format", F.lit(form)).withColumn("source_filename", F.lit("x"))
        again = parse(text)
        got = rows(again["elements"].orderBy("scene_number", "element_index"), "scene_number", "type", "text", "character")
        # a mixed-case cue was forced, and export writes the cue's text alone
        assert [g for g in got if "Old Man" not in str(g) and "tired" not in str(g)] == [w for w in want if "Old Man" not in str(w) and "tired" not in str(w)]
        assert rows(again["scripts"], "title", "author") == [("The Long Wait", "A. Writer")]


def test_native_script_cues_and_headings(spark):
    text = "इंट. घर - रात\n\nराहुल\nनमस्ते दोस्त कैसे हो।\n\nराहुल और पुलिस\n\nराहुल\nहाँ।\n"
    df = spark.createDataFrame([("n", "txt", "n.txt", text)], "script_id string, source_format string, source_filename string, text string")
    out = screenplay.parse(df)
    assert rows(out["scenes"], "int_ext", "location") == [("INT", "घर")]
    assert [r[0] for r in rows(out["elements"].orderBy("element_index"), "type")][:3] == ["scene_heading", "character", "dialogue"]


def test_no_headings_is_low_confidence(spark):
    df = spark.createDataFrame([("n", "txt", "n.txt", "just prose\n\nand more"), ("e", "txt", "e.txt", "")], "script_id string, source_format string, source_filename string, text string")
    out = screenplay.parse(df)
    assert {r[0] for r in rows(out["scripts"], "parse_confidence")} == {"low"}
    assert {r[0] for r in rows(out["warnings"], "severity")} == {"error"}


def test_line_functions(spark):
    df = spark.createDataFrame([("GOON_ONE (V.O.)",), ("DDOOCC",), ("SMASH CUT TO:",), ("JOSÉ",), ("He said.",)], "s string")
    got = rows(df, L.speaker_name(F.col("s")), L.undoubled(F.col("s")), L.is_transition(F.col("s")), L.is_cue(F.col("s")))
    assert got[0] == ("GOON ONE", "GOON_ONE (V.O.)", False, True)
    assert got[1][1] == "DOC" and got[2][2] and got[3][3] and not got[4][3]


def test_pdf_boxes(spark):
    boxes = [("p", 1, 10.0, 20.0, 10.0, 100.0, "INT. HALL - DAY"), ("p", 1, 22.0, 32.0, 10.0, 100.0, "A long hall."), ("p", 1, 34.0, 44.0, 10.0, 100.0, "Dark."),
             ("p", 1, 60.0, 70.0, 40.0, 100.0, "RAVI"), ("p", 1, 72.0, 82.0, 25.0, 100.0, "Hello there."), ("p", 1, 84.0, 94.0, 10.0, 100.0, "He leaves."), ("p", 1, 96.0, 100.0, 50.0, 100.0, "1.")]
    df = spark.createDataFrame(boxes, "script_id string, page int, top double, bottom double, x0 double, page_width double, text string")
    out = screenplay.parse_pdf(df)
    assert rows(out["elements"].orderBy("element_index"), "type", "text") == [
        ("scene_heading", "INT. HALL - DAY"), ("action", "A long hall."), ("action", "Dark."), ("character", "RAVI"), ("dialogue", "Hello there."), ("action", "He leaves.")]


def test_unreadable(spark):
    lines = [("a", "(cid:3)(cid:4)"), ("a", "/12 34"), ("a", "(cid:9)"), ("b", "words"), ("b", "(cid:1)"), ("c", " "), ("d", "/1 2"), ("d", "3 4")]
    df = spark.createDataFrame(lines, "script_id string, raw string")
    assert {r[0] for r in rows(screenplay.unreadable(df), "script_id")} == {"a", "c", "d"}
