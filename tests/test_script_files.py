"""The data source of script files: batch, stream and writer over mixed, bad and odd files."""
import pytest

from reelframe.sources import script_files
from reelframe.sources.screenplay import parse_all

FOUNTAIN = "INT. A - DAY\n\nBOB\nHi.\n"
FDX = '<?xml version="1.0"?><FinalDraft Version="1"><Content><Paragraph Type="Scene Heading"><Text>INT. HALL - DAY</Text></Paragraph><Paragraph Type="Character"><Text>ANNA</Text></Paragraph><Paragraph Type="Dialogue"><Text>Here.</Text></Paragraph></Content></FinalDraft>'


@pytest.fixture
def folder(spark, tmp_path):
    script_files.register(spark)
    home = tmp_path / "in"
    (home / "deeper").mkdir(parents=True)
    (home / "a.fountain").write_text(FOUNTAIN)
    (home / "deeper" / "B.FDX").write_text(FDX)
    (home / "bad.fdx").write_text("not xml at all")
    (home / "bytes.txt").write_bytes(b"\xff\xfe\x00")
    (home / "empty.md").write_text("")
    (home / "scan.pdf").write_bytes(b"%PDF")
    (home / "noextension").write_text("x")
    (home / ".hidden.fountain").write_text(FOUNTAIN)
    (home / "_temporary").mkdir()
    (home / "_temporary" / "c.fountain").write_text(FOUNTAIN)
    return home


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_batch_reads_every_file_and_names_what_is_wrong(spark, folder):
    df = spark.read.format("scripts").load(str(folder))
    assert rows(df, "source_filename", "source_format", "text") == sorted(
        [("a.fountain", "fountain", FOUNTAIN), ("B.FDX", "fdx", FDX), ("bad.fdx", "fdx", None), ("bytes.txt", "txt", None), ("empty.md", "md", ""), ("scan.pdf", "pdf", None), ("noextension", None, None)], key=str
    )
    wrong = {r["source_filename"]: r["error"] for r in script_files.problems(df).collect()}
    assert set(wrong) == {"bad.fdx", "bytes.txt", "scan.pdf", "noextension"} and wrong["bytes.txt"].startswith("UnicodeDecodeError") and wrong["bad.fdx"] == "not a Final Draft document"
    said = parse_all(script_files.readable(df))["elements"].where("type = 'dialogue'")
    assert rows(said, "text", "character") == [("Here.", "ANNA"), ("Hi.", "BOB")]


def test_formats_leave_other_files_closed_and_small_files_share_a_task(spark, folder):
    some = spark.read.format("scripts").option("formats", "fdx, md").load(str(folder))
    assert rows(some, "source_filename") == [("B.FDX",), ("bad.fdx",), ("empty.md",)]
    assert spark.read.format("scripts").load(str(folder)).rdd.getNumPartitions() == 1
    each = spark.read.format("scripts").option("partitionBytes", 1).load(str(folder))
    assert each.rdd.getNumPartitions() > 3 and each.count() == 7
    assert rows(spark.read.format("scripts").load(f"file://{folder}/a.fountain"), "source_filename") == [("a.fountain",)]


def test_files_read_once_are_there_when_they_are_gone(spark, folder, tmp_path):
    kept = script_files.read_once(spark, str(folder), str(tmp_path / "kept"), formats="fountain")
    (folder / "a.fountain").unlink()
    assert rows(kept, "source_filename", "text") == [("a.fountain", FOUNTAIN)]


def test_an_empty_folder_gives_no_rows_and_a_missing_one_fails(spark, folder, tmp_path):
    (tmp_path / "none").mkdir()
    assert spark.read.format("scripts").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("scripts").load(str(tmp_path / "absent")).count()


def streamed(spark, folder, home, out):
    source = spark.readStream.format("scripts").option("log", f"{home}/log").load(str(folder))
    source.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.parquet(out), *source.columns)


def test_the_stream_reads_what_the_batch_reads_once_each_over_restarts(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    everything = lambda: rows(spark.read.format("scripts").load(str(folder)), "script_id", "source_format", "source_filename", "text", "error")
    assert streamed(spark, folder, tmp_path, out) == everything()
    assert streamed(spark, folder, tmp_path, out) == everything()
    import os

    (folder / "late.txt").write_text("INT. B - DAY\n")
    os.utime(folder / "late.txt", (1, 1))  # a file that is moved in may be older than what was read
    assert streamed(spark, folder, tmp_path, out) == everything()


def test_a_listing_that_was_not_taken_is_read_after_a_restart(spark, folder, tmp_path):
    options = {"path": str(folder), "log": str(tmp_path / "log")}
    lost = script_files.ScriptStream(options)
    assert lost.latestOffset() == {"listing": 1}  # dies here
    (folder / "late.txt").write_text("x")
    again = script_files.ScriptStream(options)
    end = again.latestOffset()
    names = lambda start, stop: sorted(p.rsplit("/", 1)[1] for part in again.partitions({"listing": start}, {"listing": stop}) for p in part.paths)
    assert end == {"listing": 2} and names(1, 2) == ["late.txt"] and len(names(0, 2)) == 8 == len(set(names(0, 2)))
    assert again.latestOffset() == end


def test_writer_round_trip_and_replaced_files(spark, folder, tmp_path):
    home = str(tmp_path / "written")
    texts = script_files.readable(spark.read.format("scripts").load(str(folder)))
    texts.select("source_filename", "text").write.format("scripts").mode("append").save(home)
    back = spark.read.format("scripts").load(home)
    assert rows(back, "source_filename", "text") == rows(texts, "source_filename", "text")
    spark.createDataFrame([("a.fountain", None)], "source_filename string, text string").write.format("scripts").mode("append").save(home)
    assert ("a.fountain", "") in rows(spark.read.format("scripts").load(home), "source_filename", "text") and back.count() == 3
    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame([("../out.txt", "x")], "source_filename string, text string").write.format("scripts").mode("append").save(home)
