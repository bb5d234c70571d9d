"""The durable table: replayed batches, writers that die half-way, streams that start again."""
import json

import pytest

from reelframe.sources.durable import DurableTable

SCHEMA = "script_id string, stage string, status string, ts double"


@pytest.fixture
def table(spark, tmp_path):
    return DurableTable(spark, str(tmp_path / "t"), SCHEMA, ["script_id", "stage"], 4).create()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def batch(spark, *xs):
    return spark.createDataFrame(list(xs), SCHEMA)


def test_upserts_and_replays(spark, table):
    assert rows(table.read()) == []
    assert table.apply(batch(spark, ("a", "parse", "running", 1.0), ("b", "parse", "running", 1.0), ("a", "parse", "complete", 2.0)), 0, "q", "ts")
    once = rows(table.read())
    assert once == [("a", "parse", "complete", 2.0), ("b", "parse", "running", 1.0)]
    assert not table.apply(batch(spark, ("a", "parse", "failed", 9.0)), 0, "q", "ts") and rows(table.read()) == once
    held = table.read()
    assert table.apply(batch(spark, ("a", "parse", "failed", 9.0), ("c", "chat", "pending", 3.0)), 0, "another", "ts") and table.apply(batch(spark), 1, "q")
    assert rows(table.read()) == [("a", "parse", "failed", 9.0), ("b", "parse", "running", 1.0), ("c", "chat", "pending", 3.0)]
    assert rows(held) == once
    assert table.create().manifest()[0] == 3


def test_a_writer_that_dies_before_the_swap_changes_nothing(spark, table, monkeypatch):
    table.apply(batch(spark, ("a", "parse", "running", 1.0)), 0, "q")
    once = rows(table.read())
    monkeypatch.setattr(DurableTable, "swap", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        table.apply(batch(spark, ("a", "parse", "complete", 2.0), ("z", "parse", "running", 2.0)), 1, "q")
    assert rows(table.read()) == once
    monkeypatch.undo()
    assert table.apply(batch(spark, ("a", "parse", "complete", 2.0), ("z", "parse", "running", 2.0)), 1, "q")
    assert rows(table.read()) == [("a", "parse", "complete", 2.0), ("z", "parse", "running", 2.0)]


def test_a_second_writer_of_the_same_version_fails(spark, table):
    version, live, applied = table.manifest()
    table.apply(batch(spark, ("a", "parse", "running", 1.0)), 0, "q")
    with pytest.raises(Exception, match="(?i)exists"):
        table.swap(version + 1, live, applied | {"r": 0})
    assert rows(table.read()) == [("a", "parse", "running", 1.0)]


def test_removed_rows_go(spark, tmp_path):
    notes = DurableTable(spark, str(tmp_path / "n"), "id long, text string", ["id"], 2, "removed").create()
    change = lambda *xs: spark.createDataFrame(list(xs), "id long, text string, removed boolean")
    notes.apply(change((1, "x", False), (2, "y", None), (3, "z", True)), 0, "q")
    notes.apply(change((2, None, True), (1, "x2", False)), 1, "q")
    assert rows(notes.read()) == [(1, "x2")]
    notes.apply(change((1, None, True)), 2, "q")
    assert rows(notes.read()) == []


def test_a_stream_that_starts_again_applies_each_batch_once(spark, table, tmp_path, monkeypatch):
    arrive = lambda k, xs: (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(["script_id", "stage", "status", "ts"], x))) for x in xs))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.json").json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.sink("heartbeats", "ts")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    (tmp_path / "in").mkdir()
    arrive("one", [("a", "parse", "running", 1.0), ("a", "parse", "complete", 5.0)])
    run()
    arrive("two", [("a", "parse", "running", 7.0), ("b", "parse", "running", 7.0)])
    swap = DurableTable.swap

    def dies_after(self, *a):
        swap(self, *a)
        raise RuntimeError("lost after the swap")

    monkeypatch.setattr(DurableTable, "swap", dies_after)
    with pytest.raises(Exception, match="lost after the swap"):
        run()
    monkeypatch.undo()
    version = table.manifest()[0]
    run()  # the stream does not know that its batch went through, the table does
    assert table.manifest()[0] == version == 2
    assert rows(table.read()) == [("a", "parse", "running", 7.0), ("b", "parse", "running", 7.0)]


def test_late_changes_take_nothing_back(spark, tmp_path):
    notes = DurableTable(spark, str(tmp_path / "l"), "id long, ts long, text string", ["id"], 2, "removed").create()
    change = lambda *xs: spark.createDataFrame(list(xs), "id long, ts long, text string, removed boolean")
    notes.apply(change((1, 5, "new", False), (1, 4, "old", False), (2, 5, "kept", False)), 0, "q", "ts")
    notes.apply(change((1, 3, "older", False), (2, 4, None, True)), 1, "q", "ts")
    assert rows(notes.read()) == [(1, 5, "new"), (2, 5, "kept")]
    notes.apply(change((2, 6, None, True), (3, 1, "three", None)), 2, "q", "ts")
    assert rows(notes.read()) == [(1, 5, "new"), (3, 1, "three")]
