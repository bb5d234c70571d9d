"""Stateful streams against their batch twins, with late rows, restarts and scripts that fall silent."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reelframe.operators import tracks
from reelframe.streaming import jobs, stateful

T0 = datetime(2024, 5, 1, 12)
BEATS = "script_id string, stage string, status string, detail string, at timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def beats():
    """Micro-batches of heartbeats: gaps that are closed by late rows, real stalls, resumed runs, ends."""
    first = [("a", "parse", "running", "1", at(0)), ("a", "parse", "running", "2", at(10)), ("b", "theme", "running", "x", at(5)), ("c", "done", "complete", "", at(2)), ("d", "parse", "running", "", at(1))]
    second = [("a", "theme", "running", "3", at(60)), ("d", "parse", "running", "late", at(28)), ("d", "parse", "running", "", at(55))]
    third = [("a", "theme", "running", "late", at(52)), ("b", "theme", "complete", "back", at(90)), ("d", "parse", "failed", "", at(80)), (None, "parse", "running", "", at(85)), ("e", "parse", "running", None, None)]
    fourth = [("clock", "parse", "complete", "", at(200))]
    return [first, second, third, fourth]


def run(spark, make, batches, schema, home, once_each=True):
    """One file and one micro-batch after the other; the stream starts anew from its checkpoint each time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{home}/in"))
        stateful.start(stream, f"{home}/out", f"{home}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def test_alerts_equal_the_batch_twin(spark, tmp_path):
    make = lambda rows: stateful.stall_alerts(rows, 1800, "40 minutes")
    got = [tuple(r) for r in run(spark, make, beats(), BEATS, str(tmp_path)).collect()]
    every = spark.createDataFrame([x for b in beats() for x in b], BEATS)
    want = [tuple(r) for r in stateful.stalls(every, at(160), 1800).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 4
    assert ("a", "parse", "2", at(10), at(40)) in want and not any(r[0] == "d" for r in want)


def test_what_is_stalled_now_is_among_the_alerts(spark):
    every = spark.createDataFrame([x for b in beats() for x in b], BEATS)
    seconds = every.where("at is not null").withColumn("ts", F.unix_micros("at") / 1e6)
    now = seconds.where("script_id = 'clock'").first()["ts"]
    still = {r["script_id"] for r in jobs.stalled(seconds, now).collect()}
    ends = {r["script_id"] for r in stateful.stalls(every, at(200)).collect()}
    assert still == {"a", None} and still <= ends


@pytest.mark.parametrize("n", [1, 3, 40])
def test_ring_equals_the_window(spark, tmp_path, n):
    r = random.Random(2)
    rows = [(f"k{i % 3}", i, None if r.random() < 0.1 else r.random() * 100) for i in range(300)]
    schema = "key string, seq long, value double"
    make = lambda d: stateful.rolling_stream(d, "key", "seq", "value", n)
    got = run(spark, make, [rows[:7], rows[7:150], rows[150:]], schema, str(tmp_path))
    want = tracks.rolling(spark.createDataFrame(rows, schema), ["key"], "seq", "value", n)
    show = lambda d: sorted((x["key"], x["seq"], x["value"], x["rolling_n"], None if x["rolling_mean"] is None else round(x["rolling_mean"], 9)) for x in d.collect())
    assert str(show(got)) == str(show(want)) and len(rows) == got.count()
