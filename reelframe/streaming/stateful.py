"""Stateful stream operators with timers: stall alerts, and a ring of the last values of a key.

Both keep a bounded state a script or key and give the rows that their batch twins give, however the input is cut into micro-batches.
They need a state store with timers: start() sets RocksDB's for the session it runs in.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .jobs import STALL_SECONDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEAT, STALL = ["stage", "status", "detail"], "script_id string, stage string, detail string, last_us long, stalled_us long"


def start(rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Appends a stateful stream's rows to a Parquet folder. once: takes what is there and ends."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    trigger = {"availableNow": True} if once else {"processingTime": "5 seconds"}
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stall_watch(after: float):
    """Heartbeats of a bucket of scripts. Those that the watermark has not passed wait, so that late ones find their place; the
    others have been gone through in order. One timer a bucket: for the first that waits, or for the first stall of a last one.
    Of a script that does not run, or whose stall has been told, nothing is kept.

    A call costs milliseconds, whatever it holds, so a script has none of its own.
    """
    after = int(after * 1_000_000)

    def passed(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Goes through what the watermark has passed; gives the stalls that have come to light."""
        scripts = {s: (last, waiting) for s, last, waiting in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            for pdf in batches:
                for script, *beat in zip(*(pdf[c].tolist() for c in ["script_id", "us", *BEAT])):
                    scripts.setdefault(script, (None, []))[1].append(beat)
        mark = state.getCurrentWatermarkMs() * 1000
        out, kept, due = [], [], []
        for script, (last, waiting) in scripts.items():
            waiting.sort(key=lambda x: (x[0], *((v is not None, v or "") for v in x[1:])))
            settled = sum(x[0] <= mark for x in waiting)
            # the end of the last one's silence: the next that is settled, or the watermark
            for beat in [*waiting[:settled], [mark]]:
                if last and last[2] == "running" and beat[0] - last[0] > after:
                    out.append((script, last[1], last[3], last[0], last[0] + after))
                    last = None
                last = beat if len(beat) > 1 else last
            waiting, last = waiting[settled:], last if last and last[2] == "running" else None
            if waiting or last:
                kept.append((script, last, waiting))
                # the timer rings once the watermark is past it: one before the first millisecond that settles something
                due.append(-(-waiting[0][0] // 1000) - 1 if waiting else (last[0] + after) // 1000)
                if waiting and last:
                    due.append((last[0] + after) // 1000)
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(due), mark // 1000, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["script_id", "stage", "detail", "last_us", "stalled_us"])

    return passed


def stall_alerts(beats: DataFrame, after: float = STALL_SECONDS, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """(script_id, stage, detail, last_at, stalled_at): a stream's stalls, each told once, when the watermark has passed it.

    beats: a stream of (script_id, stage, status, detail, at timestamp). A script stalls where its last heartbeat says running and
    none follows within `after` seconds. Heartbeats up to `late` behind the newest one count in their order. Scripts are dealt
    over `buckets`, a number that must stay as long as the checkpoint does; ids are of a kind that can be cast to string and back.
    """
    kind = dict(beats.dtypes)["script_id"]
    rows = beats.where("at is not null").select(F.pmod(F.xxhash64("script_id"), F.lit(buckets)).alias("bucket"), F.col("script_id").cast("string"), *BEAT, "at", F.unix_micros("at").alias("us"))
    told = rows.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(stall_watch(after), STALL, "scripts string", "Append", "EventTimeTimeout")
    return told.select(F.col("script_id").cast(kind), "stage", "detail", F.timestamp_micros("last_us").alias("last_at"), F.timestamp_micros("stalled_us").alias("stalled_at"))


def stalls(beats: DataFrame, now, after: float = STALL_SECONDS) -> DataFrame:
    """The batch twin: all stalls up to the time `now`. Heartbeats at one time follow each other by stage, status and detail."""
    order = Window.partitionBy("script_id").orderBy("at", *BEAT)
    rows = beats.where("at is not null").withColumn("next_", F.least(F.lead("at").over(order), F.lit(now).cast("timestamp")))
    stalled_at = F.timestamp_micros(F.unix_micros("at") + F.lit(int(after * 1_000_000)))
    return rows.where("status = 'running'").where(F.col("next_") > stalled_at).select("script_id", "stage", "detail", F.col("at").alias("last_at"), stalled_at.alias("stalled_at"))


class Ring(StatefulProcessor):
    """The last n values of a key, the oldest first; nulls take a place but do not count."""

    def __init__(self, n: int, order: str, value: str, columns: list[str]):
        self.n, self.order, self.value, self.columns = n, order, value, columns

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        values = [x[0] for x in self.ring.get()] if self.ring.exists() else []
        means, counts = [], []
        for v in pdf[self.value]:
            values = [*values[-(self.n - 1):], None if pd.isna(v) else float(v)] if self.n > 1 else [None if pd.isna(v) else float(v)]
            total, known = 0.0, 0
            for x in values:
                if x is not None and x == x:
                    total, known = total + x, known + 1
            means.append(total / known if known else None)
            counts.append(known)
        self.ring.put([(x,) for x in values])
        yield pdf[self.columns].assign(rolling_mean=pd.Series(means, index=pdf.index, dtype="float64"), rolling_n=counts)

    def close(self) -> None:
        pass


def rolling_stream(rows: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """tracks.rolling() for a stream: each row with the mean of the last n values of its key, and how many they are.

    Rows of a key must arrive in order from batch to batch; within one they are sorted. The state of a key is n numbers.
    """
    columns = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(key).transformWithStateInPandas(Ring(n, order, value, columns), f"{kinds}, rolling_mean double, rolling_n long", "Append", "None")
