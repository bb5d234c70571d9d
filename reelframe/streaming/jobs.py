"""Structured Streaming jobs: watch folder, heartbeats, rolling metrics, writer profiles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.memory import stream_profiles
from ..sources.screenplay import file_format, parse_all, unreadable_fdx

STALL_SECONDS, POLL = 1800, "5 seconds"


def watch(spark: SparkSession, folder: str, archive: str, checkpoint: str, handle: Callable[[dict[str, DataFrame], int], None], once: bool = False, quarantine: str | None = None):
    """Parses screenplays as they arrive, text formats and Final Draft files; consumed files move to the archive. Unsupported and
    hidden ones stay.

    handle gets the tables of each micro-batch. once: takes what is there and ends. quarantine: a folder for scripts that cannot
    be read, and for those of a micro-batch that fails, as Parquet with the error, one folder a micro-batch, so that a batch that
    comes again replaces what it wrote; the stream goes on. Without it a failure ends the stream.
    """

    def aside(scripts: DataFrame, n: int, kind: str, error: str) -> None:
        scripts.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{quarantine}/batch={n}/kind={kind}")

    def taken(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        try:
            if quarantine is not None:
                bad = kept.where(unreadable_fdx())
                if not bad.isEmpty():
                    aside(bad, n, "unreadable", "not a Final Draft document")
                handle(parse_all(kept.where(~unreadable_fdx())), n)
            else:
                handle(parse_all(kept), n)
        except Exception as error:
            if quarantine is None:
                raise
            aside(kept, n, "failed", f"{type(error).__name__}: {error}")
        finally:
            kept.unpersist()

    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "[!.]*.{fountain,txt,md,fdx}").option("cleanSource", "archive").option("sourceArchiveDir", archive).load(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    texts = files.select(F.col("_metadata.file_path").alias("script_id"), name.alias("source_filename"), F.col("value").alias("text"))
    texts = texts.withColumn("source_format", file_format(F.col("source_filename")))
    trigger = {"availableNow": True} if once else {"processingTime": POLL}
    return texts.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_progress(events: DataFrame) -> DataFrame:
    """(script_id, stage, status, detail, ts): the last heartbeat of each script, of several at one time the greatest; works on
    streams too."""
    last = events.groupBy("script_id").agg(F.max(F.struct("ts", "stage", "status", "detail")).alias("p"))
    return last.select("script_id", "p.stage", "p.status", "p.detail", "p.ts")


def stalled(events: DataFrame, now: float, after: float = STALL_SECONDS) -> DataFrame:
    """Scripts still running whose last heartbeat is older than `after` seconds."""
    return latest_progress(events).where((F.col("status") == "running") & (F.lit(now) - F.col("ts") > after))


def sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int = STALL_SECONDS) -> DataFrame:
    """(keys, session_no, started, ended, n): the batch twin; a gap of gap_seconds or more starts a session."""
    by = Window.partitionBy(*keys).orderBy(ts)
    fresh = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(by))) >= gap_seconds * 1_000_000, F.lit(True))
    rows = events.withColumn("fresh", fresh.cast("int")).withColumn("session_no", F.sum("fresh").over(by))
    return rows.groupBy(*keys, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def profiles_of_stream(turns: DataFrame):
    return stream_profiles(turns)
