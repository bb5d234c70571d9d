"""Queries over what changes: versioned edits, gates and retries, uploads, refreshed preferences, durable state."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drafts, findings, manage, memory
from ..sources.durable import DurableTable
from .adapters import elements, shared_folder, squeezed, table
from .registry import query
from .state import as_stream


def edited_turns(spark, d):
    """Turns as lines of a script, and a log: every third turn is edited, others undo, redo or reset, across scenes."""
    seq, turn, conv = F.col("conv_id") * 100 + F.col("turn"), F.col("turn"), F.col("conv_id")
    lines = elements(spark, d, F.concat(F.col("turn").cast("string"), F.lit(": "), squeezed(F.col("text"))))
    op = F.when((conv % 7 == 6) & (turn == 4), "reset").when(turn % 3 == 0, "edit").when((turn % 3 == 1) & (conv % 2 == 0), "undo").when((turn % 3 == 2) & (conv % 4 == 0), "redo")
    change = F.array(F.struct(F.concat(turn.cast("string"), F.lit(": "), squeezed(F.col("text"))).alias("old"), F.concat(F.lit("line "), seq.cast("string")).alias("new")))
    log = table(spark, d, "conversations").select(F.floor(conv / 10).cast("long").alias("script_id"), seq.alias("seq"), op.alias("op"), seq.alias("edit_seq"), (conv % 10 + 1).cast("int").alias("scene_number"), change.alias("replacements"))
    return lines, log.where("op is not null")


@query
def element_versions(spark, d):
    """Every text that every line has had, and between which entries of the log."""
    rows = drafts.versions(drafts.history(*edited_turns(spark, d)))
    return rows.select("script_id", "scene_number", "element_index", F.sha2("text", 256).alias("sha256"), "from_seq", "to_seq")


@query
def lines_as_of(spark, d):
    """Lines that do not read as in the draft, halfway through each script's log."""
    lines, log = edited_turns(spark, d)
    table_ = drafts.versions(drafts.history(lines, log))
    half = log.groupBy("script_id").agg(F.floor((F.min("seq") + F.max("seq")) / 2).cast("long").alias("half"))
    rows = table_.join(half, "script_id").where("(from_seq is null or from_seq <= half) and (to_seq is null or to_seq > half)")
    return rows.where("text like 'line %'").select("script_id", "scene_number", "element_index", "text")


@query
def edit_outcomes(spark, d):
    """What edits, undos and redos restored and what they could not."""
    rows = drafts.changes(drafts.history(*edited_turns(spark, d))).where("op <> 'reset'")
    return rows.groupBy("script_id", "op").agg(F.count("*").alias("n"), F.sum("restored").alias("restored"), F.sum("failed").alias("failed"))


def priorities(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("script_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("outcome"))
    return o.groupBy("script_id", "category").agg(F.min("outcome").alias("outcome"))


@query
def stage_retries(spark, d):
    """Failed priorities and, along with them, those whose results they need."""
    along = spark.createDataFrame([("2-HIGH", "1-URGENT"), ("3-MEDIUM", "2-HIGH"), ("5-LOW", "3-MEDIUM")], "category string, requires string")
    return findings.retries(priorities(spark, d), along)


@query
def draft_uploads(spark, d):
    """Finished orders as drafts, the others as uploads, which take the next names."""
    o, at = table(spark, d, "orders"), F.col("o_orderkey").cast("double")
    rows = o.select(F.col("o_custkey").alias("script_id"), F.col("o_orderkey").cast("string").alias("source_filename"), at.alias("created_at"), (F.col("o_orderstatus") == "F").alias("old"))
    none = spark.createDataFrame([], "script_id long, draft_name string, source_filename string, created_at double, active boolean")
    before = drafts.uploaded(none, rows.where("old").drop("old"))
    return drafts.uploaded(before, rows.where("not old").drop("old")).select("script_id", "draft_name", "source_filename", "active")


@query
def refresh_merges(spark, d):
    """Events as preferences held, the last of a kind, and as proposals; a proposal counts only where it is stronger."""
    k, dims = F.col("event_id"), list(memory.POLES)
    dimension = F.element_at(F.array(*map(F.lit, [*dims, "mood"])), (k % 6 + 1).cast("int"))
    pole = lambda i: F.coalesce(*[F.when(dimension == x, memory.POLES[x][i]) for x in dims], F.lit("high"))
    neutral = F.coalesce(*[F.when(dimension == x, memory.NEUTRAL[x]) for x in dims], F.lit("medium"))
    value = F.when(F.floor(k / 6) % 4 == 0, pole(0)).when(F.floor(k / 6) % 4 == 1, pole(1)).when(F.floor(k / 6) % 4 == 2, neutral).otherwise("no_evidence")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("writer"), dimension.alias("dimension"), value.alias("value"), (k * 37 % 140 / 100.0).alias("confidence"), k.alias("seq"))
    last = F.max_by(F.struct("value", "confidence", F.col("seq").alias("pos"), F.lit(1).cast("long").alias("neg")), "seq")
    held = rows.where("seq % 2 = 0").groupBy("writer", "dimension").agg(last.alias("h")).select("writer", "dimension", "h.*")
    return memory.merged_refresh(held, rows.where("seq % 2 = 1"))


@query
def durable_progress(spark, d):
    """Events as heartbeats of stages, upserted by a stream into a durable table, two files a micro-batch; one file comes twice."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("script_id"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("detail"), F.col("event_id").alias("ts"))
    stream, home = as_stream(spark, rows.repartition(5, "ts"), "progress", 2)
    state = DurableTable(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", "script_id long, stage string, detail string, ts long", ["script_id", "stage"]).create()
    sink = state.sink("heartbeats", "ts")

    def twice(batch, n):
        sink(batch, n)
        sink(batch, n)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.read()


@query
def graduated_ideas(spark, d):
    """Customers as ideas, every third of which becomes a project, with orders as their talk."""
    c = table(spark, d, "customer")
    cards = c.select(F.col("c_custkey").alias("idea_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("content"))
    talk = table(spark, d, "orders").select(F.col("o_custkey").alias("idea_id"), (F.col("o_orderkey") % 20).alias("session_id")).distinct()
    moves = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("idea_id"), (F.col("c_custkey") % 50).alias("project"))
    premises, sessions = manage.graduated(cards, talk, moves)
    return sessions.join(premises.select("idea_id", "content"), "idea_id")
