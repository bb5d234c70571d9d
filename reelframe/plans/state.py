"""Queries over workflow state: edits, stages, names, queues, memory, metrics and model passes."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context, drafts, findings, manage, memory, models, tracks
from ..streaming import jobs, stateful
from .adapters import elements, shared_folder, squeezed, table
from .registry import injected, query


@query
def applied_edits(spark, d):
    """Every third turn is replaced by an edit that quotes it."""
    e = elements(spark, d)
    log = e.where("element_index % 3 = 0").select("script_id", F.col("element_index").alias("edit_seq"), "scene_number", F.array(F.struct(F.col("text").alias("old"), F.concat(F.lit("line "), F.col("element_index").cast("string")).alias("new"))).alias("replacements"))
    return drafts.apply_edits(e, log).select("script_id", "scene_number", "element_index", "text", "edited")


@query
def edits_in_force(spark, d):
    """Events as a log of edits, undos and redos."""
    op = F.when(F.col("event_id") % 5 < 3, "edit").when(F.col("event_id") % 5 == 3, "undo").otherwise("redo")
    log = table(spark, d, "events").select(F.col("user_id").alias("script_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 1_000_000).cast("int").alias("edit_seq"))
    return drafts.effective_log(log)


@query
def previous_drafts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("script_id"), F.col("o_orderkey").cast("string").alias("draft_name"), F.col("o_orderkey").alias("created_at"))
    return drafts.previous_draft(rows).select("script_id", "draft_name", "previous")


@query
def project_names(spark, d):
    uploads = table(spark, d, "part").select(F.concat("p_brand", F.lit(".fountain")).alias("filename"), F.col("p_partkey").alias("arrived"))
    taken = table(spark, d, "part").select(F.regexp_replace("p_brand", "#", "_").alias("b")).distinct().select(F.when(F.col("b") < "Brand_3", F.col("b")).otherwise(F.concat("b", F.lit("_3"))).alias("project"))
    return manage.unique_names(uploads, taken).select("arrived", "project")


@query
def open_stages(spark, d):
    """Requested stages that are not complete after the latest changes."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    rows = o.select(F.col("o_custkey").alias("script_id"), F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_orderkey").cast("string").alias("detail"), F.col("o_orderkey").cast("double").alias("ts"))
    even = F.col("ts") % 2 == 0
    return manage.outstanding(rows.select("script_id", "stage").distinct(), manage.set_stage(rows.where(even), rows.where(~even)))


@query
def chat_branches(spark, d):
    """A fork of one session's main branch, and another session's side branch deleted."""
    rows = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("session_id"), F.when(F.col("conv_id") % 2 == 0, "main").otherwise("side").alias("branch"), "text")
    out = manage.delete_branch(manage.fork(rows, 1, "main", "fork"), 2, "side")
    return out.groupBy("session_id", "branch").agg(F.count("*").alias("messages"))


@query
def note_upserts(spark, d):
    """Labels as notes: every third is changed, every fifth removed."""
    notes = table(spark, d, "labels").select("doc_id", "quality")
    changes = notes.where("doc_id % 3 = 0 or doc_id % 5 = 0").select("doc_id", (F.col("quality") + 10).cast(dict(notes.dtypes)["quality"]).alias("quality"), (F.col("doc_id") % 5 == 0).alias("removed"))
    return manage.upsert(notes, changes, ["doc_id"], "removed")


@query
def chat_titles(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("\n# "), F.col("text")).alias("text"))
    return rows.select("conv_id", "turn", manage.auto_title("text").alias("title"))


@query
def rebuilds(spark, d):
    """Scripts whose parse is newer than their working copy."""
    o = table(spark, d, "orders")
    working = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("script_id")).agg(F.max("o_orderkey").alias("ts"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("edits"))
    parsed = o.groupBy(F.col("o_custkey").alias("script_id")).agg(F.max("o_orderkey").alias("ts"))
    return manage.needs_rebuild(working, parsed)


@query
def stalled_scripts(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("script_id"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("done").alias("status"), F.lit("").alias("detail"), F.col("event_id").cast("double").alias("ts"))
    return jobs.stalled(rows, 1e12).select("script_id", "stage", "ts")


def as_stream(spark, rows, name, files=None):
    """(a stream over the rows, staged as Parquet, a folder for what it writes). files: how many a micro-batch takes at most."""
    home = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{home}/in")
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{home}/in"), home


@query
def stall_alerts(spark, d):
    """Events as heartbeats through the stream that tells stalls of a day and more; all that the watermark has passed."""
    status = F.when(F.col("event_id") % 3 == 0, "complete").otherwise("running")
    beats = table(spark, d, "events").select(F.col("user_id").alias("script_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("event_id").cast("string").alias("detail"), F.col("ts").cast("timestamp").alias("at"))
    stream, home = as_stream(spark, beats, "stalls")
    alerts = stateful.stall_alerts(stream, 86_400, "2 hours")
    stateful.start(alerts, f"{home}/out", f"{home}/checkpoint", once=True).awaitTermination()
    found = spark.read.schema(alerts.schema).parquet(f"{home}/out")
    return found.select("script_id", "stage", "detail", F.unix_micros("last_at").alias("last_us"), F.unix_micros("stalled_at").alias("stalled_us"))


@query
def rolling_replies(spark, d):
    """Events as timings through the stream that keeps each user's last forty."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("value") * 100).cast("double").alias("cents"))
    stream, home = as_stream(spark, rows, "rolling")
    means = stateful.rolling_stream(stream, "user_id", "us", "cents", tracks.RING)
    stateful.start(means, f"{home}/out", f"{home}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(means.schema).parquet(f"{home}/out").select("event_id", "rolling_mean", "rolling_n")


@query
def stage_progress(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("script_id"), F.col("l_linenumber").alias("stage_order"), F.col("l_quantity").cast("long").alias("weight"), F.when(F.col("l_returnflag") == "R", "complete").otherwise("running").alias("status"), (F.col("l_linenumber") * 60).cast("long").alias("elapsed"))
    return tracks.eta(tracks.progress(rows)).select("script_id", F.col("stage_order").cast("long").alias("stage_order"), "done_pct", "eta")


@query
def writer_topics(spark, d):
    turns = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("writer"), injected(["the protagonist", "a slow midpoint", "more banter"]).alias("text"))
    return memory.topics(turns)


@query
def refreshes_due(spark, d):
    turns = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("writer"), F.col("conv_id"))
    before = turns.where("conv_id % 10 = 0").groupBy("writer").agg(F.count("*").alias("turns_then"))
    return memory.refresh_due(turns, before)


@query
def novel_observations(spark, d):
    o = table(spark, d, "orders")
    asked = o.select(F.col("o_custkey").alias("writer"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("text"))
    known = o.where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("writer"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("text"))
    return memory.novel(asked, known).select("writer", "seq", "text")


@query
def scoped_observations(spark, d):
    """Turns that name a nation belong to that nation's region."""
    nation = table(spark, d, "nation")
    rows = table(spark, d, "conversations").withColumn("n_nationkey", F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(40))).join(nation.select("n_nationkey", "n_name"), "n_nationkey", "left")
    rows = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.regexp_replace("text", "[A-Z]", "x"), F.lit(" "), F.coalesce(F.lower("n_name"), F.lit("nowhere")), F.lit(".")).alias("text"))
    names = nation.join(table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey").select(F.col("n_name").alias("name"), F.col("r_name").alias("project"), F.col("n_nationkey").alias("dir_order"))
    return memory.scoped(rows, names).select("id", "scope")


@query
def visible_observations(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("writer"), F.when(F.col("o_orderkey") % 3 == 0, "general").otherwise(F.col("o_orderpriority")).alias("dimension"), F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"), (F.col("o_orderkey") % 4 == 0).alias("suppressed"), F.when(F.col("o_orderkey") % 2 == 0, "p").alias("scope"))
    gates = rows.select("writer", "dimension").distinct().withColumn("gated", F.col("dimension") == "1-URGENT")
    return memory.visible_observations(rows, gates, None).select("writer", "seq")


@query
def open_ledger(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "dangling").when(F.col("o_orderstatus") == "O", "paid").otherwise("other")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("script_id"), F.col("o_orderkey").alias("entry_index"), status.alias("status"))
    return findings.ledger(rows).select("script_id", "entry_index", "status", F.col("queue_rank").cast("long").alias("queue_rank"))


@query
def judgment_candidates(spark, d):
    e = table(spark, d, "events")
    props = e.groupBy(F.col("user_id").alias("script_id"), F.col("event_type").alias("phrase")).agg(F.count("*").alias("mentions"))
    promises = e.select(F.col("user_id").alias("script_id"), (F.col("event_id") % 50).cast("int").alias("scene_number"), F.col("event_id").alias("element_index"), F.col("event_id").cast("string").alias("text"))
    return findings.candidates(props, promises).select("script_id", "label", F.col("queue_rank").cast("long").alias("queue_rank"))


@query
def categories(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("script_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("finding_index"), F.col("o_orderstatus").alias("issue"))
    out = findings.by_category(rows)
    return out.select("script_id", "category", F.array_join(F.transform("findings", lambda f: f["finding_index"].cast("string")), ",").alias("findings"))


@query
def gated_outcomes(spark, d):
    """Categories fail where the one they need failed; then the script's outcome."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("script_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("outcome"))
    rows = o.groupBy("script_id", "category").agg(F.min("outcome").alias("outcome"))
    needs = spark.createDataFrame([("2-HIGH", "1-URGENT"), ("3-MEDIUM", "2-HIGH")], "category string, requires string")
    return findings.outcome(findings.close_gates(rows, needs)).select("script_id", "n", "failed", "result")


@query
def nudged_replies(spark, d):
    rows = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.when(F.col("turn") % 2 == 0, "Fine. ").otherwise(F.col("text")).alias("text"))
    return context.nudged(rows, ["What then?", "And now?"], "seq").select("session_id", "seq", "text")


@query
def bullets(spark, d):
    """Replies of a bullet a word, cut after three."""
    listed = F.concat(F.lit("- "), F.regexp_replace(squeezed(F.col("text")), " ", "\n- "))
    rows = table(spark, d, "conversations").select("conv_id", "turn", context.capped_bullets(listed, 3, " (more)").alias("text"))
    return rows.select("conv_id", "turn", "text")


class EchoClient:
    """Stands in for a model: one finding a text, with its length as the issue; it refuses more than two texts at once."""

    def chat_json(self, system: str, user: str, schema: str):
        texts = user.split("\n\n")
        if len(texts) > 2:
            raise ValueError("too long")
        return {"findings": [{"issue": str(len(t)), "severity": "low"} for t in texts]}


@query
def model_passes(spark, d):
    """Passes through a stand-in client: five turns a chunk, halved until they fit, findings counted."""
    rows = elements(spark, d).select("script_id", "scene_number", "element_index", squeezed(F.col("text")).alias("text")).withColumn("chunk", F.col("scene_number") * 1000 + F.floor(F.col("element_index") / 5))
    out = None
    for name in ("dialogue", "theme", "genre"):
        answers = models.run_pass(rows, models.PASSES[name], lambda fast: EchoClient(), ["script_id", "scene_number", "element_index"])
        counted = answers.groupBy("script_id").agg(F.count("answer").alias("findings"), F.count("error").alias("errors"), F.sum(F.col("answer.issue").cast("long")).alias("characters"))
        counted = counted.select("script_id", F.lit(name).alias("pass"), "findings", "errors", "characters")
        out = counted if out is None else out.unionByName(counted)
    return out


@query
def trait_dials(spark, d):
    trait = F.struct(F.concat(F.lit(" "), F.col("l_returnflag")).alias("trait"), (F.col("l_quantity").cast("int") - 10).alias("score"), F.array("l_linenumber").alias("scene_refs"), F.col("l_linestatus").alias("note"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("script_id"), F.struct(F.when(F.col("l_linenumber") == 1, " ").otherwise(F.col("l_linestatus")).alias("character"), F.array(trait).alias("traits")).alias("answer"))
    return models.clean_dials(rows).groupBy("script_id", "character", "trait", "score").agg(F.count("*").alias("n"))


@query
def principle_findings(spark, d):
    answer = F.struct((F.col("o_orderkey") % 2 == 0).alias("significant"), (F.col("o_orderstatus") == "F").alias("paid_off"), F.col("o_orderpriority").alias("issue"), F.lit("").alias("why_it_matters"), F.array().cast("array<int>").alias("scene_refs"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("script_id"), answer.alias("answer"))
    return models.principle_findings(rows).groupBy("script_id", "category", "severity", "issue").agg(F.count("*").alias("n"))


@query
def shown_items(spark, d):
    """Orders as open, important items with a text."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "main").otherwise("bit").alias("importance"), (F.col("o_orderkey") % 3 == 0).alias("suppressed"), F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("text"))
    return manage.with_text(manage.shown(rows, "open", "main")).select("o_orderkey")
