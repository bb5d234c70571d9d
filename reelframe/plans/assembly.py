"""Queries over what passes, chat turns and reports are put together from."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, models
from ..sources import export
from .adapters import elements, presence, squeezed, table
from .registry import query


@query
def ledger_inputs(spark, d):
    """Events as summaries, and their kinds as objects; every tenth is a promise."""
    e = table(spark, d, "events").select(F.col("user_id").alias("script_id"), "event_id", "event_type")
    props = e.groupBy("script_id", F.col("event_type").alias("phrase")).agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set((F.col("event_id") % 20).cast("int"))).alias("scenes"))
    promises = e.where("event_id % 10 = 0").select("script_id", (F.col("event_id") % 50).cast("int").alias("scene_number"), F.col("event_id").alias("element_index"), F.upper("event_type").alias("character"), F.concat(F.lit(" I will "), F.col("event_id").cast("string")).alias("text"))
    summaries = e.select("script_id", F.col("event_id").alias("scene_number"), F.col("event_type").alias("summary"))
    seeds = models.seeds(props.where("script_id % 3 <> 0"), promises.where("script_id % 3 <> 0"))
    return models.ledger_input(models.overviews(summaries), seeds)


@query
def ledger_entries(spark, d):
    """Order lines as answers of the ledger's pass."""
    status = F.when(F.col("l_returnflag") == "R", "paid").when(F.col("l_returnflag") == "A", "abandoned").otherwise("unheard of")
    answer = F.struct(
        F.when(F.col("l_linenumber") == 1, " ").otherwise(F.concat(F.lit(" line "), F.col("l_linenumber").cast("string"))).alias("setup"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("kind"),
        F.array(F.col("l_linenumber").cast("int")).alias("setup_scenes"), F.when(F.col("l_linestatus") == "O", F.array(F.col("l_quantity").cast("int"))).alias("payoff_scenes"), status.alias("status"), F.col("l_linestatus").alias("note"))
    rows = models.ledger_entries(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("script_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("item_index"), answer.alias("answer")))
    return rows.select("script_id", "entry_index", "setup", "kind", F.try_element_at("payoff_scenes", F.lit(1)).alias("payoff"), "status", "note", F.col("queue_rank").cast("long").alias("queue_rank"))


class ReaderClient:
    """Stands in for a model: reads each character it is asked about with the overview's first line as its quote; it
    misplaces those of users."""

    def __init__(self, fast: bool):
        self.fast = fast

    def chat_json(self, system: str, user: str, schema: str):
        overview, names = user.split("\n\nCharacters: ")
        scene, quote = overview.split("\n")[0].removeprefix("Scene ").split(": ", 1)
        return {"reads": [{"character": n, "how_reads": "plain", "evidence_quote": quote, "scene_refs": [9999 if n == "USER" else int(scene)]} for n in names.split(", ")]}


@query
def verified_reads(spark, d):
    """Reads of each script's leading cast through a stand-in client, their quotes looked up in the script."""
    e = elements(spark, d, F.concat(F.lit("so here it is "), squeezed(F.col("text"))))
    first = e.groupBy("script_id", "scene_number").agg(F.min_by("text", "element_index").alias("summary"))
    asked = models.reads_input(models.overviews(first), context.leading_cast(presence(spark, d), 8))
    answers = models.run_pass(asked, models.PASSES["reads"], ReaderClient, ["script_id"])
    out = models.verified_reads(answers, e)
    return out.select("script_id", "character", F.col("verification.status").alias("status"), F.col("verification.matched_scene").alias("matched_scene"))


def customer_coverage(spark, d):
    """Customers as scripts; the answers of their coverage, of which the second does not count."""
    c = table(spark, d, "customer")
    told, first = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" A story of "), F.lower("c_mktsegment"))), F.col("item_index") == 1
    answer = F.struct(F.when(first, told).otherwise("other").alias("logline"), F.when(first, F.lower("c_mktsegment")).otherwise("other").alias("genre"))
    rows = c.withColumn("item_index", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.col("c_custkey").alias("script_id"), "item_index", answer.alias("answer"))
    summaries = c.select(F.col("c_custkey").alias("script_id"), F.lit(1).alias("scene_number"), F.col("c_mktsegment").alias("summary"))
    return models.coverage_of(rows), models.overviews(summaries)


@query
def logline_inputs(spark, d):
    return models.logline_input(*customer_coverage(spark, d))


@query
def genre_inputs(spark, d):
    """Every market segment but one has conventions of its own."""
    known = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.lower("c_mktsegment").alias("genre"), F.lit(0).alias("order"), F.concat(F.lit("keep "), "c_mktsegment").alias("conventions")).distinct()
    return models.genre_input(*customer_coverage(spark, d), known, "building")


def order_findings(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "not_found").otherwise("verified")
    refs = F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((k % 20).cast("int"), F.lit(30)))
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("script_id"), k.alias("finding_index"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("issue"), F.when(k % 2 == 0, "it shows").alias("why_it_matters"),
        F.lit("low").alias("severity"), refs.alias("scene_refs"), F.when(k % 5 == 0, "").otherwise(k.cast("string")).alias("evidence_quote"), F.struct(state.alias("status")).alias("verification"))


def full_coverage(spark, d):
    c, m = table(spark, d, "customer").where("c_custkey % 3 = 0"), F.col("c_mktsegment")
    return c.select(F.col("c_custkey").alias("script_id"), F.lit("pass").alias("recommendation"), m.alias("logline"), F.lower(m).alias("genre"), F.when(F.col("c_custkey") % 2 == 0, "dry").alias("tone"),
                    F.lit("").alias("synopsis"), F.array(m, F.lit("wit")).alias("strengths"), F.lit(None).cast("array<string>").alias("weaknesses"))


@query
def report_summaries(spark, d):
    """Orders as the findings of their customer's script; those that are done also as notes on formatting."""
    notes = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("script_id"), F.col("o_orderkey").alias("finding_index"), F.col("o_orderpriority").alias("message"))
    scripts = table(spark, d, "customer").select(F.col("c_custkey").alias("script_id"))
    return context.compact_summary(scripts, order_findings(spark, d), full_coverage(spark, d), notes)


@query
def report_markdown(spark, d):
    """Reports of all customers' scripts, with every section."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    found = order_findings(spark, d)
    report = c.select(F.col("c_custkey").alias("script_id"), (F.col("c_custkey") % 90).alias("scene_count"), F.lit(None).cast("double").alias("runtime_minutes"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("script_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    none = F.array().cast("array<int>")
    entries = done.select("script_id", F.col("k").alias("queue_rank"), F.lit("paid").alias("status"), F.col("p").alias("setup"), F.array((F.col("k") % 9).cast("int")).alias("setup_scenes"), F.when(F.col("k") % 2 == 0, none).alias("payoff_scenes"), F.when(F.col("k") % 3 == 0, "so").alias("note"))
    drags = done.select("script_id", F.col("k").alias("scene_number"), (F.col("k") % 100).cast("double").alias("pace_score"))
    dials = done.select("script_id", F.col("p").alias("character"), F.col("k").cast("string").alias("trait"), (F.col("k") % 10).cast("int").alias("score"), F.lit("").alias("note"))
    formatting = done.select("script_id", F.col("k").alias("finding_index"), F.lit("low").alias("severity"), none.alias("scene_refs"), F.col("p").alias("message"))
    reads = found.where("finding_index % 7 = 0").withColumn("character", F.col("issue")).withColumn("how_reads", F.col("category"))
    logline = full_coverage(spark, d).select("script_id", F.lit("muddled").alias("signal"), F.lit("").alias("what_works"), F.lit(None).cast("string").alias("what_muddles"), F.col("genre").alias("missing"), F.col("logline").alias("tightened"))
    counts = found.groupBy("script_id").agg(*[F.count(F.when(F.col("verification.status") == s, 1)).alias(s) for s in ("verified", "not_found", "no_quote", "scene_not_found")])
    return export.markdown_report(found, report, full_coverage(spark, d), logline, reads, entries, drags, dials, formatting, counts)


@query
def chat_prompts(spark, d):
    """What the chat pass reads for every turn of a user; each turn names a scene, every third quotes one."""
    seq = F.col("conv_id") * 100 + F.col("turn")
    rows = table(spark, d, "conversations").select(
        F.floor(F.col("conv_id") / 10).cast("long").alias("script_id"), seq.alias("text_id"), "role", F.concat(F.lit("see scene "), (F.col("turn") + 8).cast("string"), F.lit(" "), squeezed(F.col("text"))).alias("text"),
        context.quoted(F.when(F.col("turn") % 2 == 0, F.col("turn").cast("int")), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" at "), F.col("turn").cast("string"), F.lit(" ")))).alias("quote"))
    blocks = context.scene_blocks(rows.select("script_id", "text_id", context.scene_refs(F.col("text")).alias("scenes")), elements(spark, d, squeezed(F.col("text"))))
    summaries = rows.where("script_id % 2 = 0").select("script_id", F.concat(F.lit("report of "), F.col("script_id").cast("string")).alias("summary")).distinct()
    out = context.chat_prompts(rows, context.script_maps(presence(spark, d)), summaries, blocks, ["script_id"], "text_id")
    return out.select("script_id", "text_id", F.sha2("text", 256).alias("sha256"))
