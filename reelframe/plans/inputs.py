"""Queries that feed an operator every input it joins, and those of small operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, craft, drafts, findings, graph, rules, structure, tracks
from ..sources import screenplay
from .adapters import elements, presence, scenes, squeezed, table
from .registry import query


@query
def referenced_scenes(spark, d):
    """Scenes that a turn names, and those of the characters that it names."""
    names = presence(spark, d).groupBy("script_id", F.col("character").alias("name")).agg(F.array_sort(F.collect_set("scene_number")).alias("scenes"))
    said = F.concat(F.when(F.col("turn") % 2 == 0, "the user and the assistant in scene ").otherwise("assistant, user, scene "), (F.col("turn") + 4).cast("string"), F.lit(". "), F.col("text"))
    texts = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("script_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("text_id"), said.alias("text"))
    return context.referenced_scenes(texts, names).select("script_id", "text_id", F.array_join("scenes", ",").alias("scenes"))


@query
def dialled_profiles(spark, d):
    """Tracks with dials and reads: of several of a name, in whatever case, the last counts."""
    e, p = elements(spark, d), presence(spark, d)
    pairs = graph.cooccurrence(p, ["script_id", "scene_number"], "character")
    named = p.select("script_id", F.when(F.col("scene_number") % 2 == 0, F.lower("character")).otherwise(F.col("character")).alias("character"), F.col("scene_number").alias("seq"))
    dials = named.withColumn("score", F.col("seq") * 10).where("script_id % 3 <> 0")
    reads = named.where("seq <= 5").withColumn("how_reads", F.concat(F.lit("as in scene "), F.col("seq").cast("string")))
    rows = tracks.character_tracks(graph.character_index(p, e), scenes(spark, d), graph.top_partners(pairs, ["script_id"]), dials, reads)
    return rows.select("script_id", "character", F.col("dials.score").cast("long").alias("score"), F.col("read.how_reads").alias("how_reads"), F.col("track_rank").cast("long").alias("track_rank"))


@query
def full_fix_queue(spark, d):
    """The queue with acts, headings and statuses."""
    k, refs = F.col("o_orderkey"), (F.col("o_orderkey") % 20 + 1).cast("int")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "major").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("script_id"), k.alias("finding_index"), severity.alias("severity"), F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(refs)).alias("scene_refs"))
    places = rows.select("script_id", F.explode("scene_refs").alias("scene_number")).distinct()
    acts = places.where("scene_number > 3").withColumn("act", F.when(F.col("scene_number") <= 10, 1).otherwise(2))
    heads = places.where("scene_number % 2 = 0").withColumn("heading_raw", F.concat(F.lit("INT. ROOM "), F.col("scene_number").cast("string")))
    statuses = rows.where("finding_index % 3 = 0").select("script_id", "finding_index", F.when(F.col("finding_index") % 2 == 0, "fixed").otherwise("open").alias("status"))
    out = findings.fix_queue(rows, acts, heads, statuses)
    return out.select("script_id", "finding_index", "severity", "act", "heading_raw", "status", F.col("queue_rank").cast("long").alias("queue_rank"))


@query
def rebased_pages(spark, d):
    """Page positions where every tenth scene has real pages."""
    e = table(spark, d, "events").select(F.col("user_id").alias("script_id"), F.col("event_id").alias("scene_number"), (F.col("event_id") % 50).alias("lines"))
    page = F.when(F.col("scene_number") % 10 == 0, (F.col("scene_number") / 4).cast("double"))
    places = e.select("script_id", "scene_number", page.alias("page_start"), page.alias("page_end"))
    return structure.page_positions(e.where("scene_number % 13 <> 0"), places)


@query
def variants_apart(spark, d):
    """Name variants of parts that no order has together."""
    offered = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name"), "l_partkey").select("p_type", "p_name", F.col("l_orderkey").alias("scene_number"))
    return craft.name_variants(table(spark, d, "part"), ["p_type"], "p_name", offered)


@query
def long_parentheticals(spark, d):
    """Scripts whose directions run over two lines; what each line becomes."""
    turn = F.concat(F.upper("role"), F.lit("\n(softly,\nturn "), F.col("turn").cast("string"), F.lit(")\nso "), squeezed(F.col("text")), F.lit("\n"))
    rows = table(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    texts = rows.select(F.col("conv_id").alias("script_id"), F.lit("fountain").alias("source_format"), F.lit("a.fountain").alias("source_filename"), F.concat(F.lit("INT. ROOM - DAY\n\n"), F.col("body")).alias("text"))
    return screenplay.parse(texts)["elements"].where("type in ('parenthetical', 'dialogue')").select("script_id", "element_index", "type", F.sha2("text", 256).alias("sha256"), "character")


@query
def selected_rules(spark, d):
    """Parts as rules, by level, tier, category and what they require."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("taxonomy_level"), F.col("p_brand").alias("confidence_tier"), (F.col("p_size") % 5).cast("string").alias("category"), F.array((F.col("p_size") % 3).cast("string"), F.lit("all")).alias("requires"))
    asked = [dict(level="ECONOMY"), dict(requires="1", category="2"), dict(tier="Brand#11", requires="all"), dict(level="nothing")]
    out = None
    for i, wanted in enumerate(asked):
        found = rules.select(rows, **wanted).select(F.lit(i).alias("asked"), "p_partkey")
        out = found if out is None else out.unionByName(found)
    return out


@query
def reordered_scenes(spark, d):
    """Scripts with their scenes in reverse, renumbered."""
    e, s = elements(spark, d), scenes(spark, d)
    order = drafts.board_order(s, s.groupBy("script_id").agg(F.reverse(F.array_sort(F.collect_list("scene_number"))).alias("order")))
    moved = drafts.reordered(e, s, order)["elements"]
    return moved.select("script_id", F.col("scene_number").cast("long").alias("scene_number"), "element_index", F.sha2("text", 256).alias("sha256"))


@query
def reply_scores(spark, d):
    """How good each turn is as a reply, stuck phrases, length and verdicts weighed; the part without repetition."""
    text = F.concat(F.when(F.col("turn") % 3 == 0, "my honest take: ").otherwise(""), F.substring("text", 1, 150))
    score = context.reply_score(F.col("t"), F.col("turn") % 2 == 0) + F.lit(3.0) * context.repetition_ratio(F.col("t"))
    return table(spark, d, "conversations").withColumn("t", text).select("conv_id", "turn", score.alias("score"))
