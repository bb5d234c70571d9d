"""Driver queries: every operator on the given tables. Doubles are left unrounded, so that engines can agree exactly."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import ascii_word_count, normalised, ratio_udf, windowed_ratio_reaches, word_count
from ..operators import context, craft, drafts, findings, graph, memory, rules, stats, structure, tracks
from ..sources import export, screenplay
from ..streaming.jobs import sessions
from . import assembly, flow, inputs, scripts, state  # noqa: F401  their queries register themselves
from .adapters import elements, generated_scripts, headings, lines_of_speech, orders_cast, presence, scenes, table, text_lines
from .registry import QUERIES, exact, injected, query


@query
def character_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.character_stats(elements(spark, d), exact)


@query
def scene_estimates(spark, d):
    return stats.scene_estimates(elements(spark, d), exact).withColumn("words", F.col("words").cast("long"))


@query
def dialogue_share(spark, d):
    return stats.dialogue_action_ratio(elements(spark, d), exact)


@query
def location_usage(spark, d):
    rows = table(spark, d, "orders").withColumn("script_id", F.col("o_custkey") % 100)
    return stats.usage(rows, "o_orderpriority", "o_orderkey").withColumn("usage_rank", F.col("usage_rank").cast("long"))


@query
def scene_length_stats(spark, d):
    return stats.scene_length_stats(stats.scene_estimates(elements(spark, d), exact), exact)


@query
def time_breakdown(spark, d):
    parts = headings(spark, d).withColumn("h", L.heading_parts(F.col("heading_raw"))).select("script_id", "h.int_ext", "h.time_of_day")
    return stats.time_breakdown(parts, exact)


@query
def script_report(spark, d):
    e = elements(spark, d)
    estimates = stats.scene_estimates(e, exact)
    return estimates.groupBy("script_id").agg(F.sum(F.col("words").cast("long")).alias("words"), F.sum("dialogue_lines").alias("dialogue_lines"), F.count("*").alias("scene_count")).join(stats.dialogue_action_ratio(e, exact), "script_id")


def supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers that share orders; a task for each 500,000 lines, so that none holds more pairs as the table grows."""
    cast = orders_cast(spark, d)
    return graph.cooccurrence(cast, ["l_orderkey"], "l_suppkey", tasks=max(spark.sparkContext.defaultParallelism, cast.count() // 500_000 + 1))


@query
def cooccurrence_pairs(spark, d):
    return supplier_pairs(spark, d)


@query
def interactions_topk(spark, d):
    rows = graph.top_partners(supplier_pairs(spark, d), [], 8)
    return rows.withColumn("partner_rank", F.col("partner_rank").cast("long"))


@query
def scene_cooccurrence(spark, d):
    rows = graph.cooccurrence(presence(spark, d), ["script_id", "scene_number"], "character", "scene_number")
    return rows.withColumn("scenes", F.array_join("scenes", ","))


@query
def quiet_gaps(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    return structure.quiet_gaps(rows, ["user_id", "event_type"], "day")


@query
def page_positions(spark, d):
    return structure.page_positions(structure.scene_lines(elements(spark, d)))


@query
def act_assignment(spark, d):
    return structure.act_of_scene(structure.page_positions(structure.scene_lines(elements(spark, d))))


@query
def acts(spark, d):
    rows = structure.acts(structure.page_positions(structure.scene_lines(elements(spark, d))), exact)
    return rows.withColumn("scene_numbers", F.array_join("scene_numbers", ",")).withColumn("scene_count", F.col("scene_count").cast("long"))


@query
def pacing_curve(spark, d):
    e = elements(spark, d)
    rows = structure.pacing_curve(e, structure.page_positions(structure.scene_lines(e)), 1)
    return rows.select("script_id", *[F.col(c).cast("long").alias(c) for c in rows.columns[1:]])


@query
def character_arc(spark, d):
    rows = structure.character_arc(presence(spark, d), scenes(spark, d), elements(spark, d), exact)
    return rows.drop("quiet_gaps").withColumn("arc_rank", F.col("arc_rank").cast("long"))


@query
def pace_index(spark, d):
    rows = craft.scene_pace(elements(spark, d), rounded=exact)
    return rows.withColumn("words", F.col("words").cast("long")).withColumn("dialogue_words", F.col("dialogue_words").cast("long"))


@query
def drag_topk(spark, d):
    rows = craft.drags(craft.scene_pace(elements(spark, d), rounded=exact))
    return rows.select("script_id", "scene_number", "pace_score", F.col("slow_rank").cast("long").alias("slow_rank"))


@query
def time_flip(spark, d):
    parts = headings(spark, d).withColumn("time_of_day", L.heading_parts(F.col("heading_raw"))["time_of_day"])
    skips = parts.where("scene_number % 7 = 0").select("script_id", "scene_number")
    return craft.time_flips(parts, skips)


@query
def heading_parse(spark, d):
    return headings(spark, d).withColumn("h", L.heading_parts(F.col("heading_raw"))).select("scene_number", "heading_raw", "h.int_ext", "h.location", "h.time_of_day")


@query
def line_flags(spark, d):
    made = headings(spark, d).select(F.col("scene_number").alias("doc_id"), F.lit(-1).alias("line_no"), F.col("heading_raw").alias("line"))
    cue = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(-2).alias("line_no"), F.concat(F.upper(F.replace("s_name", F.lit("#"), F.lit(" "))), F.when(F.col("s_suppkey") % 3 == 0, " (V.O.)").when(F.col("s_suppkey") % 3 == 1, " CUT TO:").otherwise("")).alias("line"))
    rows = text_lines(spark, d).unionByName(made).unionByName(cue).withColumn("s", F.trim("line"))
    flags = {"headings": L.is_heading, "transitions": L.is_transition, "time_markers": L.is_time_marker, "shots": L.is_shot, "parentheticals": L.is_parenthetical, "cues": L.is_cue}
    return rows.groupBy("line_no").agg(F.count("*").alias("n"), *[F.count(F.when(f(F.col("s")), 1)).alias(k) for k, f in flags.items()])


@query
def screenplay_parse(spark, d):
    out = screenplay.parse(generated_scripts(spark, d))["elements"]
    return out.select("script_id", "scene_number", "element_index", "type", "text", "character")


@query
def export_roundtrip(spark, d):
    first = screenplay.parse(generated_scripts(spark, d))
    text = export.to_fountain(first["elements"], first["scripts"]).withColumn("source_format", F.lit("fountain")).withColumn("source_filename", F.lit("again"))
    again = screenplay.parse(text)["elements"]
    return again.groupBy("script_id", "type").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("characters"))


@query
def prop_candidates(spark, d):
    rows = text_lines(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    ascii_only = F.regexp_replace("line", r"[^\x00-\x7F]", "x")
    return graph.recurring_phrases(rows.withColumn("line", ascii_only), ["source"], "doc_id", "line")


@query
def timeline_markers(spark, d):
    e = elements(spark, d, injected(["LATER", "THE NEXT DAY, EARLIER", "two years ago in 1999"]))
    return graph.time_markers(e, ["script_id", "scene_number"], "element_index").select("script_id", "scene_number", F.array_join("markers", "|").alias("markers"))


@query
def promise_phrases(spark, d):
    e = elements(spark, d, injected(["I'll show you", "I swear", "nammuko ra"]))
    return graph.promises(e).select("script_id", "scene_number", "element_index", "character", "matched")


@query
def voice_similarity(spark, d):
    profiles = craft.fingerprints(lines_of_speech(spark, d), ["scene_number", "element_index"])
    shared = graph.cooccurrence(presence(spark, d), ["script_id", "scene_number"], "character")
    return craft.similar_voices(profiles, shared, 0.0)


@query
def idiolect_shift(spark, d):
    rows = craft.idiolect_shifts(lines_of_speech(spark, d), ["scene_number", "element_index"], 0.2)
    return rows


@query
def on_the_nose(spark, d):
    e = lines_of_speech(spark, d, injected(["I am so angry.", "I love you.", "He felt sad."]))
    return craft.on_the_nose(e).select("script_id", "scene_number", "element_index", "speaker")


@query
def name_variants(spark, d):
    return craft.name_variants(table(spark, d, "part"), ["p_type"], "p_name")


@query
def long_blocks(spark, d):
    rows = text_lines(spark, d).withColumn("words", ascii_word_count(F.col("line")).cast("long"))
    return rows.where(F.col("words") > craft.LONG_ACTION).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "words")


@query
def paren_ratio(spark, d):
    return craft.parenthetical_ratio(table(spark, d, "events"), ["user_id"], "event_type", "click", "view")


@query
def first_intro(spark, d):
    return craft.unintroduced(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query
def quote_verify_exact(spark, d):
    quotes = table(spark, d, "benchmark").select("item_id", normalised(F.col("text")).alias("q"))
    bodies = table(spark, d, "documents").select("doc_id", normalised(F.col("text")).alias("body"))
    return findings.contained(quotes, bodies, [], "q", "body", "item_id", "doc_id")


@query
def quote_verify_fuzzy(spark, d):
    """Each turn's words after one that is made up, against its own scene's turns."""
    e = elements(spark, d)
    quotes = e.where("character is not null").select("script_id", "element_index", "scene_number", F.concat(F.lit("changed "), normalised(F.col("text"))).alias("q"))
    return quotes.join(findings.scene_texts(e), ["script_id", "scene_number"]).select("script_id", "scene_number", "element_index", windowed_ratio_reaches(F.col("q"), F.col("body"), findings.FUZZY).alias("verified"))


@query
def language_remarks(spark, d):
    e = table(spark, d, "conversations").withColumn("issue", injected(["reads as regional", "needs subtitles", "the dialect is fine"])).withColumn("why_it_matters", F.col("role"))
    return findings.writing_feedback(e).groupBy("conv_id").agg(F.count("*").alias("kept"))


@query
def overlay_merge(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 10).alias("script_id"), (F.col("doc_id") % 7).alias("pass"), "doc_id", "quality")
    fresh = rows.where("doc_id % 2 = 1")
    return findings.overlay(rows.where("doc_id % 2 = 0"), fresh, "pass", fresh.where("pass < 3").select("script_id", "pass"))


@query
def ledger_antijoin(spark, d):
    entries = table(spark, d, "benchmark").select("item_id", "text")
    existing = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    return findings.not_yet_said(entries, existing, [], "item_id", "text").select("item_id")


@query
def draft_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 7 <> 0")
    new = o.where("o_orderkey % 7 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 2, "X").otherwise(F.col("o_orderstatus")))
    return drafts.keyed_diff(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query
def presence_diff(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").where("l_suppkey is not null")
    out = drafts.presence_diff(rows.where("l_suppkey % 5 <> 0"), rows.where("l_suppkey % 7 <> 0"), ["l_orderkey"], "l_suppkey")
    return out.select("l_orderkey", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query
def line_alignment(spark, d):
    """Two drafts of each conversation: the second lacks every third turn and has another text for every fourth."""
    e = elements(spark, d)
    new = e.where("element_index % 3 <> 2").withColumn("text", F.when(F.col("element_index") % 4 == 1, F.upper("text")).otherwise(F.col("text")))
    return drafts.line_alignment(e, new, ["script_id", "scene_number"], "element_index").select("script_id", "scene_number", "seq", "op")


@query
def carried_findings(spark, d):
    rows = table(spark, d, "conversations")
    return drafts.carried(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"), ["conv_id"], "turn", "text", 0.5).select("conv_id", "turn", "carried")


@query
def finding_states(spark, d):
    """Each turn's text as a quote that must still stand in a draft without odd turns."""
    e = elements(spark, d).withColumn("finding_index", F.col("scene_number") * 100 + F.col("element_index")).withColumn("evidence_quote", F.col("text"))
    return drafts.finding_states(e.select("script_id", "finding_index", "evidence_quote"), e.where("element_index % 2 = 0")).select("script_id", F.col("finding_index").cast("long").alias("finding_index"), "status")


@query
def fix_queue(spark, d):
    o = table(spark, d, "orders")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "major").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    rows = o.select((F.col("o_custkey") % 100).alias("script_id"), F.col("o_orderkey").alias("finding_index"), severity.alias("severity"), F.array((F.col("o_orderkey") % 20 + 1).cast("int")).alias("scene_refs"))
    acts_ = rows.select("script_id", F.explode("scene_refs").alias("scene_number")).distinct().withColumn("act", F.when(F.col("scene_number") <= 5, 1).when(F.col("scene_number") <= 15, 2).otherwise(3))
    return findings.fix_queue(rows, acts_).select("script_id", "finding_index", "severity", "act", F.col("queue_rank").cast("long").alias("queue_rank"))


@query
def character_tracks(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    own = li.groupBy("s_nationkey", "l_suppkey").agg(F.count_distinct("l_orderkey").alias("scenes"), F.count("*").alias("lines"))
    total = li.groupBy("s_nationkey").agg(F.count_distinct("l_orderkey").alias("total"))
    w = Window.partitionBy("s_nationkey")
    return tracks.importance(own.join(total, "s_nationkey").withColumn("all_lines", F.sum("lines").over(w)), "scenes", "total", "lines", "all_lines")


@query
def rule_stats(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("confidence_tier"), F.col("p_type").alias("taxonomy_level"))
    return rules.stats(rows)


@query
def rule_lookup(spark, d):
    """Rules of every customer, from every part, with the customers of each rule: customers are counted by category before they
    meet the rules, so the join has a row a rule."""
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("taxonomy_level"), F.col("p_brand").alias("category"))
    asked = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("category"))
    levels = {"building": ["ECONOMY"], "machinery": ["SMALL"], "furniture": ["LARGE", "PROMO"]}
    counts = asked.groupBy("category").agg(F.count("*").alias("customers"), F.min("c_custkey").cast("long").alias("first_customer"), F.max("c_custkey").cast("long").alias("last_customer"))
    return rules.for_findings(counts, parts, levels).drop("taxonomy_level")


@query
def rule_lookup_whole(spark, d):
    """Rules of every customer, from every part; rules are counted by category before they meet the customers."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("taxonomy_level"), F.col("p_brand").alias("category"))
    asked = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("category"))
    levels = {"building": ["ECONOMY"], "machinery": ["SMALL"], "furniture": ["LARGE", "PROMO"]}
    found = rules.of_categories(parts, levels).groupBy("category").agg(F.count("*").alias("rules"), F.min("applicable_rule").cast("long").alias("first_rule"), F.max("applicable_rule").cast("long").alias("last_rule"))
    out = asked.join(found, "category", "left")
    return out.select("c_custkey", "category", F.coalesce("rules", F.lit(0)).alias("rules"), "first_rule", "last_rule")


@query
def beat_board(spark, d):
    s = scenes(spark, d)
    boards = s.groupBy("script_id").agg(F.reverse(F.array_sort(F.collect_list("scene_number"))).alias("order"))
    boards = boards.withColumn("order", F.when(F.col("script_id") % 2 == 0, F.col("order")).otherwise(F.slice("order", 1, 2)))
    order = drafts.board_order(s, boards)
    estimates = stats.scene_estimates(elements(spark, d), exact).withColumn("words", F.col("words").cast("long"))
    notes = elements(spark, d).where("type = 'action'").select("script_id", "scene_number")
    cards = drafts.board_cards(order, s.withColumn("heading_raw", F.concat(F.lit("SCENE "), F.col("scene_number").cast("string"))), estimates, notes)
    return cards.select("script_id", "scene_number", F.col("position").cast("long").alias("position"), "heading_raw", "words", "minutes", "note_count")


@query
def rolling_metrics(spark, d):
    e = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-(tracks.RING - 1), 0)
    return e.select("event_id", F.sum("cents").over(w).alias("rolling_cents"), F.count("cents").over(w).alias("rolling_n"))


@query
def stall_sessions(spark, d):
    rows = sessions(table(spark, d, "events"), ["user_id"], "ts", 86400)
    return rows.select("user_id", "session_no", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "n")


@query
def profile_fold(spark, d):
    text = injected(["keep it short", "go deeper", "no, I disagree"])
    # writers grow with the table, so that no fold does
    turns = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("writer"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), text.alias("text"), (F.col("turn") % 2 == 1).alias("was_probed"))
    return memory.profiles(turns)


@query
def profile_signals(spark, d):
    text = injected(["keep it short", "go deeper", "okay then"])
    turns = table(spark, d, "conversations").select((F.col("conv_id") % 50).alias("writer"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), text.alias("text"), F.lit(False).alias("was_probed"))
    return memory.observed(turns).groupBy("writer", "dimension", "pole").agg(F.count("*").alias("n"))


@query
def token_chunks(spark, d):
    rows = elements(spark, d)
    return context.chunks(rows, ["script_id", "scene_number"], "element_index", "text", 3, 400).select("script_id", "scene_number", "element_index", F.col("chunk").cast("long").alias("chunk"))


@query
def reply_cleaning(spark, d):
    noise = F.concat(F.col("text"), F.lit("\n\n-----\n<im_end|>\n\n"), F.col("text"), F.lit("\n\nIt needs subtitles. "), F.col("role"), F.lit("_"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", context.cleaned_reply(noise).alias("clean"))
    return rows.select("conv_id", "turn", F.char_length("clean").alias("characters"))


@query
def turn_kinds(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", injected(["what if", "rewrite it:", "because"]))
    return rows.groupBy("conv_id").agg(*[F.count(F.when(context.turn_kind(F.trim("t")) == k, 1)).alias(k) for k in ("question", "directive", "idea")])


@query
def trigram_repetition(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    return context.repetition_ratios(rows, F.regexp_replace("text", r"[^\x00-\x7F]", "x")).select("doc_id", "ratio")


@query
def history_window(spark, d):
    rows = table(spark, d, "conversations").withColumn("session", F.floor(F.col("conv_id") / 10).cast("long")).withColumn("seq", F.col("conv_id") * 100 + F.col("turn"))
    return context.history(rows, ["session"], "seq").select("session", "seq", F.col("from_end").cast("long").alias("from_end"))


@query
def library_digest(spark, d):
    return tracks.group_digest(table(spark, d, "documents"), "source", "doc_id", "text")


@query
def token_surplus(spark, d):
    rows = table(spark, d, "conversations")
    return context.token_surplus(rows.where("role = 'user'"), rows.where("role = 'assistant'"), ["conv_id"], "text").groupBy("conv_id").agg(F.sum("only_a").alias("only_user"), F.sum("only_b").alias("only_assistant"))


@query
def scene_references(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", F.concat(F.lit("see scene "), (F.col("turn") + 3).cast("string"), F.lit(" and Scene "), (F.col("conv_id") % 4).cast("string"), F.lit(". "), F.col("text")))
    return rows.select("conv_id", "turn", F.array_join(context.scene_refs(F.col("t")), ",").alias("refs"))


@query
def character_references(spark, d):
    names = presence(spark, d).groupBy("script_id", F.col("character").alias("name")).agg(F.array_sort(F.collect_set("scene_number")).alias("scenes"))
    said = injected(["the user says", "assistants again", "the userr"])
    texts = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("script_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("text_id"), said.alias("text"))
    return context.character_refs(texts, names)


def oracle_free() -> set[str]:
    """Queries without SQL: similarity ratios, sequence alignment and text folds."""
    return {"quote_verify_fuzzy", "line_alignment", "carried_findings", "reply_cleaning", "character_references"}
