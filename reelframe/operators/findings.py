"""Findings: shape, filters, quote verification, merging, queues, summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, normalised, windowed_ratio_udf, word_count

FUZZY = 0.72
# Patterns of remarks about a text's language or its subtitles.
LANGUAGE_REMARKS = [
    r"reads as (a )?(regional|tenglish|hinglish|indian)", r"(comes across|comes off|sounds) (as |like )?(a )?(regional|tenglish|hinglish)",
    r"probably (a )?(telugu|tamil|hindi|kannada|malayalam|tenglish|hinglish)", r"likely (a )?(telugu|tamil|hindi|kannada|malayalam|tenglish|hinglish)",
    r"(telugu|tamil|hindi|kannada|malayalam|tenglish|hinglish) (language|dialect)", r"(south|north|southern|northern) indian (language|dialect)",
    r"(an?|the) indian (language|dialect)", r"language (appears|seems|looks) to be", r"(identif\w*).{0,40}language", r"mixed[- ]language", r"code[- ]switc",
    r"regional (language|dialect|accent)", r"what (language|dialect)",
]
SUBTITLE_REMARKS = [
    r"subtitle", r"non[- ]native (speaker|viewer|audience)", r"(viewer|audience)s? (who|that) (don'?t|do not|won'?t) (speak|understand)",
    r"(foreign|international|western) (viewer|audience)", r"translat\w+ (is |would be )?(needed|required)", r"needs? (either )?subtitles",
]
SEVERITIES = {"high": 0, "major": 1, "medium": 2}
STATUSES = ["verified", "not_found", "no_quote", "scene_not_found"]


def is_language_remark(*texts: Column) -> Column:
    whole = F.concat_ws(" ", *texts)
    return whole.rlike("(?i)" + "|".join(f"(?:{p})" for p in LANGUAGE_REMARKS + SUBTITLE_REMARKS))


def writing_feedback(findings: DataFrame) -> DataFrame:
    """Drops remarks about language or subtitles; quotes are not looked at."""
    return findings.where(~is_language_remark(F.col("issue"), F.col("why_it_matters")))


def normalise(raw: DataFrame, category: str | Column) -> DataFrame:
    """Untyped findings (missing fields null) with defaults; an older `finding` field stands in for `issue`."""
    older = F.col("finding") if "finding" in raw.columns else F.lit(None)
    default = F.lit(category) if isinstance(category, str) else category
    return raw.withColumns({
        "category": F.coalesce("category", default) if "category" in raw.columns else default,
        "issue": F.coalesce("issue", older, F.lit("")), "why_it_matters": F.coalesce("why_it_matters", F.lit("")),
        "severity": F.coalesce("severity", F.lit("medium")), "scene_refs": F.coalesce("scene_refs", F.array().cast("array<int>")),
    }).drop("finding")


def scene_texts(elements: DataFrame) -> DataFrame:
    """(script_id, scene_number, body): normalised text of each scene."""
    rows = elements.where("scene_number > 0").groupBy("script_id", "scene_number").agg(F.array_sort(F.collect_list(F.struct("element_index", "text"))).alias("e"))
    return rows.select("script_id", "scene_number", normalised(F.array_join(F.transform("e", lambda x: x["text"]), "\n")).alias("body"))


def inner_words(text: Column) -> Column:
    """A phrase's inner words: whoever contains the phrase has them as whole words."""
    w = F.split(F.trim(text), r"\s+")
    return F.array_distinct(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))


def contained(quotes: DataFrame, bodies: DataFrame, keys: list[str], quote: str, body: str, id_col: str, order: str) -> DataFrame:
    """(keys, id, found_at): the first body of the group that contains each quote, by `order`.

    A quote meets only bodies that have the one of its inner words which fewest bodies of the group have; a quote with an
    inner word that no body has meets none. Only words that quotes ask for leave the bodies. A quote of less than three
    words has no word of its own: it meets the bodies that have its first characters.
    """
    asked = quotes.select(*keys, id_col, F.col(quote).alias("q_"), inner_words(F.col(quote)).alias("words_")).where("q_ <> ''")
    said = bodies.select(*keys, order, F.col(body).alias("b_"))
    wanted = asked.select(*keys, id_col, F.size("words_").alias("n_"), F.explode("words_").alias("word_"))
    words = said.select(*keys, order, F.explode(F.array_distinct(F.split("b_", r"\s+"))).alias("word_"))
    words = words.join(wanted.select(*keys, "word_").distinct(), [*keys, "word_"], "left_semi")
    counts = words.groupBy(*keys, "word_").agg(F.count("*").alias("bodies_"))
    rarest = wanted.join(counts, [*keys, "word_"]).groupBy(*keys, id_col).agg(F.min(F.struct("bodies_", "word_")).alias("w_"), F.count("*").alias("known_"), F.min("n_").alias("n_"))
    rarest = rarest.where("known_ = n_").select(*keys, id_col, F.col("w_.word_").alias("word_"))
    near = rarest.join(words, [*keys, "word_"]).join(asked.select(*keys, id_col, "q_"), [*keys, id_col]).select(*keys, id_col, "q_", order)
    hits = near.join(said, [*keys, order]).where(F.contains("b_", "q_")).select(*keys, id_col, order)
    short = asked.where("size(words_) = 0")
    if not short.isEmpty():
        grams = [F.regexp_extract_all("b_", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]
        heads = said.select(*keys, order, F.explode(F.array_distinct(F.concat(*grams))).alias("gram_"))
        close = short.withColumn("gram_", F.substring("q_", 1, 3)).join(heads, [*keys, "gram_"]).select(*keys, id_col, "q_", order)
        hits = hits.unionByName(close.join(said, [*keys, order]).where(F.contains("b_", "q_")).select(*keys, id_col, order))
    return hits.groupBy(*keys, id_col).agg(F.min(order).alias("found_at"))


def verify(findings: DataFrame, elements: DataFrame) -> DataFrame:
    """findings (script_id, finding_index, scene_refs, evidence_quote, ...) plus verification.

    Exact containment first, in the cited scenes and then anywhere; only what is left is compared by windows, in
    an Arrow function.
    """
    keys = ["script_id", "finding_index"]
    bodies = scene_texts(elements)
    quote = findings.select(*keys, "scene_refs", normalised(F.coalesce("evidence_quote", F.lit(""))).alias("q"))
    short = blank(F.col("q")) | (word_count(F.col("q")) < 3)
    asked = quote.where(~short)
    cited = asked.select(*keys, "q", F.posexplode("scene_refs").alias("at", "scene_number")).join(bodies, ["script_id", "scene_number"], "left")
    exact = F.coalesce(F.contains("body", "q"), F.lit(False))
    first = cited.groupBy(*keys).agg(
        F.min_by("scene_number", F.when(exact, F.col("at"))).alias("exact_scene"), F.count("body").alias("known"), F.count("*").alias("refs")
    )
    open_ = cited.join(first.where("exact_scene is null and known > 0"), keys, "left_semi").where("body is not null")
    fuzzy = open_.withColumn("r", windowed_ratio_udf("q", "body")).groupBy(*keys).agg(F.max("r").alias("best"), F.max_by("scene_number", F.struct("r", -F.col("at"))).alias("best_scene"))
    state = asked.join(first, keys, "left").join(fuzzy, keys, "left").withColumn("lost", (F.coalesce("refs", F.lit(0)) > 0) & (F.col("known") == 0))
    rest = state.where(~F.col("lost") & F.col("exact_scene").isNull() & (F.coalesce("best", F.lit(0.0)) < FUZZY))
    anywhere = contained(rest, bodies, ["script_id"], "q", "body", "finding_index", "scene_number").withColumnRenamed("found_at", "moved")
    state = state.join(anywhere, keys, "left")
    result = lambda status, scene=None, confidence=None, note=None: F.struct(
        F.lit(status).alias("status"), (F.lit(scene) if scene is None else scene).cast("int").alias("matched_scene"),
        (F.lit(confidence) if confidence is None else confidence).cast("double").alias("confidence"), (F.lit(note) if note is None else note).cast("string").alias("note"))
    best = F.bround(F.coalesce("best", F.lit(0.0)), 2)
    verdict = (
        F.when(F.col("exact_scene").isNotNull(), result("verified", F.col("exact_scene"), F.lit(1.0)))
        .when(F.col("lost"), result("scene_not_found"))
        .when(F.coalesce("best", F.lit(0.0)) >= FUZZY, result("verified", F.col("best_scene"), best))
        .when(F.col("moved").isNotNull(), result("verified", F.col("moved"), F.lit(1.0), F.concat(F.lit("found in scene "), F.col("moved").cast("string"))))
        .otherwise(result("not_found", None, best))
    )
    done = state.select(*keys, verdict.alias("verification"))
    return findings.join(done, keys, "left").withColumn("verification", F.coalesce("verification", result("no_quote")))


def verification_summary(findings: DataFrame) -> DataFrame:
    """One row a script with all four counts."""
    status = F.coalesce("verification.status", F.lit("no_quote"))
    return findings.groupBy("script_id").agg(*[F.count(F.when(status == s, 1)).alias(s) for s in STATUSES])


def overlay(previous: DataFrame, fresh: DataFrame, key: str, rerun: DataFrame, keys: tuple = ("script_id",)) -> DataFrame:
    """Rows of `previous` whose pass was not run again, then all of `fresh`. rerun: (keys, key) of passes run again."""
    kept = previous.join(rerun.select(*keys, key).distinct(), [*keys, key], "left_anti")
    return kept.withColumn("is_fresh", F.lit(False)).unionByName(fresh.withColumn("is_fresh", F.lit(True)), allowMissingColumns=True)


def not_yet_said(entries: DataFrame, existing: DataFrame, keys: list[str], id_col: str, text: str, head: int = 40) -> DataFrame:
    """Entries (keys, id, text) whose first `head` characters, in lower case, occur in none of the group's existing texts
    (keys, seq, text)."""
    rows = entries.select(*keys, id_col, F.substring(F.lower(text), 1, head).alias("head_"))
    said = existing.select(*keys, "seq", F.lower(text).alias("body_"))
    found = contained(rows, said, keys, "head_", "body_", id_col, "seq")
    return entries.join(found, [*keys, id_col], "left_anti")


def fix_queue(findings: DataFrame, acts: DataFrame | None = None, scenes: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """Findings by severity, act and index, with the act and heading of their first scene and their status."""
    rows = findings.withColumn("first_ref", F.try_element_at("scene_refs", F.lit(1)))
    where = lambda d, *c: d.select("script_id", F.col("scene_number").alias("first_ref"), *c)
    rows = rows.join(where(acts, "act"), ["script_id", "first_ref"], "left") if acts is not None else rows.withColumn("act", F.lit(None).cast("int"))
    if scenes is not None:
        rows = rows.join(where(scenes, "heading_raw"), ["script_id", "first_ref"], "left")
    if statuses is not None:
        rows = rows.join(statuses.select("script_id", "finding_index", "status"), ["script_id", "finding_index"], "left")
    return ranked(rows, ["script_id"], severity_weight(F.col("severity")), F.coalesce("act", F.lit(4)), F.col("finding_index"))


def severity_weight(severity: Column) -> Column:
    out = F.lit(3)
    for name, weight in SEVERITIES.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def ranked(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """rows plus queue_rank within keys. Rows that `order` leaves level follow each other by their other columns, from the
    first to the last, so that only equal rows can change places."""
    order = [*order, *(F.col(f.name) for f in rows.schema if f.name not in keys and "map<" not in f.dataType.simpleString())]
    return rows.withColumn("queue_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def by_category(findings: DataFrame) -> DataFrame:
    """(script_id, category, findings): each category's findings in input order."""
    fields = [c for c in findings.columns if c not in ("script_id", "category")]
    ordered = ["finding_index", *[c for c in fields if c != "finding_index"]]
    return findings.groupBy("script_id", "category").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("findings"))


def ledger(entries: DataFrame, limit: int = 12) -> DataFrame:
    """Setup and payoff entries, open ones first, at most `limit` a script."""
    rank = {"dangling": 0, "abandoned": 1, "red_herring": 2, "paid": 3}
    weight = F.coalesce(F.create_map(*[F.lit(x) for p in rank.items() for x in p])[F.col("status")], F.lit(4))
    return ranked(entries, ["script_id"], weight, F.col("entry_index")).where(F.col("queue_rank") <= limit)


def candidates(props: DataFrame, promises: DataFrame, limit: int = 15) -> DataFrame:
    """Top candidates for a model's judgment: props by mentions, promises in order filling the rest."""
    p = props.select("script_id", F.struct(F.lit(0).alias("source"), (-F.col("mentions")).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), F.col("phrase").alias("label"))
    q = promises.select("script_id", F.struct(F.lit(1).alias("source"), F.col("scene_number").cast("long").alias("a"), F.col("element_index").cast("long").alias("b")).alias("at"), F.col("text").alias("label"))
    return ranked(p.unionByName(q), ["script_id"], F.col("at"), F.col("label")).where(F.col("queue_rank") <= limit)


def outcome(outcomes: DataFrame) -> DataFrame:
    """complete, partial or failed per script, from (script_id, category, outcome)."""
    rows = outcomes.groupBy("script_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("outcome") == "failed", 1)).alias("failed"))
    return rows.withColumn("result", F.when(F.col("failed") == 0, "complete").when(F.col("failed") < F.col("n"), "partial").otherwise("failed"))


def closure(needs: DataFrame) -> DataFrame:
    """(category, requires): what a category needs, directly or through others, from its direct needs. A small table; circles end."""
    rows = needs.select("category", "requires").distinct()
    return rows.sparkSession.sql(
        """WITH RECURSIVE reach(category, requires, steps) AS (
        SELECT category, requires, 1 FROM {rows} UNION ALL
        SELECT reach.category, n.requires, steps + 1 FROM reach JOIN {rows} n ON n.category = reach.requires WHERE steps < (SELECT count(DISTINCT category) FROM {rows}))
        SELECT DISTINCT category, requires FROM reach""", rows=rows)


def close_gates(outcomes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Marks categories failed that need a failed one, directly or through others, whether those were run or not.
    dependencies: direct needs (category, requires)."""
    failed = outcomes.where("outcome = 'failed'").select("script_id", F.col("category").alias("requires"))
    blocked = failed.join(F.broadcast(closure(dependencies)), "requires").select("script_id", "category").distinct().withColumn("blocked", F.lit(True))
    return outcomes.join(blocked, ["script_id", "category"], "left").withColumn("outcome", F.when(F.col("blocked"), "failed").otherwise(F.col("outcome"))).drop("blocked")


def retries(outcomes: DataFrame, along: DataFrame) -> DataFrame:
    """(script_id, category, reason): what a retry runs. Failed categories, and those whose results they need, though these
    have not failed. along: (category, requires), closed over."""
    failed = outcomes.where("outcome = 'failed'").select("script_id", "category").distinct()
    pulled = failed.join(F.broadcast(closure(along)), "category").select("script_id", F.col("requires").alias("category"), F.lit(1).alias("k"))
    return failed.select("*", F.lit(0).alias("k")).unionByName(pulled).groupBy("script_id", "category").agg(F.when(F.min("k") == 0, "failed").otherwise("needed").alias("reason"))
