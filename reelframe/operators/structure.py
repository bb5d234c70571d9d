"""Pages, acts, pacing segments, presence gaps and character arcs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

LINES_PER_PAGE, ACTION_WORDS, DIALOGUE_WORDS = 54, 10, 14
FIRST_CUT, SECOND_CUT = 0.25, 0.75
MIN_GAP, THROUGHOUT = 2, 0.6


def scene_lines(elements: DataFrame) -> DataFrame:
    """Estimated printed lines of each scene; whole numbers, so their running sums are exact."""
    n = word_count(F.col("text"))
    wrap = lambda width: F.greatest(F.lit(1).cast("long"), F.ceil(n / width))
    lines = F.when(F.col("type").isin("action", "scene_heading"), wrap(ACTION_WORDS)).when(F.col("type") == "dialogue", wrap(DIALOGUE_WORDS)).otherwise(F.lit(1).cast("long"))
    return elements.where("scene_number > 0").groupBy("script_id", "scene_number").agg(F.sum(lines).alias("lines"))


def page_positions(lines: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """(script_id, scene_number, page): where each scene ends, from running lines, re-based wherever a scene has
    real pages."""
    rows = lines
    if scenes is not None:
        rows = scenes.select("script_id", "scene_number", F.when(F.col("page_start").isNotNull(), F.col("page_end")).alias("real")).join(lines, ["script_id", "scene_number"], "left")
    else:
        rows = lines.withColumn("real", F.lit(None).cast("double"))
    by = Window.partitionBy("script_id").orderBy("scene_number")
    rows = rows.withColumn("base", F.last("real", True).over(by)).withColumn("group", F.count("real").over(by))
    own = F.when(F.col("real").isNull(), F.coalesce("lines", F.lit(0))).otherwise(0)
    running = F.sum(own).over(Window.partitionBy("script_id", "group").orderBy("scene_number"))
    return rows.select("script_id", "scene_number", (F.coalesce("base", F.lit(0.0)) + running / F.lit(float(LINES_PER_PAGE))).alias("page"))


def act_of_scene(pages: DataFrame) -> DataFrame:
    """(script_id, scene_number, page, act) by the position in the script's pages."""
    total = F.nullif(F.max("page").over(Window.partitionBy("script_id")), F.lit(0.0))
    total = F.coalesce(total, F.lit(1.0))
    act = F.when(F.col("page") <= FIRST_CUT * total, 1).when(F.col("page") <= SECOND_CUT * total, 2).otherwise(3)
    return pages.withColumn("act", act)


def acts(pages: DataFrame, rounded=F.bround) -> DataFrame:
    """Always three rows a script: scenes of the act, first and last page (act 1 begins on page 1), count."""
    placed = act_of_scene(pages)
    found = placed.groupBy("script_id", "act").agg(
        F.array_sort(F.collect_list("scene_number")).alias("scene_numbers"),
        F.min("page").alias("low"), F.max_by("page", "scene_number").alias("high"), F.count("*").alias("scene_count"),
    )
    every = pages.select("script_id").distinct().select("script_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("act"))
    low = F.when(F.col("act") == 1, F.least("low", F.lit(1.0))).otherwise(F.col("low"))
    return every.join(found, ["script_id", "act"], "left").select(
        "script_id", "act", F.coalesce("scene_numbers", F.array().cast("array<int>")).alias("scene_numbers"),
        F.when(F.col("low").isNotNull(), rounded(low, 1)).alias("page_start"), rounded(F.col("high"), 1).alias("page_end"), F.coalesce("scene_count", F.lit(0)).alias("scene_count"),
    )


def pacing_curve(elements: DataFrame, pages: DataFrame, segment_pages: int = 5) -> DataFrame:
    """(script_id, segment, page_start, page_end, dialogue_words, action_words, scene_count); empty segments stay."""
    n = word_count(F.col("text"))
    volume = elements.groupBy("script_id", "scene_number").agg(
        F.sum(F.when(F.col("type") == "dialogue", n).otherwise(0)).alias("d"), F.sum(F.when(F.col("type") == "action", n).otherwise(0)).alias("a")
    )
    total = pages.groupBy("script_id").agg(F.max("page").alias("total"))
    total = total.withColumn("segments", F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(F.nullif("total", F.lit(0.0)), F.lit(1.0)) / segment_pages)))
    placed = pages.join(total, "script_id").withColumn("segment", F.least(F.floor(F.col("page") / segment_pages), F.col("segments") - 1))
    sums = placed.join(volume, ["script_id", "scene_number"], "left").groupBy("script_id", "segment").agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("dialogue_words"), F.coalesce(F.sum("a"), F.lit(0)).alias("action_words"), F.count("*").alias("scene_count")
    )
    every = total.select("script_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1)).alias("segment"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(sums, ["script_id", "segment"], "left").select(
        "script_id", "segment", (F.col("segment") * segment_pages + 1).alias("page_start"),
        F.least((F.col("segment") + 1) * segment_pages, F.ceil(F.coalesce(F.nullif("total", F.lit(0.0)), F.lit(1.0)))).alias("page_end"),
        zero("dialogue_words"), zero("action_words"), zero("scene_count"),
    )


def quiet_gaps(rows: DataFrame, keys: list[str], order: str, least: int = MIN_GAP) -> DataFrame:
    """(keys, after, absent): stretches of at least `least` positions between an entity's appearances."""
    seen = rows.select(*keys, order).distinct()
    before = F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return seen.withColumn("after", before).withColumn("absent", F.col(order) - before - 1).where(F.col("absent") >= least).select(*keys, "after", "absent")


def character_arc(presence: DataFrame, scenes: DataFrame, elements: DataFrame, rounded=F.bround) -> DataFrame:
    """Per character: first and last scene, scenes and their share, dialogue lines, gaps, whether throughout."""
    keys = ["script_id", "character"]
    seen = presence.groupBy(*keys).agg(F.min("scene_number").alias("first_scene"), F.max("scene_number").alias("last_scene"), F.count_distinct("scene_number").alias("scene_count"))
    total = scenes.groupBy("script_id").agg(F.count("*").alias("total"))
    said = elements.where("type = 'dialogue'").groupBy(*keys).agg(F.count("*").alias("dialogue_lines"))
    gaps = quiet_gaps(presence, keys, "scene_number").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("after", "absent"))).alias("quiet_gaps"), F.count("*").alias("n_gaps"))
    rows = seen.join(total, "script_id").join(said, keys, "left").join(gaps, keys, "left")
    rows = rows.select(
        *keys, "first_scene", "last_scene", "scene_count", rounded(F.lit(100.0) * F.col("scene_count") / F.col("total"), 1).alias("presence_pct"),
        F.coalesce("dialogue_lines", F.lit(0)).alias("dialogue_lines"), "quiet_gaps", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        (F.col("scene_count") * 10 >= F.col("total") * int(10 * THROUGHOUT)).alias("appears_throughout"),
    )
    return rows.withColumn("arc_rank", F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc("scene_count"), "first_scene", "character")))
