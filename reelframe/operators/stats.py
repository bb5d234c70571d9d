"""Counts and shares over elements and scenes. All take tables keyed by script_id and return DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

WORDS_PER_MINUTE = 160


def scene_estimates(elements: DataFrame, rounded=F.bround) -> DataFrame:
    """Per scene: words of speech, parentheticals and action, lines of dialogue, minutes (at least 0.1)."""
    spoken = F.col("type").isin("dialogue", "parenthetical", "action")
    rows = elements.where("scene_number > 0").groupBy("script_id", "scene_number").agg(
        F.coalesce(F.sum(F.when(spoken, word_count(F.col("text")))), F.lit(0)).alias("words"),
        F.count(F.when(F.col("type") == "dialogue", 1)).alias("dialogue_lines"),
    )
    return rows.withColumn("minutes", rounded(F.greatest(F.col("words") / WORDS_PER_MINUTE, F.lit(0.1)), 1))


def character_stats(elements: DataFrame, rounded=F.bround) -> DataFrame:
    """Per speaker: lines, words, scenes with dialogue, share of all dialogue words in percent.

    One shuffle on (script_id, character); shares come from a window over those totals, not over elements.
    """
    said = elements.where("type = 'dialogue' and character is not null")
    rows = said.groupBy("script_id", "character").agg(
        F.count("*").alias("lines"), F.sum(word_count(F.col("text"))).alias("words"), F.count_distinct("scene_number").alias("scenes")
    )
    total = F.sum("words").over(Window.partitionBy("script_id"))
    return rows.withColumn("share_pct", rounded(F.lit(100.0) * F.col("words") / F.greatest(total, F.lit(1)), 1))


def dialogue_action_ratio(elements: DataFrame, rounded=F.bround) -> DataFrame:
    """Per script: dialogue and action words and their percentages, null where there are no words."""
    count = word_count(F.col("text"))
    rows = elements.groupBy("script_id").agg(
        F.coalesce(F.sum(F.when(F.col("type") == "dialogue", count)), F.lit(0)).alias("dialogue_words"),
        F.coalesce(F.sum(F.when(F.col("type") == "action", count)), F.lit(0)).alias("action_words"),
    )
    total = F.nullif(F.col("dialogue_words") + F.col("action_words"), F.lit(0))
    return rows.withColumn("dialogue_pct", rounded(F.lit(100.0) * F.col("dialogue_words") / total, 1)).withColumn(
        "action_pct", rounded(F.lit(100.0) * F.col("action_words") / total, 1)
    )


def usage(rows: DataFrame, key: str, order: str, group: str = "script_id") -> DataFrame:
    """How often each value of `key` occurs per group, most used first, then first seen."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count("*").alias("uses"), F.min(order).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("uses"), "first_seen", key))
    return counted.withColumn("usage_rank", rank)


def location_usage(scenes: DataFrame) -> DataFrame:
    return usage(scenes, "location", "scene_number")


def scene_length_stats(estimates: DataFrame, rounded=F.bround) -> DataFrame:
    """Per script: number of scenes, mean and median words, the first shortest and first longest scene."""
    return estimates.groupBy("script_id").agg(
        F.count("*").alias("scene_count"),
        rounded(F.avg("words"), 1).alias("mean_words"),
        F.median("words").alias("median_words"),
        F.min_by("scene_number", F.struct("words", "scene_number")).alias("shortest_scene"),
        F.max_by("scene_number", F.struct(F.col("words"), -F.col("scene_number"))).alias("longest_scene"),
    )


def time_breakdown(scenes: DataFrame, rounded=F.bround) -> DataFrame:
    """Rows (script_id, dimension, value, scenes, pct): interior/exterior, time of day, and night scenes.

    One pass: each scene is exploded into its three memberships before the single aggregate.
    """
    members = F.array(
        F.struct(F.lit("int_ext").alias("dimension"), F.coalesce(F.nullif(F.col("int_ext"), F.lit("")), F.lit("UNKNOWN")).alias("value"), F.lit(1).alias("one")),
        F.struct(F.lit("time").alias("dimension"), F.coalesce(F.nullif(F.upper("time_of_day"), F.lit("")), F.lit("UNSPECIFIED")).alias("value"), F.lit(1).alias("one")),
        F.struct(F.lit("night").alias("dimension"), F.lit("NIGHT").alias("value"), F.coalesce(F.contains(F.upper("time_of_day"), F.lit("NIGHT")), F.lit(False)).cast("int").alias("one")),
    )
    rows = scenes.select("script_id", F.explode(members).alias("m")).groupBy("script_id", "m.dimension", "m.value")
    rows = rows.agg(F.sum("m.one").alias("scenes"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("script_id", "dimension"))
    return rows.withColumn("pct", rounded(F.lit(100.0) * F.col("scenes") / total, 1)).drop("n")


def report(elements: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row a script: runtime minutes (sum of rounded minutes), scene counts and dialogue shares."""
    estimates = scene_estimates(elements)
    runtime = estimates.groupBy("script_id").agg(F.sum("minutes").alias("runtime_minutes"))
    lengths = scene_length_stats(estimates)
    return scenes.select("script_id").distinct().join(runtime, "script_id", "left").join(lengths, "script_id", "left").join(dialogue_action_ratio(elements), "script_id", "left")
