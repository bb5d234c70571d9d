"""Rule base: a small dimension table, its filters, statistics and prompt fragments."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule levels that speak to each finding category. Fixed values; plot_thread is mapped to its own level.
CATEGORY_LEVELS = {
    "theme": ["story_macro"], "character": ["character", "relationship"], "structure": ["structure_pacing"], "scene_function": ["scene"], "dialogue": ["dialogue"],
    "plot_thread": ["plot_thread"],
}


def select(rules: DataFrame, level: str | None = None, category: str | None = None, requires: str | None = None, tier: str | None = None) -> DataFrame:
    out = rules
    for column, value in (("taxonomy_level", level), ("category", category), ("confidence_tier", tier)):
        out = out.where(F.col(column) == value) if value is not None else out
    return out.where(F.array_contains("requires", requires)) if requires is not None else out


def stats(rules: DataFrame) -> DataFrame:
    """(dimension, value, rules): total, by tier and by level."""
    members = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("tier").alias("dimension"), F.col("confidence_tier").alias("value")),
        F.struct(F.lit("level").alias("dimension"), F.col("taxonomy_level").alias("value")),
    )
    return rules.select(F.explode(members).alias("m")).groupBy("m.dimension", "m.value").agg(F.count("*").alias("rules"))


def for_findings(findings: DataFrame, rules: DataFrame, levels: dict[str, list[str]] = CATEGORY_LEVELS) -> DataFrame:
    """findings with the rules of their category's levels; deterministic passes' own rule ids have none, so a left join."""
    return findings.join(of_categories(rules, levels), "category", "left")


def of_categories(rules: DataFrame, levels: dict[str, list[str]] = CATEGORY_LEVELS) -> DataFrame:
    """(category, applicable_rule, taxonomy_level): the rules that speak to each finding category."""
    pairs = rules.sparkSession.createDataFrame([(c, x) for c, xs in levels.items() for x in xs], "category string, taxonomy_level string")
    named = rules.withColumnRenamed("category", "rule_category").withColumnRenamed("id", "applicable_rule")
    return pairs.join(named, "taxonomy_level").select("category", "applicable_rule", "taxonomy_level")


def fragment(rules: DataFrame) -> DataFrame:
    """(taxonomy_level, fragment): rules as lines of a prompt, attributed to their source."""
    origin = F.concat_ws(", ", "source.originator", "source.work")
    line = F.concat(F.lit("- "), F.col("name"), F.when(origin != "", F.concat(F.lit(" ("), origin, F.lit(")"))).otherwise(""), F.lit(": "), F.col("definition"), F.lit(" Look for: "), F.col("detection_signal"))
    return rules.groupBy("taxonomy_level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("fragment"))
