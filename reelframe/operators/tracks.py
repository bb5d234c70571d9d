"""Character tracks, libraries over many projects, and reply-time metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAIN_SCENES, MAIN_DIALOGUE, SUPPORTING, RING = 0.25, 0.15, 0.08, 40


def importance(rows: DataFrame, scenes: str, total: str, lines: str, all_lines: str) -> DataFrame:
    """rows plus importance: main, supporting or bit, by the shares of scenes and of dialogue."""
    s, d = F.col(scenes) / F.greatest(F.col(total), F.lit(1)), F.col(lines) / F.greatest(F.col(all_lines), F.lit(1))
    kind = F.when((s >= MAIN_SCENES) | (d >= MAIN_DIALOGUE), "main").when(s >= SUPPORTING, "supporting").otherwise("bit")
    return rows.withColumn("importance", kind)


def character_tracks(index: DataFrame, timeline: DataFrame, partners: DataFrame, dials: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """One row a character: presence, lines, importance, partners and, by upper-case name, dials and reads.

    index: graph.character_index; partners: graph.top_partners. Of several dials or reads of a name the last wins.
    """
    keys = ["script_id", "character"]
    total = timeline.groupBy("script_id").agg(F.count("*").alias("total"))
    lines = F.aggregate(F.map_values(F.coalesce("scene_dialogue_counts", F.create_map().cast("map<int,int>"))), F.lit(0), lambda s, x: s + x)
    rows = index.withColumn("lines", lines).withColumn("scene_count", F.size("scenes_present")).join(total, "script_id", "left")
    rows = rows.withColumn("total", F.coalesce("total", "scene_count")).withColumn("all_lines", F.sum("lines").over(Window.partitionBy("script_id")))
    rows = importance(rows, "scene_count", "total", "lines", "all_lines")
    friends = partners.groupBy("script_id", F.col("member").alias("character")).agg(F.array_sort(F.collect_list(F.struct("partner_rank", "partner", "together"))).alias("interactions"))
    rows = rows.join(friends, keys, "left").withColumn("upper_name", F.upper("character"))
    for name, extra in (("dials", dials), ("read", reads)):
        if extra is not None:
            last = extra.groupBy("script_id", F.upper("character").alias("upper_name")).agg(F.max_by(F.struct(*[c for c in extra.columns if c not in keys]), "seq").alias(name))
            rows = rows.join(last, ["script_id", "upper_name"], "left")
    order = [F.when(F.col("importance") == "main", 0).when(F.col("importance") == "supporting", 1).otherwise(2), F.desc("scene_count"), F.desc("lines"), F.col("character")]
    return rows.withColumn("track_rank", F.row_number().over(Window.partitionBy("script_id").orderBy(*order))).drop("upper_name", "all_lines")


def library(projects: DataFrame, findings: DataFrame, index: DataFrame, exclude: str | None = None, themes: int = 4, cast: int = 8, cut: int = 120) -> DataFrame:
    """(script_id, title, themes, characters) of every project but `exclude`."""
    rows = projects if exclude is None else projects.where(F.col("script_id") != exclude)
    first = F.row_number().over(Window.partitionBy("script_id").orderBy("finding_index"))
    theme = findings.where("category = 'theme'").withColumn("r", first).where(F.col("r") <= themes)
    theme = theme.groupBy("script_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("issue", 1, cut).alias("t")))), lambda x: x["t"]).alias("themes"))
    top = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc(F.size("scenes_present")), "character"))
    people = index.withColumn("r", top).where(F.col("r") <= cast).groupBy("script_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "character"))), lambda x: x["character"]).alias("characters"))
    return rows.select("script_id", "title").join(theme, "script_id", "left").join(people, "script_id", "left")


def digest(books: DataFrame) -> DataFrame:
    line = F.concat(F.col("title"), F.lit(": "), F.array_join(F.coalesce("themes", F.array().cast("array<string>")), "; "), F.lit(" ("), F.array_join(F.coalesce("characters", F.array().cast("array<string>")), ", "), F.lit(")"))
    return books.select("script_id", "title", line.alias("digest"))


def group_digest(rows: DataFrame, key: str, order: str, text: str, most: int = 4, cut: int = 120) -> DataFrame:
    """(key, n, digest): per group its number of rows and the openings of its first `most`.

    Only the least `most` of each partial group survive the shuffle: the cap runs before texts are collected.
    """
    head = F.substring(F.regexp_replace(text, r"\s+", " "), 1, cut)
    part = F.pmod(F.xxhash64(order), F.lit(64))
    local = rows.select(key, order, head.alias("t"), part.alias("p")).withColumn("r", F.row_number().over(Window.partitionBy(key, "p").orderBy(order)))
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    few = local.where(F.col("r") <= most).withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("r") <= most)
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " | ")
    return n.join(few.groupBy(key).agg(text_.alias("digest")), key)


def rolling(rows: DataFrame, keys: list[str], order: str, value: str, n: int = RING) -> DataFrame:
    """rows plus rolling_mean over the last n values of each key, and rolling_n."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("rolling_mean", F.avg(value).over(w)).withColumn("rolling_n", F.count(value).over(w))


def progress(stages: DataFrame, order: str = "stage_order") -> DataFrame:
    """stages (script_id, stage, weight, status, ...) plus done_pct: the share of weight in stages complete so far."""
    w = Window.partitionBy("script_id")
    done = F.sum(F.when(F.col("status") == "complete", F.col("weight")).otherwise(0)).over(w.orderBy(order))
    return stages.withColumn("done_pct", F.lit(100.0) * done / F.sum("weight").over(w))


def eta(progress_rows: DataFrame) -> DataFrame:
    """seconds left, from (elapsed, done_pct); null before anything is done."""
    return progress_rows.withColumn("eta", F.when(F.col("done_pct") > 0, F.col("elapsed") * (100 - F.col("done_pct")) / F.col("done_pct")))
