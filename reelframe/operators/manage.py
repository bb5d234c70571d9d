"""Small-table state: names, stages, notes, sessions. Each function returns the new table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitised_stem


def unique_names(uploads: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """uploads (filename, arrived) plus project: the sanitised stem, or the first of stem_2, stem_3 ... that is free.

    A name is free if no project of `taken` has it, and no upload's own stem is the same (that upload comes first for
    it). Uploads of one stem take the free names in order of arrival.
    """
    rows = uploads.withColumn("stem", sanitised_stem(F.col("filename")))
    stems = rows.groupBy("stem").agg(F.count("*").alias("n"))
    gone = stems.select(F.col("stem").alias("project"), F.lit(True).alias("natural"))
    if taken is not None:
        gone = gone.unionByName(taken.select("project", F.lit(False).alias("natural")).distinct())
    # as many names as uploads, and one more for each name that may be gone already
    root = F.explode(F.array_distinct(F.array(F.col("project"), F.regexp_replace("project", r"_\d+$", ""))))
    lost = gone.select(root.alias("stem")).groupBy("stem").agg(F.count("*").alias("lost"))
    names = stems.join(lost, "stem", "left").select("stem", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("lost", F.lit(0)))).alias("k"))
    names = names.withColumn("project", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("k").cast("string"))))
    clash = gone.groupBy("project").agg(F.bool_and("natural").alias("natural"))
    free = names.join(clash, "project", "left").where(F.col("natural").isNull() | (F.col("natural") & (F.col("k") == 1)))
    free = free.select("stem", "project", F.row_number().over(Window.partitionBy("stem").orderBy("k")).alias("nth"))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("arrived", "filename"))
    return rows.withColumn("nth", nth).join(free, ["stem", "nth"]).drop("stem", "nth")


def set_stage(stages: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest status of each (script_id, stage); changes with a later ts win, of one ts the greatest (status, detail)."""
    columns = ["script_id", "stage", "status", "detail", "ts"]
    rows = stages.select(*columns).unionByName(changes.select(*columns))
    latest = rows.groupBy("script_id", "stage").agg(F.max(F.struct("ts", "status", "detail")).alias("p"))
    return latest.select("script_id", "stage", "p.status", "p.detail", "p.ts")


def outstanding(requested: DataFrame, stages: DataFrame) -> DataFrame:
    """Requested (script_id, stage) that are not complete yet."""
    return requested.join(stages.where("status = 'complete'"), ["script_id", "stage"], "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], removed: str | None = None) -> DataFrame:
    """table with changed rows replaced and new ones added; where `removed` names a flag, flagged rows go."""
    kept = table.join(changes.select(*keys), keys, "left_anti")
    fresh = changes.where(~F.coalesce(F.col(removed), F.lit(False))).drop(removed) if removed else changes
    return kept.unionByName(fresh, allowMissingColumns=True)


def fork(messages: DataFrame, session: str, source: str, name: str) -> DataFrame:
    """messages plus a copy of a branch's history under a new name."""
    copy = messages.where((F.col("session_id") == session) & (F.col("branch") == source)).withColumn("branch", F.lit(name))
    return messages.unionByName(copy)


def delete_branch(messages: DataFrame, session: str, name: str) -> DataFrame:
    if name == "main":
        raise ValueError("the main branch cannot be deleted")
    return messages.where(~((F.col("session_id") == session) & (F.col("branch") == name)))


def auto_title(text: str = "text") -> Column:
    """The first line with content, without markup at its start, at most 48 characters."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^[#*\- ]+", "")), 1, 48)


def newest_first(rows: DataFrame, ts: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(ts), key)


def with_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """Notes and stashed lines that hold a text at all."""
    return rows.where(F.trim(F.coalesce(text, F.lit(""))) != "")


def shown(rows: DataFrame, status: str | None = None, importance: str | None = None) -> DataFrame:
    """Items as a list shows them: of one status, of one importance, and never suppressed ones."""
    for column, value in (("status", status), ("importance", importance)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows.where(~F.coalesce("suppressed", F.lit(False))) if "suppressed" in rows.columns else rows


def activated(working: dict[str, DataFrame], draft: dict[str, DataFrame], stages: DataFrame, derived: list[str], keep: Callable[[dict[str, DataFrame]], None]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, stages) with a draft put in the working copy's place. keep is called with the working copy first, to
    save it (see sources.export.snapshot); stages derived from it wait again for the draft's scripts."""
    keep(working)
    scripts = draft["elements"].select("script_id").distinct()
    again = stages.where(F.col("stage").isin(*derived)).join(scripts, "script_id", "left_semi")
    again = again.withColumn("status", F.lit("pending")).withColumn("detail", F.lit(None).cast("string"))
    other = {name: rows.join(scripts, "script_id", "left_anti").unionByName(draft[name], allowMissingColumns=True) for name, rows in working.items()}
    return other, upsert(stages, again, ["script_id", "stage"])


def needs_rebuild(working: DataFrame, parsed: DataFrame) -> DataFrame:
    """Scripts whose parse is newer than their working copy and that have no edits. (script_id, ts[, edits])"""
    rows = parsed.select("script_id", F.col("ts").alias("parsed_ts")).join(working, "script_id", "left")
    return rows.where("ts is null or (parsed_ts > ts and coalesce(edits, 0) = 0)").select("script_id")


def graduated(cards: DataFrame, sessions: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(premises, sessions) of the projects that ideas become. cards: (idea_id, content, ...); sessions: (idea_id, session_id, ...);
    moves: (idea_id, project). A premise is the idea's card with its page, empty if it has none; an idea's sessions are copied, and
    where two ideas go to one project with the same session, the one of the greater idea_id stays."""
    premises = moves.join(cards, "idea_id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    copied = sessions.join(moves, "idea_id").withColumn("n_", F.row_number().over(Window.partitionBy("project", "session_id").orderBy(F.desc("idea_id"))))
    return premises, copied.where("n_ = 1").drop("n_")
