"""Sinks: screenplays as Fountain, plain text or Final Draft XML, and tables as JSON or Markdown."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .screenplay import FDX_TYPES

BLOCK = ["character", "parenthetical", "dialogue"]


def text_of(elements: DataFrame, scripts: DataFrame, marked: bool) -> DataFrame:
    """(script_id, text): one document a script. marked: transitions get Fountain's > mark.

    A blank line follows every element but those whose block goes on; a cue begins a block of its own, so that
    reading the text again gives the same elements.
    """
    by = Window.partitionBy("script_id", "scene_number").orderBy("element_index")
    goes_on = F.col("type").isin(*BLOCK) & F.coalesce(F.lead("type").over(by).isin(*BLOCK[1:]), F.lit(False))
    shown = F.when((F.col("type") == "parenthetical") & ~F.col("text").startswith("("), F.concat(F.lit("("), F.col("text"), F.lit(")")))
    shown = shown.when((F.col("type") == "transition") & F.lit(marked), F.concat(F.lit("> "), F.col("text"))).otherwise(F.col("text"))
    lines = elements.where("text <> ''").withColumn("line", F.concat(shown, F.when(goes_on, "").otherwise("\n")))
    body = lines.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_number", "element_index", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.when(F.col("title") != "", F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"))).otherwise(""), F.when(F.col("author") != "", F.concat(F.lit("Author: "), F.col("author"), F.lit("\n"))).otherwise(""))
    rows = scripts.select("script_id", head.alias("head")).join(body, "script_id", "left")
    whole = F.concat(F.when(F.col("head") != "", F.concat("head", F.lit("\n"))).otherwise(""), F.coalesce("body", F.lit("")))
    return rows.select("script_id", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("text"))


def to_fountain(elements: DataFrame, scripts: DataFrame) -> DataFrame:
    return text_of(elements, scripts, True)


def to_txt(elements: DataFrame, scripts: DataFrame) -> DataFrame:
    return text_of(elements, scripts, False)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_fdx(elements: DataFrame, scripts: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for k, v in FDX_TYPES.items() for x in (v, k)])
    number = F.when(F.col("type") == "scene_heading", F.concat(F.lit(' Number="'), F.col("scene_number").cast("string"), F.lit('"'))).otherwise("")
    line = F.concat(F.lit('<Paragraph Type="'), kinds[F.col("type")], F.lit('"'), number, F.lit("><Text>"), escaped(F.col("text")), F.lit("</Text></Paragraph>"))
    body = elements.where("text <> ''").groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_number", "element_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    page = lambda c, prefix="": F.when(F.col(c) != "", F.concat(F.lit(f"<Paragraph><Text>{prefix}"), escaped(F.col(c)), F.lit("</Text></Paragraph>"))).otherwise("")
    rows = scripts.join(body, "script_id", "left")
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<FinalDraft DocumentType="Script" Version="1">\n<Content>\n'), F.coalesce("body", F.lit("")), F.lit("\n</Content>\n<TitlePage><Content>"), page("title"), page("author", "by "), F.lit("</Content></TitlePage>\n</FinalDraft>\n"))
    return rows.select("script_id", text.alias("text"))


EXPORTS = {"fountain": to_fountain, "txt": to_txt, "fdx": to_fdx}


def export(elements: DataFrame, scripts: DataFrame, form: str) -> DataFrame:
    if form not in EXPORTS:
        raise ValueError(f"unsupported export format: {form}")
    return EXPORTS[form](elements, scripts)


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder a script: Spark writes the parts, partitioned by script."""
    texts.select("script_id", F.col("text").alias("value")).write.partitionBy("script_id").mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def script_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(script_id, value): the nested document of each script as JSON."""
    e = F.struct("element_index", "type", "text", "character", "line_start")
    bodies = tables["elements"].groupBy("script_id", "scene_number").agg(F.array_sort(F.collect_list(e)).alias("elements"))
    cast = tables["presence"].groupBy("script_id", "scene_number").agg(F.array_sort(F.collect_set("character")).alias("characters_present"))
    scenes = tables["scenes"].join(bodies, ["script_id", "scene_number"], "left").join(cast, ["script_id", "scene_number"], "left")
    nested = scenes.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in scenes.columns if c != "script_id"]))).alias("scenes"))
    front = bodies.where("scene_number = 0").select("script_id", F.col("elements").alias("front_matter"))
    rows = tables["scripts"].join(nested, "script_id", "left").join(front, "script_id", "left")
    return rows.select("script_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def section(rows: DataFrame, place: int, title: str, line: Column, *at: str) -> DataFrame:
    """(script_id, place, body): a titled part of each script's report, its lines ordered by `at`."""
    listed = F.array_sort(F.collect_list(F.struct(*at, line.alias("line"))))
    return rows.groupBy("script_id").agg(F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("body")).withColumn("place", F.struct(F.lit(place).alias("part"), F.lit(0).cast("long").alias("at")))


def named_fields(*fields: tuple[str, Column]) -> Column:
    """A line a field that has a value."""
    return F.concat_ws("\n", *[F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), value)) for name, value in fields])


def scene_list(scenes: Column, otherwise: str) -> Column:
    return F.when(F.size(F.coalesce(scenes, F.array().cast("array<int>"))) > 0, F.array_join(F.transform(scenes, lambda n: F.concat(F.lit("scene "), n.cast("string"))), ", ")).otherwise(otherwise)


def markdown_report(
    findings: DataFrame, report: DataFrame, coverage: DataFrame | None = None, logline: DataFrame | None = None, reads: DataFrame | None = None, entries: DataFrame | None = None,
    drags: DataFrame | None = None, dials: DataFrame | None = None, formatting: DataFrame | None = None, verification: DataFrame | None = None,
) -> DataFrame:
    """(script_id, markdown): figures, then what is given of coverage, logline test, reads, every category's findings in input
    order, ledger, drags, dials, formatting and the count of verified quotes. A script has the sections it has rows for."""
    mark = F.when(F.col("verification.status") == "verified", "").when(F.col("verification.status") == "not_found", " (quote not found)").otherwise("") if "verification" in findings.columns else F.lit("")
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), F.col("issue"), mark, F.when(F.col("evidence_quote") != "", F.concat(F.lit("\n  > "), F.col("evidence_quote"))).otherwise(""))
    part = findings.groupBy("script_id", "category").agg(F.min("finding_index").cast("long").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    parts = part.select("script_id", F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.col("body")).alias("body"), F.struct(F.lit(4).alias("part"), "at").alias("place"))
    listed = lambda c: F.array_join(F.col(c), "; ")
    found = lambda: F.when(F.col("verification.status") == "verified", "").otherwise(" (quote not found)")
    noted = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("; "), F.col("note"))).otherwise("")
    given = [
        (coverage, 1, "Coverage", lambda: named_fields(("Recommendation", F.upper("recommendation")), ("Logline", F.col("logline")), ("Genre", F.col("genre")), ("Tone", F.col("tone")), ("Synopsis", F.col("synopsis")), ("Strengths", listed("strengths")), ("Weaknesses", listed("weaknesses"))), []),
        (logline, 2, "Logline", lambda: named_fields(("Signal", F.upper("signal")), ("Works", F.col("what_works")), ("Muddles", F.col("what_muddles")), ("Missing", F.col("missing")), ("Tightened", F.col("tightened"))), []),
        (reads, 3, "Characters", lambda: F.concat(F.lit("- **"), "character", F.lit("** "), F.coalesce("how_reads", F.lit("")), F.when(F.col("evidence_quote") != "", F.concat(F.lit("\n  > "), F.col("evidence_quote"), found())).otherwise("")), ["finding_index"]),
        (entries, 5, "Setups and payoffs", lambda: F.concat(F.lit("- **"), "status", F.lit("** "), "setup", F.lit(" ("), scene_list(F.col("setup_scenes"), "general"), F.lit("; payoff: "), scene_list(F.col("payoff_scenes"), "never"), F.lit(")"), noted), ["queue_rank"]),
        (drags, 6, "Pace", lambda: F.concat(F.lit("- scene "), F.col("scene_number").cast("string"), F.lit(": "), F.round("pace_score").cast("int").cast("string"), F.lit(" of 100")), ["scene_number"]),
        (dials, 7, "Dials", lambda: F.concat(F.lit("- "), "character", F.lit(", "), "trait", F.lit(": "), F.col("score").cast("string"), F.lit(" of 10"), noted), ["character", "trait"]),
        (formatting, 8, "Formatting", lambda: F.concat(F.lit("- **"), "severity", F.lit("** "), scene_list(F.col("scene_refs"), "general"), F.lit(": "), "message"), ["finding_index"]),
        (verification, 9, "Quotes", lambda: F.concat(*[x for s in ("verified", "not_found", "no_quote", "scene_not_found") for x in (F.lit(f"{'' if s == 'verified' else ', '}{s.replace('_', ' ')} "), F.col(s).cast("string"))]), []),
    ]
    for rows, place, title, text, at in given:
        if rows is not None:
            parts = parts.unionByName(section(rows, place, title, text(), *at))
    body = parts.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# Report\n\nScenes: "), F.coalesce(F.col("scene_count").cast("string"), F.lit("0")), F.lit("\nMinutes: "), F.coalesce(F.col("runtime_minutes").cast("string"), F.lit("0")), F.lit("\n\n"))
    return report.join(body, "script_id", "left").select("script_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def snapshot(tables: dict[str, DataFrame], path: str, draft: str) -> None:
    """Writes every table under its name, partitioned by draft; an existing draft of that name is replaced."""
    for name, rows in tables.items():
        rows.withColumn("draft_name", F.lit(draft)).write.partitionBy("draft_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")
