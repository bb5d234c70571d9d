"""Screenplay files to tables, many scripts at once.

The text formats need no sequential code: what a line is depends on the lines before it only through resets
(blank lines, headings, transitions), so islands between resets and window functions inside them decide.

Tables: lines (script_id, line_no, raw[, page, layout]) -> elements (script_id, scene_number 0 for front matter,
element_index, type, text, character, line_start, page), scenes (script_id, scene_number, heading_raw, int_ext,
location, time_of_day, page_start, page_end), scripts, presence and warnings.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as L

FORMATS = {"fountain": "fountain", "txt": "txt", "md": "md", "fdx": "fdx", "pdf": "pdf"}
#: Final Draft paragraph types. Fixed values.
FDX_TYPES = {
    "Scene Heading": "scene_heading", "Action": "action", "Character": "character", "Dialogue": "dialogue",
    "Parenthetical": "parenthetical", "Transition": "transition", "Shot": "shot", "General": "general",
}


def file_format(path: Column) -> Column:
    """The format that a path's extension names; an unknown one fails the query."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(extension.isin(*FORMATS), extension).otherwise(F.raise_error(F.concat(F.lit("unsupported screenplay format: "), path)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, source_format, source_filename, text) of the screenplay files under a path."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("script_id"), name.alias("source_filename"), F.col("value").alias("text"))
    return raw.withColumn("source_format", file_format(F.col("source_filename")))


def split_lines(texts: DataFrame) -> DataFrame:
    """One row a line, numbered from 0; block comments are gone from Fountain files before they are numbered."""
    body = F.when(F.col("source_format") == "fountain", F.regexp_replace("text", r"(?s)/\*.*?\*/", "")).otherwise(F.col("text"))
    return texts.select("script_id", "source_format", "source_filename", F.posexplode(F.split(body, "\n")).alias("line_no", "raw"))


def title_pages(lines: DataFrame) -> DataFrame:
    """(script_id, start, title, author): key-value lines before the first blank one, if the first line is one.

    An indented line continues the value above it; any other line ends the title page.
    """
    by = Window.partitionBy("script_id").orderBy("line_no")
    key = F.regexp_extract("raw", r"^([A-Za-z][A-Za-z0-9 ]{0,30}):\s*(.*)$", 1)
    value = F.regexp_extract("raw", r"^([A-Za-z][A-Za-z0-9 ]{0,30}):\s*(.*)$", 2)
    kind = F.when(F.trim("raw") == "", "blank").when(key != "", "key").when(F.col("raw").rlike(r"^[ \t]"), "more").otherwise("end")
    rows = lines.where(F.col("source_format").isin("fountain", "md")).withColumn("kind", kind).withColumn("key", F.lower(F.trim(key))).withColumn("value", F.trim(value))
    stop = F.min(F.when(F.col("kind").isin("blank", "end"), F.col("line_no"))).over(Window.partitionBy("script_id"))
    first = F.min_by("kind", "line_no").over(Window.partitionBy("script_id"))
    last = F.max("line_no").over(Window.partitionBy("script_id"))
    stop_kind = F.min_by("kind", F.when(F.col("kind").isin("blank", "end"), F.col("line_no"))).over(Window.partitionBy("script_id"))
    rows = rows.select("*", stop.alias("stop"), first.alias("first"), last.alias("last"), stop_kind.alias("stop_kind")).where(F.col("first").isin("key", "blank"))
    head = rows.where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).withColumn("field", F.count(F.when(F.col("kind") == "key", 1)).over(by))
    fields = head.groupBy("script_id", "field").agg(
        F.first(F.when(F.col("kind") == "key", F.col("key")), ignorenulls=True).alias("key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("kind") == "key", F.col("value")).otherwise(F.trim("raw")).alias("v")))), lambda x: x["v"]), " ").alias("value"),
        F.max("field").alias("n"),
    )
    latest = lambda name: F.max_by("value", F.when(F.col("key") == name, F.col("n")))
    named = fields.groupBy("script_id").agg(latest("title").alias("title"), F.coalesce(F.nullif(latest("author"), F.lit("")), latest("credit")).alias("author"))
    start = F.when(F.col("stop").isNull(), F.col("last") + 1).when(F.col("stop_kind") == "blank", F.col("stop") + 1).otherwise(F.col("stop"))
    starts = rows.groupBy("script_id").agg(F.max(start).alias("start"))
    return starts.join(named, "script_id", "left").select("script_id", "start", "title", "author")


def classify(lines: DataFrame) -> DataFrame:
    """Elements of text lines (script_id, source_format, line_no, raw[, page]) that begin at the script's first line."""
    page = F.col("page") if "page" in lines.columns else F.lit(None).cast("int")
    rows = lines.select("script_id", "source_format", "line_no", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("s"), page.alias("page"))
    by = Window.partitionBy("script_id").orderBy("line_no")
    # the next two lines with text: running windows over the lines in reverse
    after = Window.partitionBy("script_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n1", F.last(F.when(F.col("s") != "", F.col("s")), True).over(after))
    rows = rows.withColumn("n2", F.last(F.when(F.col("s") != "", F.struct("n1")), True).over(after)["n1"])
    s, marked = F.col("s"), F.col("source_format").isin("fountain", "md")
    kind = (
        F.when(s == "", "blank")
        .when(marked & s.rlike(r"^\.[^.]"), "forced_heading")
        .when(marked & s.startswith("@"), "forced_cue")
        .when(marked & s.startswith(">") & ~s.endswith("<"), "forced_transition")
        .when(marked & s.rlike("^[#=]"), "dropped")
        .when(marked & s.startswith("~"), "lyric")
        .when(L.is_heading(s), "heading")
        .when(L.is_transition(s), "transition")
        .when(L.is_time_marker(s), "transition")
        .when(L.is_shot(s), "shot")
        .when(L.is_closing(s), "closing")
        .when(L.is_cue(s, F.col("n1"), F.col("n2")), "cue")
        .otherwise("plain")
    )
    rows = rows.withColumn("kind", kind)
    heading = F.col("kind").isin("heading", "forced_heading")
    reset = heading | F.col("kind").isin("blank", "transition", "forced_transition")
    rows = rows.withColumn("scene_number", F.count(F.when(heading, 1)).over(by).cast("int")).withColumn("island", F.count(F.when(reset, 1)).over(by))
    inside = Window.partitionBy("script_id", "island").orderBy("line_no")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("kind") == "forced_cue") | ((F.col("kind") == "cue") & (F.col("scene_number") > 0))
    first = F.min(F.when(opens, F.col("line_no"))).over(so_far)
    cue = (F.col("kind") == "forced_cue") | (opens & (F.col("line_no") == first))
    rows = rows.withColumn("opened", first).withColumn("cue", cue)
    name = F.when(F.col("cue"), L.speaker_name(F.when(F.col("kind") == "forced_cue", F.trim(F.substring("s", 2, 1 << 20))).otherwise(s)))
    rows = rows.withColumn("speaker", F.last(name, True).over(so_far)).withColumn("block", F.count(F.when(F.col("cue"), 1)).over(so_far))
    body = F.col("opened").isNotNull() & ~F.col("cue") & ~F.col("kind").isin("shot", "lyric", "dropped") & ~reset
    state = F.when(body & s.endswith(")"), False).when(body & s.startswith("("), True)
    earlier = Window.partitionBy("script_id", "island", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last(state, True).over(earlier), F.lit(False))
    spoken = F.coalesce(F.col("speaker"), F.lit("")) != ""
    kind_of = (
        F.when(heading, "scene_heading")
        .when(F.col("kind").isin("transition", "forced_transition"), "transition")
        .when(F.col("kind") == "shot", "shot")
        .when(F.col("cue"), "character")
        .when(F.col("kind") == "lyric", F.when(F.col("opened").isNotNull() & spoken, "dialogue").otherwise("action"))
        .when(body & spoken, F.when(carried | s.startswith("("), "parenthetical").otherwise("dialogue"))
        .when((F.col("kind") == "closing") & (F.col("scene_number") > 0), "transition")
        .otherwise("action")
    )
    text = F.when(F.col("kind").isin("forced_heading", "forced_cue", "forced_transition", "lyric"), F.trim(F.substring("s", 2, 1 << 20))).otherwise(s)
    out = rows.select("script_id", "scene_number", "line_no", "kind", kind_of.alias("type"), text.alias("text"), "speaker", "page")
    out = out.where(~F.col("kind").isin("blank", "dropped"))
    at = Window.partitionBy("script_id", "scene_number").orderBy("line_no")
    return out.select(
        "script_id", "scene_number", (F.row_number().over(at) - 1).alias("element_index"), "type", "text",
        F.when(F.col("type").isin("character", "dialogue", "parenthetical"), F.col("speaker")).alias("character"),
        F.col("line_no").cast("int").alias("line_start"), "page",
    )


def parse(texts: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables of Fountain, Markdown and plain-text scripts (script_id, source_format, source_filename, text).

    keep: writes a table and reads it back. The elements go through it, so that what is made of them parses no line again.
    """
    lines = split_lines(texts)
    titles = title_pages(lines)
    body = lines.join(titles, "script_id", "left").where(F.col("line_no") >= F.coalesce("start", F.lit(0)))
    elements = classify(body)
    elements = keep(elements) if keep else elements
    scripts = texts.select("script_id", "source_format", "source_filename").join(titles.drop("start"), "script_id", "left")
    return tables(elements, scripts, "medium")


def parse_fdx(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables of Final Draft files: paragraphs carry their types; speech belongs to the last cue before it."""
    # a run without attributes is read as a bare string; wrapping every run keeps one shape
    shaped = F.regexp_replace(F.regexp_replace("text", r"<Text\s[^>/]*/>", ""), r"<Text(?:\s[^>]*[^>/])?>", '<Text x="">')
    doc = texts.withColumn("x", F.from_xml(shaped, schema_of(), {"valueTag": "_VALUE", "attributePrefix": "_"}))
    rows = doc.select("script_id", F.posexplode("x.Content.Paragraph").alias("line_no", "p"))
    kinds = F.create_map(*[F.lit(v) for pair in FDX_TYPES.items() for v in pair])
    said = F.trim(F.array_join(F.transform(F.coalesce("p.Text", F.array()), lambda t: F.coalesce(t["_VALUE"], F.lit(""))), ""))
    rows = rows.select("script_id", "line_no", F.coalesce(kinds[F.col("p._Type")], F.lit("general")).alias("type"), said.alias("text")).where("text <> ''")
    by = Window.partitionBy("script_id").orderBy("line_no")
    rows = rows.withColumn("scene_number", F.count(F.when(F.col("type") == "scene_heading", 1)).over(by).cast("int"))
    carry = F.when(F.col("type") == "character", L.speaker_name(F.col("text"))).when(~F.col("type").isin("dialogue", "parenthetical", "action"), "")
    speaker = F.nullif(F.last(carry, True).over(Window.partitionBy("script_id", "scene_number").orderBy("line_no")), F.lit(""))
    at = Window.partitionBy("script_id", "scene_number").orderBy("line_no")
    elements = rows.select(
        "script_id", "scene_number", (F.row_number().over(at) - 1).alias("element_index"), "type", "text",
        F.when(F.col("type").isin("character", "dialogue", "parenthetical") & (F.col("scene_number") > 0), speaker).alias("character"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("page"),
    )
    front = doc.select("script_id", F.posexplode("x.TitlePage.Content.Paragraph").alias("n", "p")).withColumn("t", said).where("t <> ''")
    front = front.withColumn("n", F.row_number().over(Window.partitionBy("script_id").orderBy("n")))
    credit = F.when(F.col("n").between(2, 5), F.nullif(F.trim(F.regexp_extract("t", r"(?i)^(?:written\s+)?by\s+(.+)$", 1)), F.lit("")))
    titles = front.groupBy("script_id").agg(F.min_by("t", "n").alias("title"), F.min_by(credit, F.when(credit.isNotNull(), F.col("n"))).alias("author"))
    return tables(elements, texts.select("script_id", "source_format", "source_filename").join(titles, "script_id", "left"), "high")


def unreadable_fdx() -> Column:
    """Whether a Final Draft file's text has no document in it."""
    return (F.col("source_format") == "fdx") & ~F.col("text").rlike(r"(?s)<FinalDraft\b.*<Content\b.*</FinalDraft>")


def parse_all(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables of scripts of all text formats and of Final Draft files."""
    plain, marked = parse(texts.where("source_format <> 'fdx'")), parse_fdx(texts.where("source_format = 'fdx'"))
    return {name: rows.unionByName(marked[name], allowMissingColumns=True) for name, rows in plain.items()}


def schema_of():
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    run = StructType([StructField("_VALUE", StringType()), StructField("_x", StringType())])
    paragraphs = StructType([StructField("Paragraph", ArrayType(StructType([StructField("_Type", StringType()), StructField("Text", ArrayType(run))])))])
    return StructType([StructField("Content", paragraphs), StructField("TitlePage", StructType([StructField("Content", paragraphs)]))])


def tables(elements: DataFrame, scripts: DataFrame, confidence: str) -> dict[str, DataFrame]:
    """scripts, scenes, elements, presence and warnings of parsed elements."""
    parts = L.heading_parts(F.col("text"))
    heads = elements.where("type = 'scene_heading'").select("script_id", "scene_number", F.col("text").alias("heading_raw"), parts.alias("h"), F.col("page").alias("first_page"))
    sizes = elements.groupBy("script_id", "scene_number").agg(F.count("*").alias("n"), F.max_by("page", "element_index").alias("page_end"))
    scenes = heads.join(sizes, ["script_id", "scene_number"]).select(
        "script_id", "scene_number", "heading_raw", "h.int_ext", "h.location", "h.time_of_day",
        F.col("first_page").cast("double").alias("page_start"), F.col("page_end").cast("double").alias("page_end"), "n",
    )
    presence = elements.where("scene_number > 0 and character <> ''").select("script_id", "scene_number", "character").distinct()
    counts = scenes.groupBy("script_id").agg(F.count("*").alias("scenes"), F.array_sort(F.collect_list(F.when(F.col("n") <= 1, F.col("scene_number")))).alias("bare"))
    known = scripts.join(counts, "script_id", "left")
    found = known.withColumn("parse_confidence", F.when(F.col("scenes").isNull(), "low").otherwise(confidence))
    warnings = known.where("scenes is null or size(bare) > 0").select(
        "script_id", F.when(F.col("scenes").isNull(), "error").otherwise("warning").alias("severity"),
        F.when(F.col("scenes").isNull(), "no scene headings").otherwise(F.concat(F.size("bare"), F.lit(" scenes have a heading only: "), F.array_join(F.slice("bare", 1, 10), ", "))).alias("message"),
    )
    return {"scripts": found.drop("scenes", "bare"), "scenes": scenes.drop("n"), "elements": elements, "presence": presence, "warnings": warnings}


def pdf_lines(boxes: DataFrame, gap: float = 1.35) -> DataFrame:
    """Lines of PDF text boxes (script_id, page, top, bottom, x0, page_width, text), a blank one at each paragraph gap.

    A gap of more than `gap` times the page's median ends a paragraph; page-number footers are dropped.
    """
    by = Window.partitionBy("script_id", "page").orderBy("top", "x0")
    text = L.undoubled(L.replaced_apostrophe(F.trim("text")))
    rows = boxes.withColumn("text", text).where(~F.col("text").rlike(r"^\d{1,3}\.?$") & (F.col("text") != ""))
    rows = rows.withColumn("gap", F.col("top") - F.lag("bottom").over(by))
    rows = rows.withColumn("middle", F.median("gap").over(Window.partitionBy("script_id", "page")))
    ends = (F.col("gap") > F.col("middle") * gap) & (F.col("middle") > 0)
    two = F.when(F.coalesce(ends, F.lit(False)), F.array(F.lit(""), F.col("text"))).otherwise(F.array("text"))
    rows = rows.select("script_id", "page", "top", "x0", L.page_band(F.col("x0"), F.col("page_width")).alias("layout"), F.posexplode(two).alias("k", "raw"))
    at = Window.partitionBy("script_id").orderBy("page", "top", "x0", "k")
    return rows.select("script_id", F.lit("pdf").alias("source_format"), (F.row_number().over(at) - 1).alias("line_no"), "raw", "page", F.when(F.col("raw") != "", F.col("layout")).alias("layout"))


def unreadable(lines: DataFrame) -> DataFrame:
    """Scripts of whose non-blank lines more than half are glyph garbage, and those without any."""
    full = F.trim("raw") != ""
    numbers = F.avg(F.when(full, L.has_glyph_numbers(F.col("raw")).cast("int")))
    names = F.avg(F.when(full, L.is_glyph_names(F.trim("raw")).cast("int")))
    shares = lines.groupBy("script_id").agg(numbers.alias("numbers"), names.alias("names"))
    return shares.where("numbers is null or numbers > 0.5 or names > 0.5").select("script_id")


def laid_out(lines: DataFrame) -> DataFrame:
    """PDF lines with what their columns tell made explicit: a run of right-aligned lines is one transition, and a
    left or centred line inside a speech (no parenthetical open) starts a new block, as if a blank stood before it."""
    by = Window.partitionBy("script_id").orderBy("line_no")
    right = F.coalesce(F.col("layout") == "right", F.lit(False))
    rows = lines.withColumn("start", right & ~F.coalesce(F.lag(right).over(by), F.lit(False))).withColumn("right", right)
    rows = rows.withColumn("run", F.count(F.when(F.col("start") | ~F.col("right"), 1)).over(by))
    rows = rows.groupBy("script_id", "source_format", "run").agg(
        F.min("line_no").alias("line_no"), F.min("page").alias("page"), F.first("layout").alias("layout"), F.bool_or("right").alias("right"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), " ").alias("raw"),
    )
    rows = rows.withColumn("inside", F.coalesce(F.lag("raw").over(by).rlike(r"^\s*\([^)]*$"), F.lit(False)))
    outside = F.col("layout").isin("left", "center") & ~F.col("raw").rlike(r"^\s*\(") & ~F.col("inside")
    parts = F.when(F.coalesce(outside, F.lit(False)), F.array(F.lit(""), F.col("raw"))).when(F.col("right") & ~L.is_transition(F.trim("raw")), F.array(F.concat(F.lit("> "), F.col("raw")))).otherwise(F.array("raw"))
    rows = rows.select("script_id", F.when(F.col("right"), "fountain").otherwise("txt").alias("source_format"), "line_no", "page", F.posexplode(parts).alias("k", "raw"))
    at = Window.partitionBy("script_id").orderBy("line_no", "k")
    return rows.select("script_id", "source_format", (F.row_number().over(at) - 1).alias("line_no"), "raw", "page")


def parse_pdf(boxes: DataFrame) -> dict[str, DataFrame]:
    """Tables of PDF scripts from their extracted text boxes; unreadable ones are left to an OCR step before."""
    lines = pdf_lines(boxes)
    scripts = boxes.select("script_id").distinct().withColumn("source_format", F.lit("pdf")).withColumn("source_filename", F.col("script_id"))
    scripts = scripts.withColumn("title", F.lit(None).cast("string")).withColumn("author", F.lit(None).cast("string"))
    return tables(classify(laid_out(lines)), scripts, "medium")

