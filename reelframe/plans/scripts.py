"""Queries over whole scripts that are written out from the given conversations: formats, exports, graph, tracks."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, craft, findings, graph, structure, tracks
from ..operators import stats as S
from ..sources import export, json_files, screenplay, script_files
from ..streaming import jobs
from .adapters import elements, generated_scripts, kept, presence, scenes, shared_folder, squeezed, table
from .registry import injected, query

ELEMENT = ["script_id", "scene_number", "element_index", "type", "text", "character"]


def rich_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Fountain with a title page, a boneyard, forced and caseless headings and cues, parentheticals, lyrics, shots and transitions."""
    rows = table(spark, d, "conversations").withColumn("script_id", F.floor(F.col("conv_id") / 10).cast("long"))
    turn, said = F.col("turn").cast("string"), F.concat(F.lit("so "), squeezed(F.col("text")), F.lit("\n"))
    cue = F.when(F.col("turn") % 5 == 0, F.lit("ராமன்")).otherwise(F.concat(F.lit("@User "), turn))
    part = F.when(F.col("role") == "system", said).when(F.col("role") == "assistant", F.concat(F.lit("ASSISTANT (V.O.)\n"), said)).otherwise(F.concat(cue, F.lit("\n(softly)\n"), said))
    body = rows.groupBy("script_id", "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    c = F.col("conv_id").cast("string")
    heading = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(".THE ROOF "), c)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("INT. ROOM "), c, F.lit(" - NIGHT"))).otherwise(F.concat(F.lit("इंट. घर "), c, F.lit(" - रात")))
    tail = F.concat(F.lit("\n~la la\n\nANGLE ON the door\n\n# a section\n\nTWO DAYS LATER\n\n"), F.when(F.col("conv_id") % 2 == 0, "> FADE OUT.").otherwise("CUT TO:"), F.lit("\n"))
    scene = body.select("script_id", "conv_id", F.concat(heading, F.lit("\n\n"), "body", tail).alias("t"))
    text = scene.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "t"))), lambda x: x["t"]), "\n").alias("text"))
    s = F.col("script_id").cast("string")
    head = F.concat(F.lit("Title: Script "), s, F.lit("\nAuthor: Writer "), s, F.lit("\n\n/* cut\nthis */\n"))
    return text.select("script_id", F.concat(head, "text").alias("text"), F.lit("fountain").alias("source_format"), F.concat(s, F.lit(".fountain")).alias("source_filename"))


def pdf_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Text boxes of a script a conversation group: 40 lines a page, a page number under each, a year as the last line of action."""
    rows = table(spark, d, "conversations").withColumn("script_id", F.floor(F.col("conv_id") / 10).cast("long"))
    box = lambda k, text, x: F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.lit(k).alias("k"), text.alias("text"), F.lit(x).alias("x0"))
    two = F.array(box(0, F.upper("role"), 220.0), box(1, F.concat(F.lit("so "), squeezed(F.col("text"))), 150.0))
    lines = rows.select("script_id", F.explode(two).alias("b"))
    convs = rows.groupBy("script_id", "conv_id").agg(F.max("turn").alias("turn"))
    heads = convs.withColumn("turn", F.lit(-1).cast(dict(rows.dtypes)["turn"])).select("script_id", F.explode(F.array(box(0, F.concat(F.lit("INT. ROOM "), F.col("conv_id").cast("string"), F.lit(" - DAY")), 72.0))).alias("b"))
    ends = convs.select("script_id", F.explode(F.array(box(2, F.lit("1999"), 72.0), box(3, F.lit("CUT TO:"), 420.0))).alias("b"))
    every = lines.unionByName(heads).unionByName(ends).groupBy("script_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    every = every.select("script_id", F.posexplode("bs").alias("n", "b"))
    page, line = F.floor(F.col("n") / 40) + 1, F.col("n") % 40
    top = line * 20.0 - F.when(F.col("b.k") == 1, 6.0).otherwise(0.0)  # speech stands closer to its cue
    out = every.select("script_id", page.cast("int").alias("page"), top.alias("top"), (top + 10.0).alias("bottom"), "b.x0", F.lit(612.0).alias("page_width"), "b.text")
    numbers = out.select("script_id", "page").distinct().select("script_id", "page", F.lit(900.0).alias("top"), F.lit(910.0).alias("bottom"), F.lit(300.0).alias("x0"), F.lit(612.0).alias("page_width"), F.concat(F.col("page").cast("string"), F.lit(".")).alias("text"))
    return out.unionByName(numbers)


def whole_files(rows: DataFrame, name: str) -> str:
    """Writes each row's column value as a file of its own under the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def fountain_elements(spark, d):
    return screenplay.parse(rich_scripts(spark, d))["elements"].select(*ELEMENT)


@query
def fountain_scenes(spark, d):
    return screenplay.parse(rich_scripts(spark, d))["scenes"].select("script_id", "scene_number", "heading_raw", "int_ext", "location", "time_of_day")


@query
def fountain_titles(spark, d):
    out = screenplay.parse(rich_scripts(spark, d))
    return out["scripts"].select("script_id", "title", "author", "parse_confidence", "source_format")


@query
def plain_elements(spark, d):
    """The same scripts as plain text and as Markdown, by turns."""
    form = F.when(F.col("script_id") % 2 == 0, "txt").otherwise("md")
    rows = screenplay.parse(generated_scripts(spark, d).withColumn("source_format", form))["elements"]
    return rows.groupBy("script_id", "scene_number", "type").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("characters"))


@query
def fdx_elements(spark, d):
    """Written as Final Draft XML and read again."""
    first = screenplay.parse(rich_scripts(spark, d))
    text = export.to_fdx(first["elements"], first["scripts"]).withColumn("source_format", F.lit("fdx")).withColumn("source_filename", F.lit("again.fdx"))
    return screenplay.parse_fdx(text)["elements"].select(*ELEMENT)


@query
def fdx_titles(spark, d):
    first = screenplay.parse(rich_scripts(spark, d))
    text = export.to_fdx(first["elements"], first["scripts"]).withColumn("source_format", F.lit("fdx")).withColumn("source_filename", F.lit("again.fdx"))
    return screenplay.parse_fdx(text)["scripts"].select("script_id", "title", "author", "parse_confidence")


@query
def pdf_elements(spark, d):
    return screenplay.parse_pdf(pdf_boxes(spark, d))["elements"].select(*ELEMENT)


@query
def unreadable_scripts(spark, d):
    """Every third script's lines carry glyph numbers, every seventh's are glyph names."""
    lines = screenplay.split_lines(generated_scripts(spark, d))
    broken = F.when(F.col("script_id") % 3 == 0, F.concat(F.lit("(cid:12)"), "raw")).when(F.col("script_id") % 7 == 0, F.lit("/1 /2")).otherwise(F.col("raw"))
    return screenplay.unreadable(lines.withColumn("raw", F.when(F.trim("raw") == "", F.col("raw")).otherwise(broken)))


@query
def export_text(spark, d):
    first = screenplay.parse(generated_scripts(spark, d))
    return export.export(first["elements"], first["scripts"], "txt").select("script_id", F.sha2("text", 256).alias("sha256"))


@query
def json_roundtrip(spark, d):
    """Every script as one JSON file, and read again."""
    first = screenplay.parse(generated_scripts(spark, d))
    again = json_files.read_scripts(spark, whole_files(export.script_json(first), "scripts"))
    names = again["scripts"].select("script_id", F.split("source_filename", r"\.")[0].cast("long").alias("script"))
    n = lambda what, name: again[what].groupBy("script_id").agg(F.count("*").alias(name))
    out = names.join(n("scenes", "scenes"), "script_id").join(n("elements", "elements"), "script_id").join(n("presence", "characters"), "script_id")
    return out.select(F.col("script").alias("script_id"), "scenes", "elements", "characters")


@query
def session_files(spark, d):
    """Conversations as session files, one a group of ten, and read again."""
    rows = table(spark, d, "conversations").withColumn("session", F.floor(F.col("conv_id") / 10).cast("long"))
    message = F.struct("role", F.col("text").alias("content"), (F.col("conv_id") * 100 + F.col("turn")).cast("double").alias("ts"), F.lit("chat").alias("mode"), F.array((F.col("conv_id") % 10 + 1).cast("int")).alias("scene_refs"))
    made = rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(F.col("conv_id"), F.col("turn"), message.alias("m")))).alias("ms"))
    branch = F.struct(F.lit("main").alias("name"), F.transform("ms", lambda x: x["m"]).alias("messages"))
    s = F.col("session").cast("string")
    value = F.to_json(F.struct(s.alias("session_id"), F.concat(F.lit("Talk "), s).alias("title"), F.col("session").cast("double").alias("updated_at"), F.lit("main").alias("active_branch"), F.create_map(F.lit("main"), branch).alias("branches")))
    read = json_files.read_sessions(spark, whole_files(made.select(value.alias("value")), "sessions"))
    messages = F.col("branches")["main"]["messages"]
    return read.select("session_id", "title", "updated_at", F.size(messages).cast("long").alias("messages"), F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.char_length(m["content"])).alias("characters"))


@query
def watch_folder(spark, d):
    """Scripts that arrive as files, parsed by the stream; the sums of its micro-batches."""
    folder = whole_files(generated_scripts(spark, d).select(F.col("text").alias("value")), "arrivals")
    home = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    keep = lambda tables, n: tables["elements"].groupBy("type").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{home}/out")
    jobs.watch(spark, folder, f"{home}/archive", f"{home}/checkpoint", keep, once=True).awaitTermination()
    return spark.read.schema("type string, n long").parquet(f"{home}/out").groupBy("type").agg(F.sum("n").alias("n"))


def mixed_files(spark: SparkSession, d: str) -> str:
    """A folder of the written-out scripts: Fountain and Final Draft files by turns, every fifth of the latter broken."""
    rich, odd = rich_scripts(spark, d), F.col("script_id") % 2 == 1
    whole = screenplay.parse(rich.where(odd))
    marked = export.to_fdx(whole["elements"], whole["scripts"])
    marked = marked.select(F.concat(F.col("script_id").cast("string"), F.lit(".fdx")).alias("source_filename"), F.when(F.col("script_id") % 5 == 0, "broken").otherwise(F.col("text")).alias("text"))
    home = f"{shared_folder(spark)}/scripts-{uuid.uuid4().hex}"
    script_files.register(spark)
    for rows in (rich.where(~odd).select("source_filename", "text"), marked):
        rows.write.format("scripts").mode("append").save(home)
    return home


def elements_by_format(rows: DataFrame) -> DataFrame:
    """(source_format, type, n, characters) of the elements of files; files that cannot be read are of type error."""
    form = lambda c: F.regexp_extract(c, r"\.([a-z]+)$", 1).alias("source_format")
    parsed = screenplay.parse_all(script_files.readable(rows))["elements"].groupBy(form("script_id"), "type").agg(F.count("*").alias("n"), F.sum(F.char_length("text").cast("long")).alias("characters"))
    bad = script_files.problems(rows).groupBy(form("script_id"), F.lit("error").alias("type")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("characters"))
    return parsed.unionByName(bad)


@query
def script_file_source(spark, d):
    """Scripts written as files by the data source and read as a batch, once."""
    return elements_by_format(script_files.read_once(spark, mixed_files(spark, d), f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"))


@query
def script_file_stream(spark, d):
    """The same files as a stream; its rows are kept before they are parsed."""
    folder, home = mixed_files(spark, d), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.format("scripts").option("log", f"{home}/log").load(folder)
    source.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/rows").trigger(availableNow=True).start().awaitTermination()
    return elements_by_format(spark.read.schema(source.schema).parquet(f"{home}/rows"))


@query
def formatting_checks(spark, d):
    """The checks read the elements in many branches, so the scripts are parsed once and kept."""
    out = screenplay.parse(rich_scripts(spark, d), kept)
    rows = craft.formatting(out["elements"], out["scenes"])
    first = F.coalesce(F.try_element_at("scene_refs", F.lit(1)), F.lit(0))
    return rows.groupBy("script_id", "rule", "severity").agg(F.count("*").alias("n"), F.sum(first.cast("long")).alias("first_refs"))


@query
def character_index(spark, d):
    rows = graph.character_index(presence(spark, d), elements(spark, d))
    said = F.aggregate(F.map_values("scene_dialogue_counts"), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("script_id", "character", F.array_join("scenes_present", ",").alias("scenes"), "first_scene", "last_scene", said.alias("lines"))


@query
def character_profiles(spark, d):
    """Tracks of every script's characters, with their partners."""
    e, p = elements(spark, d), presence(spark, d)
    pairs = graph.cooccurrence(p, ["script_id", "scene_number"], "character")
    rows = tracks.character_tracks(graph.character_index(p, e), scenes(spark, d), graph.top_partners(pairs, ["script_id"]))
    partners = F.array_join(F.transform("interactions", lambda x: x["partner"]), ",")
    return rows.select("script_id", "character", "importance", F.col("scene_count").cast("long").alias("scene_count"), F.col("lines").cast("long").alias("lines"), partners.alias("partners"), F.col("track_rank").cast("long").alias("track_rank"))


@query
def trait_mentions(spark, d):
    phrase = F.when(F.col("turn") % 2 == 0, "ASSISTANT (30s, tired)").otherwise("USER (calm)")
    e = elements(spark, d, F.concat(phrase, F.lit(" "), F.col("text")))
    return graph.trait_mentions(presence(spark, d), e)


@query
def scene_timeline(spark, d):
    rows = scenes(spark, d).withColumn("int_ext", F.lit("INT")).withColumn("time_of_day", F.when(F.col("scene_number") % 2 == 0, "NIGHT"))
    e = elements(spark, d, injected(["LATER", "two years ago in 1999", "EARLIER"])).withColumn("type", F.lit("action"))
    return graph.timeline(rows, e).select("script_id", "scene_number", "int_ext", "time_of_day", F.array_join("markers", "|").alias("markers"))


@query
def prop_mentions(spark, d):
    e = elements(spark, d, F.concat(F.when(F.col("turn") % 3 == 0, "the GOLD WATCH").otherwise("a RED LAMP"), F.lit(" "), F.regexp_replace("text", "[A-Z]", "x"))).withColumn("type", F.lit("action"))
    found = graph.props(e, presence(spark, d))
    return graph.prop_mentions(e, found).groupBy("script_id", "phrase").agg(F.count("*").alias("mentions"), F.sum(F.char_length("text")).alias("characters"))


@query
def script_summary(spark, d):
    """Runtime, scene lengths and dialogue shares of every script, rounded as reports are."""
    rows = S.report(elements(spark, d), scenes(spark, d))
    return rows.select("script_id", F.round(F.col("runtime_minutes") * 10).cast("long").alias("tenths"), "scene_count", "dialogue_words", "action_words", "shortest_scene", "longest_scene")


@query
def quote_verification(spark, d):
    """A quote a turn: the turn itself, nonsense, none, or the turn with a scene that does not exist."""
    e = elements(spark, d)
    quote = F.when(F.col("element_index") % 4 == 1, "zzqx wwqk ppqj vvqy").when(F.col("element_index") % 4 == 2, F.lit(None).cast("string")).otherwise(F.col("text"))
    refs = F.when(F.col("element_index") % 4 == 3, F.array(F.lit(99))).otherwise(F.array("scene_number"))
    asked = e.select("script_id", (F.col("scene_number") * 1000 + F.col("element_index")).alias("finding_index"), refs.alias("scene_refs"), quote.alias("evidence_quote"))
    return findings.verification_summary(findings.verify(asked, e))


@query
def library_lines(spark, d):
    """A line of themes and characters for every script but the first."""
    e = elements(spark, d)
    said = e.where("type = 'dialogue'").select("script_id", (F.col("scene_number") * 1000 + F.col("element_index")).alias("finding_index"), F.when(F.col("character") == "USER", "theme").otherwise("other").alias("category"), squeezed(F.col("text")).alias("issue"))
    projects = e.select("script_id").distinct().withColumn("title", F.concat(F.lit("S"), F.col("script_id").cast("string")))
    books = tracks.library(projects, said, graph.character_index(presence(spark, d), e), exclude=0)
    return tracks.digest(books).select("script_id", "digest")


@query
def script_cast(spark, d):
    """The best-known members of each group, as the map of a script lists them."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("script_id"), F.col("l_orderkey").alias("scene_number"), F.col("l_suppkey").alias("character"))
    return context.leading_cast(rows).select("script_id", "character", "scenes", F.col("cast_rank").cast("long").alias("cast_rank"))


@query
def scene_texts_for(spark, d):
    """Blocks of the scenes that a turn asks for, one of which is missing."""
    e = elements(spark, d)
    wanted = e.select("script_id", (F.col("scene_number") * 1000 + F.col("element_index")).alias("text_id"), F.array("scene_number", F.lit(99)).alias("scenes"))
    rows = context.scene_blocks(wanted, e)
    return rows.select("script_id", "text_id", F.sha2("block", 256).alias("sha256"), F.array_join("missing", ",").alias("missing"))


@query
def ungrounded_replies(spark, d):
    rows = elements(spark, d).select("script_id", (F.col("scene_number") * 1000 + F.col("element_index")).alias("text_id"), F.concat(F.lit("See scene "), (F.col("element_index") + 7).cast("string"), F.lit(" and scene 77.")).alias("text"))
    return context.ungrounded(rows, scenes(spark, d)).select("script_id", "text_id", "unknown_scene")


@query
def page_spans(spark, d):
    """Pages re-based on the parsed pages of PDF scripts."""
    out = screenplay.parse_pdf(pdf_boxes(spark, d))
    return out["scenes"].select("script_id", "scene_number", "page_start", "page_end")


@query
def cue_presence(spark, d):
    """Characters as chat context sees them: from cue texts, upper case."""
    rows = context.presence_from_cues(screenplay.parse(rich_scripts(spark, d))["elements"])
    return rows.select("script_id", "name", F.array_join("scenes", ",").alias("scenes"))


@query
def act_lengths(spark, d):
    rows = structure.act_of_scene(structure.page_positions(structure.scene_lines(elements(spark, d))))
    return rows.groupBy("script_id", "act").agg(F.count("*").alias("scenes"))
