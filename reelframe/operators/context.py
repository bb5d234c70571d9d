"""Conversation text: references to scenes and characters, reply cleaning, turn kinds, chunking, history."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_ratio_at_least
from .findings import is_language_remark
from .mentions import mentions

MAX_SCENES, NAME_LENGTH, TOKEN_LENGTH, NICKNAME, CAST = 4, 3, 4, 0.58, 24
HISTORY, CHUNK_BUDGET, CHUNK_SCENES, CHARS_PER_TOKEN = 16, 1400, 6, 4
SIGNATURE, LEAST_SIGNATURE, SAME_PREFIX, LEAST_PARAGRAPH = 120, 16, 36, 20
BULLET = r"^\s*(•|-|\d+[.)])\s+"
# How turns begin, and phrases that mark a stuck reply. A word ends where no letter of any script, digit, mark or
# underscore follows; spelled out, as \b means ASCII letters to some engines and all letters to others.
WORD_END = r"(?![\p{L}\p{Mn}\p{Nd}_])"
QUESTION_START = r"(?i)^(who|what|why|how|does|can|should|is|are|would|could|do|did)" + WORD_END
DIRECTIVE_START = r"(?i)^(rewrite|fix|change|try|add|cut|move|remove|make|let'?s|write|imagine|explain)" + WORD_END
REASONING = r"(?i)\b(because|since|so that|the reason|my instinct|i feel like|the thing is)\b"
STUCK = [
    "what catches", "feels thin", "coffee cools", "coffee cooling", "end credits roll", "theater walls", "projection booth", "balcony seats", "ceiling rafters",
    "window seat", "alive and breathing", "beginning moment zero", "between your hands", "five pitches", "half-formed", "wasting another week",
    "furniture nobody lives", "sitting upstairs", "pushing harder", "someone who knows better", "last email", "your editor", "the editor",
    "credits stop rolling", "first thing morning", "having feelings on screen", "pick one", "atmosphere and mood", "tomorrow afternoon",
]
VERDICTS = ["verdict", "my honest take", "my read", "my take", "recommend", "the one thing", "next step", "commit", "buy", "sold"]
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\"'(“«])"


def presence_from_cues(elements: DataFrame) -> DataFrame:
    """(script_id, name, scenes) from cue texts: upper case, what stands before a parenthesis; underscores stay."""
    name = F.trim(F.substring_index(F.upper("text"), "(", 1))
    rows = elements.where("type = 'character' and scene_number > 0").select("script_id", name.alias("name"), "scene_number").where("name <> ''")
    return rows.groupBy("script_id", "name").agg(F.array_sort(F.collect_set("scene_number")).alias("scenes"))


def leading_cast(presence: DataFrame, most: int = CAST) -> DataFrame:
    """(script_id, character, scenes, cast_rank): the characters of the most scenes of each script, as its map lists them."""
    rows = presence.where("character is not null").groupBy("script_id", "character").agg(F.count_distinct("scene_number").alias("scenes"))
    rank = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc("scenes"), "character"))
    return rows.withColumn("cast_rank", rank).where(F.col("cast_rank") <= most)


def scene_refs(text: Column, limit: int | None = MAX_SCENES) -> Column:
    """Scene numbers that a text names, in ascending order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[Ss]cene\s+(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    found = F.array_sort(F.array_distinct(found))
    return F.slice(found, 1, limit) if limit else found


def character_refs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(script_id, text_id, name, tier): characters that a text mentions, by the first tier that holds.

    1 whole name, 2 a name's token of four letters or more, 3 a prefix either way, 4 the script's single most similar
    name. A text without a long enough word has no fourth tier. texts: (script_id, text_id, text). Texts meet the
    names of their own script only.
    """
    known = names.select("script_id", "name").where(F.char_length("name") >= NAME_LENGTH)
    word_list = F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z']{2,}"), F.lit(0))
    key = ["script_id", "text_id"]
    tokens = F.filter(F.split("name", r"[\s_]+"), lambda t: F.char_length(t) >= TOKEN_LENGTH)
    parts = known.select("script_id", "name", F.explode(tokens).alias("token"))
    asked = known.select("script_id", "name").unionByName(parts.select("script_id", F.col("token").alias("name")))
    said = mentions(texts, asked, ["script_id"], "text_id").withColumnRenamed("name", "said")
    whole = said.join(known.select("script_id", F.col("name").alias("said")).distinct(), ["script_id", "said"]).select(*key, F.col("said").alias("name"), F.lit(1).alias("tier"))
    token = said.join(parts.select("script_id", "name", F.col("token").alias("said")), ["script_id", "said"]).select(*key, "name", F.lit(2).alias("tier"))
    # a word and a name of which one begins the other share the first NAME_LENGTH letters, as both have as many
    words = texts.select(*key, F.explode(F.array_distinct(F.transform(word_list, lambda x: F.upper(x)))).alias("w")).withColumn("head", F.substring("w", 1, NAME_LENGTH))
    heads = known.withColumn("head", F.substring("name", 1, NAME_LENGTH))
    prefix = words.join(heads, ["script_id", "head"]).where(F.col("w").startswith(F.col("name")) | F.col("name").startswith(F.col("w"))).select(*key, "name", F.lit(3).alias("tier"))
    sure = whole.unionByName(token).unionByName(prefix).groupBy(*key, "name").agg(F.min("tier").alias("tier"))
    count = known.groupBy("script_id").agg(F.count_distinct("name").alias("names"))
    done = sure.groupBy(*key).agg(F.count("*").alias("known"))
    missed = texts.select(*key).distinct().join(count, "script_id").join(done, key, "left").where(F.coalesce("known", F.lit(0)) < F.col("names")).select(*key)
    long = texts.join(missed, ["script_id", "text_id"], "left_semi").select("script_id", "text_id", F.explode(F.array_distinct(F.transform(F.filter(word_list, lambda x: F.char_length(x) >= 4), lambda x: F.upper(x)))).alias("word"))
    n, m = F.char_length("name"), F.char_length("word")
    tried = long.join(known.where(F.char_length("name") >= 4), "script_id").where(F.least(n, m) * 2.0 / (n + m) >= NICKNAME)
    tried = tried.withColumn("r", short_ratio_at_least("name", "word", NICKNAME)).where("r is not null")
    best = tried.groupBy("script_id", "text_id").agg(F.max("r").alias("r"), F.max_by("name", F.struct("r", "name")).alias("name"))
    near = best.join(sure, ["script_id", "text_id", "name"], "left_anti").select("script_id", "text_id", "name", F.lit(4).alias("tier"))
    return sure.unionByName(near)


def referenced_scenes(texts: DataFrame, names: DataFrame, limit: int = MAX_SCENES) -> DataFrame:
    """(script_id, text_id, scenes): named scenes and those of mentioned characters, the first few."""
    keys = ["script_id", "text_id"]
    spoken = character_refs(texts, names).join(names, ["script_id", "name"]).select(*keys, F.explode("scenes").alias("n"))
    named = texts.select(*keys, F.explode(scene_refs(F.col("text"))).alias("n"))
    return named.unionByName(spoken).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("n")), 1, limit).alias("scenes"))


def scene_blocks(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """(script_id, text_id, block, missing): text of the wanted scenes, and numbers that the script lacks."""
    keys = ["script_id", "text_id"]
    bodies = elements.where("scene_number > 0").groupBy("script_id", "scene_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_index", "text"))), lambda x: x["text"]), "\n").alias("body"))
    rows = wanted.select(*keys, F.explode("scenes").alias("scene_number")).join(bodies, ["script_id", "scene_number"], "left")
    part = F.struct("scene_number", F.concat(F.lit("Scene "), F.col("scene_number").cast("string"), F.lit("\n"), F.col("body")).alias("t"))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), part))), lambda x: x["t"]), "\n\n").alias("block"),
        F.array_sort(F.collect_list(F.when(F.col("body").isNull(), F.col("scene_number")))).alias("missing"),
    )


def ungrounded(replies: DataFrame, scenes: DataFrame) -> DataFrame:
    """replies (script_id, text_id, text) plus unknown_scene: the first scene they name that the script lacks."""
    known = scenes.groupBy("script_id").agg(F.collect_set("scene_number").alias("known"))
    rows = replies.join(known, "script_id", "left")
    return rows.withColumn("unknown_scene", F.try_element_at(F.array_except(scene_refs(F.col("text"), None), F.coalesce("known", F.array().cast("array<int>"))), F.lit(1))).drop("known")


def without_language_talk(text: Column) -> Column:
    """Sentences about the language dropped, line by line; runs of blank lines collapsed."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.array_join(F.filter(F.split(line, SENTENCE_END), lambda s: ~is_language_remark(s)), " "))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def without_debris(text: Column) -> Column:
    """Separator lines, leaked tags and a separator at the very end removed."""
    def kept(line: Column) -> Column:
        s = F.trim(line)
        single = s.rlike(r"^([^\p{L}\p{N}])\1*$")
        return (s == "") | (~single & ~s.rlike(r"^<\S*$"))

    out = F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), kept), "\n"), r"^\n+|\n+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"</?[a-zA-Z][^>]*>|<[^>\s]+>", ""), r"^\n+|\n+$", "")
    return F.rtrim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[_-]+\s*$", ""))


def signature(paragraph: Column) -> Column:
    """Letters and digits of a paragraph's opening sentence; null for short paragraphs."""
    compact = F.trim(F.regexp_replace(paragraph, r"(?U)\s+", " "))
    head = F.regexp_extract(F.substring(compact, 1, SIGNATURE), r"^([^.!?]*[.!?]?)", 1)
    sig = F.regexp_replace(F.lower(head), "[^a-z0-9]+", "")
    return F.when((F.char_length(compact) >= LEAST_PARAGRAPH) & (F.char_length(sig) >= LEAST_SIGNATURE), sig)


def without_repeats(text: Column) -> Column:
    """Paragraphs that open like an earlier kept one dropped, with the question echoes before them.

    A fold over the paragraphs in order: only kept ones count as seen.
    """
    paragraphs = F.split(F.regexp_replace(text, r"^\n+|\n+$", ""), r"\n\s*\n")
    marked = F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), signature(p).alias("s"), signature(F.try_element_at(paragraphs, i + 2)).alias("next")))

    def seen(known: Column, sig: Column) -> Column:
        return F.exists(known, lambda k: (k == sig) | ((F.least(F.char_length(k), F.char_length(sig)) >= SAME_PREFIX) & (k.startswith(sig) | sig.startswith(k))))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(state: Column, x: Column) -> Column:
        again = F.coalesce(seen(state["seen"], x["s"]), F.lit(False))
        echo = x["s"].isNotNull() & F.trim(x["p"]).rlike(r"\?\.*$") & F.coalesce(seen(state["seen"], x["next"]), F.lit(False))
        more = F.struct(F.concat(state["kept"], F.array(x["p"])).alias("kept"), F.when(x["s"].isNull(), state["seen"]).otherwise(F.concat(state["seen"], F.array(x["s"]))).alias("seen"))
        return F.when(again | echo, state).otherwise(more)

    return F.regexp_replace(F.array_join(F.aggregate(marked, start, step)["kept"], "\n\n"), r"\n{3,}", "\n\n")


def cleaned_reply(text: Column) -> Column:
    return without_repeats(without_debris(without_language_talk(text)))


def turn_kind(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", "idea").when(t.endswith("?") | t.rlike(QUESTION_START), "question").when(t.rlike(DIRECTIVE_START), "directive").otherwise("idea")


def should_probe(text: Column) -> Column:
    return (turn_kind(text) == "idea") & ~text.rlike(REASONING)


def ends_forward(text: Column) -> Column:
    t = F.rtrim(text)
    last = F.lower(F.regexp_extract(t, r"(\S+)$", 1))
    return t.endswith("?") | last.rlike("want|let's|lets|should|shall|right")


def nudged(replies: DataFrame, nudges: list[str], order: str, least: int = 120) -> DataFrame:
    """Short replies that lead nowhere get a nudge, in turn by their order within the session."""
    stranded = (F.trim("text") != "") & ~ends_forward(F.col("text")) & (F.char_length(F.trim("text")) < least)
    nth = F.count(F.when(stranded, 1)).over(Window.partitionBy("session_id").orderBy(order))
    nudge = F.element_at(F.array(*map(F.lit, nudges)), (F.pmod(nth - 1, F.lit(len(nudges))) + 1).cast("int"))
    return replies.withColumn("text", F.when(stranded, F.concat(F.trim("text"), F.lit("\n\n"), nudge)).otherwise(F.col("text")))


def capped_bullets(text: Column, most: int, note: str) -> Column:
    """The text up to its bullet number `most` + 1, and a note if that cut something."""
    lines = F.split(text, "\n")
    places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(BULLET), i)), lambda i: i.isNotNull())
    cut = F.rtrim(F.array_join(F.slice(lines, F.lit(1), F.greatest(F.try_element_at(places, F.lit(most + 1)), F.lit(0))), "\n"))
    return F.when(F.size(places) > most, F.concat(cut, F.lit(note))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN)) + 25


def chunks(rows: DataFrame, keys: list[str], order: str, text: str, size: int = CHUNK_SCENES, budget: int = CHUNK_BUDGET) -> DataFrame:
    """rows plus chunk: greedy packing in order, closed by the size cap or the token budget.

    A fold over each group's token estimates (integers, never texts); order-dependent, so one fold a group.
    """
    item = F.struct(F.col(order).alias("o"), (token_estimate(F.col(text)) + 30).cast("int").alias("t"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast(f"array<struct<o:{dict(rows.dtypes)[order]},chunk:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= size) | (s["used"] + x["t"] > budget))
        chunk = s["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x["t"]).otherwise(s["used"] + x["t"]).alias("used"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), chunk.alias("chunk")))).alias("out"))

    folded = rows.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step)["out"].alias("out"))
    placed = folded.select(*keys, F.explode("out").alias("x")).select(*keys, F.col("x.o").alias(order), F.col("x.chunk").alias("chunk"))
    return rows.join(placed, [*keys, order])


def history(messages: DataFrame, keys: list[str], order: str, n: int = HISTORY) -> DataFrame:
    """The last n messages of each conversation."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return messages.withColumn("from_end", rank).where(F.col("from_end") <= n)


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def trigram_share(w: Column, least: int = 40) -> Column:
    """Share of an array's trigrams that occurred before, by their 64-bit hashes; 0 below `least` words."""
    n = F.size(w)
    grams = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= least, (n - 2 - F.size(F.array_distinct(grams))) / (n - 2)).otherwise(F.lit(0.0))


def repetition_ratio(text: Column, least: int = 40) -> Column:
    """trigram_share of a text's words. For whole tables see repetition_ratios, which splits a text once."""
    return trigram_share(letter_words(text), least)


def repetition_ratios(rows: DataFrame, text: Column, name: str = "ratio", least: int = 40) -> DataFrame:
    """rows plus the ratio; the words stand in a projection of their own, which Catalyst keeps apart, as they are used often."""
    return rows.withColumn("words_", letter_words(text)).withColumn(name, trigram_share(F.col("words_"), least)).drop("words_")


def reply_score(text: Column, needs_verdict: Column) -> Column:
    low = F.lower(text)
    stuck = F.size(F.filter(F.array(*map(F.lit, STUCK)), lambda g: F.contains(low, g)))
    verdict = F.exists(F.array(*map(F.lit, VERDICTS)), lambda g: F.contains(low, g))
    out = F.lit(2.0) - 2.0 * stuck - F.when(F.char_length(text) < 60, 1.5).otherwise(0.0) - F.when(F.char_length(text) > 1400, 1.5).otherwise(0.0)
    return out - 3.0 * repetition_ratio(text) - F.when(needs_verdict & ~verdict, 2.0).otherwise(0.0)


def token_surplus(a: DataFrame, b: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word, only_a, only_b): multiset difference of words between two versions."""
    count = lambda d, n: d.select(*keys, F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias(n))
    rows = count(a, "a").join(count(b, "b"), [*keys, "word"], "full_outer").fillna(0, ["a", "b"])
    return rows.select(*keys, "word", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("only_a"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("only_b")).where("only_a <> only_b")


def fuzzy_rank(labels: DataFrame, query: str, label: str) -> DataFrame:
    """Commands that match a typed query: as a substring (shorter labels first), else as a subsequence with bonuses
    for adjacent letters and word starts."""
    q, low = query.lower(), F.lower(label)
    letters = F.split(low, "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(-2).alias("last"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        wanted = F.element_at(F.array(*[F.lit(x) for x in (q or " ")]), F.least(s["at"] + 1, F.lit(max(1, len(q)))))
        hit = (s["at"] < len(q)) & (c == wanted)
        before = F.when(s["i"] == 0, F.lit(" ")).otherwise(F.element_at(letters, F.greatest(s["i"], F.lit(1))))
        bonus = F.lit(1) + F.when(s["last"] == s["i"] - 1, 2).otherwise(0) + F.when(before == " ", 3).otherwise(0)
        return F.struct((s["at"] + hit.cast("int")).alias("at"), (s["score"] + F.when(hit, bonus).otherwise(0)).alias("score"), F.when(hit, s["i"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i"))

    done = F.aggregate(letters, start, step)
    score = F.when(F.contains(low, F.lit(q)), 100 + len(q) - F.char_length(label)).when(done["at"] == len(q), done["score"])
    return labels.withColumn("match_score", score).where("match_score is not null")


def quoted(scene: Column, text: Column, longest: int = 4000) -> Column:
    """A passage that the writer points at: struct<scene_number, text>, scenes from 1, at most `longest` characters; null if blank."""
    clean = F.trim(text)
    return F.when(clean != "", F.struct(F.when(scene.isNotNull(), F.greatest(scene, F.lit(1))).alias("scene_number"), F.substring(clean, 1, longest).alias("text")))


def compact_summary(scripts: DataFrame, findings: DataFrame, coverage: DataFrame, formatting: DataFrame) -> DataFrame:
    """(script_id, summary): coverage, every finding and formatting notes of each script as a dense text; one line if it has none.

    coverage: (script_id, recommendation, logline, genre, tone, strengths, weaknesses); findings with an optional
    verification; formatting: (script_id, finding_index, message).
    """
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    head = coverage.select("script_id", F.concat_ws(
        "\n", field("Coverage", F.upper("recommendation")), field("Logline", F.col("logline")), field("Genre and tone", F.concat_ws(" / ", "genre", "tone")),
        field("Strengths", listed(F.col("strengths"))), field("Weaknesses", listed(F.col("weaknesses")))).alias("head"))
    places = F.array_join(F.transform("scene_refs", lambda n: F.concat(F.lit("Scene "), n.cast("string"))), ", ")
    lost = F.coalesce(F.col("verification.status") == "not_found", F.lit(False)) if "verification" in findings.columns else F.lit(False)
    line = F.concat(F.lit("- ("), "category", F.lit(", "), "severity", F.lit(") "), F.when(F.size("scene_refs") > 0, places).otherwise("General"), F.lit(": "), "issue",
                    F.when(F.coalesce("why_it_matters", F.lit("")) != "", F.concat(F.lit("; "), "why_it_matters")).otherwise(""), F.when(lost, " [quote not found]").otherwise(""))
    of = lambda rows, text, name: rows.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_index", text.alias("t")))), lambda x: x["t"]), "\n").alias(name))
    rows = scripts.select("script_id").join(head, "script_id", "left").join(of(findings, line, "found"), "script_id", "left")
    rows = rows.join(of(formatting, F.concat(F.lit("- "), "message"), "notes"), "script_id", "left")
    parts = F.concat_ws("\n\n", "head", F.concat(F.lit("Findings:\n"), "found"), F.concat(F.lit("Formatting:\n"), "notes"))
    return rows.select("script_id", F.when(parts == "", "(no report)").otherwise(parts).alias("summary"))


def script_maps(presence: DataFrame, most: int = CAST) -> DataFrame:
    """(script_id, map): the leading cast of each script with their scenes, a line each."""
    known = presence.groupBy("script_id", "character").agg(F.array_sort(F.collect_set("scene_number")).alias("at"))
    rows = leading_cast(presence, most).join(known, ["script_id", "character"])
    line = F.concat("character", F.lit(": "), F.array_join(F.transform("at", lambda n: n.cast("string")), ", "))
    return rows.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cast_rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("map"))


def chat_prompts(messages: DataFrame, maps: DataFrame, summaries: DataFrame, blocks: DataFrame, keys: list[str], order: str, n: int = HISTORY) -> DataFrame:
    """(script_id, text_id, text): what the pass chat reads for each turn of the writer, its parts in this order: the script's
    map, its report's summary, the scenes referred to, scenes asked for that it lacks, the last n messages, the
    quoted passage, the turn itself. Parts that are missing are left out.

    messages: (keys, script_id, text_id, order, role, text, quote); blocks: see scene_blocks.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    rows = messages.withColumn("earlier_", F.array_join(F.collect_list(F.concat("role", F.lit(": "), "text")).over(before), "\n")).where("role = 'user'")
    rows = rows.join(maps, "script_id", "left").join(summaries, "script_id", "left").join(blocks, ["script_id", "text_id"], "left")
    place = F.coalesce(F.concat(F.lit(" from scene "), F.col("quote.scene_number").cast("string")), F.lit(""))
    titled = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), c))
    lacks = F.array_join(F.transform("missing", lambda x: x.cast("string")), ", ")
    prompt = F.concat_ws(
        "\n\n", titled("Cast", F.col("map")), titled("Report", F.col("summary")), F.when(F.col("block") != "", F.col("block")), titled("No such scenes", lacks), titled("Earlier", F.col("earlier_")),
        F.concat(F.lit("Quoted"), place, F.lit(":\n"), F.col("quote.text")), titled("Writer", F.col("text")))
    return rows.select("script_id", "text_id", prompt.alias("text"))


def finished_replies(replies: DataFrame, scenes: DataFrame, nudges: list[str], order: str) -> DataFrame:
    """Replies (script_id, text_id, session_id, text, order) as the writer sees them: cleaned, with an admission where they name
    a scene that the script lacks, and with a nudge where they lead nowhere."""
    rows = ungrounded(replies.withColumn("text", cleaned_reply(F.col("text"))), scenes)
    flag = F.concat(F.rtrim("text"), F.lit("\n\n(I named scene "), F.col("unknown_scene").cast("string"), F.lit(", but this script has no such scene. Which one do you mean?)"))
    return nudged(rows.withColumn("text", F.when(F.col("unknown_scene").isNotNull(), flag).otherwise(F.col("text"))), nudges, order)
