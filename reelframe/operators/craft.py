"""Deterministic craft passes: voice, idiolect, subtext, continuity, pacing, formatting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import voice_tokens, whole_word, word_count
from .graph import TIME_SKIP

MIN_LINES, SIMILAR, MOST_PAIRS, PROFILE_WORDS = 3, 0.72, 6, 40
IDIOLECT_LINES, HALF_LINES, SHIFT = 6, 3, 0.45
DRAG_SCORE, MOST_DRAGS, DRAG_WORDS = 68.0, 4, 20
LONG_ACTION, PAREN_LINES, PAREN_RATIO = 60, 5, 0.4
# Words for emotions as an alternation, direct statements of them, and opposite times of day.
EMOTION = (
    "angry|happy|sad|scared|afraid|hurt|tired|excited|worried|confused|nervous|"
    "jealous|proud|disappointed|furious|terrified|lonely|ashamed|guilty|frustrated|"
    "relieved|surprised|anxious|heartbroken|furious|mad|glad|frightened"
)
ON_THE_NOSE = (
    r"(?i)\b(i('m| am| feel| felt| was| became| got) (so |really |very )?(?:" + EMOTION + r"))"
    r"|\b(i hate (you|this|it)|i love (you|this|it)|i('m| am) in love)\b"
)
OPPOSITE = {
    "NIGHT": {"DAY", "MORNING"},
    "DAY": {"NIGHT"},
    "MORNING": {"NIGHT"},
}
NO_NAMES = ["INT", "EXT", "INT/EXT", "EST", "CONTINUOUS"]


def first_lines(elements: DataFrame, speaker: str = "raw_cue") -> DataFrame:
    """(script_id, scene_number, element_index, speaker, text): the first dialogue after each cue.

    speaker: "raw_cue" takes the cue as written, extensions and all; "normalized" the character's name.
    """
    by = Window.partitionBy("script_id", "scene_number").orderBy("element_index")
    rows = elements.where("scene_number > 0").withColumn("cue_no", F.count(F.when(F.col("type") == "character", 1)).over(by))
    name = F.trim("text") if speaker == "raw_cue" else F.col("character")
    rows = rows.withColumn("speaker", F.last(F.when(F.col("type") == "character", name), True).over(by)).where("type = 'dialogue' and cue_no > 0 and speaker <> ''")
    nth = F.row_number().over(Window.partitionBy("script_id", "scene_number", "cue_no").orderBy("element_index"))
    return rows.withColumn("n", nth).where("n = 1").select("script_id", "scene_number", "element_index", "speaker", F.trim("text").alias("text"))


def fingerprints(lines: DataFrame, order: list[str], least: int = MIN_LINES) -> DataFrame:
    """Per speaker with enough lines: counts of the PROFILE_WORDS commonest words, mean line and word length,
    question and exclamation rates. `order` are the columns that put a speaker's lines in order."""
    keys = ["script_id", "speaker"]
    style = lines.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(word_count(F.col("text"))).alias("line_words"),
        F.sum(F.regexp_count("text", F.lit(r"\?"))).alias("questions"), F.sum(F.regexp_count("text", F.lit("!"))).alias("bangs"),
        F.sum(F.aggregate(voice_tokens(F.col("text")), F.lit(0), lambda s, w: s + F.char_length(w))).alias("letters"),
        F.sum(F.size(voice_tokens(F.col("text")))).alias("tokens"),
    ).where(F.col("n") >= least)
    tokens = lines.select(*keys, *order, F.posexplode(voice_tokens(F.col("text"))).alias("at", "word"))
    counted = tokens.groupBy(*keys, "word").agg(F.count("*").alias("uses"), F.min(F.struct(*order, "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("uses"), "first"))
    common = counted.withColumn("r", rank).where(F.col("r") <= PROFILE_WORDS).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "uses"))).alias("freq"))
    rows = style.join(common, keys, "left")
    return rows.select(
        *keys, F.coalesce("freq", F.create_map().cast("map<string,bigint>")).alias("freq"), (F.col("line_words") / F.col("n")).alias("line_len"),
        (F.col("letters") / F.greatest("tokens", F.lit(1))).alias("word_len"), (F.col("questions") / F.col("n")).alias("q_rate"), (F.col("bangs") / F.col("n")).alias("bang_rate"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two count maps, 0 if one is empty."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + a[k] * F.coalesce(F.try_element_at(b, k), F.lit(0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def closeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 for the same style apart from vocabulary, 0 for none in common."""
    gap = lambda k, floor, extra=0.0: F.abs(a[k] - b[k]) / F.greatest(F.lit(floor), a[k] + b[k] + extra)
    total = gap("line_len", 1.0) + gap("word_len", 0.5) + gap("q_rate", 0.05, 0.001) + gap("bang_rate", 0.05, 0.001)
    return F.greatest(F.lit(0.0), 1 - total / 4)


def similar_voices(profiles: DataFrame, shared: DataFrame, threshold: float = SIMILAR, limit: int | None = MOST_PAIRS) -> DataFrame:
    """Pairs (a < b) of speakers whose voices are alike and who share a scene. shared: (script_id, a, b, together).

    Starts from the pairs that share a scene, so speakers are never all paired up.
    """
    style = ["line_len", "word_len", "q_rate", "bang_rate"]
    side = lambda s: profiles.select("script_id", F.col("speaker").alias(s), F.upper("speaker").alias(f"key_{s}"), F.struct("freq", *style).alias(f"p_{s}"))
    pairs = shared.select("script_id", F.upper("a").alias("x"), F.upper("b").alias("y"), "together")
    pairs = pairs.unionByName(pairs.select("script_id", F.col("y").alias("x"), F.col("x").alias("y"), "together")).distinct()
    rows = pairs.join(side("a").withColumnRenamed("key_a", "x"), ["script_id", "x"]).join(side("b").withColumnRenamed("key_b", "y"), ["script_id", "y"]).where("a < b")
    a, b = ({k: F.col(f"p_{s}.{k}") for k in style} for s in "ab")
    rows = rows.withColumn("similarity", 0.7 * cosine(F.col("p_a.freq"), F.col("p_b.freq")) + 0.3 * closeness(a, b)).where(F.col("similarity") >= threshold)
    rows = rows.select("script_id", "a", "b", "similarity", "together")
    if limit is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc("similarity"), "a", "b"))
    return rows.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def idiolect_shifts(lines: DataFrame, order: list[str], shift: float = SHIFT) -> DataFrame:
    """Speakers whose mean line length changes sharply between the halves of their lines."""
    keys = ["script_id", "speaker"]
    rows = lines.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    early, n = F.col("k") <= F.floor(F.col("n") / 2), word_count(F.col("text"))
    halves = rows.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.count(F.when(early, 1)).alias("n1"), F.sum(F.when(early, n)).alias("w1"), F.sum(F.when(~early, n)).alias("w2"),
    ).where((F.col("n_lines") >= IDIOLECT_LINES) & (F.col("n1") >= HALF_LINES) & (F.col("n_lines") - F.col("n1") >= HALF_LINES))
    halves = halves.withColumn("early_len", F.col("w1") / F.col("n1")).withColumn("late_len", F.col("w2") / (F.col("n_lines") - F.col("n1")))
    rel = F.coalesce(F.abs(F.col("early_len") - F.col("late_len")) / F.nullif(F.greatest("early_len", "late_len"), F.lit(0.0)), F.lit(0.0))
    return halves.withColumn("shift", rel).where(F.col("shift") >= shift).select(*keys, "n_lines", "early_len", "late_len", "shift")


def on_the_nose(lines: DataFrame) -> DataFrame:
    """Lines in which speakers name their own emotion."""
    return lines.where(F.col("text").rlike(ON_THE_NOSE))


def time_flips(scenes: DataFrame, skips: DataFrame | None = None, keys: tuple = ("script_id",), order: str = "scene_number", time: str = "time_of_day") -> DataFrame:
    """Scenes whose time of day is the opposite of the scene before, unmarked. skips: (keys, order) of marked scenes."""
    rows = scenes
    if skips is not None:
        marked = skips.select(*keys, order).distinct().withColumn("marked", F.lit(True))
        rows = scenes.join(marked, [*keys, order], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    else:
        rows = scenes.withColumn("marked", F.lit(False))
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("now", F.upper(time)).withColumn("before", F.upper(F.lag(time).over(by))).withColumn("marked_before", F.lag("marked").over(by))
    flip = F.lit(False)
    for before, now in OPPOSITE.items():
        flip = flip | ((F.col("before") == before) & F.col("now").isin(*now))
    return rows.where(flip & ~F.col("marked") & ~F.coalesce("marked_before", F.lit(False))).select(*keys, order, "before", "now")


def marked_scenes(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("type") == "action") & F.col("text").rlike(TIME_SKIP)).select("script_id", "scene_number").distinct()


def name_variants(names: DataFrame, keys: list[str], name: str, seen: DataFrame | None = None, distance: int = 2) -> DataFrame:
    """(keys, a, b): names within `distance` edits, or a prefix of at least 4 letters up to 3 short; a < b.

    Candidates meet in joins, never as all pairs: a name is cut into distance + 1 stretches, and names within
    that many edits share a stretch up to a shift (of at most `distance`); prefixes meet on their own. seen:
    (keys, name, scene); pairs that share a scene are out.
    """
    rows = names.where(F.col(name).isNotNull() & ~F.upper(name).isin(NO_NAMES)).select(*keys, F.col(name).alias("n"), F.upper(name).alias("u")).distinct().where("u <> ''")
    parts = distance + 1
    size = F.char_length("u")
    # stretches of the longer name, of a length that its shorter partner of len - d characters would have too
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda d: F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct((size - d).alias("len"), i.alias("part"), (F.floor(i * (size - d) / parts)).alias("from"), (F.floor((i + 1) * (size - d) / parts) - F.floor(i * (size - d) / parts)).alias("w")))))
    own = rows.select(*keys, "n", "u", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(
        size.alias("len"), i.alias("part"), F.substring("u", (F.floor(i * size / parts) + 1).cast("int"), (F.floor((i + 1) * size / parts) - F.floor(i * size / parts)).cast("int")).alias("t")))).alias("s"))
    probe = rows.select(*keys, "n", "u", F.explode(F.filter(cuts, lambda c: c["len"] > 0)).alias("c"), size.alias("size"))
    probe = probe.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("c.from") - distance), F.col("c.from") + distance)))
    probe = probe.select(*keys, "n", "u", F.struct(F.col("c.len").alias("len"), F.col("c.part").alias("part"), F.substring("u", (F.col("at") + 1).cast("int"), F.col("c.w").cast("int")).alias("t")).alias("s")).distinct()
    close = own.alias("x").join(probe.alias("y"), [*[F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys], F.col("x.s") == F.col("y.s")])
    close = close.where((F.col("x.u") != F.col("y.u")) & (F.levenshtein(F.col("x.u"), F.col("y.u"), distance) >= 0))
    heads = rows.select(*keys, "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.substring("u", F.lit(1), size - k))).alias("u")).where("length(u) >= 4")
    starts = rows.alias("x").join(heads.alias("y"), [*[F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys], F.col("x.u") == F.col("y.u")])
    pair = lambda d: d.select(*[F.col(f"x.{k}").alias(k) for k in keys], F.least("x.n", "y.n").alias("a"), F.greatest("x.n", "y.n").alias("b"))
    found = pair(close).unionByName(pair(starts)).distinct()
    if seen is None:
        return found
    where = seen.select(*keys, F.upper(name).alias("u"), "scene_number").distinct()
    both = found.join(where.select(*keys, F.col("u").alias("ua"), F.col("scene_number")), keys).where(F.upper("a") == F.col("ua"))
    both = both.select(*keys, "a", "b", "scene_number").join(where.select(*keys, F.col("u").alias("ub"), "scene_number"), [*keys, "scene_number"]).where(F.upper("b") == F.col("ub"))
    return found.join(both.select(*keys, "a", "b").distinct(), [*keys, "a", "b"], "left_anti")


def scene_pace(elements: DataFrame, keys: tuple = ("script_id",), rounded=F.bround) -> DataFrame:
    """Per scene: words, beats, density, action share, and how slow it is from 0 to 100 within its script.

    All that is no dialogue counts as movement, headings and cues included.
    """
    n = word_count(F.col("text"))
    rows = elements.where("scene_number > 0").groupBy(*keys, "scene_number").agg(
        F.sum(n).alias("words"), F.count(F.when(n > 0, 1)).alias("beats"), F.sum(F.when(F.col("type") == "dialogue", n).otherwise(0)).alias("dialogue_words")
    )
    rows = rows.withColumn("density", rounded(F.col("words") / F.greatest("beats", F.lit(1)), 1))
    rows = rows.withColumn("action_share", rounded((F.col("words") - F.col("dialogue_words")) / F.greatest("words", F.lit(1)), 3))
    every = Window.partitionBy(*keys)
    span = lambda c: F.greatest(F.lit(1e-9), F.max(c).over(every) - F.min(c).over(every))
    dense = (F.col("density") - F.min("density").over(every)) / span("density")
    still = (F.max("action_share").over(every) - F.col("action_share")) / span("action_share")
    return rows.withColumn("pace_score", rounded(100 * (0.6 * dense + 0.4 * still), 0))


def drags(pace: DataFrame, keys: tuple = ("script_id",)) -> DataFrame:
    """The slowest MOST_DRAGS scenes of each script, of those only the ones slow and long enough."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pace_score"), "scene_number"))
    return pace.withColumn("slow_rank", rank).where((F.col("slow_rank") <= MOST_DRAGS) & (F.col("pace_score") >= DRAG_SCORE) & (F.col("words") >= DRAG_WORDS))


def parenthetical_ratio(rows: DataFrame, keys: list[str], kind: str = "type", paren: str = "parenthetical", said: str = "dialogue", least: int = PAREN_LINES, ratio: float = PAREN_RATIO) -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count(F.when(F.col(kind) == paren, 1)).alias("parens"), F.count(F.when(F.col(kind) == said, 1)).alias("lines"))
    return counted.where((F.col("lines") >= least) & (F.col("parens") > ratio * F.col("lines")))


def unintroduced(rows: DataFrame, keys: list[str], order: str, shown, spoken) -> DataFrame:
    """Entities whose first `spoken` row comes before any `shown` row. shown and spoken are conditions."""
    first = rows.groupBy(*keys).agg(F.min(F.when(shown, F.col(order))).alias("first_shown"), F.min(F.when(spoken, F.col(order))).alias("first_spoken"))
    return first.where("first_spoken is not null and (first_shown is null or first_shown > first_spoken)")


def formatting(elements: DataFrame, scenes: DataFrame) -> DataFrame:
    """(script_id, rule, severity, scene_refs, message) of all formatting checks."""
    row = lambda d, rule, severity, refs, message: d.select("script_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), refs.alias("scene_refs"), message.alias("message"))
    scene, none = F.array("scene_number"), F.array().cast("array<int>")
    out = row(scenes.where("coalesce(int_ext, '') = ''"), "scene_heading_missing_int_ext", "medium", scene, F.concat(F.lit("No interior or exterior in heading: "), F.col("heading_raw")))
    out = out.unionByName(row(scenes.where("coalesce(time_of_day, '') = ''"), "scene_heading_missing_time_of_day", "low", scene, F.concat(F.lit("No time of day in heading: "), F.col("heading_raw"))))
    n = word_count(F.col("text"))
    long = elements.where((F.col("type") == "action") & (F.col("scene_number") > 0) & (n > LONG_ACTION))
    out = out.unionByName(row(long, "long_action_block", "low", scene, F.concat(F.lit("Action of "), n.cast("string"), F.lit(" words in one block"))))
    heavy = parenthetical_ratio(elements.where("character is not null and scene_number > 0"), ["script_id", "character"])
    share = F.concat(F.col("character"), F.lit(": parentheticals on "), F.col("parens").cast("string"), F.lit(" of "), F.col("lines").cast("string"), F.lit(" lines"))
    out = out.unionByName(row(heavy, "heavy_parenthetical_usage", "low", none, share))
    names = elements.where("type = 'character' and scene_number > 0").select("script_id", "character").distinct()
    at = F.struct(F.col("scene_number").alias("scene"), F.col("element_index").alias("index"))
    action = elements.where("type = 'action' and scene_number > 0").select("script_id", "text", at.alias("at"))
    shown = names.join(action, "script_id").where(whole_word(F.col("text"), F.col("character"))).select("script_id", "character", "at", F.lit(True).alias("shown"))
    cues = elements.where("type = 'character' and scene_number > 0").select("script_id", "character", at.alias("at"), F.lit(False).alias("shown"))
    late = unintroduced(shown.unionByName(cues), ["script_id", "character"], "at", F.col("shown"), ~F.col("shown"))
    out = out.unionByName(row(late, "character_not_capitalized_on_first_appearance", "low", F.array(F.col("first_spoken.scene")), F.concat(F.col("character"), F.lit(" speaks before being introduced in action"))))
    return out
