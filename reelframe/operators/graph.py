"""The knowledge graph as tables: co-occurrence edges, characters, props, promises, time markers, traits."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the extraction patterns.
CAPITALS = r"\b([A-Z]{3,}(?:\s[A-Z]{3,}){0,2})\b"
PROP_STOP = ["THE", "AND", "BUT", "FOR", "WITH", "FROM", "INT", "EXT", "DAY", "NIGHT", "CONTINUOUS", "LATER", "MOMENTS", "CUT", "FADE", "SAME"]
TIME_SKIP = r"(?i)\b(LATER|MOMENTS LATER|THE NEXT (?:DAY|MORNING|NIGHT)|EARLIER|\d+\s+(?:YEARS?|MONTHS?|WEEKS?|DAYS?|HOURS?)\s+(?:LATER|AGO)|(?:19|20)\d{2})\b"
PROMISE = r"(?i)\b(I'?ll (?:tell|show|explain|prove)|I promise|when this is (?:all )?over|you'?ll understand|someday you'?ll|I swear|trust me,? (?:I|you))\b"
TELUGU_PROMISE = (
    r"(?i)\b(cheptha(?:nu)?|chepthaam?|chupistha(?:nu)?|chestha(?:nu)?|istha(?:nu)?|nammuko|pratijna|pratigya|oka roju|tappakunda|nee kosam|"
    r"marchiponu|wait chey|appudu choodu|nijam ga cheptha|satyam ga cheptha)\b"
)
DESCRIPTOR, AGE = r"\(([^)]{3,80})\)", r"\b(\d{1,3})\s*(?:s\b|years?[\s-]old\b)"
WITHIN, EXCERPT = 90, 160


def cooccurrence(presence: DataFrame, group: list[str], member: str, order: str | None = None, tasks: int | None = None) -> DataFrame:
    """(group but the last, a, b, together[, scenes]): how many containers two members share, a < b.

    group: the container's key, e.g. script and scene. Members are made distinct per container, collected once,
    and paired inside the container, so the pairs need no join; counts combine before the second shuffle. A
    container's pairs grow with the square of its members: containers are scenes or orders, which are small.
    tasks: how many tasks containers are dealt over; by default Spark decides by their size, which pairs exceed many times.
    """
    presence = presence.repartition(tasks, *group) if tasks else presence
    cast = presence.where(F.col(member).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("cast_")).where(F.size("cast_") > 1)
    pairs = F.flatten(F.transform("cast_", lambda a, i: F.transform(F.slice("cast_", i + 2, F.size("cast_")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    keys = group[:-1]
    rows = cast.select(*group, F.explode(pairs).alias("p")).groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    aggregates = [F.count("*").alias("together")]
    if order:
        aggregates.append(F.array_sort(F.collect_list(order)).alias("scenes"))
    return rows.agg(*aggregates)


def top_partners(pairs: DataFrame, keys: list[str], limit: int = 8) -> DataFrame:
    """(keys, member, partner, together, partner_rank): each member's strongest partners."""
    way = lambda a, b: F.struct(F.col(a).alias("member"), F.col(b).alias("partner"))
    both = pairs.select(*keys, F.inline(F.array(way("a", "b"), way("b", "a"))), "together")
    rank = F.row_number().over(Window.partitionBy(*keys, "member").orderBy(F.desc("together"), "partner"))
    return both.withColumn("partner_rank", rank).where(F.col("partner_rank") <= limit)


def character_index(presence: DataFrame, elements: DataFrame) -> DataFrame:
    """Per character: scenes, first and last, and a map from scene to lines of dialogue."""
    keys = ["script_id", "character"]
    seen = presence.groupBy(*keys).agg(F.array_sort(F.collect_set("scene_number")).alias("scenes_present"), F.min("scene_number").alias("first_scene"), F.max("scene_number").alias("last_scene"))
    said = elements.where("type = 'dialogue' and character is not null and scene_number > 0").groupBy(*keys, "scene_number").agg(F.count("*").cast("int").alias("n"))
    said = said.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scene_number", "n")))).alias("scene_dialogue_counts"))
    return seen.join(said, keys, "left")


def trait_mentions(presence: DataFrame, elements: DataFrame) -> DataFrame:
    """(script_id, character, scene_number, element_index, descriptor, kind): a parenthetical soon after a name in action."""
    action = elements.where("type = 'action'").select("script_id", "scene_number", "element_index", "text")
    rows = presence.join(action, ["script_id", "scene_number"]).where(F.contains("text", "character"))
    near = F.substring("text", F.expr("locate(character, text)"), F.char_length("character") + WITHIN)
    rows = rows.withColumn("descriptor", F.regexp_extract(near, DESCRIPTOR, 1)).where("descriptor <> ''")
    return rows.select("script_id", "character", "scene_number", "element_index", "descriptor", F.when(F.col("descriptor").rlike(AGE), "age").otherwise("descriptor").alias("kind"))


def recurring_phrases(rows: DataFrame, keys: list[str], container: str, text: str, excluded: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(keys, phrase, containers, mentions): runs of capitals that occur in at least `least` containers.

    A phrase counts once a row. `excluded` (keys, phrase) takes names out; phrases of stop words only never count.
    """
    found = rows.select(*keys, container, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALS), F.lit(1)))).alias("phrase"))
    found = found.where(~F.forall(F.split("phrase", r"\s"), lambda w: w.isin(PROP_STOP)))
    counted = found.groupBy(*keys, "phrase").agg(F.count_distinct(container).alias("containers"), F.count("*").alias("mentions"))
    counted = counted.where(F.col("containers") >= least)
    return counted.join(excluded, [*keys, "phrase"], "left_anti") if excluded is not None else counted


def props(elements: DataFrame, presence: DataFrame) -> DataFrame:
    """Prop candidates of each script: capitals in action that recur and are no character's name."""
    action = elements.where("type = 'action' and scene_number > 0")
    return recurring_phrases(action, ["script_id"], "scene_number", "text", presence.select("script_id", F.col("character").alias("phrase")).distinct())


def prop_mentions(elements: DataFrame, found: DataFrame) -> DataFrame:
    """(script_id, phrase, scene_number, element_index, text): the first EXCERPT characters of each mention."""
    action = elements.where("type = 'action' and scene_number > 0")
    rows = action.select("script_id", "scene_number", "element_index", F.substring("text", 1, EXCERPT).alias("text"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CAPITALS), F.lit(1)))).alias("phrase"))
    return rows.join(found.select("script_id", "phrase"), ["script_id", "phrase"], "left_semi")


def time_markers(rows: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """(keys, markers): explicit time skips in order of appearance, each once."""
    found = rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.regexp_extract_all(text, F.lit(TIME_SKIP), F.lit(0)).alias("m")))), lambda x: x["m"])).alias("m"))
    return found.select(*keys, F.array_distinct("m").alias("markers"))


def timeline(scenes: DataFrame, elements: DataFrame) -> DataFrame:
    marks = time_markers(elements.where("type = 'action'"), ["script_id", "scene_number"], "element_index")
    rows = scenes.select("script_id", "scene_number", "int_ext", "time_of_day").join(marks, ["script_id", "scene_number"], "left")
    return rows.withColumn("markers", F.coalesce("markers", F.array().cast("array<string>")))


def promises(elements: DataFrame) -> DataFrame:
    """Dialogue that commits its speaker: the first English phrase, else the first Telugu one."""
    hit = F.coalesce(F.regexp_substr("text", F.lit(PROMISE)), F.regexp_substr("text", F.lit(TELUGU_PROMISE)))
    said = elements.where("type = 'dialogue' and character is not null")
    return said.select("script_id", "scene_number", "element_index", "character", "text", hit.alias("matched")).where("matched is not null")
