"""Model passes: chunks of rows through an injectable client, with retries and halving, as one map over sorted partitions.

A client is made once a partition by a factory and has chat_json(system, user, schema) -> object. Nothing here
opens a connection; tests pass fakes.
"""
from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import findings

CATEGORIES = ["dialogue", "theme", "character", "structure", "scene_function", "principles", "reads", "setup_payoff", "dials", "coverage", "logline", "genre"]
OVERVIEW = {"theme", "character", "structure", "scene_function", "reads", "setup_payoff", "dials", "coverage"}
NEEDS = {"genre": "coverage", "logline": "coverage", **{c: "overview" for c in OVERVIEW}}
FINDING = "category string, issue string, why_it_matters string, severity string, scene_refs array<int>, evidence_quote string, rule_id string"


@dataclass(frozen=True)
class Pass:
    """One pass: its instruction, the Spark schema of an answer's items, the key that may wrap them, its model tier."""

    name: str
    instruction: str
    schema: str
    key: str
    max_tokens: int
    fast: bool = False
    chunk: int = 1


#: The passes, with the shape of what each returns.
PASSES = {
    p.name: p
    for p in [
        Pass("summaries", "Summarise each scene in two sentences.", "scene_number int, summary string", "summaries", 800, True, 6),
        Pass("dialogue", "Find weak dialogue and quote it.", FINDING, "findings", 1200, False, 3),
        *[Pass(c, f"Find problems of {c.replace('_', ' ')} and quote the text.", FINDING, "findings", 1500) for c in ("theme", "character", "structure", "scene_function")],
        Pass("principles", "Is this planted element significant, and is it paid off?", "candidate string, significant boolean, paid_off boolean, issue string, why_it_matters string, scene_refs array<int>", "judgments", 500),
        Pass("reads", "Describe what each character wants and does, with a quote.", "character string, how_reads string, apparent_intent string, gap string, evidence_quote string, scene_refs array<int>", "reads", 1200, True),
        Pass("setup_payoff", "List setups and whether they pay off.", "setup string, kind string, setup_scenes array<int>, payoff_scenes array<int>, status string, note string", "ledger", 2000),
        Pass("dials", "Score each character from 1 to 10 between the poles.", "character string, traits array<struct<trait:string,score:int,scene_refs:array<int>,note:string>>", "dials", 1800),
        Pass("coverage", "Write a reader's coverage.", "recommendation string, logline string, genre string, tone string, synopsis string, strengths array<string>, weaknesses array<string>", "coverage", 900),
        Pass("logline", "Test the logline.", "signal string, what_works string, what_muddles string, missing string, tightened string", "logline", 700, True),
        Pass("genre", "Check the genre's conventions.", FINDING, "findings", 1200),
        Pass("rewrite", "Propose line replacements for the scene.", "old string, new string", "replacements", 1500),
        Pass("chat", "Answer the writer.", "reply string", "reply", 600),
        Pass("refresh", "What have you noticed about how the writer works?", "dimension string, text string, confidence double", "observations", 800),
    ]
}


def resolve_categories(wanted: None | str | list[str] | tuple) -> list[str]:
    """None and "all" mean every category; a comma-separated string or a list keeps known names in their order."""
    if wanted is None or wanted == "all":
        return list(CATEGORIES)
    asked = [w.strip() for w in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    return [c for c in CATEGORIES if c in asked]


def items(answer: object, key: str) -> list[dict]:
    """An answer's items, whether bare, in a list, or wrapped under its key (or the only list it has)."""
    if isinstance(answer, str):
        start = min((i for i in (answer.find("{"), answer.find("[")) if i >= 0), default=-1)
        if start < 0:
            return []
        try:
            answer = json.JSONDecoder().raw_decode(answer[start:])[0]
        except json.JSONDecodeError:
            return []
    if isinstance(answer, dict):
        lists = [v for v in answer.values() if isinstance(v, list)]
        inner = answer.get(key, lists[0] if len(lists) == 1 and len(answer) == 1 else answer)
        answer = inner if isinstance(inner, list) else [inner]
    return [x for x in answer or [] if isinstance(x, dict)]


def with_halving(chunk: list, call: Callable[[list], list], least: int = 1) -> Iterator[tuple[list, list, str | None]]:
    """(part, items, error) of a chunk, in order; what fails is cut in two until a part of `least` fails by itself."""
    waiting = [chunk]
    while waiting:
        part = waiting.pop()
        try:
            found, error = call(part), None
        except Exception as e:  # a model's failure is a row's error, not the job's
            found, error = [], f"{type(e).__name__}: {e}"
        if error and len(part) > least:
            half = len(part) // 2
            waiting += [part[half:], part[:half]]
        else:
            yield part, found, error


def with_retries(call: Callable[[], object], tries: int = 6, wait: float = 1.5, busy: tuple = (429, 503)) -> object:
    """Calls again while the server says it is busy, waiting longer each time."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception as error:
            if n == tries or getattr(error, "status", None) not in busy:
                raise
            time.sleep(wait * n)
    raise AssertionError("unreachable")


def run_pass(rows: DataFrame, what: Pass, client_factory: Callable[[bool], object], keys: list[str], text: str = "text", language: str = "eng", wait: float = 1.5) -> DataFrame:
    """(keys[0], item_index, error, answer struct): the pass over rows, chunked within each group.

    rows has a `chunk` column (see context.chunks) or is taken row by row, where it lies. Rows of a chunk come together in
    a partition sorted by chunk; partitions run in parallel. item_index counts a group's answers from 0, by chunk (by keys[1:], where there
    is none) and by their order within it, so answers keep the order of the script that was read in several parts.
    """
    group, at = keys[0], ["chunk"] if "chunk" in rows.columns else keys[1:]
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (group, *at)] + ["part long", "place int", "error string", "raw string"])

    def answers(texts: list[str]) -> list[tuple]:
        client, out = client_factory(what.fast), []
        ask = lambda part: items(with_retries(lambda: client.chat_json(f"{what.instruction} Answer in {language}.", "\n\n".join(part), what.schema), wait=wait), what.key)
        for _, found, error in with_halving(texts, ask):
            out += [(len(out) + i, None, json.dumps(x)) for i, x in enumerate(found)] if error is None else [(len(out), error, None)]
        return out

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, kind = None, [], None
        alike = lambda a, b: a == b or (a != a and b != b)

        def made(found: list[tuple]) -> pa.RecordBatch:
            types = [*kind, pa.int64(), pa.int32(), pa.string(), pa.string()]
            columns = zip(*found) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[group, *at, "part", "place", "error", "raw"])

        for b in batches:
            kind, found = [b.schema.field(i).type for i in (0, 1)], []
            for *key, line in zip(*(b.column(i).to_pylist() for i in range(3))):
                if texts and not all(map(alike, key, held)):
                    found += [(*held, 0, *x) for x in answers(texts)]
                    texts = []
                held = key
                texts.append(line)
            yield made(found)
        if texts:
            yield made([(*held, 0, *x) for x in answers(texts)])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(*row[:-1], *x) for row in pdf[[group, *at, "part", text]].itertuples(index=False) for x in answers([row[-1]])]
            yield pd.DataFrame(found, columns=[group, *at, "part", "place", "error", "raw"])

    if at == ["chunk"]:
        # sorted partitions, not a group each: a chunk is small, and one call a chunk costs more than its rows
        placed = rows.select(group, "chunk", F.col(text).alias("line_"), *keys[1:]).repartition(group, "chunk")
        placed = placed.sortWithinPartitions(group, "chunk", *[F.asc_nulls_last(k) for k in keys[1:]])
        answered = placed.select(group, "chunk", "line_").mapInArrow(chunks, schema)
    else:
        answered = rows.select(group, *at, F.monotonically_increasing_id().alias("part"), text).mapInPandas(each, schema)
    order = Window.partitionBy(group).orderBy(*at, "part", "place", "raw")
    numbered = answered.withColumn("item_index", F.row_number().over(order) - 1)
    return numbered.select(group, "item_index", "error", F.from_json("raw", what.schema).alias("answer"))


def with_progress(answers: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same answers, and an observation that counts them and their errors while any action runs over them."""
    seen = Observation(name)
    return answers.observe(seen, F.count("answer").alias("answered"), F.count("error").alias("failed")), seen


def clean_dials(answers: DataFrame) -> DataFrame:
    """(script_id, character, trait, score, scene_refs, note): scores clamped to 1..10, unnamed entries dropped."""
    rows = answers.select("script_id", F.trim("answer.character").alias("character"), F.explode("answer.traits").alias("t")).where("character <> '' and trim(t.trait) <> '' and t.score is not null")
    return rows.select("script_id", "character", F.trim("t.trait").alias("trait"), F.greatest(F.lit(1), F.least(F.lit(10), F.col("t.score"))).alias("score"), "t.scene_refs", F.substring(F.trim("t.note"), 1, 200).alias("note"))


def principle_findings(answers: DataFrame) -> DataFrame:
    """Only what is significant and not paid off becomes a finding."""
    rows = answers.where("answer.significant and not answer.paid_off")
    return rows.select("script_id", F.lit("plot_thread").alias("category"), "answer.issue", "answer.why_it_matters", F.lit("medium").alias("severity"), "answer.scene_refs")


def resolved_model(explicit: str | None, inherited: str | None, loaded: list[str]) -> str | None:
    return explicit or inherited or (loaded[0] if loaded else None)


def conventions(reports: DataFrame, table: DataFrame, default: str = "drama") -> DataFrame:
    """reports (script_id, genre) with the conventions of the best matching genre of the table (genre, order, conventions):
    equal, one within the other (table order), most words in common, else the default. The table is a small dimension."""
    asked, own = F.lower(F.trim("genre")), F.lower("known")
    known = table.select(F.col("genre").alias("known"), F.col("order"), "conventions")
    common = F.size(F.array_intersect(F.split(asked, r"\W+"), F.split(own, r"\W+")))
    rank = F.when(asked == own, F.lit(1000)).when((asked != "") & (F.contains(asked, own) | F.contains(own, asked)), 500 - F.col("order")).when(common > 0, common).when(own == default, F.lit(0))
    every = known.groupBy().agg(F.collect_list(F.struct("known", "order", "conventions")).alias("all"))
    rows = reports.select("script_id", F.coalesce("genre", F.lit("")).alias("genre")).join(every).select("script_id", "genre", F.inline("all"))
    return rows.withColumn("rank", rank).where("rank is not null").groupBy("script_id", "genre").agg(F.max_by("known", F.struct("rank", -F.col("order"))).alias("matched"), F.max_by("conventions", F.struct("rank", -F.col("order"))).alias("conventions"))


def in_order(rows: DataFrame, at: list[str], line: Column, name: str, separator: str = "\n") -> DataFrame:
    """(script_id, name): the lines of each script, ordered by `at`, as one text."""
    listed = F.array_sort(F.collect_list(F.struct(*at, line.alias("line_"))))
    return rows.groupBy("script_id").agg(F.array_join(F.transform(listed, lambda x: x["line_"]), separator).alias(name))


def overviews(summaries: DataFrame) -> DataFrame:
    """(script_id, text): what passes over a whole script read, from (script_id, scene_number, summary)."""
    return in_order(summaries.where("summary <> ''"), ["scene_number"], F.concat(F.lit("Scene "), F.col("scene_number").cast("string"), F.lit(": "), F.col("summary")), "text")


def seeds(props: DataFrame, promises: DataFrame, cut: int = 120) -> DataFrame:
    """(script_id, seeds): what the ledger starts from, a line each: objects by mentions, then promises in order.

    props: (script_id, phrase, mentions, scenes array<int>); promises: (script_id, scene_number, element_index,
    character, text), of which the first `cut` characters are shown.
    """
    place = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.alias("c")).alias("at")
    scenes = F.array_join(F.transform("scenes", lambda n: F.concat(F.lit("S"), n.cast("string"))), ", ")
    things = props.select("script_id", place(0, -F.col("mentions"), F.lit(0), F.col("phrase")), F.concat(F.lit("- object "), F.col("phrase"), F.lit(" in "), scenes).alias("line"))
    head = F.substring(F.trim("text"), 1, cut)
    said = promises.select("script_id", place(1, F.col("scene_number"), F.col("element_index"), F.lit("")), F.concat(F.lit("- promise of "), F.col("character"), F.lit(" in S"), F.col("scene_number").cast("string"), F.lit(": "), head).alias("line"))
    return in_order(things.unionByName(said), ["at"], F.col("line"), "seeds")


def ledger_input(overview: DataFrame, seeds_: DataFrame) -> DataFrame:
    """(script_id, text): an overview with its seeds, for the pass setup_payoff. A script without seeds says so."""
    return overview.join(seeds_, "script_id", "left").select("script_id", F.concat("text", F.lit("\n\nCandidates:\n"), F.coalesce("seeds", F.lit("(none)"))).alias("text"))


def ledger_entries(answers: DataFrame, limit: int = 12) -> DataFrame:
    """The ledger of each script from the pass's answers: entries without a setup go, an unknown status is dangling, open
    entries come first, at most `limit` a script stay."""
    a = answers.where("trim(answer.setup) <> ''")
    known = F.coalesce(F.col("answer.status").isin("paid", "dangling", "abandoned", "red_herring"), F.lit(False))
    payoff = F.filter(F.coalesce("answer.payoff_scenes", F.array().cast("array<int>")), lambda n: n.isNotNull())
    rows = a.select(
        "script_id", F.col("item_index").alias("entry_index"), F.substring(F.trim("answer.setup"), 1, 200).alias("setup"), F.coalesce("answer.kind", F.lit("other")).alias("kind"),
        F.filter(F.coalesce("answer.setup_scenes", F.array().cast("array<int>")), lambda n: n.isNotNull()).alias("setup_scenes"), F.when(F.size(payoff) > 0, payoff).alias("payoff_scenes"),
        F.when(known, F.col("answer.status")).otherwise("dangling").alias("status"), F.substring(F.trim(F.coalesce("answer.note", F.lit(""))), 1, 400).alias("note"),
    )
    return findings.ledger(rows, limit)


def reads_input(overview: DataFrame, cast: DataFrame) -> DataFrame:
    """(script_id, text): an overview with the leading characters (see context.leading_cast); scripts without any are not read."""
    names = in_order(cast, ["cast_rank"], F.col("character"), "names", ", ")
    return overview.join(names, "script_id").select("script_id", F.concat("text", F.lit("\n\nCharacters: "), "names").alias("text"))


def verified_reads(answers: DataFrame, elements: DataFrame) -> DataFrame:
    """Reads of named characters with their quotes looked up in the script, as those of findings are."""
    rows = answers.where("trim(answer.character) <> ''").select("script_id", F.col("item_index").alias("finding_index"), "answer.*")
    rows = rows.withColumn("scene_refs", F.coalesce("scene_refs", F.array().cast("array<int>")))
    return findings.verify(rows, elements)


def coverage_of(answers: DataFrame) -> DataFrame:
    """One coverage a script: its first answer; of several that are numbered alike the least."""
    first = F.row_number().over(Window.partitionBy("script_id").orderBy("item_index", "answer"))
    return answers.where("answer is not null").withColumn("n_", first).where("n_ = 1").select("script_id", "answer.*")


def logline_input(coverage: DataFrame, overview: DataFrame) -> DataFrame:
    """(script_id, text): the coverage's logline over the overview; scripts without a logline are not tested."""
    asked = coverage.where("trim(logline) <> ''").select("script_id", F.trim("logline").alias("logline"))
    return asked.join(overview, "script_id").select("script_id", F.concat(F.lit("Logline: "), "logline", F.lit("\n\n"), "text").alias("text"))


def genre_input(coverage: DataFrame, overview: DataFrame, table: DataFrame, default: str = "drama") -> DataFrame:
    """(script_id, text): the conventions of the coverage's genre over the overview."""
    known = conventions(coverage.select("script_id", "genre"), table, default)
    return known.join(overview, "script_id").select("script_id", F.concat(F.lit("Conventions of "), "matched", F.lit(": "), "conventions", F.lit("\n\n"), "text").alias("text"))
