"""Draft comparison, revision by logged edits, beat boards."""
from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import contained
from .similarity import similar_pairs

SAME_LINE, SAME_ISSUE, EDIT_MATCH = 0.95, 0.7, 0.8


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed, changed or unchanged, in one full outer join on the keys."""
    side = lambda d, s: d.select(*keys, F.struct(*values).alias(s))
    rows = side(old, "was").join(side(new, "is"), keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed").otherwise("unchanged")
    return rows.select(*keys, change.alias("change"))


def scene_signatures(elements: DataFrame, scenes: DataFrame) -> DataFrame:
    body = elements.where("type <> 'scene_heading'").groupBy("script_id", "scene_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("element_index", "type", "text"))), lambda x: F.struct(x["type"], x["text"])).alias("body"))
    return scenes.select("script_id", "scene_number", "heading_raw").join(body, ["script_id", "scene_number"], "left")


def scene_diff(old: dict, new: dict) -> DataFrame:
    """old and new: dicts with elements and scenes."""
    return keyed_diff(*(scene_signatures(d["elements"], d["scenes"]) for d in (old, new)), ["script_id", "scene_number"], ["heading_raw", "body"])


def presence_diff(old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, added, removed): items that an entity gained or lost; entities without a difference are left out."""
    side = lambda d, s: d.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias(s))
    rows = side(old, "was").join(side(new, "is"), keys, "full_outer")
    empty = F.array().cast(dict(side(old, "was").dtypes)["was"])
    was, now = F.coalesce("was", empty), F.coalesce("is", empty)
    out = rows.select(*keys, F.array_sort(F.array_except(now, was)).alias("added"), F.array_sort(F.array_except(was, now)).alias("removed"))
    return out.where("size(added) > 0 or size(removed) > 0")


def line_alignment(old: DataFrame, new: DataFrame, keys: list[str], order: str, kind: str = "type", text: str = "text") -> DataFrame:
    """(keys, seq, op, old_text, new_text): lines of two versions side by side, aligned by longest common runs.

    One Python task a key (a scene): a scene is small, and keys are spread over all tasks.
    """
    schema_of_keys = ", ".join(f"`{k}` {dict(old.dtypes)[k]}" for k in keys)

    def align(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = ([tuple(r) for r in d.sort_values("o")[["k", "t"]].itertuples(index=False)] if len(d) else [] for d in (a, b))
        rows = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, left, right).get_opcodes():
            for k in range(max(i2 - i1, j2 - j1)):
                rows.append((*key, len(rows), op, left[i1 + k][1] if i1 + k < i2 else None, right[j1 + k][1] if j1 + k < j2 else None))
        return pd.DataFrame(rows, columns=[*keys, "seq", "op", "old_text", "new_text"])

    # explicit new columns: both sides may come from one frame
    pick = lambda d: d.select(*keys, (F.col(order) + 0).alias("o"), F.concat(kind, F.lit("")).alias("k"), F.concat(text, F.lit("")).alias("t"))
    return pick(old).groupBy(*keys).cogroup(pick(new).groupBy(*keys)).applyInPandas(align, f"{schema_of_keys}, seq int, op string, old_text string, new_text string")


def finding_states(findings: DataFrame, elements: DataFrame) -> DataFrame:
    """(script_id, finding_index, status): still_present if an element holds the quote or nearly equals it,
    addressed if not, unknown without a quote."""
    key = ["script_id"]
    asked = findings.where("coalesce(trim(evidence_quote), '') <> ''").select("script_id", "finding_index", F.col("evidence_quote").alias("text"))
    lines = elements.select("script_id", F.col("text")).distinct().withColumn("line_id", F.sha2("text", 256))
    exact = contained(asked, lines, key, "text", "text", "finding_index", "line_id").select("script_id", "finding_index")
    rest = asked.join(exact, ["script_id", "finding_index"], "left_anti")
    alike = similar_pairs(rest, lines, key, "text", SAME_LINE).select("script_id", F.col("left_text").alias("text")).distinct()
    near = rest.join(alike, ["script_id", "text"], "left_semi").select("script_id", "finding_index")
    there = exact.unionByName(near).distinct().withColumn("there", F.lit(True))
    rows = findings.select("script_id", "finding_index", F.coalesce(F.trim("evidence_quote"), F.lit("")).alias("q")).join(there, ["script_id", "finding_index"], "left")
    return rows.select("script_id", "finding_index", F.when(F.col("q") == "", "unknown").when(F.col("there"), "still_present").otherwise("addressed").alias("status"))


def carried(old: DataFrame, new: DataFrame, keys: list[str], id_col: str, text: str, threshold: float = SAME_ISSUE) -> DataFrame:
    """(keys, id, best, carried): each new text's greatest similarity to the group's old texts, null below the threshold."""
    a = new.select(*keys, id_col, F.lower(text).alias("text"))
    b = old.select(*keys, F.lower(text).alias("text"))
    best = similar_pairs(a, b, keys, "text", threshold).groupBy(*keys, F.col("left_text").alias("text")).agg(F.max("similarity").alias("best"))
    return a.join(best, [*keys, "text"], "left").select(*keys, id_col, "best", F.col("best").isNotNull().alias("carried"))


def previous_draft(drafts: DataFrame) -> DataFrame:
    return drafts.withColumn("previous", F.lag("draft_name").over(Window.partitionBy("script_id").orderBy("created_at", "draft_name")))


def hit(lines: list[str | None], old: str | None) -> int | None:
    """The line that a replacement of `old` changes: the one that equals it, else the most similar one if similar enough."""
    old = (old or "").strip()
    if not old or "\n" in old:
        return None
    same = [i for i, t in enumerate(lines) if (t or "").strip() == old]
    if not same:
        scores = [(difflib.SequenceMatcher(None, old, t or "").ratio(), -i) for i, t in enumerate(lines)]
        best = max(scores, default=(0.0, 0))
        same = [-best[1]] if best[0] >= EDIT_MATCH else []
    return same[0] if len(same) == 1 else None


def apply_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Elements after all edits in order. edits: (script_id, edit_seq, scene_number, replacements array<struct<old,new>>).

    A replacement hits the one line that equals `old`; several equal lines are ambiguous and skipped; without an
    equal line the most similar one is taken if similar enough; empty and multi-line `old` are skipped. An ordered
    fold per scene, scenes in parallel. The result adds `edited`.
    """
    columns = [c for c in elements.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in elements.schema) + ", edited boolean"

    def fold(key, lines: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        if not len(lines):
            return pd.DataFrame(columns=[*columns, "edited"])
        lines = lines.sort_values("element_index").reset_index(drop=True)
        text, edited = lines["text"].tolist(), [False] * len(lines)
        for change in (c for group in (log.sort_values("edit_seq")["replacements"] if len(log) else []) for c in group):
            i = hit(text, change["old"])
            if i is not None:
                text[i], edited[i] = (change["new"] or "").strip(), True
        return lines.assign(text=text, edited=edited)[[*columns, "edited"]]

    keys = ["script_id", "scene_number"]
    return elements.groupBy(*keys).cogroup(edits.select(*keys, "edit_seq", "replacements").groupBy(*keys)).applyInPandas(fold, schema)


def resolved_log(log: DataFrame) -> DataFrame:
    """(script_id, seq, op, target, made): which edit each entry of a log is about; null where there is nothing to undo or redo.

    log: (script_id, seq, op edit|undo|redo|reset, edit_seq for edits). Undo takes the last edit back, redo puts back the last one
    undone, a new edit clears what was undone, a reset clears all. target is the edit's edit_seq, made the seq of its entry, which
    tells edits apart that share an edit_seq. Rows pass in order; a task holds the two stacks of one script.
    """
    rows = log.where("script_id is not null").select("script_id", F.col("seq").cast("long").alias("seq"), "op", F.col("edit_seq").cast("long").alias("target"))
    kind = dict(rows.dtypes)["script_id"]

    def run(batches):
        current, done, undone = None, [], []
        for pdf in batches:
            targets = []
            for script, seq, op, edit in zip(pdf["script_id"], pdf["seq"], pdf["op"], pdf["target"]):
                if script != current:
                    current, done, undone = script, [], []
                target = None, None
                if op == "edit":
                    target = int(edit), int(seq)
                    done.append(target)
                    undone = []
                elif op in ("undo", "redo"):
                    source, to = (done, undone) if op == "undo" else (undone, done)
                    if source:
                        target = source.pop()
                        to.append(target)
                else:
                    done, undone = [], []
                targets.append(target)
            yield pdf.assign(**{c: pd.array([t[i] for t in targets], dtype="Int64") for i, c in enumerate(("target", "made"))})

    return rows.repartition("script_id").sortWithinPartitions("script_id", "seq").mapInPandas(run, f"script_id {kind}, seq long, op string, target long, made long")


def effective_log(log: DataFrame) -> DataFrame:
    """(script_id, edit_seq): edits in force after undo, redo and reset, by the last word on each; a row an edit, also where edits
    share an edit_seq."""
    rows = resolved_log(log)
    reset = F.max(F.when(F.col("op") == "reset", F.col("seq"))).over(Window.partitionBy("script_id"))
    said = rows.withColumn("reset", reset).where("target is not null and (reset is null or seq > reset)")
    last = said.groupBy("script_id", "target", "made").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op <> 'undo'").select("script_id", F.col("target").cast("int").alias("edit_seq"))


def history(elements: DataFrame, log: DataFrame) -> DataFrame:
    """What a log of edits, undos, redos and resets makes of elements: see versions() and changes(), which take it apart.

    log: (script_id, seq, op, edit_seq, scene_number, replacements array<struct<old,new>>), the last three for edits. An edit may hit a
    similar line (apply_edits); undo and redo change back only what stands exactly as the edit left or found it, and on one line
    only. A scene's entries are a fold of their own, scenes run in parallel; entries without a target change nothing.
    """
    keys, entries = ["script_id", "scene_number"], resolved_log(log)
    edits = log.where("op = 'edit'").select("script_id", F.col("seq").cast("long").alias("made"), "scene_number", "replacements")
    places = elements.select(*keys).distinct()
    aimed = entries.join(edits, ["script_id", "made"])
    resets = entries.where("op = 'reset'").join(places, "script_id").withColumn("replacements", F.lit(None).cast(dict(edits.dtypes)["replacements"]))
    steps = aimed.unionByName(resets).select(*keys, "seq", "op", "target", "made", "replacements")
    kinds = dict(elements.dtypes)
    columns = ["script_id", "scene_number", "element_index", "text", "from_seq", "to_seq", "seq", "op", "target", "restored", "failed"]
    schema = f"script_id {kinds['script_id']}, scene_number {kinds['scene_number']}, element_index {kinds['element_index']}, text string, from_seq long, to_seq long, seq long, op string, target long, restored long, failed long"

    def fold(key, lines: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("element_index") if len(lines) else lines
        places, text = lines["element_index"].tolist() if len(lines) else [], lines["text"].tolist() if len(lines) else []
        first, since, out, applied = list(text), [None] * len(text), [], {}

        def change(i: int, new: str | None, seq: int) -> None:
            if text[i] != new:
                if since[i] != seq:
                    out.append((*key, places[i], text[i], since[i], seq, None, None, None, None, None))
                text[i], since[i] = new, seq

        def swap(pairs: list[tuple], seq: int) -> tuple[int, int]:
            done = 0
            for old, new in pairs:
                same = [i for i, t in enumerate(text) if t == old]
                if len(same) == 1:
                    change(same[0], new, seq)
                    done += 1
            return done, len(pairs) - done

        for seq, op, target, made, replacements in ops.sort_values("seq")[["seq", "op", "target", "made", "replacements"]].itertuples(index=False) if len(ops) else []:
            seq = int(seq)
            if op == "edit":
                pairs, missed = [], 0
                for r in replacements if replacements is not None else []:
                    i = hit(text, r["old"])
                    if i is None:
                        missed += 1
                    else:
                        pairs.append((text[i], (r["new"] or "").strip()))
                        change(i, pairs[-1][1], seq)
                applied[made] = pairs
                counts = len(pairs), missed
            elif op == "reset":
                for i, t in enumerate(first):
                    change(i, t, seq)
                counts = len(first), 0
            else:
                pairs = applied.get(made, [])
                counts = swap([(b, a) for a, b in pairs] if op == "undo" else pairs, seq)
            out.append((*key, None, None, None, None, seq, op, None if op == "reset" else int(target), *counts))
        out += [(*key, places[i], t, since[i], None, None, None, None, None, None) for i, t in enumerate(text)]
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({c: "Int64" for c in ("element_index", "from_seq", "to_seq", "seq", "target", "restored", "failed")})

    return elements.select(*keys, "element_index", "text").groupBy(*keys).cogroup(steps.groupBy(*keys)).applyInPandas(fold, schema)


def versions(told: DataFrame) -> DataFrame:
    """(script_id, scene_number, element_index, text, from_seq, to_seq): each text of each element and the entries between which it
    stood. from_seq is null for the text of the draft, to_seq for the one that stands now."""
    return told.where("element_index is not null").select("script_id", "scene_number", "element_index", "text", "from_seq", "to_seq")


def changes(told: DataFrame) -> DataFrame:
    """(script_id, scene_number, seq, op, target, restored, failed): what each entry changed in its scene, and what it could not."""
    return told.where("op is not null").select("script_id", "scene_number", "seq", "op", "target", "restored", "failed")


def as_of(table: DataFrame, seq: int | None = None) -> DataFrame:
    """Elements as they stood right after an entry of the log; as they stand now, without one."""
    until = F.col("to_seq").isNull() if seq is None else F.col("to_seq").isNull() | (F.col("to_seq") > seq)
    since = F.lit(True) if seq is None else F.col("from_seq").isNull() | (F.col("from_seq") <= seq)
    return table.where(until & since).drop("from_seq", "to_seq")


def uploaded(drafts: DataFrame, uploads: DataFrame) -> DataFrame:
    """Drafts (script_id, draft_name, source_filename, created_at, active) after uploads (script_id, source_filename, created_at): each
    upload is the next draft-N of its script, by time, and the last one is the active draft."""
    n = drafts.groupBy("script_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("script_id").orderBy("created_at", "source_filename")
    fresh = uploads.withColumn("k", F.row_number().over(order)).withColumn("left_", F.count("*").over(Window.partitionBy("script_id"))).join(n, "script_id", "left")
    fresh = fresh.select("script_id", F.concat(F.lit("draft-"), (F.coalesce("n", F.lit(0)) + F.col("k")).cast("string")).alias("draft_name"), "source_filename", "created_at", (F.col("k") == F.col("left_")).alias("active"))
    again = uploads.select("script_id").distinct().withColumn("again", F.lit(True))
    old = drafts.join(again, "script_id", "left").withColumn("active", F.col("active") & F.col("again").isNull()).drop("again")
    return old.unionByName(fresh)


def upload(drafts: DataFrame, uploads: DataFrame, stages: DataFrame, keep: Callable[[DataFrame], None]) -> tuple[DataFrame, DataFrame]:
    """(drafts, stages) after uploads. keep is called first, with (script_id, draft_name) of the active drafts that give way, to
    snapshot them; a script whose parse is not complete has nothing to keep. All stages of the scripts wait again."""
    scripts = uploads.select("script_id").distinct()
    active = drafts.where("active").select("script_id", "draft_name")
    parsed = stages.where("stage = 'parse' and status = 'complete'").select("script_id").distinct()
    keep(scripts.join(parsed, "script_id", "left_semi").join(active, "script_id", "left").select("script_id", F.coalesce("draft_name", F.lit("original")).alias("draft_name")))
    waiting = stages.join(scripts.withColumn("again", F.lit(True)), "script_id", "left")
    reset = lambda c: F.when(F.col("again"), "pending" if c == "status" else None).otherwise(F.col(c)).alias(c) if c in ("status", "detail") else F.col(c)
    return uploaded(drafts, uploads), waiting.select(*[reset(c) for c in stages.columns])


def board_order(scenes: DataFrame, boards: DataFrame) -> DataFrame:
    """(script_id, position, scene_number): the saved order if it is a permutation of the scenes, else the natural one."""
    natural = scenes.groupBy("script_id").agg(F.array_sort(F.collect_list("scene_number")).alias("natural"))
    rows = natural.join(boards.select("script_id", "order"), "script_id", "left")
    chosen = F.when(F.array_sort("order") == F.col("natural"), F.col("order")).otherwise(F.col("natural"))
    return rows.select("script_id", F.posexplode(chosen).alias("position", "scene_number"))


def board_cards(order: DataFrame, scenes: DataFrame, estimates: DataFrame, notes: DataFrame) -> DataFrame:
    keys = ["script_id", "scene_number"]
    n = notes.groupBy(*keys).agg(F.count("*").alias("note_count"))
    rows = order.join(scenes.select(*keys, "heading_raw"), keys).join(estimates.select(*keys, "words", "minutes"), keys, "left").join(n, keys, "left")
    return rows.withColumn("note_count", F.coalesce("note_count", F.lit(0)))


def reordered(elements: DataFrame, scenes: DataFrame, order: DataFrame) -> dict[str, DataFrame]:
    """Elements and scenes renumbered 1..N in board order."""
    keys = ["script_id", "scene_number"]
    move = lambda d: d.join(order, keys).withColumn("scene_number", F.col("position") + 1).drop("position")
    return {"elements": move(elements).unionByName(elements.where("scene_number = 0")), "scenes": move(scenes)}
