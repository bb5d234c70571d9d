"""Many names in many texts: one pass over a text finds all names of its group, by an Aho-Corasick automaton.

Names of a group are cut into shards of at most `shard` names, its texts into blocks of about `block`; a task holds one
automaton and one block, so neither a group with a million names nor one with a million texts is a task. No word of a text is
exploded. What the automaton finds is tested by the regular expression of a whole word, so results are those of
a join on that expression.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole_word

SHARD, BLOCK = 50_000, 2_048


def folded(text: str) -> str:
    """Letter case out of the way, one character for one, as regular expressions take it."""
    up = "".join(c if len(u := c.upper()) != 1 else u for c in text)
    return "".join(c if len(u := c.lower()) != 1 else u for c in up)


def ascii_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def inside(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] surely begins or ends within a word."""
    return (start > 0 and ascii_word(text[start - 1]) and ascii_word(text[start])) or (end < len(text) and ascii_word(text[end - 1]) and ascii_word(text[end]))


def mentions(texts: DataFrame, names: DataFrame, keys: list[str], id_col: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(keys, id, name): the names (keys, name) that occur in each text (keys, id, text) as whole words, in any case.

    Without keys all texts meet all names. Null texts and empty names have no mentions; repeated names count once.
    """
    key = keys or ["all_"]
    add = lambda d: d if keys else d.withColumn("all_", F.lit(0))
    said = add(texts.where("text is not null")).select(*key, id_col, "text")
    known = add(names.where("name <> ''")).select(*key, "name").distinct()
    blocks = said.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("blocks"))
    shards = known.groupBy(*key).agg(F.ceil(F.count("*") / shard).alias("shards"))
    sizes = blocks.join(shards, key)
    left = said.join(sizes, key).withColumn("block", F.pmod(F.xxhash64(id_col), "blocks")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    right = known.join(sizes, key).withColumn("shard", F.pmod(F.xxhash64("name"), "shards")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    by, kinds = [*key, "block", "shard"], dict(said.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"`{id_col}` {kinds[id_col]}", "text string", "name string"])

    def scan(group, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        found, machine, of = [], ahocorasick.Automaton(), {}
        for name in own["name"]:
            of.setdefault(folded(name), []).append(name)
        for plain, same in of.items():
            machine.add_word(plain, (len(plain), same))
        if of and len(rows):
            machine.make_automaton()
            for i, text in zip(rows[id_col], rows["text"]):
                plain = folded(text)
                hits = {n for end, (size, same) in machine.iter(plain) if not inside(plain, end + 1 - size, end + 1) for n in same}
                found += [(*group[: len(key)], i, text, n) for n in hits]
        return pd.DataFrame(found, columns=[*key, id_col, "text", "name"])

    hits = left.select(*by, id_col, "text").groupBy(*by).cogroup(right.select(*by, "name").groupBy(*by)).applyInPandas(scan, schema)
    return hits.where(whole_word(F.col("text"), F.col("name"), True)).select(*keys, id_col, "name").distinct()
