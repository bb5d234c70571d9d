"""Names found by automata against the join on the regular expression of a whole word."""
import random

import pytest
from pyspark.sql import functions as F

from reelframe.functions.text import whole_word
from reelframe.operators import memory, mentions

NAMES = ["RAVI", "Ravi Kumar", "ravi", "O'BRIEN", "அவன்", "STRASSE", "straße", "A", "AB-1", "$5", "C++", "DR. NO", "x_y", "İstanbul", "end\\E", "(odd)", "ÉTÉ", "the", ""]
TEXTS = ["Ravi kumar met ravi.", "RAVINDRA is no ravi_x", "o'brien's door", "அவன் வந்தான்", "in der Strasse und straße", "a b AB-1 ab-12", "it costs $5, not $50", "C++ and c++x", "see Dr. No. dr. nobody", "x_y x_yz", "istanbul İstanbul", "end\\E", "(odd) (ODD)x", "été Été", "", None, "The THE other", "  ravi", "ravi\nkumar"]


def rows(d, *c):
    return sorted((tuple(r) for r in d.select(*c).collect()), key=str)


@pytest.mark.parametrize("shard, block", [(50_000, 2_048), (3, 4), (1, 1)])
def test_mentions_equal_the_regex_join(spark, shard, block):
    r = random.Random(9)
    texts = spark.createDataFrame([(k, i, t) for k in (1, 2) for i, t in enumerate(TEXTS + [" ".join(r.choices(NAMES + ["and", "so"], k=6)) for _ in range(20)])] + [(3, 0, "ravi")], "k int, id int, text string")
    names = spark.createDataFrame([(1, n) for n in NAMES + ["RAVI"]] + [(2, n) for n in NAMES[:4]] + [(4, "ravi")], "k int, name string")
    told = lambda d: d.where("text is not null and name <> ''").where(whole_word(F.col("text"), F.col("name"), True)).distinct()
    assert rows(mentions.mentions(texts, names, ["k"], "id", shard, block), "k", "id", "name") == rows(told(texts.join(names, "k")), "k", "id", "name")
    once = texts.where("k = 1")
    assert rows(mentions.mentions(once, names, [], "id", shard, block), "id", "name") == rows(told(once.join(names.select("name"))), "id", "name")


def test_scope_is_the_first_project_in_order(spark):
    seen = spark.createDataFrame([(1, "Ravi and Meera"), (2, "meera alone"), (3, "nobody"), (4, None)], "id int, text string")
    who = spark.createDataFrame([("Meera", "a", 1), ("RAVI", "b", 2), ("ravi", "c", 0)], "name string, project string, dir_order int")
    assert rows(memory.scoped(seen, who), "id", "scope") == [(1, "c"), (2, "a"), (3, "global"), (4, "global")]
