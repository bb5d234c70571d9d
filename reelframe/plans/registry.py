"""The registered queries, and what their modules share."""
from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def exact(x, digits=0):
    """Stands in for a rounding function: driver queries leave doubles as they are, so that engines can agree."""
    return x


def injected(options: list[str]):
    """The text with a phrase put before it, chosen by the turn; every fourth turn has none."""
    phrase = F.lit("")
    for i, text in enumerate(options):
        phrase = F.when(F.col("turn") % 4 == i, text).otherwise(phrase)
    return F.concat(phrase, F.lit(" "), F.col("text"))
