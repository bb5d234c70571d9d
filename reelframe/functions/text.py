"""Text expressions shared by all operators; plain Spark columns unless a name ends in _udf."""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

#: Words that carry no voice. Fixed values.
STOP_WORDS = (
    "a an the and or but if then else of to in on at for with from by as is are was were be been being i you he she it we they me him her us them "
    "my your his its our their this that these those do does did have has had will would can could should shall not no yes yeah okay well so just "
    "really very what who when where why how"
).split()


def words(text: Column) -> Column:
    """White-space-separated words; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def ascii_word_count(text: Column) -> Column:
    """The same for runs of anything but ASCII white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)))


def voice_tokens(text: Column) -> Column:
    """Lower-case letter runs without the stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def normalised(text: Column) -> Column:
    """Lower case, punctuation dropped, white space squeezed: the form in which quotes are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds half to even. Differs from rounding the binary value only where a tie is not exactly representable."""
    return F.bround(x, digits)


def initial_capped(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def truncated(text: Column, limit: int, marker: str) -> Column:
    """At most `limit` characters and, if something was cut, the marker."""
    return F.when(F.char_length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(marker))).otherwise(text)


def quoted(name: Column) -> Column:
    """The name as a literal within a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word(text: Column, name: Column, ignore_case: bool = False) -> Column:
    return F.regexp_like(text, F.concat(F.lit("(?U)(?i)" if ignore_case else "(?U)"), F.lit(r"\b"), quoted(name), F.lit(r"\b")))


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two texts; 0 if one is null."""
    return pd.Series([Matched(x, y).at_least(0.0) if x is not None and y is not None else 0.0 for x, y in zip(a, b)])


def common_lengths(quote: str, windows: list[str]) -> list[int]:
    """The length of the longest common subsequence of the quote and each window, all at once.

    Bit-parallel (Hyyro): a bit a character of the windows, laid end to end in one number with a free bit after each, which takes the
    carry of its window's addition.
    """
    ends = np.cumsum([len(w) + 1 for w in windows]).tolist()
    if not ends:
        return []
    letters = np.frombuffer("\0".join([*windows, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = np.ones(len(letters), bool)
    inside[np.array(ends) - 1] = False
    bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
    all_, masks = bits(inside), {c: bits((letters == ord(c)) & inside) for c in set(quote)}
    v = all_
    for c in quote:
        u = v & masks[c]
        if u:
            v = ((v + u) | (v ^ u)) & all_
    missed = bin(v)[2:].zfill(len(letters))[::-1]
    return [len(w) - missed.count("1", end - 1 - len(w), end - 1) for w, end in zip(windows, ends)]


def short_ratio_at_least(a: str | Column, b: str | Column, threshold: float) -> Column:
    """ratio_udf of two words if it is at least the threshold, else null. Words whose common characters are too few are not
    compared, and a pair that a task has met is not compared again."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(1 << 16)
        def ratio(x: str, y: str) -> float | None:
            if 2.0 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) < threshold:
                return None
            return Matched(x, y).at_least(threshold)

        for left, right in batches:
            yield pd.Series([ratio(x, y) for x, y in zip(left, right)], dtype="float64")

    return run(a, b)


def cut_windows(q: str, t: str) -> list[str]:
    """A text's windows of about the quote's length, half a window apart."""
    wanted, found = q.split(), t.split()
    if not wanted or not found:
        return []
    size = max(len(wanted), 3)
    return [" ".join(found[at : at + size + 2]) for at in range(0, max(1, len(found) - size + 1), max(1, size // 2))]


def bounded(q: str, windows: list[str]) -> list[tuple[float, str]]:
    """(bound, window), the greatest bound first. What the similarity counts as matched is a common subsequence, so none is above
    its bound."""
    bounds = [2.0 * n / (len(q) + len(w)) for n, w in zip(common_lengths(q, windows), windows)]
    return sorted(zip(bounds, windows), key=lambda x: -x[0])


class Matched:
    """difflib.SequenceMatcher(None, a, b) of two texts, with the same blocks. Of a long text that leaves out its frequent characters as
    starts of a block; here they are not even gone through."""

    def __init__(self, a: str, b: str):
        self.a, self.b, self.of = a, b, {}
        counts, frequent = Counter(b), len(b) // 100 + 1 if len(b) >= 200 else len(b)
        starts = {c for c in counts.keys() & set(a) if counts[c] <= frequent}
        for j, c in enumerate(b):
            if c in starts:
                self.of.setdefault(c, []).append(j)
        self.at = [i for i, c in enumerate(a) if c in starts]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        a, b, of = self.a, self.b, self.of
        i0, j0, size, before, ends = alo, blo, 0, -2, {}
        for i in self.at[bisect_left(self.at, alo) : bisect_left(self.at, ahi)]:
            if i != before + 1:
                ends = {}
            before, new = i, {}
            for j in of[a[i]]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = new[j] = ends.get(j - 1, 0) + 1
                if k > size:
                    i0, j0, size = i - k + 1, j - k + 1, k
            ends = new
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        return i0, j0, size

    def at_least(self, threshold: float) -> float | None:
        """The ratio if it is at least the threshold, else null. Blocks are found in the largest of the stretches that are left, until
        what may still match is too little."""
        n, m = len(self.a), len(self.b)
        if not n + m:
            return 1.0
        size = lambda x: min(x[1] - x[0], x[3] - x[2])
        left, matched, most = [(0, n, 0, m)], 0, min(n, m)
        while left:
            if 2.0 * (matched + most) / (n + m) < threshold:
                return None
            here = left.pop(max(range(len(left)), key=lambda i: size(left[i])))
            i, j, k = self.longest(*here)
            matched, most = matched + k, most - size(here)
            parts = [x for x in ((here[0], i, here[2], j), (i + k, here[1], j + k, here[3])) if k and size(x) > 0]
            left, most = left + parts, most + sum(map(size, parts))
        return 2.0 * matched / (n + m) if 2.0 * matched / (n + m) >= threshold else None


@F.pandas_udf(DoubleType())
def windowed_ratio_udf(quote: pd.Series, text: pd.Series) -> pd.Series:
    """Best similarity of a quote to windows of the text of about its own length, half a window apart."""

    def best(q: str | None, t: str | None) -> float:
        out = 0.0
        for bound, window in bounded(q or "", cut_windows(q or "", t or "")):
            if bound <= out:
                break
            out = Matched(q, window).at_least(out) or out
        return out

    return pd.Series([best(q, t) for q, t in zip(quote, text)])


def windowed_ratio_reaches(quote: Column, text: Column, threshold: float) -> Column:
    """Whether windowed_ratio_udf is at least the threshold, which is above 0: windows whose bound is lower are left, and the first
    one that reaches it decides. The window that holds the quote's middle is tried before any bound is worked out."""

    def reaches(q: str | None, t: str | None) -> bool:
        windows, middle = cut_windows(q or "", t or ""), (q or "")[len(q or "") // 2 :][:12]
        likely = sorted((w for w in windows if middle in w), key=lambda w: abs(w.find(middle) - len(w) // 2))[:1]
        if likely and Matched(q, likely[0]).at_least(threshold) is not None:
            return True
        rest = bounded(q or "", [w for w in windows if w not in likely])
        return any(Matched(q, w).at_least(threshold) is not None for bound, w in rest if bound >= threshold)

    @F.pandas_udf(BooleanType())
    def run(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([reaches(q, t) for q, t in zip(quotes, texts)], dtype=bool)

    return run(quote, text)


def sanitised_stem(name: Column) -> Column:
    """A file stem as a project name: what is no letter, digit, underscore or hyphen becomes an underscore."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^\p{L}\p{N}_-]", "_")


def balanced_json(text: Column) -> Column:
    """The outermost {...} or [...] of a reply, code fences aside; null if there is none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)
