"""Text measures and normalisation. Native where Spark has the expression, Arrow-batched Python where it hasn't."""

from __future__ import annotations

import difflib
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EDITS

#: White space as Python's ``str.split`` sees it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalise(text: Column) -> Column:
    """Lower case, no punctuation, single blanks; letters and digits of any script stay."""
    plain = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}]", "")
    return trim_space(F.regexp_replace(plain, f"{SPACE}+", " "))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def keep_letters(text: Column) -> Column:
    """Everything but Hangul syllables, Latin letters, digits and blanks becomes a blank."""
    return F.regexp_replace(text, r"[^가-힣a-zA-Z0-9\s]", " ")


def is_digits(text: Column) -> Column:
    return text.rlike(r"^\p{Nd}+$")


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate: edit distance over the reference's length, one at least."""
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def normalise_unicode(text: Column, form: str = "NFKC", casefold: bool = True, drop_punctuation: bool = False) -> Column:
    """Unicode normal form, case folding, single blanks and, if asked for, no punctuation."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            t = unicodedata.normalize(form, t)
            t = " ".join((t.casefold() if casefold else t).split())
            return " ".join(re.sub(r"[^\w\s]", "", t).split()) if drop_punctuation else t

        return values.map(one)

    return run(text)


def edit_counts(a, b) -> tuple[int, int, int, int]:
    """(distance, substitutions, deletions, insertions); of ties a match or substitution goes before a deletion, that
    before an insertion.

    Bit-parallel after Myers and Hyyro: a row of the table is a pair of integers with a bit for each item of b, set where
    the cost rises or falls. The way back needs two bits a cell; every square root of the rows is kept, and the rows
    between are worked out again when the way comes to them, so memory grows with len(b) times the root of len(a)."""
    m, n = len(a), len(b)
    full = (1 << n) - 1
    equal: dict = {}
    for j, y in enumerate(b):
        equal[y] = equal.get(y, 0) | 1 << j
    step = math.isqrt(m) + 1

    def rows(start: int, up: int, down: int, told: list | None = None) -> tuple[int, int]:
        """Carries a row on over up to ``step`` items of a; told gets where the way isn't diagonal, and where it deletes."""
        for x in a[start : start + step]:
            same = equal.get(x, 0)
            t = same | down
            zero = ((((t & up) + up) ^ up) | t) & full
            rise = down | full & ~(zero | up)
            if told is not None:
                off = zero & ~same
                told.append((off, off & rise))
            rise, fall = rise << 1 | 1, (zero & up) << 1
            up, down = (fall | ~(zero | rise)) & full, rise & zero
        return up, down

    kept = [(full, 0)]
    for start in range(0, m, step):
        kept.append(rows(start, *kept[-1]))
    s = d = i = 0
    at = n
    for start in reversed(range(0, m, step)):
        told: list[tuple[int, int]] = []
        rows(start, *kept[start // step], told)
        k = len(told) - 1
        while k >= 0 and at:
            off, gone = told[k]
            if not off >> (at - 1) & 1:
                s += a[start + k] != b[at - 1]
                k, at = k - 1, at - 1
            elif gone >> (at - 1) & 1:
                d, k = d + 1, k - 1
            else:
                i, at = i + 1, at - 1
        d += k + 1
    i += at
    return s + d + i, s, d, i


def edit_ops(reference: Column, hypothesis: Column) -> Column:
    """struct<dist, s, d, i> over characters; null if either side is."""

    @F.pandas_udf(EDITS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [edit_counts(x, y) if x is not None and y is not None else (None,) * 4 for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["dist", "s", "d", "i"]).astype("Int32")

    return run(reference, hypothesis)


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate in percent; an empty reference gives 0, or 100 if there are words."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float | None:
            if x is None or y is None:
                return None
            ref, hyp = x.split(), y.split()
            return (100.0 if hyp else 0.0) if not ref else 100.0 * edit_counts(ref, hyp)[0] / len(ref)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(reference, hypothesis)


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio with the usual junk rule for long texts."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    return run(a, b)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: a bit for each character of a."""
    full = (1 << len(a)) - 1
    held: dict[str, int] = {}
    for k, x in enumerate(a):
        held[x] = held.get(x, 0) | 1 << k
    row = full
    for y in b:
        u = row & held.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def similarity_from(a: Column, b: Column, threshold: float) -> Column:
    """``similarity`` where it may be ``threshold``, else null. Matched blocks are a common subsequence, so the longest one's
    length says which pairs needn't be compared."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> float | None:
            if x is None or y is None or 2 * common_length(x, y) < (threshold - 1e-9) * (len(x) + len(y)):
                return None
            return difflib.SequenceMatcher(None, x, y).ratio()

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return run(a, b)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether two texts' lengths allow a similarity of ``threshold``: cheap, and never wrong about those that reach it."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(True)).otherwise(2 * F.least(la, lb) >= threshold * (la + lb))
