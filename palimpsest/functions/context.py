"""Context windows around a candidate, and distances to keywords, as Column expressions.

Keywords are looked for in the window's own text, so a word that the window cuts counts as
it stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import BIK_VALUE, KEYWORDS
from .spanx import matches, part

MARKS = r".!?;\n"


def sentence(text: Column, start: Column, end: Column, more: int = 80) -> Column:
    """(text, pos): the candidate's sentence and ``more`` characters around; its place there."""
    left = F.char_length(F.regexp_extract(F.substring(text, F.lit(1), start), rf"(?s)^(.*[{MARKS}])", 1))
    right = end + F.char_length(F.regexp_extract(F.substring(text, end + 1, F.lit(2**30)), rf"^([^{MARKS}]*)", 1))
    lo = F.greatest(left - more, F.lit(0))
    return F.struct(part(text, lo, right + more).alias("text"), (start - lo).cast("int").alias("pos"))


def wide(text: Column, start: Column, end: Column, more: int = 260) -> Column:
    lo = F.greatest(start - more, F.lit(0))
    return F.struct(part(text, lo, end + more).alias("text"), (start - lo).cast("int").alias("pos"))


def has(window: Column, family: str) -> Column:
    return window["text"].rlike(KEYWORDS[family])


def before(window: Column, family: str) -> Column:
    """Characters between the nearest keyword that ends before the candidate, and it."""
    pos = window["pos"]
    found = F.filter(matches(window["text"], KEYWORDS[family]), lambda m: m["end"] <= pos)
    return F.array_min(F.transform(found, lambda m: pos - m["end"]))


def center(window: Column, family: str, raw: Column) -> Column:
    """Distance between the middle of the nearest keyword on either side, and the candidate's."""
    middle = window["pos"] + F.floor(F.char_length(raw) / 2)
    return F.array_min(F.transform(matches(window["text"], KEYWORDS[family]), lambda m: F.abs(F.floor((m["start"] + m["end"]) / 2) - middle)))


def after(window: Column, family: str, raw: Column, most: int) -> Column:
    """Whether a keyword stands in the ``most`` characters after the candidate."""
    at = window["pos"] + F.char_length(raw)
    return part(window["text"], at, at + most).rlike(KEYWORDS[family])


def within(distance: Column, most: int) -> Column:
    return F.when(distance <= most, distance)


def find_bik(near: Column, far: Column) -> Column:
    """The first code after its keyword: in the sentence, else in the wide window; or null."""
    one = lambda w: F.nullif(F.regexp_replace(F.regexp_extract(w["text"], BIK_VALUE, 1), r"(?U)\D", ""), F.lit(""))
    return F.coalesce(one(near), one(far))
