"""Spans of patterns and folds over spans, as Column expressions (no Python at run time).

Offsets count code points. A pattern's matches are bracketed by two private characters and
the text is split there, so odd pieces are matches and running lengths are offsets; those
two characters are taken out of the input first.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F

OPEN, SHUT = "\ue000", "\ue001"
MATCH = "array<struct<start:int,end:int,text:string>>"
SPAN = "struct<start:int,end:int,entity_type:string,score:double,branch:string>"
SPANS = f"array<{SPAN}>"


@contextmanager
def uncaptured():
    """Columns made in here record no call sites: with thousands of expressions that costs
    most of a plan's time. The same as spark.python.sql.dataFrameDebugging.enabled=false."""
    from pyspark.errors import utils

    before = getattr(utils, "_enable_debugging_cache", None)
    utils._enable_debugging_cache = False
    try:
        yield
    finally:
        utils._enable_debugging_cache = before


def settle(rows: DataFrame) -> DataFrame:
    """The same rows, with every column computed here: the optimizer can't copy a long
    expression into each place that reads it. One inline generator, no shuffle."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def clean(text: Column) -> Column:
    """Text without the private characters (null: empty). Few texts have one; translating is slow."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.contains(whole, F.lit(OPEN)) | F.contains(whole, F.lit(SHUT)), F.translate(whole, OPEN + SHUT, "")).otherwise(whole)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, where ``value`` is computed once: as the one element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Matches of a text that are folded at once.
FOLD = 32


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, left to right: start, end, text. They are folded in blocks, so
    that an array that grows is never copied for each match of a long text; a text without a
    match is scanned once."""
    parts = F.split(F.regexp_replace(text, pattern, OPEN + "$0" + SHUT), f"[{OPEN}{SHUT}]", -1)

    def step(a: Column, x: Column) -> Column:  # x: the text before a match, and the match
        start = a["pos"] + F.char_length(x["gap"])
        end = (start + F.char_length(x["text"])).cast("int")
        return F.struct(end.alias("pos"), F.array_append(a["out"], F.struct(start.cast("int").alias("start"), end.alias("end"), x["text"].alias("text"))).alias("out"))

    def block(a: Column, some: Column) -> Column:
        zero = F.struct(a["pos"].alias("pos"), F.array().cast(MATCH).alias("out"))
        return F.aggregate(some, zero, step, lambda b: F.struct(b["pos"].alias("pos"), F.array_append(a["out"], b["out"]).alias("out")))

    def folded(pieces: Column) -> Column:
        last = F.size(pieces) - 2
        pairs = lambda i: F.transform(F.sequence(i, F.least(i + 2 * FOLD - 2, last - 1), F.lit(2)), lambda k: F.struct(F.get(pieces, k).alias("gap"), F.get(pieces, k + 1).alias("text")))
        blocks = F.transform(F.sequence(F.lit(0), last - 1, F.lit(2 * FOLD)), pairs)
        return F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{MATCH}>").alias("out")), block, lambda a: F.flatten(a["out"]))

    return F.when(text.rlike(pattern), once(parts, folded)).when(text.isNotNull(), F.array().cast(MATCH))


_BUILT: dict = {}


def built(make: Callable[..., Column], *of) -> Column:
    """``make(*of)``, made once: long expressions take seconds to build. Arguments are told
    apart by identity, or by value where they are strings."""
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    key = (id(gateway), make, *(x if isinstance(x, str) else id(x) for x in of))
    if key not in _BUILT:
        if len(_BUILT) >= 256:
            _BUILT.clear()
        with uncaptured():
            _BUILT[key] = (make(*of), gateway, of)  # what the key names stays alive
    return _BUILT[key][0]


def part(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points, clipped at either side."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(end - lo, F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def same(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def without_overlap(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others (interval anti-join within a row)."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlap(s, o)))


def numbered(spans: Column) -> Column:
    """Spans with their place in the array as ``ord``."""
    return F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["branch"].alias("branch"), i.cast("int").alias("ord")))


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["branch"].alias("branch")))


def duels(spans: Column, loser: Callable[[Column, Column], Column]) -> Column:
    """Go through pairs in array order; ``loser`` says -1 (the earlier goes), 1 (the later
    goes) or 0. What has gone fights no more."""
    n = F.size(spans)
    none = F.array().cast("array<int>")

    def against_later(gone: Column, i: Column) -> Column:
        a = F.get(spans, i)

        def fight(state: Column, j: Column) -> Column:
            out = F.when(state["over"] | F.array_contains(state["gone"], j), F.lit(0)).otherwise(loser(a, F.get(spans, j)))
            now = F.when(out == 1, F.array_append(state["gone"], j)).when(out == -1, F.array_append(state["gone"], i)).otherwise(state["gone"])
            return F.struct(now.alias("gone"), (state["over"] | (out == -1)).alias("over"))

        later = F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(none)
        fought = F.aggregate(later, F.struct(gone.alias("gone"), F.lit(False).alias("over")), fight, lambda s: s["gone"])
        return F.when(F.array_contains(gone, i), gone).otherwise(fought)

    gone = F.aggregate(F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(none), none, against_later)
    return F.filter(spans, lambda s, i: ~F.array_contains(gone, i.cast("int")))


def best_first(spans: Column) -> Column:
    """Greedy choice by score, then length, then start; a span stays if it overlaps none that
    stayed. Results come in the order of the input."""
    return plain(greedy(numbered(spans)))


def greedy(spans: Column) -> Column:
    """``best_first`` of spans with ``ord``, which they keep."""
    ranked = F.array_sort(
        F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["ord"].alias("d"), s.alias("s")))
    )
    zero = F.array().cast("array<struct<start:int,end:int,entity_type:string,score:double,branch:string,ord:int>>")
    kept = F.aggregate(ranked, zero, lambda acc, r: F.when(F.exists(acc, lambda k: overlap(k, r["s"])), acc).otherwise(F.array_append(acc, r["s"])))
    return by_ord(kept)


def by_ord(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["ord"].alias("o"), s.alias("s")))), lambda x: x["s"])


#: Spans of a row from which those that can't meet are told apart.
MANY = 16


def in_groups(spans: Column, choice: Callable[[Column], Column]) -> Column:
    """``choice`` of spans with ``ord``, where only spans that overlap decide on one another. Many spans are
    cut where none overlaps a later one, and each group is chosen from by itself: a row's time grows with
    its spans, not with their square. Results come in the order of the input."""

    def ends(state: Column, some: Column) -> Column:  # the greatest end so far, before each span
        zero = F.struct(state["end"].alias("end"), F.array().cast("array<int>").alias("out"))
        step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.array_append(a["out"], a["end"]).alias("out"))
        return F.aggregate(some, zero, step, lambda a: F.struct(a["end"].alias("end"), F.array_append(state["out"], a["out"]).alias("out")))

    def cut(ranked: Column) -> Column:
        n = F.size(ranked)
        blocks = F.transform(F.sequence(F.lit(1), n, F.lit(MANY)), lambda i: F.slice(ranked, i, F.lit(MANY)))
        zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<array<int>>").alias("out"))
        return once(F.aggregate(blocks, zero, ends, lambda a: F.flatten(a["out"])), lambda before: chosen(ranked, n, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(ranked, i)["start"] >= F.get(before, i))))

    def chosen(ranked: Column, n: Column, firsts: Column) -> Column:
        return once(firsts, lambda at: F.flatten(F.transform(at, lambda i, k: once(by_ord(F.slice(ranked, i + 1, F.coalesce(F.get(at, k + 1), n) - i)), choice))))

    ranked = F.transform(F.array_sort(F.transform(numbered(spans), lambda s: F.struct(s["start"].alias("a"), s["ord"].alias("b"), s.alias("s")))), lambda x: x["s"])
    return plain(F.when(F.size(spans) > MANY, by_ord(once(ranked, cut))).otherwise(once(numbered(spans), choice)))
