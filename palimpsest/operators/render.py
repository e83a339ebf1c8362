"""Rendering of spans in a text: masked, as type tags, or as placeholders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spanx import part, settle

MODES = ("mask", "tag", "pseudonymize")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}; not {mode!r}")
    return mode


def replace_spans(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """Each span's text replaced by ``put(span)``; spans don't overlap."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(s["end"].cast("int").alias("at"), F.concat(a["out"], part(text, a["at"], s["start"]), put(s)).alias("out"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**30))))


def tag(text: Column, spans: Column) -> Column:
    return replace_spans(text, spans, lambda s: F.concat(F.lit("["), s["entity_type"], F.lit("]")))


def mask(text: Column, spans: Column, char: str = "*", count: int = 1_000_000_000, from_end: bool = False) -> Column:
    """Each span masked: ``count`` characters at most, from its beginning or its end."""

    def put(s: Column) -> Column:
        n = F.least(s["end"] - s["start"], F.lit(count)).cast("int")
        hidden, value = F.repeat(F.lit(char), n), part(text, s["start"], s["end"])
        left = s["end"] - s["start"] - n
        return F.concat(F.substring(value, F.lit(1), left), hidden) if from_end else F.concat(hidden, F.substring(value, n + 1, left))

    return replace_spans(text, spans, put)


def allowed(spans: Column, entities: list[str] | None, defaults: list[str]) -> Column:
    """Spans of the listed types, after resolution: None is the defaults, [] nothing."""
    names = [e.strip().upper() for e in (defaults if entities is None else entities)]
    return F.filter(spans, lambda s: F.array_contains(F.array(*map(F.lit, names)).cast("array<string>"), s["entity_type"]))


def render(found: DataFrame, mode: str = "mask", char: str = "*", count: int = 1_000_000_000, from_end: bool = False) -> DataFrame:
    """``found`` (norm, spans) with ``rendered``; spans sorted by place."""
    check_mode(mode)
    rows = settle(found.withColumn("spans", F.array_sort("spans")))
    text, spans = F.col("norm"), F.col("spans")
    return rows.withColumn("rendered", tag(text, spans) if mode == "tag" else mask(text, spans, char, count, from_end))
