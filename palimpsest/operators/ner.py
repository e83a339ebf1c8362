"""The model branch after the model: tokens with tags become spans. The model itself is a
provider; none is shipped, and without one the branch is empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.spanx import matches

#: A provider: batches of (doc_id, norm) to batches of (doc_id, spans), loaded once a worker.
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SPANS = "doc_id long, spans array<struct<start:int,end:int,entity_type:string,score:double,branch:string>>"


def provide(normalised: DataFrame, provider: Provider) -> DataFrame:
    return normalised.select("doc_id", "norm").mapInPandas(provider, SPANS)


#: Characters that are tokens of their own; labels that punctuation doesn't join.
ALONE = r"""(){}\[\]«»"“”‘’',;:!?"""
APART = ("FIRST_NAME", "LAST_NAME", "MIDDLE_NAME", "CITY", "COUNTRY", "DISTRICT", "REGION", "STREET", "HOUSE")


def tokens(text: Column) -> Column:
    """Words by white space; brackets, quotes and ``,;:!?`` are tokens of their own, and so is
    each dot at either end of what is left (dots within it stay)."""
    inner = rf"[^\s{ALONE}.](?:[^\s{ALONE}]*[^\s{ALONE}.])?"
    return matches(text, rf"(?U)[{ALONE}]|{inner}|\.")


def windows(sizes: list[int], budget: int = 510, stride: int = 128) -> list[tuple[int, int, int, int]]:
    """Windows over words of so many sub-words each: (first, end, own first, own end). Neighbours
    share about ``stride`` sub-words, and each owns up to the middle of what it shares; a word
    beyond the budget is in no window. Every word that fits is owned once."""
    out, at, n = [], 0, len(sizes)
    while at < n:
        if sizes[at] > budget:
            at += 1
            continue
        end, used = at, 0
        while end < n and sizes[end] <= budget and used + sizes[end] <= budget:
            used += sizes[end]
            end += 1
        out.append([at, end, at, end])
        if end >= n or sizes[end] > budget:
            at = end
            continue
        back, shared = end, 0
        while back - 1 > at and shared + sizes[back - 1] <= stride:
            back -= 1
            shared += sizes[back]
        at = back
    for left, right in zip(out, out[1:]):
        if right[0] < left[1]:
            left[3] = right[2] = (right[0] + left[1]) // 2
    return [tuple(w) for w in out]


def bridge(rows: DataFrame, fixed: tuple[str, ...] = APART) -> DataFrame:
    """A single untagged punctuation token between two equal tags joins them, but for names
    and places. rows: (doc_id, tok_ord, token, start, end, tag)."""
    order = Window.partitionBy("doc_id").orderBy("tok_ord")
    label = lambda c: F.regexp_extract(c, "^[^-]*-(.*)$", 1)
    left, right = F.lag("tag").over(order), F.lead("tag").over(order)
    joins = (F.col("tag") == "O") & F.col("token").rlike(r"^[.,;:!?]+\z") & (label(left) != "") & (label(left) == label(right)) & ~label(left).isin(*fixed)
    return rows.withColumn("tag", F.when(joins, F.concat(F.lit("I-"), label(left))).otherwise(F.col("tag")))


def merge_runs(rows: DataFrame, labels: dict[str, str] | None = None, score: float = 0.70) -> DataFrame:
    """Runs of one label, whether B- or I-, are one span; labels are mapped to types, and
    labels without a type go."""
    order = Window.partitionBy("doc_id").orderBy("tok_ord")
    rows = rows.withColumn("label", F.when(F.col("tag").rlike("^[BI]-"), F.substring(F.col("tag"), F.lit(3), F.lit(2**30))).otherwise(F.lit("O")))
    rows = rows.withColumn("new", F.coalesce(F.lag("label").over(order) != F.col("label"), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order)).filter("label <> 'O'")
    spans = rows.groupBy("doc_id", "island", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if labels is not None:
        kinds = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        spans = spans.withColumn("label", kinds[F.col("label")]).filter("label is not null")
    return spans.select("doc_id", "start", "end", F.col("label").alias("entity_type"), F.lit(score).alias("score"))
