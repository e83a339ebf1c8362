"""Stable placeholders per session, and the mapping that takes them back.

Names and places may be compared loosely, in order of appearance; that needs one pass over
a session's own mentions. All other types are ranked by windows alone.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X
from ..functions.spanx import part, settle
from .render import replace_spans

MERGED = "array<struct<start:int,end:int,entity_type:string,score:double,parts:int>>"


def merge_names(spans: Column, text: Column, most: int = X.NAME_PARTS) -> Column:
    """Names with only white space between them are one, of ``most`` parts at most; any other
    span between ends a name."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        gap = part(text, last["end"], s["start"])
        joins = (s["entity_type"] == "PERSON") & (last["entity_type"] == "PERSON") & gap.rlike(r"(?U)^\s*\z") & (last["parts"] < most)
        longer = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["entity_type"].alias("entity_type"), F.greatest(last["score"], s["score"]).alias("score"), (last["parts"] + 1).alias("parts"))
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), F.lit(1).alias("parts"))
        return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), longer)).otherwise(F.array_append(acc, new))

    return F.aggregate(F.array_sort(spans), F.array().cast(MERGED), step)


def mentions(found: DataFrame) -> DataFrame:
    """found (session, text_ord, doc_id, norm, spans) -> one row a mention, with its key."""
    rows = settle(found.withColumn("merged", merge_names(F.col("spans"), F.col("norm"))))
    rows = rows.select("session", "text_ord", "doc_id", "norm", F.explode("merged").alias("s"))
    value = F.trim(F.regexp_replace(part(F.col("norm"), F.col("s.start"), F.col("s.end")), r"(?U)\s+", " "))
    return rows.select("session", "text_ord", "doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.entity_type").alias("entity_type"), value.alias("value"))


def ratio(a: str, b: str) -> float:
    """Insert-and-delete similarity of two strings, 0 to 100: 2 * common / (len + len)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def _loose(threshold: dict[str, float], normal: Callable[[str, str], str]):
    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text_ord", "start"], kind="stable")
        kind = rows["entity_type"].iloc[0]
        known: dict[str, int] = {}
        loose: dict[str, int] = {}
        ids, count = [], 0
        for value in rows["value"]:
            key = normal(kind, value)
            if key not in known:
                may = kind == "PERSON" or not any(c.isdigit() for c in key)
                best = max(((ratio(key, k), -i, n) for i, (k, n) in enumerate(loose.items())), default=(0, 0, 0)) if may else (0, 0, 0)
                if best[0] >= threshold[kind]:
                    known[key] = best[2]
                else:
                    count += 1
                    known[key] = count
                if may:
                    loose[key] = known[key]
            ids.append(known[key])
        return rows.assign(id=ids)[["session", "text_ord", "doc_id", "start", "end", "entity_type", "value", "id"]]

    return f


def rank(rows: DataFrame) -> DataFrame:
    """(session, entity_type, value, id): distinct values by first appearance. Values are
    folded before they are ranked, so a value that all texts have costs one row."""
    first = rows.groupBy("session", "entity_type", "value").agg(F.min(F.struct("text_ord", "start")).alias("first"))
    order = Window.partitionBy("session", "entity_type").orderBy("first", "value")
    return first.select("session", "entity_type", "value", F.row_number().over(order).cast("int").alias("id"))


def fold_case(kind: str, value: str) -> str:
    """The stand-in for a morphology provider: lower case, no inflection."""
    return value.lower()


def assign(found: DataFrame, loose: bool = True, normal: Callable[[str, str], str] = fold_case, gender: Column | None = None) -> DataFrame:
    """Mentions with id and tag. Ids count from 1 by session and type, in order of first
    appearance; equal values share one."""
    rows = mentions(found)
    is_loose = F.col("entity_type").isin(*X.FUZZY) if loose else F.lit(False)
    cols = ["session", "text_ord", "doc_id", "start", "end", "entity_type", "value", "id"]
    exact = rows.filter(~is_loose)
    out = exact.join(rank(exact), ["session", "entity_type", "value"]).select(*cols)
    if loose:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        out = out.unionByName(rows.filter(is_loose).groupBy("session", "entity_type").applyInPandas(_loose(X.FUZZY, normal), f"{kinds}, id int"))
    name = F.format_string('<PII type="%s" gender="%s" id="%d" />', F.col("entity_type"), F.lit("unknown") if gender is None else gender, F.col("id"))
    return out.withColumn("tag", F.when(F.col("entity_type") == "PERSON", name).otherwise(F.format_string('<PII type="%s" id="%d" />', F.col("entity_type"), F.col("id"))))


def mapping(assigned: DataFrame) -> DataFrame:
    """(session, tag, entity_type, id, value): the later text's value, there the leftmost."""
    order = Window.partitionBy("session", "tag").orderBy(F.col("text_ord").desc(), F.col("start"))
    top = assigned.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return top.select("session", "tag", "entity_type", "id", "value")


def placed(found: DataFrame, assigned: DataFrame) -> DataFrame:
    """``found`` with ``rendered``: each mention replaced by its tag."""
    per = assigned.groupBy("session", "text_ord", "doc_id").agg(F.collect_list(F.struct("start", "end", "tag")).alias("tags"))
    rows = settle(found.join(per, ["session", "text_ord", "doc_id"], "left"))
    tags = F.coalesce("tags", F.array().cast("array<struct<start:int,end:int,tag:string>>"))
    return rows.withColumn("rendered", replace_spans(F.col("norm"), tags, lambda s: s["tag"])).drop("tags")


def refused(rows: DataFrame) -> DataFrame:
    """(session, reason) of sessions whose mapping is beyond a ceiling: so many entries, so many
    characters of a string. Sizes are said, never a value."""
    sizes = rows.groupBy("session").agg(F.count("*").alias("n"), F.max(F.greatest(F.char_length("tag"), F.coalesce(F.char_length("value"), F.lit(0)))).alias("longest"))
    many = F.when(F.col("n") > X.MAPPING_ENTRIES, F.format_string(f"%d mapping entries, more than {X.MAPPING_ENTRIES}", "n"))
    long = F.when(F.col("longest") > X.MAPPING_CHARS, F.format_string(f"a mapping string of %d characters, more than {X.MAPPING_CHARS}", "longest"))
    return sizes.select("session", F.coalesce(many, long).alias("reason")).filter("reason is not null")
