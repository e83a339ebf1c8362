"""Placeholders back to values: one join over the original text's tags.

Inserted values are never read again, so a mapping can't make work without end; tags within
a value that are left in the result are scrubbed. Letter case and outer spaces of type and
id don't matter, other attributes must be about the same, and unknown tags become ``****``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.spanx import clean, matches, settle
from .pseudonymize import ratio
from .render import replace_spans

TAG = r"(?i)<PII\b[^>]*/>"
SCRUBBED = "****"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's text, or an empty one; quotes may be escaped."""
    return F.lower(F.trim(F.regexp_extract(F.replace(tag, F.lit('\\"'), F.lit('"')), rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)))


@F.pandas_udf(T.BooleanType())
def _about(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([not x or not y or ratio(x, y) >= 80 for x, y in zip(a, b)], dtype=bool)


def tags(texts: DataFrame) -> DataFrame:
    """(session, doc_id, start, end, kind, id, gender) of each tag in texts (session, doc_id, text)."""
    rows = texts.select("session", "doc_id", F.explode(matches(clean(F.col("text")), TAG)).alias("m"))
    return rows.select("session", "doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), *[_attribute(F.col("m.text"), n).alias(a) for n, a in (("type", "kind"), ("id", "id"), ("gender", "gender"))])


def restore(texts: DataFrame, mapping: DataFrame, inflect: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``texts`` (session, doc_id, text) with ``restored``. mapping: (session, tag, value), and
    ``ord`` where its order matters (of entries with equal type and id the first counts).
    ``inflect`` may change the values of found tags by their context."""
    entries = mapping if "ord" in mapping.columns else mapping.withColumn("ord", F.lit(0))
    keyed = entries.select("session", *[_attribute(F.col("tag"), n).alias(a) for n, a in (("type", "kind"), ("id", "id"), ("gender", "entry_gender"))], "value", "ord", "tag")
    first = Window.partitionBy("session", "kind", "id").orderBy("ord", "tag")
    keyed = keyed.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "ord", "tag")
    found = tags(texts).join(keyed, ["session", "kind", "id"], "left")
    found = found.withColumn("value", F.when(_about(F.coalesce("gender", F.lit("")), F.coalesce("entry_gender", F.lit(""))), F.col("value")))
    if inflect:
        found = inflect(found)
    put = F.coalesce(F.regexp_replace("value", TAG, SCRUBBED), F.lit(SCRUBBED))
    per = found.groupBy("session", "doc_id").agg(F.collect_list(F.struct("start", "end", put.alias("value"))).alias("found"))
    rows = settle(texts.join(per, ["session", "doc_id"], "left").withColumn("text", clean(F.col("text"))))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return rows.withColumn("restored", replace_spans(F.col("text"), F.coalesce("found", none), lambda s: s["value"])).drop("found")


#: The case that a preposition asks for.
PREPOSITION_CASE = {"о": "loct", "об": "loct", "при": "loct", "к": "datv", "ко": "datv", "по": "datv", "от": "gent", "до": "gent", "из": "gent", "у": "gent", "без": "gent", "для": "gent", "с": "ablt", "со": "ablt", "за": "ablt", "под": "ablt", "перед": "ablt", "над": "ablt", "в": "loct", "на": "loct", "через": "accs", "про": "accs"}


def case_before(text: Column, start: Column, window: int = 150) -> Column:
    """The grammatical case that the word before a tag asks for, or null; for an inflecting
    provider. Only the ``window`` characters before it are looked at."""
    left = F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))
    word = F.lower(F.regexp_extract(left, r"(?iuU)([а-яё]+)\s*\z", 1))
    return F.create_map(*[F.lit(x) for kv in PREPOSITION_CASE.items() for x in kv])[word]
