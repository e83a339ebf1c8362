"""Which of overlapping spans stay: five passes, each over one row's array of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, normalize as N
from ..functions.spanx import built, duels, greedy, in_groups, matches, overlap, part, settle


def email_shaped(spans: Column, text: Column) -> Column:
    """Model spans for mail addresses must look like one, or stand after a word for mail."""

    def good(s: Column) -> Column:
        value = N.safe(part(text, s["start"], s["end"]))
        before = N.safe(part(text, s["start"] - 40, s["start"]))
        core = value.rlike(r"(?U)[^\s@]+\s*@\s*[^\s@]")
        return core & (value.rlike(r"(?U)[^\s@]@") | value.rlike(r"(?U)@[^@]*\.\s*[A-Za-z]{2,}") | before.rlike(X.KEYWORDS["mail"]))

    return F.filter(spans, lambda s: (s["entity_type"] != "EMAIL_ADDRESS") | good(s))


def over_phones(spans: Column, winners: tuple[str, ...]) -> Column:
    """Phone numbers that overlap a document number go."""
    return F.filter(spans, lambda s: (s["entity_type"] != "PHONE_NUMBER") | ~F.exists(spans, lambda o: o["entity_type"].isin(*winners) & overlap(o, s)))


def by_pairs(spans: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Rules (winner, loser) on overlapping pairs, in array order."""

    def loser(a: Column, b: Column) -> Column:
        wins = lambda x, y: F.array_contains(F.array(*[F.lit(f"{w}>{v}") for w, v in rules]), F.concat(x["entity_type"], F.lit(">"), y["entity_type"]))
        return F.when(~overlap(a, b), 0).when(wins(a, b), 1).when(wins(b, a), -1).otherwise(0)

    return duels(spans, loser) if rules else spans


def same_type(spans: Column) -> Column:
    """Of two spans of a type that overlap the longer stays; of equal ones the earlier."""
    size = lambda s: s["end"] - s["start"]
    return duels(spans, lambda a, b: F.when((a["entity_type"] != b["entity_type"]) | ~overlap(a, b), 0).when(size(a) < size(b), -1).otherwise(1))


def dates_in_addresses(spans: Column, text: Column) -> Column:
    """A date that is part of a dotted address, or stands right beside one, is none."""
    def touches(s: Column) -> Column:
        lo = F.greatest(s["start"] - 20, F.lit(0))
        near = matches(part(text, lo, s["end"] + 20), X.IPV4_PREFIX)
        a, b = (lambda m: lo + m["start"]), (lambda m: lo + m["end"])
        inside = F.exists(near, lambda m: ((a(m) <= s["start"]) & (s["start"] < b(m))) | ((a(m) < s["end"]) & (s["end"] <= b(m))) | ((s["start"] <= a(m)) & (s["end"] >= b(m))))

        def beside(o: Column) -> Column:
            close = (F.abs(s["start"] - o["end"]) <= 5) | (F.abs(s["end"] - o["start"]) <= 5)
            gap = F.when(s["start"] >= o["end"], part(text, o["end"], s["start"])).otherwise(part(text, s["end"], o["start"]))
            return (o["entity_type"] == "IP_ADDRESS") & close & gap.rlike(r"(?U)^(?:\s*|\.)\z")

        return inside | F.exists(spans, beside)

    return F.filter(spans, lambda s: (s["entity_type"] != "DATE_TIME") | ~touches(s))


def dates_in_norms(spans: Column, text: Column) -> Column:
    """A dotted date between a norm's name and its year is the norm's number."""

    def norm(s: Column) -> Column:
        tail, left = part(text, s["end"], s["end"] + 8), part(text, s["start"] - 24, s["start"])
        return part(text, s["start"], s["end"]).rlike(X.NORMATIVE_DATE) & tail.rlike(X.NORMATIVE_SUFFIX) & left.rlike(X.NORMATIVE_PREFIX)

    return F.filter(spans, lambda s: (s["entity_type"] != "DATE_TIME") | ~norm(s))


def addresses_without_digits(spans: Column, text: Column) -> Column:
    return F.filter(spans, lambda s: (s["entity_type"] != "IP_ADDRESS") | part(text, s["start"], s["end"]).rlike(r"(?U)\d"))


def links_in_mail(spans: Column, text: Column) -> Column:
    """A link that is the domain of a mail address is no link."""

    def domain(s: Column) -> Column:
        after_at = F.regexp_extract(part(text, s["start"] - 100, s["start"]), r"(?s)^.*@(.*)\z", 1)
        has_at = part(text, s["start"] - 100, s["start"]).contains("@")
        beside = F.exists(spans, lambda o: (o["entity_type"] == "EMAIL_ADDRESS") & (s["start"] > o["end"]) & part(text, o["end"], s["start"]).rlike(r"(?U)^\s*\z"))
        return (has_at & after_at.rlike(r"^[\p{L}\p{N}._+\-]*\z")) | beside

    return F.filter(spans, lambda s: (s["entity_type"] != "URL") | ~domain(s))


PAIRWISE = tuple(X.PAIRWISE)
HANDLERS = (dates_in_addresses, dates_in_norms, addresses_without_digits, links_in_mail)


def resolve(rows: DataFrame, spans: str, text: str, out: str, *, over_phone=tuple(X.OVER_PHONE), pairwise=PAIRWISE, handlers=HANDLERS) -> DataFrame:
    """Phones, pairs, handlers, equal types, and the greedy choice by score, one after another."""
    rows = settle(rows.withColumn(out, over_phones(F.col(spans), tuple(over_phone))))
    rows = settle(rows.withColumn(out, built(_by_pairs, out, pairwise)))
    for handler in handlers:
        rows = settle(rows.withColumn(out, built(_handled, handler, out, text)))
    rows = settle(rows.withColumn(out, built(_same_type, out)))
    return settle(rows.withColumn(out, built(_best_first, out)))


def _by_pairs(spans: str, rules: tuple[tuple[str, str], ...]) -> Column:
    return in_groups(F.col(spans), lambda s: by_pairs(s, tuple(rules)))


def _handled(handler, spans: str, text: str) -> Column:
    return handler(F.col(spans), F.col(text))


def _same_type(spans: str) -> Column:
    return in_groups(F.col(spans), same_type)


def _best_first(spans: str) -> Column:
    return in_groups(F.col(spans), greedy)


def rules_over_model(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Long form: all rule spans, and model spans that overlap none (an interval anti-join
    keyed by document)."""
    m, r = model.alias("m"), rules.alias("r")
    hit = (F.col("m.doc_id") == F.col("r.doc_id")) & (F.col("m.start") < F.col("r.end")) & (F.col("r.start") < F.col("m.end"))
    return rules.unionByName(m.join(r, hit, "left_anti"))
