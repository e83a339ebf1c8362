"""Detection of personal data: candidates, number rules, pattern rules and their order.

Everything stays nested in the document's row: candidates, contexts, verdicts and spans are
arrays, so no step shuffles, and a document costs what its own candidates cost. Cheap guards
(is there a digit, an at sign, a colon) keep the patterns off most texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import checks, context as C, fixed as X, normalize as N
from ..functions.spanx import SPANS, built, matches, once, part, same, settle, uncaptured, without_overlap
from . import resolve

Rule = Callable[[Column], Column]  # candidate -> struct(score, entity_type) or null

CANDIDATE = "array<struct<ord:int,start:int,end:int,raw:string>>"


def number_rules() -> dict[str, Callable[[Column], Column]]:
    """Score of a candidate for each type, or null. A candidate has: raw, digits, near and far
    (windows), and for each keyword family the distances that its length can need."""
    n = lambda c: F.char_length(c["digits"])
    w, v = F.when, F.lit

    def nearest(c, family, near, far):
        return F.coalesce(C.within(c[f"{family}_near"], near), C.within(c[f"{family}_far"], far))

    def anywhere(c, family):
        return C.has(c["near"], family) | C.has(c["far"], family)

    def document_near(c, family):
        return nearest(c, family, 80, 160).isNotNull() | C.after(c["near"], family, c["raw"], 200)

    def arbiter(c):
        """1 passport, -1 licence, 0 unclear."""
        p, d = nearest(c, "passport", 80, 160), nearest(c, "licence", 80, 160)
        less = lambda a, b: w(a < b, 1).when(b < a, -1)
        one_side = w(p.isNotNull() & d.isNull(), 1).when(d.isNotNull() & p.isNull(), -1)
        around = [less(C.center(c[x], "passport", c["raw"]), C.center(c[x], "licence", c["raw"])) for x in ("near", "far")]
        return F.coalesce(one_side, less(p, d), *around, v(0))

    def inn(c):
        i, p, d = nearest(c, "inn", 80, 160), nearest(c, "passport", 80, 160), nearest(c, "licence", 80, 160)
        first = i.isNotNull() & F.coalesce(p > i, v(True)) & F.coalesce(d > i, v(True))
        marked = anywhere(c, "series") | F.trim(c["raw"]).rlike(f"{X.SERIES_AND_NUMBER.replace('(?iuU)', '(?iuU)^(?:', 1)})\\z")
        clear = ~marked & ~anywhere(c, "passport") & ~anywhere(c, "certificate") & d.isNull()
        ten = w(first, 0.90).when(clear, 0.85)
        return w((n(c) == 12) & checks.inn12(c["digits"]), 0.95).when((n(c) == 10) & checks.inn10(c["digits"]), ten)

    def oms(c):
        o, k = nearest(c, "oms", 100, 220), nearest(c, "card", 100, 220)
        near_o, near_k = C.has(c["near"], "oms"), C.has(c["near"], "card")
        alone = w(near_o | near_k, near_o & ~near_k).otherwise(C.has(c["far"], "oms") & ~C.has(c["far"], "card"))
        score = w(o.isNotNull() & k.isNull(), 0.90).when(o.isNotNull(), w(o < k, 0.85)).when(alone, 0.85)
        return w((n(c) == 16) & checks.luhn(c["digits"]), score)

    def card(c):
        o, k, weak = (nearest(c, f, 100, 220) for f in ("oms", "card", "card_weak"))
        near_o, near_k, near_w = (C.has(c["near"], f) for f in ("oms", "card", "card_weak"))
        widen = ~near_k & ~near_o
        any_o, any_k = w(widen, C.has(c["far"], "oms")).otherwise(near_o), w(widen, C.has(c["far"], "card")).otherwise(near_k)
        any_w = near_w | (widen & C.has(c["far"], "card_weak"))
        sixteen = (
            w(k.isNotNull() & o.isNull(), 0.90)
            .when(k.isNotNull(), w(k < o, 0.85).when(k == o, 0.60))
            .when(o.isNull(), w(weak.isNotNull(), 0.80).when((any_k | any_w) & ~any_o, 0.85))
        )
        return w(checks.luhn(c["digits"]), w(n(c).isin(13, 15, 18, 19), 0.90).when(n(c) == 16, sixteen))

    def passport(c):
        here, rival = document_near(c, "passport"), document_near(c, "licence")
        return w(n(c) == 10, w(here & ~rival, 0.80).when(here, w(arbiter(c) == 1, 0.75)))

    def licence(c):
        here, rival = document_near(c, "licence"), document_near(c, "passport")
        return w(n(c) == 10, w(here & ~rival, 0.80).when(here, w(arbiter(c) == -1, 0.75)))

    def whole(pattern):
        return pattern.replace("(?iuU)", "(?iuU)^(?:", 1) + ")\\z"

    def military(c):
        raw = F.trim(c["raw"])
        near = (c["military_near"] <= 60).eqNullSafe(v(True))
        far = nearest(c, "military", 140, 140).isNotNull() | C.after(c["near"], "military", c["raw"], 40)
        series = F.upper(F.regexp_replace(F.regexp_extract(raw, X.MILITARY_STRICT, 1), "[^A-Za-zА-Яа-яЁё]", ""))
        strict = w(~series.isin(*X.MILITARY_UNCLEAR), 0.95).when(near, 0.90).when(far, 0.85)
        shaped = raw.rlike(whole(X.MILITARY_PLAIN)) | raw.rlike(whole(X.MILITARY_NUMBERED))
        return w((n(c) == 7) & shaped, w(raw.rlike(X.MILITARY_STRICT), strict).when(near, 0.85).when(far, 0.80))

    def birth(c):
        raw, word = F.trim(c["raw"]), anywhere(c, "birth")
        return w((n(c) == 6) & raw.rlike(X.BIRTH), w(raw.rlike(X.BIRTH_STRICT), w(word, 0.95).otherwise(0.85)).otherwise(w(word, 0.90).otherwise(0.80)))

    def bank_account(c):
        word = nearest(c, "account", 120, 120).isNotNull()
        bik = C.find_bik(c["near"], c["far"])
        return w(n(c) == 20, w(bik.isNotNull(), w(checks.account(c["digits"], bik), 0.97).when(word, 0.60)).when(word, 0.90))

    def bik(c):
        return w((n(c) == 9) & (c["bik_near"] <= 40), w(checks.bik(c["digits"]), 0.95).otherwise(0.85))

    def postal(c):
        yes, no = C.within(c["postal_near"], 60), C.within(c["postal_rival_near"], 60)
        near = F.coalesce(yes <= F.coalesce(no, v(10**6)), no.isNull() & C.after(c["near"], "postal", c["raw"], 45))
        return w((n(c) == 6) & ~anywhere(c, "postal_veto") & near & checks.postal_prefix(c["digits"]), 0.92)

    def telegram(c):
        return w(c["raw"].startswith("@") & ~(c["other_network_near"] <= 40).eqNullSafe(v(True)), 0.90)

    return {
        "BIRTH_CERTIFICATE": birth, "MILITARY_ID": military, "SNILS": lambda c: w((n(c) == 11) & checks.snils(c["digits"]), 0.95), "TELEGRAM": telegram, "INN": inn,
        "BANK_ACCOUNT": bank_account, "BIK": bik, "CREDIT_CARD": card, "OMS": oms, "PASSPORT": passport, "POSTAL_CODE": postal, "DRIVER_LICENSE": licence,
    }


#: Which lengths ask for which family's distances; 0 stands for candidates that start with an at sign.
NEEDS = {
    "inn": (10,), "passport": (10,), "licence": (10,), "oms": (16,), "card": (16,), "card_weak": (16,), "account": (20,), "bik": (9,),
    "postal": (6,), "postal_rival": (6,), "military": (7,), "other_network": (0,),
}
ONE_SIDED = ("bik", "postal", "postal_rival", "other_network")


@dataclass(frozen=True)
class Catalog:
    """The rules in use. ``with_rule`` and ``without`` give changed copies; nothing registers
    itself on import."""

    numbers: dict[str, Rule] = field(default_factory=number_rules)
    order: tuple[str, ...] = tuple(X.PRIORITY)
    candidates: tuple[str, ...] = tuple(X.CANDIDATES)
    patterns: tuple[tuple[str, float, str], ...] = tuple(X.REGEX_RULES)
    over_phone: tuple[str, ...] = tuple(X.OVER_PHONE)
    pairwise: tuple[tuple[str, str], ...] = tuple(X.PAIRWISE)
    handlers: tuple[Callable, ...] = resolve.HANDLERS

    def with_pattern(self, kind: str, score: float, pattern: str) -> Catalog:
        """One more pattern rule (Java syntax)."""
        return replace(self, patterns=(*self.patterns, (kind, score, pattern)))

    def with_number_rule(self, kind: str, rule: Rule, patterns: tuple[str, ...] = (), before: str | None = None) -> Catalog:
        """One more number rule: its candidate patterns come before the general ones."""
        at = self.order.index(before) if before else len(self.order)
        general = len(self.candidates) - 3
        return replace(
            self, numbers=self.numbers | {kind: rule}, order=(*self.order[:at], kind, *self.order[at:]), candidates=(*self.candidates[:general], *patterns, *self.candidates[general:])
        )

    def with_pair(self, winner: str, loser: str) -> Catalog:
        return replace(self, pairwise=(*self.pairwise, (winner, loser)))

    def with_handler(self, handler: Callable[[Column, Column], Column]) -> Catalog:
        """``handler(spans, text)`` gives the spans that stay."""
        return replace(self, handlers=(*self.handlers, handler))

    def without(self, kind: str) -> Catalog:
        return replace(self, numbers={k: r for k, r in self.numbers.items() if k != kind}, order=tuple(k for k in self.order if k != kind), patterns=tuple(p for p in self.patterns if p[0] != kind))

    def entity_types(self) -> list[str]:
        return sorted({*self.order, *(p[0] for p in self.patterns), *X.MODEL_ONLY})


@cache
def default_catalog() -> Catalog:
    """The rules as they come: one object, so that what is built from it is built once."""
    return Catalog()


def candidates(text: Column, patterns: tuple[str, ...] = tuple(X.CANDIDATES)) -> Column:
    """Matches of all patterns in pattern order, each span once (the first pattern has it)."""
    digits = text.rlike(r"(?U)(?:\d\D*+){5}\d")
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    at_sign = [F.when(F.contains(text, F.lit("@")), matches(text, p)).otherwise(none) if "@[A-Za-z]" in p else None for p in patterns]
    found = [matches(text, p) if a is None else a for p, a in zip(patterns, at_sign)]
    every = F.flatten(F.when(digits, F.array(*found)).otherwise(F.array(none, *[a for a in at_sign if a is not None])))
    zero = F.array().cast("array<struct<start:int,end:int,text:string>>")
    fresh = F.aggregate(every, zero, lambda acc, m: F.when(F.exists(acc, lambda k: same(k, m)), acc).otherwise(F.array_append(acc, m)))
    return F.transform(fresh, lambda m, i: F.struct(i.cast("int").alias("ord"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("raw")))


def data_spans(raw: Column) -> Column:
    """Where in a candidate its values are: (start, end) of one or more."""
    trim = "№ \\t,.;:()\\[\\]«»\"'"
    inner = F.transform(
        matches(raw, r"(?U)\S+"),
        lambda t: F.struct(
            (t["start"] + F.char_length(F.regexp_extract(t["text"], f"^[{trim}]*", 0))).cast("int").alias("start"),
            (t["end"] - F.char_length(F.regexp_extract(F.regexp_replace(t["text"], f"^[{trim}]+", ""), f"[{trim.replace('№', '')}]*\\z", 0))).cast("int").alias("end"),
        ),
    )
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(False).alias("cut"))

    def step(a: Column, t: Column) -> Column:
        value = part(raw, t["start"], t["end"])
        service = (t["start"] >= t["end"]) | value.rlike(X.SERVICE_WORD)
        last = F.get(a["out"], F.size(a["out"]) - 1)
        joins = ~a["cut"] & (F.size(a["out"]) > 0) & part(raw, last["end"], t["start"]).rlike(r"(?U)^[\s\-–—/]*\z")
        longer = F.array_append(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.struct(last["start"].alias("start"), t["end"].alias("end")))
        out = F.when(service, a["out"]).when(joins, longer).otherwise(F.array_append(a["out"], t))
        return F.struct(out.alias("out"), service.alias("cut"))

    found = F.aggregate(inner, zero, step, lambda a: a["out"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length(raw).cast("int").alias("end")))
    return F.when(F.size(found) > 0, found).otherwise(whole)


def number_spans(safe: Column, catalog: Catalog) -> Column:
    """Spans of the number rules in a text with plain spaces and dashes: candidates, contexts, distances, the best verdict, one of
    overlapping candidates with the same digits, and its values."""
    found = candidates(safe, catalog.candidates)
    seen = F.transform(
        found,
        lambda c: F.struct(
            c["ord"].alias("ord"), c["start"].alias("start"), c["end"].alias("end"), c["raw"].alias("raw"), checks.digits_only(c["raw"]).alias("digits"),
            C.sentence(safe, c["start"], c["end"]).alias("near"), C.wide(safe, c["start"], c["end"]).alias("far"),
        ),
    )

    def measured(c: Column) -> Column:
        n = F.char_length(c["digits"])
        fields = [c[k].alias(k) for k in ("ord", "start", "end", "raw", "digits", "near", "far")]
        for family, lengths in NEEDS.items():
            asked = c["raw"].startswith("@") if lengths == (0,) else n.isin(*lengths)
            fields.append(F.when(asked, C.before(c["near"], family)).alias(f"{family}_near"))
            if family not in ONE_SIDED:
                fields.append(F.when(asked, C.before(c["far"], family)).alias(f"{family}_far"))
        return F.struct(*fields)

    def judged(c: Column) -> Column:
        verdicts = []
        for rank, kind in enumerate(catalog.order):
            score = catalog.numbers[kind](c)
            verdicts.append(F.when(score.isNotNull(), F.struct(score.cast("double").alias("score"), F.lit(rank).alias("rank"), F.lit(kind).alias("entity_type"))))
        best = F.array_max(F.filter(F.array(*verdicts), lambda x: x.isNotNull()))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["raw"].alias("raw"), c["digits"].alias("digits"), best.alias("best"))

    judged_ = F.filter(F.transform(F.transform(seen, measured), judged), lambda c: c["best"].isNotNull())
    zero = F.array().cast("array<struct<start:int,end:int,raw:string,digits:string,best:struct<score:double,rank:int,entity_type:string>>>")
    fresh = F.aggregate(
        judged_,
        zero,
        lambda acc, c: F.when(F.exists(acc, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]) & (k["digits"] == c["digits"])), acc).otherwise(F.array_append(acc, c)),
    )
    out = F.transform(
        fresh,
        lambda c: F.transform(
            data_spans(c["raw"]),
            lambda s: F.struct(
                (c["start"] + s["start"]).cast("int").alias("start"), (c["start"] + s["end"]).cast("int").alias("end"), c["best"]["entity_type"].alias("entity_type"), c["best"]["score"].alias("score"), F.lit("rules").alias("branch")
            ),
        ),
    )
    return F.flatten(out)


def pattern_spans(text: Column, catalog: Catalog) -> Column:
    """Spans of the pattern rules. Of one type's spans that lie within one another or are
    equal, one with the higher score stays."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    asked = F.struct(text.rlike(r"(?U)\d").alias("digit"), F.contains(text, F.lit("@")).alias("at"), F.contains(text, F.lit(":")).alias("colon"))
    def named(kind: str, score: float):
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("entity_type"), F.lit(score).alias("score"), F.lit("rules").alias("branch"))

    def found(has: Column) -> Column:
        guard = {"EMAIL_ADDRESS": has["at"], "IP_PORT": has["colon"] & has["digit"], "DATE_TIME": has["digit"], "IP_ADDRESS": has["digit"]}
        return F.array(*[F.transform(F.when(guard.get(kind, F.lit(True)), matches(text, p)).otherwise(none), named(kind, score)) for kind, score, p in catalog.patterns])

    return F.array_distinct(F.flatten(once(asked, found)))


def _numbers(text: str, catalog: Catalog) -> Column:
    return number_spans(F.col(text), catalog)


def pattern_column(text: str, catalog: Catalog) -> Column:
    return pattern_spans(F.col(text), catalog)


def _numbers_each(texts: str, catalog: Catalog) -> Column:
    return F.transform(texts, lambda t: number_spans(t, catalog))


def _patterns_each(texts: str, catalog: Catalog) -> Column:
    return F.transform(texts, lambda t: pattern_spans(t, catalog))


def _sorted(numbers: Column, patterns: Column) -> Column:
    return F.array_sort(F.concat(numbers.cast(SPANS), patterns.cast(SPANS)))


def rule_spans(rows: DataFrame, text: str, out: str, catalog: Catalog) -> DataFrame:
    """``rows`` with all rule spans of a text column, by (start, end, type)."""
    rows = settle(rows.withColumn("_safe", N.safe(F.col(text))))
    rows = settle(rows.withColumn("_numbers", built(_numbers, "_safe", catalog)))
    return settle(rows.withColumn(out, _sorted(F.col("_numbers"), built(pattern_column, text, catalog)))).drop("_safe", "_numbers")


def _moved(s: Column, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["branch"].alias("branch"))


def normalised(docs: DataFrame, english: bool = True) -> DataFrame:
    """doc_id, text, norm."""
    rows = docs.select("doc_id", "text", F.col("text").alias("norm"))
    for step in N.normalising(english):
        rows = settle(rows.withColumn("norm", step(F.col("norm"))))
    return rows


def _all_texts(rows: DataFrame, catalog: Catalog, translit: bool) -> DataFrame:
    """``rows`` (work, blobs) with ``main``: spans of the text, its Cyrillic form and its blobs."""
    empty = F.array().cast(SPANS)
    rows = settle(rows.withColumn("blanked", N.blank_out(F.col("work"), F.col("blobs"))))
    rows = settle(rows.withColumn("latin", N.looks_like_translit(F.col("blanked")) if translit else F.lit(False)))
    rows = settle(rows.withColumn("cyr", N.to_cyrillic(F.col("blanked"), F.col("latin"))))
    source = F.when(F.col("latin"), F.col("blanked")).otherwise(F.col("work"))
    texts = F.concat(F.array(source), F.when(F.col("latin"), F.array(F.col("cyr.text"))).otherwise(F.array().cast("array<string>")), F.transform("blobs", lambda b: b["decoded"]))
    rows = settle(rows.withColumn("texts", texts))
    rows = settle(rows.withColumn("_safe", F.transform("texts", N.safe)))
    rows = settle(rows.withColumn("_numbers", built(_numbers_each, "_safe", catalog)))
    rows = settle(rows.withColumn("_patterns", built(_patterns_each, "texts", catalog)))
    rows = settle(rows.withColumn("by_text", F.zip_with("_numbers", "_patterns", _sorted))).drop("_safe", "_numbers", "_patterns")
    back = F.transform(F.get("by_text", F.lit(1)), lambda s: F.struct(N.source_span(F.col("cyr.pieces"), s["start"], s["end"]).alias("at"), s.alias("s")))
    rows = settle(rows.withColumn("back", F.when(F.col("latin"), F.filter(back, lambda x: x["at"].isNotNull()))))
    rows = settle(rows.withColumn("back", F.coalesce(F.transform("back", lambda x: _moved(x["s"], x["at"]["start"], x["at"]["end"])).cast(SPANS), empty)))
    first = F.when(F.col("latin"), 2).otherwise(1)
    # A blob's spans cover the blob as a whole.
    inside = F.flatten(F.transform("blobs", lambda b, i: F.transform(F.get("by_text", first + i), lambda s: _moved(s, b["start"], b["end"]))))
    main = F.concat(F.col("back"), without_overlap(F.get("by_text", F.lit(0)), F.col("back")), F.coalesce(inside.cast(SPANS), empty))
    rows = settle(rows.withColumn("main", main))
    return rows


def detect(docs: DataFrame, catalog: Catalog | None = None, *, model: DataFrame | None = None, translit: bool = True, english: bool = True, base64: bool = True, budget: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text, norm, spans, rejected.

    ``model`` has precomputed spans (doc_id, spans) over the normalised text; without it the
    model branch is empty. A text with more base64 than the budget is refused as a whole:
    ``rejected`` says why, and it has no spans. Without ``budget`` every text is read, whatever
    base64 it has. Null and empty texts have no spans.
    """
    with uncaptured():
        return _detect(docs, catalog or default_catalog(), model, translit, english, base64, budget)


def _detect(docs: DataFrame, catalog: Catalog, model: DataFrame | None, translit: bool, english: bool, base64: bool, budget: bool) -> DataFrame:
    rows = normalised(docs, english)
    none, empty = F.array().cast("array<struct<start:int,end:int,decoded:string>>"), F.array().cast(SPANS)
    rows = settle(rows.withColumn("blobs", N.base64_blobs(F.col("norm")) if base64 else none))
    size = F.aggregate(F.col("blobs"), F.lit(0), lambda a, b: a + F.char_length(b["decoded"]))
    over = (F.size("blobs") > X.BASE64_BLOBS) | (size > X.BASE64_CHARS) if budget else F.lit(False)
    rows = settle(rows.withColumn("rejected", F.when(over, F.lit("base64 budget"))))
    rows = rows.withColumn("blobs", F.when(F.col("rejected").isNull(), F.col("blobs")).otherwise(none))
    rows = settle(rows.withColumn("work", F.when(F.col("rejected").isNull(), F.col("norm")).otherwise(F.lit(""))))
    rows = _all_texts(rows, catalog, translit) if translit or base64 else rule_spans(rows, "work", "main", catalog)
    rows = rows.withColumnRenamed("main", "rules").select("doc_id", "text", "norm", "work", "rules", "rejected")
    if model is not None:
        m = model.select(F.col("doc_id").alias("model_id"), F.col("spans").cast(SPANS).alias("model_spans"))
        rows = rows.join(m, F.col("doc_id").eqNullSafe(F.col("model_id")), "left").withColumn("model_spans", resolve.email_shaped(F.coalesce("model_spans", empty), F.col("norm")))
        rows = rows.withColumn("all", F.concat(F.col("rules"), without_overlap(F.col("model_spans"), F.col("rules"))))
    else:
        rows = rows.withColumn("all", F.col("rules"))
    out = resolve.resolve(rows, "all", "work", "spans", over_phone=catalog.over_phone, pairwise=catalog.pairwise, handlers=catalog.handlers)
    return out.select("doc_id", "text", "norm", "spans", "rejected")


def long_spans(found: DataFrame) -> DataFrame:
    """One row a span: doc_id, start, end, entity_type, score, value."""
    rows = found.select("doc_id", "norm", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.entity_type", "s.score", part(F.col("norm"), F.col("s.start"), F.col("s.end")).alias("value"))
