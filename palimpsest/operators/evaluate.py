"""Scores against labelled data: gold spans, matching, rates, gates."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import fixed as X
from ..functions.spanx import overlap, part

GOLD = "array<struct<label:string,start:int,end:int>>"


def gold_spans(text: Column, tokens: Column, tags: Column) -> Column:
    """IOB2 tags to spans: tokens are found left to right, a span begins where the label
    changes or a tag says B-; a token that isn't found neither begins nor ends one."""
    n = F.least(F.size(tokens), F.size(tags))
    none = F.lit(None).cast("string")
    zero = F.struct(F.lit(0).alias("pos"), none.alias("label"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.array().cast(GOLD).alias("out"))

    def closed(a: Column) -> Column:
        whole = a["label"].isNotNull() & a["start"].isNotNull() & a["end"].isNotNull()
        return F.when(whole, F.array_append(a["out"], F.struct(a["label"].alias("label"), a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["out"])

    def step(a: Column, i: Column) -> Column:
        token, tag = F.get(tokens, i), F.get(tags, i)
        place = F.call_function("instr", F.substring(text, a["pos"] + 1, F.lit(2**30)), token)
        start = F.when(place > 0, a["pos"] + place - 1)
        end = start + F.char_length(token)
        label = F.when(tag != "O", F.regexp_replace(tag, "^[^-]*-", ""))
        new = ~label.eqNullSafe(a["label"]) | tag.startswith("B-")
        return F.struct(
            F.coalesce(end, a["pos"]).cast("int").alias("pos"), label.alias("label"), F.when(new, start).otherwise(a["start"]).cast("int").alias("start"),
            F.when(new, end).otherwise(F.when(a["end"].isNotNull(), F.coalesce(end, a["end"]))).cast("int").alias("end"), F.when(new, closed(a)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), zero, step, closed)


def map_labels(spans: DataFrame, labels: dict[str, str], column: str = "label") -> tuple[DataFrame, DataFrame]:
    """Spans with mapped labels, and counts of labels that the map doesn't have."""
    kinds = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    known = spans.withColumn("_to", kinds[F.col(column)])
    return known.filter("_to is not null").withColumn(column, F.col("_to")).drop("_to"), known.filter("_to is null").groupBy(column).agg(F.count("*").alias("n"))


def valid(pred: DataFrame, texts: DataFrame, categories: list[str]) -> DataFrame:
    """Predictions of known types that lie within their text."""
    size = texts.select("row_id", F.char_length("text").alias("_n"))
    return pred.join(size, "row_id").filter(F.col("label").isin(*categories) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n"))).drop("_n")


def _numbered(spans: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("row_id").orderBy("start", "end", "label")
    return spans.withColumn(name, F.row_number().over(order))


def gate_match(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each gold span goes to the first prediction of its label that overlaps it; a prediction
    may take several. (row_id, label, start, end) each, and ``hit``."""
    g, p = _numbered(gold, "g_ord"), _numbered(pred, "p_ord")
    pair = g.alias("g").join(p.alias("p"), (F.col("g.row_id") == F.col("p.row_id")) & (F.col("g.label") == F.col("p.label")) & (F.col("g.start") < F.col("p.end")) & (F.col("p.start") < F.col("g.end")))
    taken = pair.groupBy(F.col("g.row_id").alias("row_id"), F.col("g.g_ord").alias("g_ord")).agg(F.min("p.p_ord").alias("p_ord"))
    golds = g.join(taken.select("row_id", "g_ord", F.lit(True).alias("hit")), ["row_id", "g_ord"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    preds = p.join(taken.select("row_id", "p_ord", F.lit(True).alias("hit")).distinct(), ["row_id", "p_ord"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return golds.drop("g_ord"), preds.drop("p_ord")


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 to six places; 0 where there is nothing to divide by."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2 * p * r, p + r), 6).alias("f1")]


def metrics(golds: DataFrame, preds: DataFrame) -> DataFrame:
    """tp, fp, fn and rates of each label, and of all (label null), by rollup."""
    kind = lambda d, gold: d.select("label", F.lit(gold).alias("is_gold"), "hit")
    return scores(kind(golds, True).unionByName(kind(preds, False)))


def scores(both: DataFrame, n: Column | None = None) -> DataFrame:
    """``metrics`` of golds and predictions in one table (label, is_gold, hit), which is read once; ``n`` is how many spans a
    row stands for. Labels are summed before the rollup, which makes two rows of each that it gets."""
    gold, hit, n = F.col("is_gold"), F.col("hit"), F.lit(1) if n is None else n
    both = both.select("label", *[F.when(c, n).otherwise(0).alias(k) for k, c in (("tp", gold & hit), ("fp", ~gold & ~hit), ("fn", gold & ~hit))])
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    out = both.groupBy("label").agg(*sums).rollup("label").agg(*sums)
    return out.select("label", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def errors(golds: DataFrame, preds: DataFrame) -> DataFrame:
    """Missed and false spans; false ones with the gold labels that they overlap."""
    fn = golds.filter(~F.col("hit")).select(F.lit("FN").alias("error_type"), "row_id", "label", "start", "end", F.lit("").alias("overlap_gold_labels"))
    f, g = preds.filter(~F.col("hit")).alias("f"), golds.alias("g")
    near = f.join(g, (F.col("f.row_id") == F.col("g.row_id")) & (F.col("f.start") < F.col("g.end")) & (F.col("g.start") < F.col("f.end")), "left")
    fp = near.groupBy(*[F.col(f"f.{c}").alias(c) for c in ("row_id", "label", "start", "end")]).agg(F.array_join(F.array_sort(F.collect_set("g.label")), "|").alias("overlap_gold_labels"))
    return fn.unionByName(fp.select(F.lit("FP").alias("error_type"), "row_id", "label", "start", "end", "overlap_gold_labels"))


def coverage(categories: list[str], golds: DataFrame) -> DataFrame:
    """Configured labels that no gold span has."""
    spark = golds.sparkSession
    return spark.createDataFrame([(c,) for c in categories], "label string").join(golds.select("label").distinct(), "label", "left_anti")


def gates(scores: DataFrame, missing: DataFrame, error_rate: float = 0.0, baseline: float | None = None, same_data: bool = False, floor: float = 0.95, category_floor: float = 0.85, most_errors: float = 0.05, most_drop: float = 0.02) -> DataFrame:
    """(gate, passed): overall F1, each category's, coverage, transport errors, regression."""
    micro = F.max(F.when(F.col("label").isNull(), F.col("f1")))
    low = F.count_if(F.col("label").isNotNull() & (F.col("f1") < category_floor))
    one = scores.agg(micro.alias("micro"), low.alias("low")).crossJoin(F.broadcast(missing.agg(F.count("*").alias("missing"))))  # one row each
    drop = F.lit(True) if baseline is None or not same_data else F.col("micro") >= baseline - most_drop
    checks = {"micro_f1": F.col("micro") >= floor, "category_floor": F.col("low") == 0, "coverage": F.col("missing") == 0, "error_rate": F.lit(error_rate <= most_errors), "regression": drop}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])).alias("g")).select("g.gate", "g.passed")


def families(spans: DataFrame, exact: dict[str, str], prefixes: dict[str, str] | None = None, column: str = "entity_type") -> DataFrame:
    """Labels to families, by name or by beginning; others go."""
    kinds = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]) if exact else F.create_map(F.lit(""), F.lit(""))
    out = kinds[F.col(column)]
    for start, family in (prefixes or {}).items():
        out = F.coalesce(out, F.when(F.col(column).startswith(start), F.lit(family)))
    return spans.withColumn("label", out).filter("label is not null")


def merge_neighbours(spans: Column, text: Column) -> Column:
    """Neighbouring predictions of one merging family, apart by a short connective, are one.
    spans: array of (start, end, label)."""
    kind = "array<struct<start:int,end:int,label:string>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        gap = part(text, last["end"], s["start"])
        joins = (s["label"] == last["label"]) & s["label"].isin(*X.MERGE_FAMILIES) & (s["start"] >= last["end"]) & (F.char_length(gap) <= X.MERGE_GAP) & gap.rlike(X.ADDRESS_LINK)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))
        return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), longer)).otherwise(F.array_append(acc, new))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def one_label(spans: Column) -> Column:
    """Where predictions overlap the one with the highest score stays; spans: (start, end,
    label, score)."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), s["end"].alias("c"), s.alias("s"))))
    zero = F.array().cast("array<struct<start:int,end:int,label:string,score:double>>")
    return F.array_sort(F.aggregate(ranked, zero, lambda acc, r: F.when(F.exists(acc, lambda k: overlap(k, r["s"])), acc).otherwise(F.array_append(acc, r["s"]))))


def drop_on_excluded(pred: DataFrame, excluded: DataFrame) -> DataFrame:
    """Predictions that overlap excluded gold go (interval anti-join)."""
    p, e = pred.alias("p"), excluded.alias("e")
    return p.join(e, (F.col("p.row_id") == F.col("e.row_id")) & (F.col("p.start") < F.col("e.end")) & (F.col("e.start") < F.col("p.end")), "left_anti")


def strict_match(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One to one where start, end and label are equal: equi-join of numbered repeats."""
    keys = ["row_id", "start", "end", "label"]
    nth = lambda d: d.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    g, p = nth(gold), nth(pred)
    mark = lambda a, b: a.join(b.select(*keys, "nth", F.lit(True).alias("hit")), [*keys, "nth"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("nth")
    return mark(g, p), mark(p, g)


#: Spans of a row and label that are matched side by side with those of other rows, at most.
SIDE_BY_SIDE = 64


def _side_by_side(first: np.ndarray, size: np.ndarray, gold: np.ndarray, start: np.ndarray, end: np.ndarray, hits: np.ndarray) -> None:
    """Marks hits in groups of sorted spans (none ends before it begins), a step in all groups at a time: the next gold and
    the next prediction are a hit if they overlap, else the one that ends first is done."""
    own = np.repeat(np.arange(len(first)), size)
    rows = np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(own))
    is_gold = gold[rows]
    golds, preds = rows[is_gold], rows[~is_gold]
    g_size, p_size = (np.bincount(own[k], minlength=len(first)) for k in (is_gold, ~is_gold))
    g_end, p_end = np.cumsum(g_size), np.cumsum(p_size)
    g, p = g_end - g_size, p_end - p_size
    while True:
        live = np.flatnonzero((g < g_end) & (p < p_end))
        if not len(live):
            return
        if len(live) < len(g):
            g, p, g_end, p_end = g[live], p[live], g_end[live], p_end[live]
        i, j = golds[g], preds[p]
        past = end[i] <= start[j]
        hit = (start[i] < end[j]) & ~past
        hits[i[hit]] = hits[j[hit]] = 1
        g = g + (hit | past)
        p = p + ~past


def _soft(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by row, label, start and end, with ``hit``. A span goes to the first waiting one of the other kind that it
    overlaps, else it waits; one that ends before a later one of the other kind begins waits no more. Each span is looked at
    once and leaves once, and batches leave when none of their spans waits. Small groups that lie within a batch are matched
    side by side."""
    held: dict[int, tuple[pa.RecordBatch, bytearray]] = {}
    waiting = {True: deque(), False: deque()}  # golds and predictions: start, end, batch, place
    group, last = 0, None
    for n, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        keys, starts, ends = (batch.column(k) for k in ("row_id", "label")), batch.column("start"), batch.column("end")
        keys = [k.dictionary_encode(null_encoding="encode") for k in keys]
        new = np.any([np.diff(k.indices.to_numpy(zero_copy_only=False), prepend=k.indices[0].as_py()) != 0 for k in keys], axis=0)
        at = lambda i: [k[i].as_py() for k in keys]
        new[0] = last is None or at(0) != last
        last, groups = at(batch.num_rows - 1), group + np.cumsum(new)
        whole = (starts.is_valid().to_numpy(zero_copy_only=False) & ends.is_valid().to_numpy(zero_copy_only=False)).nonzero()[0]
        columns = [groups, batch.column("is_gold").to_numpy(zero_copy_only=False), *(pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (starts, ends))]
        hits = bytearray(batch.num_rows)
        held[n] = batch, hits
        # Not side by side: groups that other batches may have, large ones, and those with a span that ends before it begins.
        _, gold, start, end = columns
        of = groups[whole]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else whole
        size = np.diff(np.append(at, len(of)))
        small = (size <= SIDE_BY_SIDE) & (of[at] != group) & (of[at] != groups[-1])
        if len(at):
            small &= np.add.reduceat(end[whole] < start[whole], at, dtype=np.int64) == 0
            k = np.zeros(len(whole), np.uint8)
            _side_by_side(at[small], size[small], gold[whole], start[whole], end[whole], k)
            np.frombuffer(hits, np.uint8)[whole] = k
            whole = whole[~np.repeat(small, size)]
        for i, of, gold, start, end in zip(whole.tolist(), *(c[whole].tolist() for c in columns)):
            if of != group:
                group = of
                waiting[True].clear()
                waiting[False].clear()
            others = waiting[not gold]
            while others and others[0][1] <= start:
                others.popleft()
            if others and others[0][0] < end:
                _, _, m, k = others.popleft()
                held[m][1][k] = hits[i] = 1
            else:
                waiting[gold].append((start, end, n, i))
        if group != groups[-1]:  # the last group's spans have no place
            group = int(groups[-1])
            waiting[True].clear()
            waiting[False].clear()
        first = min((w[0][2] for w in waiting.values() if w), default=n + 1)
        for m in [m for m in held if m < first]:
            yield _with_hits(*held.pop(m))
    for rows in held.values():
        yield _with_hits(*rows)


def _with_hits(batch: pa.RecordBatch, hits: bytearray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.frombuffer(hits, dtype=bool))], names=[*batch.schema.names, "hit"])


def _soft_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _soft(batches):
        out = pa.Table.from_batches([batch]).group_by(["label", "is_gold", "hit"]).aggregate([([], "count_all")])
        yield from out.rename_columns(["label", "is_gold", "hit", "n"]).to_batches()


def soft_hits(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One to one, greedy from left to right, where labels are equal and spans overlap: (row_id, label, start, end, is_gold,
    hit). Labels don't compete, so each one's spans of a row are read once, in order, however many they are."""
    rows, kinds = _in_order(gold, pred)
    return rows.mapInArrow(_soft, f"{kinds}, hit boolean")


def soft_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``scores`` of ``soft_hits``; the spans themselves don't come back from the workers."""
    rows, _ = _in_order(gold, pred)
    return scores(rows.mapInArrow(_soft_counts, f"label {rows.schema['label'].dataType.simpleString()}, is_gold boolean, hit boolean, n long"), F.col("n"))


def _in_order(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, str]:
    """Spans of both kinds, dealt by row and label and sorted; their columns' types."""
    cols = ["row_id", "label", "start", "end"]
    both = gold.select(*cols, F.lit(True).alias("is_gold")).unionByName(pred.select(*cols, F.lit(False).alias("is_gold")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema)
    return both.repartition("row_id", "label").sortWithinPartitions(*cols), kinds


def soft_match(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``soft_hits`` of golds and of predictions."""
    out = soft_hits(gold, pred)
    return out.filter("is_gold").drop("is_gold"), out.filter("not is_gold").drop("is_gold")


def macro(scores: DataFrame) -> DataFrame:
    """Mean rates over the labels that have gold spans."""
    return scores.filter("label is not null and support > 0").agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def clean_rows_hit(texts: DataFrame, golds: DataFrame, preds: DataFrame) -> DataFrame:
    """Rows without gold spans, and how many of them have a false span."""
    empty = texts.select("row_id").join(golds.select("row_id").distinct(), "row_id", "left_anti")
    bad = preds.select("row_id").distinct().withColumn("bad", F.lit(1))
    return empty.join(bad, "row_id", "left").agg(F.count("*").alias("negatives"), F.count("bad").alias("with_false_span"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def offset_map(original: pd.Series, changed: pd.Series) -> pd.Series:
    """For each place of the changed text its place in the original, by longest common blocks."""

    def one(a: str, b: str) -> list[int]:
        out = [0] * (len(b) + 1)
        for kind, i, i_end, j, j_end in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for k in range(j, j_end):
                out[k] = i + k - j if kind == "equal" else i
        out[len(b)] = len(a)
        return out

    return pd.Series([one(a or "", b or "") for a, b in zip(original, changed)])


def to_original(spans: Column, places: Column) -> Column:
    """Spans of the normalised text in the original: the end is that of the last character."""
    end = lambda s: F.greatest(F.get(places, s["end"] - 1) + 1, F.when(s["end"] == F.size(places) - 1, F.get(places, s["end"])).otherwise(F.lit(0)))
    return F.transform(spans, lambda s: F.struct(F.get(places, s["start"]).alias("start"), end(s).cast("int").alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["branch"].alias("branch")))
