"""Placeholders, restoration, labelled data, scoring, settings and the stream."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.spanx import SPANS
from palimpsest.operators import evaluate as E, ner, pseudonymize as P
from palimpsest.operators.restore import case_before, restore
from palimpsest.plans import api
from palimpsest.sources import config, labelled
from palimpsest.streaming.sessions import OUT, stream_placeholders

TEXTS = ["Иван Петров пишет ivan@mail.ru", "снова ivan@mail.ru и anna@mail.ru", "Иван  Петров, иван петров"]


def found(spark):
    spans = [
        [(0, 4, "PERSON"), (5, 11, "PERSON"), (18, 30, "EMAIL_ADDRESS")],
        [(6, 18, "EMAIL_ADDRESS"), (21, 33, "EMAIL_ADDRESS")],
        [(0, 4, "PERSON"), (6, 12, "PERSON"), (14, 18, "PERSON"), (19, 25, "PERSON")],
    ]
    rows = [(1, i, i, t, [(a, b, k, 0.7, "model") for a, b, k in s]) for i, (t, s) in enumerate(zip(TEXTS, spans))]
    return spark.createDataFrame(rows, f"session long, text_ord long, doc_id long, norm string, spans {SPANS}")


def test_placeholders_and_back(spark):
    rows = found(spark)
    assigned = P.assign(rows)
    got = {r.doc_id: r.rendered for r in P.placed(rows, assigned).collect()}
    assert got[0] == '<PII type="PERSON" gender="unknown" id="1" /> пишет <PII type="EMAIL_ADDRESS" id="1" />'
    assert got[1] == 'снова <PII type="EMAIL_ADDRESS" id="1" /> и <PII type="EMAIL_ADDRESS" id="2" />'
    assert got[2].count('type="PERSON"') == 2 and got[2].count('id="1"') == 2
    texts = spark.createDataFrame([(1, d, t) for d, t in got.items()], "session long, doc_id long, text string")
    back = {r.doc_id: r.restored for r in restore(texts, P.mapping(assigned)).collect()}
    assert back[1] == TEXTS[1] and back[0].endswith(TEXTS[0][11:])


def test_restoring_is_bounded_and_scrubs(spark):
    t = lambda k, i: f'<PII type="{k}" id="{i}" />'
    texts = spark.createDataFrame([(1, 1, f"a {t('X', 1)} {t('X', 2)} <pii id='3' type='x' new=\"1\"/> <PII open"), (1, 2, None), (2, 3, t("X", 1))], "session long, doc_id long, text string")
    mapping = spark.createDataFrame([(1, t("X", 1), "one " + t("X", 1), 0), (1, t("x", " 1 "), "later", 1), (1, t("X", 3), "$3 \\", 2)], "session long, tag string, value string, ord int")
    got = {r.doc_id: r.restored for r in restore(texts, mapping).collect()}
    assert got == {1: "a one **** **** $3 \\ <PII open", 2: "", 3: "****"}


def test_similarity_is_by_common_letters():
    assert P.ratio("111", "11") == 80 and P.ratio("", "") == 100 and P.ratio("ab", "cd") == 0


def test_the_word_before_asks_for_a_case(spark):
    rows = spark.createDataFrame([("письмо для ",), ("без слов",)], "t string")
    assert [r.c for r in rows.select(case_before(F.col("t"), F.char_length("t")).alias("c")).collect()] == ["gent", None]


def test_tokens_windows_and_bridges(spark):
    (r,) = spark.createDataFrame([("ул. Ленина, д.5 (кв. 7)... «Да!»",)], "t string").select(ner.tokens(F.col("t")).alias("m")).collect()
    assert [m.text for m in r.m] == ["ул", ".", "Ленина", ",", "д.5", "(", "кв", ".", "7", ")", ".", ".", ".", "«", "Да", "!", "»"]
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.choice([1, 2, 5, 40, 700]) for _ in range(rng.randint(0, 400))]
        owned = [i for _, _, a, b in ner.windows(sizes) for i in range(a, b)]
        assert owned == [i for i, s in enumerate(sizes) if s <= 510]
        assert all(sum(sizes[a:b]) <= 510 for a, b, _, _ in ner.windows(sizes))
    rows = [(1, i, t, i, i + 1, g) for i, (t, g) in enumerate([("a", "B-DOC"), (",", "O"), ("b", "I-DOC"), (",", "O"), (".", "O"), ("c", "B-DOC"), ("x", "B-CITY"), (",", "O"), ("y", "B-CITY")])]
    df = ner.bridge(spark.createDataFrame(rows, "doc_id int, tok_ord int, token string, start int, end int, tag string"))
    spans = sorted((r.start, r.end, r.entity_type) for r in ner.merge_runs(df, {"DOC": "PASSPORT", "CITY": "LOCATION"}).collect())
    assert spans == [(0, 3, "PASSPORT"), (5, 6, "PASSPORT"), (6, 7, "LOCATION"), (8, 9, "LOCATION")]


def test_labelled_csv_to_gold(spark, tmp_path):
    rows = pd.DataFrame(
        {
            "id": ["a", "b", "c"], "text": ["Ivan lives in Rome now", "", "x"], "tokens": ["['Ivan', 'lives', 'in', 'Rome', 'now']", "['no', 'text']", "broken"],
            "ner_tags": ["['B-NAME', 'O', 'O', 'B-CITY', 'I-CITY']", "['B-A', 'B-A']", "[]"], "source": ["s", "s", "s"],
        }
    )
    rows.to_csv(tmp_path / "d.csv", index=False)
    got = {r.row_id: r for r in labelled.read_iob2_csv(spark, str(tmp_path / "d.csv")).collect()}
    assert [tuple(g) for g in got["a"].gold] == [("NAME", 0, 4), ("CITY", 14, 22)]
    assert got["b"].text == "no text" and [tuple(g) for g in got["b"].gold] == [("A", 0, 2), ("A", 3, 7)] and got["c"].gold == []
    assert labelled.dataset_digest(spark, str(tmp_path / "d.csv")).first().size > 0


def test_matchers_against_loops(spark):
    rng = random.Random(6)
    make = lambda n: [(r, rng.choice("AB"), a := rng.randint(0, 20), a + rng.randint(1, 6)) for r in range(8) for _ in range(rng.randint(0, n))]
    gold, pred = make(6), make(6)
    schema = "row_id int, label string, start int, end int"
    g, p = spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)
    order = lambda rows: sorted(rows, key=lambda s: (s[0], s[2], s[3]))
    used, hits = set(), 0
    for x in order(gold):
        for j, y in enumerate(order(pred)):
            if j not in used and x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3]:
                used.add(j)
                hits += 1
                break
    sg, sp = E.soft_match(g, p)
    assert sg.filter("hit").count() == sp.filter("hit").count() == hits
    strict = sum(min(gold.count(x), pred.count(x)) for x in set(gold))
    assert E.strict_match(g, p)[0].filter("hit").count() == strict
    gate = E.gate_match(g, p)
    assert gate[0].filter("hit").count() == sum(any(x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3] for y in pred) for x in gold)
    total = {r.label: r for r in E.metrics(*gate).collect()}[None]
    assert total.tp + total.fn == len(gold)


def test_soft_matches_of_a_row_with_very_many_spans_take_one_pass():
    import time

    import pyarrow as pa

    rng = random.Random(7)
    loop = lambda golds, preds: [next((j for j in range(len(preds)) if preds[j][2] and preds[j][0] < e and s < preds[j][1] and not preds[j].__setitem__(2, False)), None) is not None for s, e in golds]
    for size in (3, 60, 3000):  # spans of no length, too; batches cut groups anywhere
        rows = sorted((r, rng.choice(["A", None]) or "", a := rng.randint(0, size), a + rng.randint(0, 6), rng.random() < 0.5) for r in range(3) for _ in range(size))
        table = pa.Table.from_pylist([dict(zip(("row_id", "label", "start", "end", "is_gold"), (r, k or None, *x))) for r, k, *x in rows])
        out = [x for b in E._soft(table.to_batches(max_chunksize=7)) for x in b.to_pylist()]
        assert [tuple(x.values())[:5] for x in out] == [(r, k or None, *x) for r, k, *x in rows]
        for key in {x[:2] for x in rows}:
            mine = [x for x in out if (x["row_id"], x["label"] or "") == key]
            preds = [[x["start"], x["end"], True] for x in mine if not x["is_gold"]]
            assert [x["hit"] for x in mine if x["is_gold"]] == loop([(x["start"], x["end"]) for x in mine if x["is_gold"]], preds)
            assert [x["hit"] for x in mine if not x["is_gold"]] == [not free for _, _, free in preds]
    n, began = 100_000, time.time()
    table = pa.table({"row_id": [1] * 2 * n, "label": ["A"] * 2 * n, "start": [i // 2 * 3 for i in range(2 * n)], "end": [i // 2 * 3 + 2 for i in range(2 * n)], "is_gold": [i % 2 == 0 for i in range(2 * n)]})
    assert all(pa.Table.from_batches(E._soft(table.to_batches(max_chunksize=10_000)))["hit"].to_pylist()) and time.time() - began < 30


def test_soft_matches_of_many_small_rows_are_found_side_by_side(monkeypatch):
    import time

    import pyarrow as pa

    rng = random.Random(11)
    rows = sorted((r, rng.choice("AB"), s := rng.randint(0, 20), s + rng.randint(-1 if r % 50 == 0 else 0, 8), rng.random() < 0.5) for r in range(900) for _ in range(rng.randint(1, 12)))
    table = pa.Table.from_pylist([dict(zip(("row_id", "label", "start", "end", "is_gold"), x)) for x in rows])
    read = lambda size: [x["hit"] for b in E._soft(table.to_batches(max_chunksize=size)) for x in b.to_pylist()]
    side_by_side = [read(size) for size in (10_000, 500, 7)]
    monkeypatch.setattr(E, "SIDE_BY_SIDE", 0)
    assert all(x == read(10_000) for x in side_by_side) and any(side_by_side[0])
    monkeypatch.undo()
    n = 400_000
    many = pa.table({"row_id": [i // 8 for i in range(n)], "label": ["A"] * n, "start": [i % 8 * 3 for i in range(n)], "end": [i % 8 * 3 + 5 for i in range(n)], "is_gold": [i % 2 == 0 for i in range(n)]}).to_batches(max_chunksize=10_000)

    def seconds():
        began = time.process_time()
        out = sum(b.column("hit").true_count for b in E._soft(many))
        return time.process_time() - began, out

    fast, found = min(seconds() for _ in range(3))
    monkeypatch.setattr(E, "SIDE_BY_SIDE", 0)
    slow, same = min(seconds() for _ in range(3))
    assert found == same == n and fast < 0.6 * slow, (fast, slow)


def test_soft_scores_are_those_of_the_hits(spark):
    rows = [(r, k, s, s + 5) for r in range(40) for k in ("A", None) for s in range(r % 4, 30, 7)]
    gold = spark.createDataFrame(rows, "row_id long, label string, start int, end int")
    pred = spark.createDataFrame([(r, k, s + r % 6, e + r % 6) for r, k, s, e in rows if s % 5] + [(1, "B", None, 3)], gold.schema)
    key = lambda r: tuple(map(str, r))
    got = sorted(E.soft_scores(gold, pred).collect(), key=key)
    assert got == sorted(E.metrics(*E.soft_match(gold, pred)).collect(), key=key) and len(got) == 4


def test_soft_scores_of_the_query_are_those_of_first_fit(spark, tmp_path):
    from collections import Counter

    from palimpsest import queries as Q

    lines = Q.table(spark, "/root/testdata/sf0.001", "lineitem").crossJoin(spark.range(2))
    shifted = F.col("l_orderkey") + F.col("id") * 10_000_000
    for name, key in (("shifted", shifted), ("one_row", F.when(F.col("l_orderkey") % 2 == 0, 2).otherwise(shifted))):
        lines.withColumn("l_orderkey", key.cast("bigint")).drop("id").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        of = {}  # golds and predictions of a row and label
        for k, sql in enumerate((Q._GOLD, Q._PRED)):
            for r in Q._spans(spark, f"{tmp_path}/{name}", sql).collect():
                of.setdefault((r.row_id, r.label), ([], []))[k].append((r.start, r.end))
        want = Counter()
        for (_, label), (golds, preds) in of.items():
            left, hits = sorted(preds), 0
            for s, e in sorted(golds):
                fit = next((j for j, y in enumerate(left) if y[0] < e and s < y[1]), None)
                hits += fit is not None
                left = left if fit is None else left[:fit] + left[fit + 1 :]
            for k in (label, None):
                want.update({(k, "tp"): hits, (k, "fp"): len(left), (k, "fn"): len(golds) - hits})
        got = {(r.label, k): r[k] for r in Q.scorer_soft(spark, f"{tmp_path}/{name}").collect() for k in ("tp", "fp", "fn")}
        assert got == dict(want) and len(got) == 9


def test_soft_matches_call_python_for_batches_not_for_each_row(spark):
    gold = spark.range(40).selectExpr("id as row_id", "'A' as label", "0 as start", "5 as end")
    for out in (E.soft_match(gold, gold)[0], E.metrics(*E.soft_match(gold, gold))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan
    assert E.soft_match(gold, gold)[0].filter("hit").count() == 40


def test_neighbours_and_offsets(spark):
    rows = spark.createDataFrame([("Москва, ул. Ленина, д. 5", [(0, 6, "ADDRESS"), (12, 18, "ADDRESS"), (23, 24, "ADDRESS"), (23, 24, "OTHER")])], "t string, s array<struct<start:int,end:int,label:string>>")
    assert [tuple(x) for x in rows.select(E.merge_neighbours(F.col("s"), F.col("t")).alias("m")).first().m] == [(0, 24, "ADDRESS"), (23, 24, "OTHER")]
    df = spark.createDataFrame([("a  b­c", "a bc")], "o string, n string")
    assert df.select(E.offset_map("o", "n").alias("m")).first().m == [0, 1, 3, 5, 6]


def test_settings_by_rank(tmp_path, spark):
    (tmp_path / "c.yaml").write_text("ner_stride: 64\ntranslit: 'no'\nentities: []\n")
    s = config.load(str(tmp_path / "c.yaml"), spark, {"PALIMPSEST_NER_STRIDE": "32", "PALIMPSEST_MODEL_REVISION": " "}, mask_char="#")
    assert (s.ner_stride, s.translit, s.mask_char, s.model_revision, len(s.entities)) == (32, False, "#", None, 20)
    with pytest.raises(ValueError):
        config.load(None, env={}, unknown=1)
    with pytest.raises(ValueError):
        config.load(None, env={}, translit="perhaps")
    assert config.load(str(tmp_path / "absent.yaml"), env={}) == config.Settings()


def test_api_limits_and_allowlist(spark):
    docs = api.texts(spark, ["ИНН 7707083893, ivan@mail.ru", "x" * 50])
    kept, over = api.limited(docs, config.Settings(max_text_chars=40))
    assert kept.count() == 1 and "text" not in over.columns and over.first().n_chars == 50
    got = api.anonymize(kept, "tag", entities=["inn "]).first()
    assert got.rendered == "ИНН [INN], ivan@mail.ru"
    assert api.anonymize(kept, "tag", entities=[]).first().rendered == "ИНН 7707083893, ivan@mail.ru"
    assert api.texts(spark, []).count() == 0 and api.texts(spark, "one").count() == 1


def test_stream_keeps_ids(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = f"session string, text_ord long, doc_id long, norm string, spans {SPANS}"
    span = lambda v: [{"start": 0, "end": len(v), "entity_type": "EMAIL_ADDRESS", "score": 0.8, "branch": "rules"}]
    for n, values in enumerate((["b@x.ru", "a@x.ru"], ["a@x.ru", "c@x.ru"])):
        lines = [json.dumps({"session": "s", "text_ord": 10 * n + i, "doc_id": 10 * n + i, "norm": v, "spans": span(v)}) for i, v in enumerate(values)]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_placeholders(rows).writeStream.format("memory").queryName("tagged").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.value, r.tag) for r in spark.table("tagged").collect()}
    assert len(got) == 3 and OUT


def test_mappings_beyond_a_ceiling_are_refused_with_a_reason(spark):
    tag = '<PII type="X" id="%d" />'
    rows = [(1, tag % 1, "one"), (2, tag % 1, "v" * 5000)] + [(3, tag % k, "v") for k in range(4097)]
    mapping = spark.createDataFrame(rows, "session long, tag string, value string")
    docs = spark.createDataFrame([(s, s, f"a {tag % 1} b") for s in (1, 2, 3, 4)], "session long, doc_id long, text string")
    got = {r.session: (r.restored, r.rejected) for r in api.deanonymize(docs, mapping).collect()}
    assert got[1] == ("a one b", None) and got[4] == ("a **** b", None)
    assert got[2] == (None, "a mapping string of 5000 characters, more than 4096") and got[3] == (None, "4097 mapping entries, more than 4096")
