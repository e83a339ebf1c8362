"""Detection, resolution and rendering against planted truth and plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import checks, fixed, normalize as N
from palimpsest.functions.spanx import SPANS, best_first, clean, matches
from palimpsest.operators import resolve
from palimpsest.operators.detect import Catalog, data_spans, detect, long_spans, normalised, pattern_column
from palimpsest.operators.render import render

B64 = "0L/QsNGB0L/QvtGA0YIg0YHQtdGA0LjRjyA0NTA5INC90L7QvNC10YAgMTIzNDU2"
CASES = [
    ("ИНН 7707083893 и СНИЛС 112-233-445 95", [("INN", "7707083893"), ("SNILS", "112-233-445 95")]),
    ("паспорт серия 45 09 номер 123456, выдан", [("PASSPORT", "45 09"), ("PASSPORT", "123456")]),
    ("карта visa 4111 1111 1111 1111 до 12/25", [("CREDIT_CARD", "4111 1111 1111 1111"), ("DATE_TIME", "12/25")]),
    ("полис ОМС 4111111111111111", [("OMS", "4111111111111111")]),
    ("сервер 10.0.5.21:45 работает 15.03.2021", [("IP_PORT", "10.0.5.21:45"), ("DATE_TIME", "15.03.2021")]),
    ("почта ivan@mail.ru, телега @durov_official", [("EMAIL_ADDRESS", "ivan@mail.ru"), ("TELEGRAM", "@durov_official")]),
    ("инстаграм @durov_official", []),
    ("расчётный счёт 30101810800000000451 БИК 044525451", [("BANK_ACCOUNT", "30101810800000000451"), ("BIK", "044525451")]),
    ("индекс 123007, г. Москва", [("POSTAL_CODE", "123007")]),
    ("заказ 123007 оплачен", []),
    ("водительское удостоверение 9912 345678", [("DRIVER_LICENSE", "9912 345678")]),
    ("военный билет АБ 1234567", [("MILITARY_ID", "АБ 1234567")]),
    ("Moj nomer pasporta 4509 123456 zovut Ivan", [("PASSPORT", "4509 123456")]),
    (B64, [("PASSPORT", B64)]),
    ("СП 30.13330.2016 и ГОСТ 12.01.2004-91 нормы", []),
    ("12 января 2021 года и 5 часов", [("DATE_TIME", "12 января 2021 года"), ("DATE_TIME", "5 часов")]),
    ("phone +1 (807) 555-5623 of nobody", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, norm string")
    return long_spans(detect(docs)).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_planted_values_are_found(found, i):
    got = [(r.entity_type, r.value) for r in sorted(found, key=lambda r: r.start) if r.doc_id == i]
    assert got == CASES[i][1]


def test_too_much_base64_is_refused_as_a_whole(spark):
    docs = spark.createDataFrame([(1, " ".join([B64] * 33)), (2, B64 + " ИНН 7707083893")], "doc_id long, text string")
    got = {r.doc_id: r for r in detect(docs).collect()}
    assert got[1].rejected and not got[1].spans and not got[2].rejected and len(got[2].spans) == 2


def test_documents_beyond_the_base64_budget_are_read_too(spark, tmp_path):
    import base64

    from palimpsest import queries

    long_blob = base64.b64encode(("паспорт 4509 123456 " + "слово " * 4000).encode()).decode()
    many = [B64] * 100
    docs = [(1, "ИНН 7707083893 " + " ".join(many)), (2, f"{long_blob} СНИЛС 112-233-445 95"), (3, B64)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["detect_documents"](spark, str(tmp_path)).collect()
    assert all(r.value == docs[r.doc_id - 1][1][r.start : r.end] for r in got)
    of = lambda k: [(r.entity_type, r.value) for r in sorted(got, key=lambda r: r.start) if r.doc_id == k]
    assert of(1) == [("INN", "7707083893"), *[("PASSPORT", b) for b in many]]
    assert of(2) == [("PASSPORT", long_blob), ("SNILS", "112-233-445 95")]
    assert of(3) == [("PASSPORT", B64)]


def test_many_spans_are_chosen_from_in_groups_as_they_are_at_once(spark):
    r = random.Random(5)
    kinds = ["URL", "DATE_TIME", "IP_ADDRESS", "IP_PORT", "EMAIL_ADDRESS"]
    some = lambda n: [(a, a + r.randrange(9), r.choice(kinds), r.choice([0.5, 0.6, 0.9]), "rules") for a in (r.randrange(4 * n + 1) for _ in range(n))]
    rows = spark.createDataFrame([(n, some(n)) for n in (0, 1, 16, 17, 33, 60)], f"k int, s {SPANS}")
    s = F.col("s")
    ways = [(resolve._by_pairs("s", resolve.PAIRWISE), resolve.by_pairs(s, resolve.PAIRWISE)), (resolve._same_type("s"), resolve.same_type(s)), (resolve._best_first("s"), best_first(s))]
    for x in rows.select(*[c for way in ways for c in way]).collect():
        assert x[0] == x[1] and x[2] == x[3] and x[4] == x[5]


def test_a_text_with_base64_is_read_as_it_is_without(spark):
    at_its_end = "дата 12.01.2004-91"  # a pattern asks whether the text ends there
    docs = spark.createDataFrame([(1, at_its_end), (2, f"{B64} {at_its_end}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.entity_type, r.value) for r in long_spans(detect(docs)).collect())
    assert got == [(1, "DATE_TIME", "12.01.2004"), (2, "DATE_TIME", "12.01.2004"), (2, "PASSPORT", B64)]


@pytest.mark.parametrize("name", ["base64_children", "transliterated"])
def test_keys_of_one_small_file_are_dealt_to_many_tasks(spark, tmp_path, name):
    import duckdb

    from palimpsest import queries
    from palimpsest.plans import planted

    spark.range(1, 101).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = queries.QUERIES[name](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= planted.SPREAD > 1
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, rows.collect())) == sorted(con.sql(queries.ORACLE[name]).fetchall())


def test_offsets_count_code_points(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1 é😀́\n") for _ in range(60)) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", matches(clean(F.col("t")), r"[a1]+").alias("m")).collect():
        assert [(m.start, m.end, m.text) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a1]+", r.t or "")]


def span(kind, start, end, score=0.5):
    return (start, end, kind, score, "rules")


def test_triangle_gives_the_port_in_every_order(spark):
    text = "сервер 10.0.5.21:45 работает"
    spans = [span("IP_PORT", 7, 19, 0.6), span("IP_ADDRESS", 7, 16, 0.85), span("DATE_TIME", 14, 19, 0.75)]
    df = spark.createDataFrame([(i, text, list(p)) for i, p in enumerate(itertools.permutations(spans))], f"i int, t string, s {SPANS}")
    assert {tuple(x.entity_type for x in r.out) for r in resolve.resolve(df, "s", "t", "out").collect()} == {("IP_PORT",)}


def test_pairs_have_no_cycle():
    edges = set(fixed.PAIRWISE)
    assert not any((b, a) in edges for a, b in edges)
    while edges:
        ends = {b for _, b in edges} - {a for a, _ in edges}
        assert ends
        edges = {(a, b) for a, b in edges if b not in ends}


def test_greedy_choice_matches_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        rows.append((i, [span(rng.choice("AB"), a := rng.randint(0, 30), a + rng.randint(1, 9), rng.choice([0.3, 0.5, 0.9])) for _ in range(rng.randint(0, 9))]))
    df = spark.createDataFrame(rows, f"i int, s {SPANS}")
    for r in df.select("s", best_first(F.col("s")).alias("out")).collect():
        kept = []
        for k, s in sorted(enumerate(r.s), key=lambda x: (-x[1].score, x[1].start - x[1].end, x[1].start, x[0])):
            if all(s.end <= q.start or q.end <= s.start for _, q in kept):
                kept.append((k, s))
        assert [tuple(x) for x in r.out] == [tuple(s) for _, s in sorted(kept)]


@pytest.mark.parametrize(
    "raw, values",
    [("серия 45 09 номер 123456", ["45 09", "123456"]), ("№ 12345", ["12345"]), ("4509 - 123456", ["4509 - 123456"]), ("(77 07),", ["77 07"]), ("номер", ["номер"]), ("сер. 12 № 34", ["12", "34"])],
)
def test_values_of_a_candidate(spark, raw, values):
    (r,) = spark.createDataFrame([(raw,)], "t string").select(data_spans(F.col("t")).alias("s")).collect()
    assert [raw[s.start : s.end] for s in r.s] == values


@pytest.mark.parametrize(
    "given, want",
    [
        ("Код: один два три четыре.", "Код: 1234."), ("один два три", "один два три"), ("сто двадцать три", "123"), ("девять сто", "9 100"), ("одна тысяча", "1000"),
        ("три тысячи", "3 1000"), ("пять", "пять"), ("двадцать", "20"), ("A B—C­  d", "A B-C d"), ("card four one one one", "card 4111"), ("two thousand", "2000"), ("one two three", "1 2 3"), ("seven", "seven"),
    ],
)
def test_numbers_in_words(given, want):
    text = re.sub(" {2,}", " ", given.replace(" ", " ").replace("—", "-").replace("­", ""))
    assert N.english_numbers(N.russian_numbers(text)) == want


def test_what_looks_like_transliteration_matches_a_loop_and_cuts_words_once(spark):
    rng = random.Random(4)
    pool = ["the", "and", "with", "Moj", "iz", "zhivu", "shkola", "abc", "Zz'", "слово", "и", "a@b.ru", "x=y", "https://a/ya", "www.ya", "ya" * 11, "A1b2" * 6, "12", "йод"]
    texts = ["", *[" ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(400)]]

    def loop(text):
        t = re.sub(fixed.STRUCTURAL.removeprefix("(?U)"), " ", text)
        words = [w.lower() for w in re.findall(fixed.LATIN_WORD, t) if len(w) <= fixed.TRANSLIT_WORD_MAX]
        latin, cyrillic = len(re.findall("[A-Za-z]", t)), len(re.findall("[а-яА-ЯёЁ]", t))
        english, russian = (sum(w in ws for w in words) for ws in (fixed.ENGLISH_STOPWORDS, fixed.TRANSLIT_STOPWORDS))
        hints = any(h in w for w in words for h in fixed.TRANSLIT_HINTS)
        return len(words) >= 2 and latin > cyrillic and not (english >= 2 and english > russian) and (russian >= 1 or hints)

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.looks_like_translit(F.col("t")).alias("v"))
    got = [(r.t, r.v) for r in rows.collect()]
    assert got == [(t, loop(t)) for t in texts] and len({v for _, v in got}) == 2
    assert rows._jdf.queryExecution().analyzed().toString().count(fixed.LATIN_WORD) == 1


def test_a_text_is_asked_for_digits_once_for_all_patterns(spark):
    rows = spark.createDataFrame([("",)], "t string").select(pattern_column("t", Catalog()).alias("s"))
    assert rows._jdf.queryExecution().analyzed().toString().count(r"(?U)\d") == 1


def test_numbers_of_both_languages_are_read_by_one_worker(spark):
    texts = ["код один два три четыре five and twenty two, сто двадцать три", "двадцать one", "plain", "", None, "сто", "two thousand"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.norm for r in normalised(rows).collect()}
    assert got == {i: N.english_numbers(N.russian_numbers(t or "")) for i, t in enumerate(texts)}
    assert normalised(rows)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_transliteration_and_its_way_back():
    assert N.cyrillic("Shcherbakova")[0] == "Щербакова"
    text = "Moj e-mail a@b.ru zhivu"
    out, pieces = N.cyrillic(text)
    assert "a@b.ru" in out and out.endswith("живу")
    assert all(text[a:b] == out[x:y] for x, y, a, b, same in pieces if same)


def test_pieces_of_a_batch_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    texts = ["Moj e-mail a@b.ru zhivu", None, "", "x=1 ya www.ya.ru Shcherbakova " + "shch" * 9]
    got = N.cyrillic_column(pa.array(texts, pa.string())).to_pylist()
    keys = ("to", "to_end", "at", "at_end", "as_is")
    assert got == [{"text": None, "pieces": []} if t is None else {"text": (c := N.cyrillic(t))[0], "pieces": [dict(zip(keys, p)) for p in c[1]]} for t in texts]
    column = pa.array(["Moj dom na ulitse " * 200] * 200)  # 320,000 pieces
    tracemalloc.start()
    N.cyrillic_column(column)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


@pytest.mark.parametrize("check, good, bad", [("inn10", "7715964180", "7715964181"), ("inn12", "500100732259", "500100732258"), ("snils", "11223344595", "11223344566"), ("luhn", "4111111111111111", "4111111111111112")])
def test_check_digits(spark, check, good, bad):
    rows = spark.createDataFrame([(good, True), (bad, False), ("12", False), ("", False), ("x" * len(good), False)], "n string, y boolean")
    assert all(bool(r.v) == r.y for r in rows.select("y", getattr(checks, check)(F.col("n")).alias("v")).collect())


def test_account_and_code(spark):
    rows = spark.createDataFrame([("30101810800000000451", "044525451", True), ("30101810400000000225", "044525225", False)], "a string, b string, y boolean")
    assert all(r.v == r.y for r in rows.select("y", checks.account(F.col("a"), F.col("b")).alias("v")).collect())


def test_rendering(spark):
    df = spark.createDataFrame([(1, "ab cd ef", [span("X", 3, 5), span("Y", 0, 2)])], f"doc_id int, norm string, spans {SPANS}")
    assert render(df, "mask").first().rendered == "** ** ef"
    assert render(df, "tag").first().rendered == "[Y] [X] ef"
    assert render(df, "mask", "#", 1, True).first().rendered == "a# c# ef"
    with pytest.raises(ValueError):
        render(df, "other")


def test_catalog_is_changed_by_copies(spark):
    rules = Catalog().with_pattern("BADGE", 0.9, r"B-\d{3}").without("TELEGRAM")
    docs = spark.createDataFrame([(1, "B-123 @durov_official")], "doc_id long, text string")
    assert [(r.entity_type, r.value) for r in long_spans(detect(docs, rules)).collect()] == [("BADGE", "B-123")]
    assert "TELEGRAM" in Catalog().entity_types() and "TELEGRAM" not in rules.entity_types()


def test_rules_beat_the_model(spark):
    docs = spark.createDataFrame([(1, "ИНН 7707083893 Иван")], "doc_id long, text string")
    model = spark.createDataFrame([(1, [(4, 14, "PHONE_NUMBER", 0.7, "model"), (15, 19, "PERSON", 0.7, "model")])], f"doc_id long, spans {SPANS}")
    assert {r.entity_type for r in long_spans(detect(docs, model=model)).collect()} == {"INN", "PERSON"}


@pytest.mark.parametrize("name", ["document_contests", "number_vetoes", "date_forms", "address_forms"])
def test_contests_and_vetoes_are_what_their_sql_says(spark, tmp_path, name):
    import duckdb

    from palimpsest import queries

    spark.range(1, 61).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(queries.ORACLE[name]).fetchall()
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want) and want
