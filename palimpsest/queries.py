"""Queries over the driver's tables, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import checks, normalize as N
from .functions.lineage import checkpoint
from .functions.spanx import SPANS, best_first, built, clean, matches
from .operators import evaluate as E, ner, pseudonymize as P, resolve
from .operators.detect import default_catalog, detect, long_spans, pattern_column
from .operators.render import render
from .operators.restore import restore
from .plans import api, planted
from .sources.config import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- Whole documents ------------------------------------------------------------------


@query("email_ip_counts")
def email_ip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: mail and network addresses and dates of all documents, by type."""
    rules = default_catalog()
    rows = table(spark, sf_dir, "documents").select("doc_id", N.squeeze(N.safe(clean(F.col("text")))).alias("norm"))
    rows = resolve.resolve(rows.withColumn("found", built(pattern_column, "norm", rules)), "found", "norm", "spans")
    one = rows.select("doc_id", F.explode("spans").alias("s"))
    return one.groupBy(F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"))


@query("detect_documents")
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full detection of all documents, one row a span: none is refused, whatever base64 it has."""
    return long_spans(detect(table(spark, sf_dir, "documents"), budget=False))


@query(
    "luhn_valid_runs",
    """
with r as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) as run from documents),
d as (select doc_id, run, list_transform(range(1, length(run) + 1), lambda i: cast(substr(run, length(run) + 1 - i, 1) as int)) as rev from r where length(run) >= 10)
select doc_id, run from d
where list_sum(list_transform(range(1, length(run) + 1), lambda i: case when i % 2 = 1 then rev[i] when rev[i] > 4 then 2 * rev[i] - 9 else 2 * rev[i] end)) % 10 = 0
""",
)
def luhn_valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0))).alias("run"))
    return rows.filter(F.char_length("run") >= 10).filter(checks.luhn(F.col("run")))


@query(
    "normalize_text",
    r"""
select doc_id, sha256(regexp_replace(regexp_replace(translate(translate(coalesce(text, ''), chr(160) || chr(8239) || chr(8201) || chr(8199) || chr(8288) || chr(9), '      '),
       chr(8212) || chr(8211) || chr(8208) || chr(8209) || chr(8210) || chr(8722), '------'), '[\x{AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), ' {2,}', ' ', 'g')) as norm_sha256 from documents
""",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(N.squeeze(N.safe(clean(F.col("text")))), 256).alias("norm_sha256"))


# --- Checksums, on numbers made from keys; about one of ten or eleven is right by chance ---

_STEM = "cast(o_orderkey * {salt} % 9{zeros} + 1{zeros} as varchar(20))"


def _number(digits: int, salt: int = 7919) -> str:
    return _STEM.format(salt=salt, zeros="0" * (digits - 1)).replace("o_orderkey", "cast(o_orderkey as bigint)")


def _weights(weights: list[int], start: int = 1, column: str = "number") -> str:
    return "(" + " + ".join(f"{w} * cast(substr({column}, {start + i}, 1) as int)" for i, w in enumerate(weights)) + ")"


_SUM = _weights([9, 8, 7, 6, 5, 4, 3, 2, 1])
_CHECKS = {
    "inn10_checksum": (10, lambda c: checks.inn10(c), f"{_weights([2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = cast(substr(number, 10, 1) as int)"),
    "inn12_checksum": (12, lambda c: checks.inn12(c), f"{_weights([7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = cast(substr(number, 11, 1) as int) and {_weights([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = cast(substr(number, 12, 1) as int)"),
    "snils_checksum": (11, lambda c: checks.snils(c), f"(case when {_SUM} < 100 then {_SUM} when {_SUM} <= 101 then 0 when {_SUM} % 101 = 100 then 0 else {_SUM} % 101 end) = cast(substr(number, 10, 2) as int)"),
    "bik_structure": (9, lambda c: checks.bik(F.concat(F.lit("04"), F.substring(c, 3, 7))), "cast(substr(number, 7, 3) as int) between 50 and 999"),
    "postal_prefix": (6, lambda c: checks.postal_prefix(c), "cast(substr(number, 1, 3) as int) between 101 and 499 or cast(substr(number, 1, 3) as int) between 600 and 699"),
}


def _check(digits: int, rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_number(digits)} as number")
    return rows.select("o_orderkey", "number", rule(F.col("number")).alias("valid"))


for _name, (_digits, _rule, _sql) in _CHECKS.items():
    query(_name, f"with n as (select o_orderkey, {_number(_digits)} as number from orders) select o_orderkey, number, ({_sql}) as valid from n")(partial(_check, _digits, _rule))


@query(
    "account_bik_checksum",
    f"""with n as (select o_orderkey, concat('40817810', {_number(12, 50021)}) as number, concat('044525', {_number(3, 31)}) as bik from orders),
w as (select *, concat(substr(bik, 7, 3), number) as whole from n)
select o_orderkey, number, bik, {_weights([7, 1, 3] * 7 + [7, 1], column="whole")} % 10 = 0 as valid from w""",
)
def account_bik_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('40817810', {_number(12, 50021)}) as number", f"concat('044525', {_number(3, 31)}) as bik")
    return rows.select("o_orderkey", "number", "bik", checks.account(F.col("number"), F.col("bik")).alias("valid"))


# --- Planted data: each type's rule must find what was planted, there, and nothing else ----


def _planted(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(planted.docs(spark, sf_dir, name), translit=False, english=False, base64=False)
    return long_spans(found).select("doc_id", "start", "end", "entity_type", "value")


for _name in planted.PLANTED:
    query(f"planted_{_name}", planted.gold_sql(_name))(partial(_planted, _name))


def _cases(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests between types, vetoes and further forms: one value a text, or none."""
    found = detect(planted.case_docs(spark, sf_dir, name), translit=False, english=False, base64=False)
    return long_spans(found).select("doc_id", "start", "end", "entity_type", "value")


for _name in planted.CASES:
    query(_name, planted.case_gold_sql(_name))(partial(_cases, _name))


def _rendered(name: str, mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(planted.docs(spark, sf_dir, name), translit=False, english=False, base64=False)
    return render(found, mode).select("doc_id", "rendered")


def _rendered_sql(name: str, put: str) -> str:
    before, _, after, _ = planted.PLANTED[name]
    return f"select {planted.KEY} as doc_id, concat('{before}', {put}, '{after}') as rendered from customer"


query("mask_text", _rendered_sql("card", "'****************'"))(partial(_rendered, "card", "mask"))
query("tag_text", _rendered_sql("email", "'[EMAIL_ADDRESS]'"))(partial(_rendered, "email", "tag"))

@query("base64_children", f"select {planted.KEY} as doc_id, 'PASSPORT' as entity_type, true as is_whole from customer")
def base64_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in base64: the whole blob is the span."""
    docs = planted.docs(spark, sf_dir, "passport").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("text"))
    found = detect(docs, translit=False, english=False).select("doc_id", "norm", F.explode("spans").alias("s"))
    whole = (F.col("s.start") == 0) & (F.col("s.end") == F.char_length("norm"))
    return found.select("doc_id", F.col("s.entity_type").alias("entity_type"), whole.alias("is_whole"))


@query("transliterated", f"select {planted.KEY} as doc_id, 'PASSPORT' as entity_type, concat('45', {planted.stem(8)}) as value from customer")
def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Russian in Latin letters: found in Cyrillic, placed in the source."""
    rows = planted.keys(spark, sf_dir).selectExpr(f"{planted.KEY} as doc_id", f"concat('moj pasport ', concat('45', {planted.stem(8)}), ' vydan v gorode') as text")
    return long_spans(detect(rows, english=False, base64=False)).select("doc_id", "entity_type", "value")


_DIGIT_WORDS = {"0": "ноль", "1": "один", "2": "два", "3": "три", "4": "четыре", "5": "пять", "6": "шесть", "7": "семь", "8": "восемь", "9": "девять"}


@query("spelled_digits", f"select {planted.KEY} as doc_id, concat('код ', {planted.stem(6)}, '.') as norm from customer")
def spelled_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in words become digits again."""
    words = F.create_map(*[F.lit(x) for kv in _DIGIT_WORDS.items() for x in kv])
    rows = table(spark, sf_dir, "customer").selectExpr(f"{planted.KEY} as doc_id", f"{planted.stem(6)} as n")
    spelled = F.array_join(F.transform(F.filter(F.split("n", ""), lambda d: d != ""), lambda d: words[d]), " ")
    return rows.select("doc_id", N.normalise(F.concat(F.lit("код "), spelled, F.lit("."))).alias("norm"))


# --- Span algebra over spans made from lineitem -----------------------------------------

_PRED = "select l_orderkey as row_id, case when l_linestatus = 'O' then 'OPEN' else 'DONE' end as label, cast(l_linenumber * 10 + l_partkey % 7 as int) as s, cast(l_linenumber * 10 + l_partkey % 7 + 3 + l_suppkey % 9 as int) as e, cast(l_quantity as double) as score from lineitem"
_GOLD = "select l_orderkey as row_id, case when l_returnflag = 'N' then 'OPEN' else 'DONE' end as label, cast(l_linenumber * 10 + l_suppkey % 5 as int) as s, cast(l_linenumber * 10 + l_suppkey % 5 + 4 + l_partkey % 6 as int) as e from lineitem where l_linenumber <> 3"


def _spans(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = spark.sql(sql.replace("from lineitem", "from {t}"), t=table(spark, sf_dir, "lineitem"))
    return rows.withColumnsRenamed({"s": "start", "e": "end"})


@query(
    "rules_over_model",
    f"""with m as ({_PRED}), r as ({_GOLD} and l_linenumber % 2 = 0)
select row_id as doc_id, label as entity_type, s as "start", e as "end" from r union all
select row_id, label, s, e from m where not exists (select 1 from r where r.row_id = m.row_id and m.s < r.e and r.s < m.e)""",
)
def rules_over_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda d: d.select(F.col("row_id").alias("doc_id"), F.col("label").alias("entity_type"), "start", "end")
    return resolve.rules_over_model(shape(_spans(spark, sf_dir, _PRED)), shape(_spans(spark, sf_dir, _GOLD + " and l_linenumber % 2 = 0")))


@query(
    "resolve_overlaps",
    f"""with recursive p as ({_PRED}), o as (select *, row_number() over (partition by row_id order by score desc, e - s desc, s, label, e) as k from p),
w as (select row_id, 0::bigint as k, [{{'s': 0::int, 'e': 0::int, 'label': ''}}] as kept from (select distinct row_id from o)
union all select w.row_id, o.k, case when len(list_filter(w.kept, lambda x: x.s < o.e and o.s < x.e)) > 0 then w.kept else list_append(w.kept, {{'s': o.s, 'e': o.e, 'label': o.label}}) end
from w join o on o.row_id = w.row_id and o.k = w.k + 1),
l as (select row_id, unnest(arg_max(kept, k)) as x from w group by row_id)
select row_id as doc_id, x.s as "start", x.e as "end", x.label as entity_type from l where x.label <> ''""",
)
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice by score, within each document's array."""
    rows = _spans(spark, sf_dir, _PRED).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("label").alias("entity_type"), "score", F.lit("rules").alias("branch")))).alias("spans")
    )
    # Of equals the first in the array stays, so the array is in the order of the last keys.
    order = F.array_sort("spans", lambda a, b: F.when(a["entity_type"] != b["entity_type"], F.when(a["entity_type"] < b["entity_type"], -1).otherwise(1)).otherwise(a["end"] - b["end"]))
    kept = rows.select("row_id", F.explode(best_first(order.cast(SPANS))).alias("s"))
    return kept.select(F.col("row_id").alias("doc_id"), "s.start", "s.end", "s.entity_type")


_MATCH = f"""with g as (select *, row_number() over (partition by row_id order by s, e, label) as g_ord from ({_GOLD})),
p as (select *, row_number() over (partition by row_id order by s, e, label) as p_ord from ({_PRED})),
m as (select g.row_id, g.g_ord, min(p.p_ord) as p_ord from g join p on g.row_id = p.row_id and g.label = p.label and g.s < p.e and p.s < g.e group by all),
gh as (select g.*, m.p_ord is not null as hit from g left join m using (row_id, g_ord)),
ph as (select p.*, exists (select 1 from m where m.row_id = p.row_id and m.p_ord = p.p_ord) as hit from p)"""
_METRICS = """, u as (select label, hit::int as tp, (not hit)::int as fn, 0 as fp from gh union all select label, 0, 0, (not hit)::int from ph),
t as (select label, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from u group by rollup (label)),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as c from t)
select label, tp, fp, fn, round(p, 6) as precision, round(c, 6) as recall, round(case when p + c > 0 then 2 * p * c / (p + c) else 0.0 end, 6) as f1, tp + fn as support from r"""


@query("gate_metrics", _MATCH + _METRICS)
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(*E.gate_match(_spans(spark, sf_dir, _GOLD), _spans(spark, sf_dir, _PRED)))


@query(
    "gate_errors",
    _MATCH
    + """ select 'FN' as error_type, row_id, label, s as "start", e as "end", '' as overlap_gold_labels from gh where not hit union all
select distinct 'FP', ph.row_id, ph.label, ph.s, ph.e, coalesce((select string_agg(distinct g.label, '|' order by g.label) from g where g.row_id = ph.row_id and ph.s < g.e and g.s < ph.e), '') from ph where not hit""",
)
def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.errors(*E.gate_match(_spans(spark, sf_dir, _GOLD), _spans(spark, sf_dir, _PRED)))


_VERDICTS = f"""{_MATCH}{_METRICS.rpartition("select label, tp")[0].rstrip()},
q as (select label, round(case when p + c > 0 then 2 * p * c / (p + c) else 0.0 end, 6) as f1 from r)
select 'micro_f1' as gate, (select f1 from q where label is null) >= 0.95 as passed union all
select 'category_floor', (select count(*) from q where label is not null and f1 < 0.85) = 0 union all
select 'coverage', (select count(*) from (values ('OPEN'), ('DONE'), ('ABSENT')) v(name) where name not in (select label from g)) = 0 union all
select 'error_rate', 0.0 <= 0.05 union all select 'regression', true"""


@query("gate_verdicts", _VERDICTS)
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds, preds = E.gate_match(_spans(spark, sf_dir, _GOLD), _spans(spark, sf_dir, _PRED))
    return E.gates(E.metrics(golds, preds), E.coverage(["OPEN", "DONE", "ABSENT"], golds))


_STRICT = f"""with g as (select *, row_number() over (partition by row_id, s, e, label order by 1) as nth from ({_GOLD})),
p as (select *, row_number() over (partition by row_id, s, e, label order by 1) as nth from ({_PRED})),
gh as (select g.*, p.row_id is not null as hit from g left join p using (row_id, s, e, label, nth)),
ph as (select p.*, g.row_id is not null as hit from p left join g using (row_id, s, e, label, nth))"""


@query("scorer_strict", _STRICT.replace("p.row_id is not null", "p.score is not null").replace("g.row_id is not null", "g.x is not null").replace(f"order by 1) as nth from ({_GOLD})", f"order by 1) as nth, 1 as x from ({_GOLD})") + _METRICS)
def scorer_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(*E.strict_match(_spans(spark, sf_dir, _GOLD), _spans(spark, sf_dir, _PRED)))


@query("scorer_soft")
def scorer_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.soft_scores(_spans(spark, sf_dir, _GOLD), _spans(spark, sf_dir, _PRED))


@query(
    "scorer_excluded",
    f"""with p as ({_PRED}), x as ({_GOLD} and l_linenumber = 1)
select row_id, label, s as "start", e as "end", score from p where not exists (select 1 from x where x.row_id = p.row_id and p.s < x.e and x.s < p.e)""",
)
def scorer_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drop_on_excluded(_spans(spark, sf_dir, _PRED), _spans(spark, sf_dir, _GOLD + " and l_linenumber = 1"))


_TAGS = "select l_orderkey as doc_id, l_linenumber as tok_ord, cast(l_linenumber * 10 as int) as s, cast(l_linenumber * 10 + 8 as int) as e, case min(l_returnflag) when 'N' then 'O' when 'A' then 'B-NAME' else 'I-PLACE' end as tag from lineitem group by l_orderkey, l_linenumber"


@query(
    "iob_merge",
    f"""with t as (select *, case when tag = 'O' then 'O' else substr(tag, 3) end as label from ({_TAGS})),
n as (select *, case when lag(label) over w = label then 0 else 1 end as new from t window w as (partition by doc_id order by tok_ord)),
i as (select *, sum(new) over (partition by doc_id order by tok_ord) as island from n)
select doc_id, min(s) as "start", max(e) as "end", case label when 'NAME' then 'PERSON' else 'LOCATION' end as entity_type, 0.7::double as score from i where label <> 'O' group by doc_id, island, label""",
)
def iob_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one label: gaps and islands."""
    return ner.merge_runs(_spans(spark, sf_dir, _TAGS), {"NAME": "PERSON", "PLACE": "LOCATION"})


_MENTIONS = "select l_orderkey as session, l_linenumber as text_ord, cast(l_partkey % 5 as int) as s, l_linestatus as entity_type, concat(l_returnflag, cast(l_suppkey % 4 as varchar(9))) as value from lineitem"


@query(
    "pseudonym_ids",
    f"""with m as ({_MENTIONS}), f as (select session, entity_type, value, min((text_ord, s)) as first from m group by all)
select session, entity_type, value, cast(row_number() over (partition by session, entity_type order by first, value) as int) as id from f""",
)
def pseudonym_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rank(_spans(spark, sf_dir, _MENTIONS))


@query("pseudonym_mapping", f"""with d as ({planted.docs_sql('email')}), v as (select doc_id % 7 as session, doc_id, {planted.PLANTED['email'][1].replace('c_custkey', 'doc_id')} as value from d)
select session, value, cast(row_number() over (partition by session order by doc_id) as int) as id, concat('<PII type="EMAIL_ADDRESS" id="', row_number() over (partition by session order by doc_id), '" />') as tag from v""")
def pseudonym_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of mail addresses, sessions of a seventh of the rows."""
    docs = planted.docs(spark, sf_dir, "email").withColumn("session", F.col("doc_id") % 7)
    found = checkpoint(api.with_sessions(detect(docs, translit=False, english=False, base64=False), docs))
    return P.mapping(P.assign(found)).select("session", "value", "id", "tag")


@query("restore_round_trip", f"select doc_id % 50 as session, doc_id, text as restored from ({planted.docs_sql('card')})")
def restore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders in, values out: the text that there was."""
    docs = planted.docs(spark, sf_dir, "card").withColumn("session", F.col("doc_id") % 50)
    found = checkpoint(api.with_sessions(detect(docs, translit=False, english=False, base64=False), docs))
    assigned = checkpoint(P.assign(found))
    texts = P.placed(found, assigned).select("session", "doc_id", F.col("rendered").alias("text"))
    return restore(texts, P.mapping(assigned)).select("session", "doc_id", "restored")


@query("scrub_unknown", f"select {planted.KEY} % 50 as session, {planted.KEY} as doc_id, concat('Hello **** and ', c_name) as restored from customer")
def scrub_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that no mapping knows become stars."""
    rows = table(spark, sf_dir, "customer").selectExpr(f"{planted.KEY} % 50 as session", f"{planted.KEY} as doc_id", """concat('Hello <pii ID="7" type="x"/> and ', c_name) as text""")
    return restore(rows, spark.createDataFrame([], "session long, tag string, value string")).select("session", "doc_id", "restored")


@query("conversation_placeholders")
def conversation_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with placeholders, ids shared by a conversation's turns."""
    rows = table(spark, sf_dir, "conversations").select(F.xxhash64("conv_id", "turn").alias("doc_id"), "text", F.col("conv_id").alias("session"), F.col("turn").alias("text_ord"))
    return api.anonymize(rows, "pseudonymize").select("session", "text_ord", "rendered")


@query("words_of_text", r"select doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: true)) as n_words from documents")
def words_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span extraction counted over whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(matches(clean(F.col("text")), "[A-Za-z]+")).cast("bigint").alias("n_words"))


@query("capabilities", "select '0.1.0' as version, 'auto' as device, 20 as n_configured, 'LOCATION,PERSON,PHONE_NUMBER,URL' as unavailable")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = api.capabilities(spark, Settings())
    return row.select("version", "device", F.size("configured").alias("n_configured"), F.array_join("unavailable", ",").alias("unavailable"))
