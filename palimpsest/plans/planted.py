"""Texts with planted personal data, made from keys by SQL that Spark and DuckDB both run.

Each row of ``customer`` gives a number with its check digits and a carrier phrase of known
length, so the oracle states what was planted and where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "cast(c_custkey as bigint)"


def stem(digits: int, salt: int = 7919) -> str:
    low = 10 ** (digits - 1)
    return f"cast(({KEY} * {salt} + 12345) % {9 * low} + {low} as varchar(20))"


def _digit(number: str, i: int) -> str:
    return f"cast(substr({number}, {i}, 1) as int)"


def _weighted(number: str, weights: list[int], start: int = 1) -> str:
    return "(" + " + ".join(f"{w} * {_digit(number, start + i)}" for i, w in enumerate(weights)) + ")"


def inn10() -> str:
    s = stem(9)
    return f"concat({s}, cast({_weighted(s, [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 as varchar(20)))"


def inn12() -> str:
    s = stem(10, 104729)
    one = f"concat({s}, cast({_weighted(s, [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 as varchar(20)))"
    return f"concat({one}, cast({_weighted(one, [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 as varchar(20)))"


def snils() -> str:
    s = stem(9, 31337)
    t = _weighted(s, [9, 8, 7, 6, 5, 4, 3, 2, 1])
    return f"concat({s}, lpad(cast(case when {t} < 100 then {t} when {t} <= 101 then 0 when {t} % 101 = 100 then 0 else {t} % 101 end as varchar(20)), 2, '0'))"


def luhn16() -> str:
    s = f"concat('4', {stem(14, 65537)})"
    doubled = " + ".join(f"case when {_digit(s, i)} > 4 then 2 * {_digit(s, i)} - 9 else 2 * {_digit(s, i)} end" for i in range(1, 16, 2))
    plain = " + ".join(_digit(s, i) for i in range(2, 16, 2))
    return f"concat({s}, cast((10 - ({doubled} + {plain}) % 10) % 10 as varchar(20)))"


def account() -> str:
    """An account at the bank 044525225, with its key digit at the ninth place."""
    tail = stem(11, 50021)
    fixed = sum(int(d) * w for d, w in zip("225", [7, 1, 3]))
    weights = [[7, 1, 3][(i + 3) % 3] for i in range(20)]
    body = f"concat('408178100', {tail})"
    total = f"({fixed} + {_weighted(body, weights)})"
    # The key digit has weight 3 at place 9: a digit d with 3d = -total mod 10 is -7 * total mod 10.
    return f"concat('40817810', cast((1000 - {total}) % 10 * 7 % 10 as varchar(20)), {tail})"


#: name: (before, value, after, entity type)
PLANTED: dict[str, tuple[str, str, str, str]] = {
    "inn_10": ("Организация, ИНН ", inn10(), " в реестре", "INN"),
    "inn_12": ("ИНН предпринимателя ", inn12(), " указан", "INN"),
    "snils": ("СНИЛС сотрудника ", snils(), " внесён", "SNILS"),
    "card": ("Оплата с карты visa ", luhn16(), " прошла", "CREDIT_CARD"),
    "oms": ("полис ОМС ", luhn16(), " действует", "OMS"),
    "passport": ("паспорт ", f"concat('45', {stem(8)})", " выдан", "PASSPORT"),
    "licence": ("водительские права ", f"concat('99', {stem(8)})", " получены", "DRIVER_LICENSE"),
    "account": ("расчётный счёт ", account(), " открыт", "BANK_ACCOUNT"),
    "bik": ("реквизит: БИК ", f"concat('044525', cast(({KEY} * 31) % 900 + 100 as varchar(20)))", " банка", "BIK"),
    "postal": ("почтовый индекс ", f"concat('1', cast(({KEY} * 77) % 90000 + 10000 as varchar(20)))", ", Москва", "POSTAL_CODE"),
    "telegram": ("мой телеграм ", f"concat('@user_', {stem(6)})", " пишите", "TELEGRAM"),
    "military": ("военный билет ", f"concat('АБ ', {stem(7)})", " выдан", "MILITARY_ID"),
    "birth": ("свидетельство о рождении ", f"concat('II-МЮ № ', {stem(6)})", " выдано", "BIRTH_CERTIFICATE"),
    "date": ("дата ", f"concat(lpad(cast({KEY} % 28 + 1 as varchar(20)), 2, '0'), '.', lpad(cast({KEY} % 12 + 1 as varchar(20)), 2, '0'), '.', cast(1950 + {KEY} % 70 as varchar(20)))", " назначена", "DATE_TIME"),
    "ip": ("сервер ", f"concat('10.', cast({KEY} % 256 as varchar(20)), '.', cast({KEY} * 3 % 256 as varchar(20)), '.', cast({KEY} * 7 % 256 as varchar(20)))", " отвечает", "IP_ADDRESS"),
    "ip_port": ("узел ", f"concat('10.', cast({KEY} % 256 as varchar(20)), '.', cast({KEY} * 3 % 256 as varchar(20)), '.7:', cast({KEY} % 60000 + 1000 as varchar(20)))", " открыт", "IP_PORT"),
    "email": ("пишите на ", f"concat('user', {stem(6)}, '@mail.example')", " сегодня", "EMAIL_ADDRESS"),
}


def docs_sql(name: str) -> str:
    before, value, after, _ = PLANTED[name]
    return f"select {KEY} as doc_id, concat('{before}', {value}, '{after}') as text from customer"


def gold_sql(name: str) -> str:
    """What detection must find: the planted value and its place (service words are none)."""
    before, value, _, kind = PLANTED[name]
    at = len(before)
    if name == "birth":  # series and number are two values
        return (
            f'select {KEY} as doc_id, cast({at} as int) as "start", cast({at + 5} as int) as "end", \'{kind}\' as entity_type, \'II-МЮ\' as value from customer union all '
            f'select {KEY}, cast({at + 8} as int), cast({at + 14} as int), \'{kind}\', {stem(6)} from customer'
        )
    return f'select {KEY} as doc_id, cast({at} as int) as "start", cast({at} + length({value}) as int) as "end", \'{kind}\' as entity_type, {value} as value from customer'


#: Tasks for each split of a file of keys.
SPREAD = 16


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of ``customer``, dealt to more tasks than the file has splits: a key takes a few bytes, detection in its text
    takes most of a millisecond, so a split that is small to read is long to work on."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return rows.repartition(SPREAD * max(rows.rdd.getNumPartitions(), 1))


def docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    before, value, after, _ = PLANTED[name]
    rows = keys(spark, sf_dir)
    return rows.selectExpr(f"{KEY} as doc_id", f"concat('{before}', {value}, '{after}') as text")


# --- Contests, vetoes and forms: each row of customer is one of a table's cases, by its key ----

_DAY, _YEAR = f"cast({KEY} % 19 + 10 as varchar(20))", f"cast(1950 + {KEY} % 70 as varchar(20))"
_MONTH = f"lpad(cast({KEY} % 12 + 1 as varchar(20)), 2, '0')"
_TEN = f"concat('45', substr({stem(8)}, 1, 2), ' ', substr({stem(8)}, 3, 6))"


def _glued(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _digits(first: str, digits: int) -> str:
    return f"concat('{first}', substr({stem(8, 40009)}, 2, {digits}))"


#: name: cases of (before, value, after, entity type or None where nothing may be found)
CASES: dict[str, list[tuple[str, str, str, str | None]]] = {
    "document_contests": [
        ("Права водителя не нужны, нужен паспорт ", _TEN, "", "PASSPORT"),
        ("Сдан паспорт, взамен водительские права ", _TEN, "", "DRIVER_LICENSE"),
        ("Списано с банковской карты ", luhn16(), "", "CREDIT_CARD"),
        ("Предъявлен полис ОМС ", luhn16(), "", "OMS"),
        ("Банковская карта потеряна, номер полиса ОМС ", luhn16(), "", "OMS"),
        ("", _glued("'АБ '", stem(7)), "", "MILITARY_ID"),
        ("", _glued("'РФ '", stem(7)), "", None),
        ("Военный билет ", _glued("'РФ '", stem(7)), "", "MILITARY_ID"),
    ],
    "number_vetoes": [
        ("почтовый адрес: ", _digits("9", 5), "", None),
        ("почтовый адрес: ", _digits("5", 5), "", None),
        ("почтовый индекс ", _digits("6", 5), "", "POSTAL_CODE"),
        ("номер заказа ", _digits("1", 5), "", None),
        ("контрольное число ", _digits("1", 5), " в логах", None),
        ("", _digits("63", 4), ", г. Новосибирск, ул. Садовая", "POSTAL_CODE"),
        ("Биржевой индекс за день вырос на ", _digits("27", 4), " пунктов", None),
        ("БИК ", _digits("12", 7), "", "BIK"),
        ("номер обращения ", _digits("044525", 3), " в системе", None),
        ("мой инстаграм ", _glued("'@user_'", stem(6)), "", None),
        ("мой ник в телеграме ", _glued("'user_'", stem(6)), "", None),
        ("мой канал ", _glued("'t.me/user_'", stem(6)), "", None),
    ],
    "date_forms": [
        ("Встреча ", _glued(_DAY, "' мая '", _YEAR), " в офисе", "DATE_TIME"),
        ("Дата ", _glued(_DAY, "'/'", _MONTH, "'/'", _YEAR), "", "DATE_TIME"),
        ("Дата ", _glued(_YEAR, "'/'", _MONTH, "'/'", _DAY), "", "DATE_TIME"),
        ("Время ", _glued(_DAY.replace("% 19 + 10", "% 14 + 10"), "':00'"), "", "DATE_TIME"),
        ("Займёт ", _glued(_DAY, "' часов'"), "", "DATE_TIME"),
        ("Срок ", _glued(_MONTH, "'/'", _YEAR), "", "DATE_TIME"),
        ("Запись ", _glued(_YEAR, "'-'", _MONTH, "'-'", _DAY, "'T10:30:00Z'"), "", "DATE_TIME"),
        ("Дата ", _glued(_DAY, "' янв. '", _YEAR), "", "DATE_TIME"),
        ("Дата ", _glued(_DAY, "'-го января '", _YEAR), "", "DATE_TIME"),
        ("Период ", _glued("'январь '", _YEAR), "", "DATE_TIME"),
        ("Дата ", _glued(_YEAR, "', '", _DAY, "' мая'"), "", "DATE_TIME"),
        ("English ", _glued("'January '", _DAY, "'th, '", _YEAR), "", "DATE_TIME"),
        ("СП ", _glued("'2.1.3678-'", _DAY), "", None),
        ("п. ", _glued("'3.'", _DAY), " договора", None),
        ("версия ", _glued("'1.2.'", f"cast({KEY} % 9 as varchar(20))"), "", None),
    ],
    "address_forms": [
        ("узел ", _glued("'2001:0db8:85a3:0000:0000:8a2e:0370:'", stem(4)), " в сети", "IP_ADDRESS"),
        ("узел ", _glued("'2001:db8::'", stem(3)), " в сети", "IP_ADDRESS"),
        ("узел ", _glued("'192.168.'", f"cast({KEY} % 256 as varchar(20))", "'.7'"), " в сети", "IP_ADDRESS"),
        ("пишите на ", _glued("'a.'", stem(5), "'+x@sub.mail.example'"), " сегодня", "EMAIL_ADDRESS"),
    ],
}


def _by_case(name: str, column: str) -> str:
    whens = "".join(f" when {i} then {f if isinstance(f, str) else 'null'}" for i, f in enumerate(_case_values(name, column)))
    return f"case {KEY} % {len(CASES[name])}{whens} end"


def _case_values(name: str, column: str):
    for before, value, after, kind in CASES[name]:
        yield {"text": f"concat('{before}', {value}, '{after}')", "value": value, "at": f"{len(before)}", "kind": kind and f"'{kind}'"}[column]


def case_gold_sql(name: str) -> str:
    """What must be found in a table of cases: its one value, or nothing."""
    inner = f"select {KEY} as doc_id, cast({_by_case(name, 'at')} as int) as place, {_by_case(name, 'value')} as value, {_by_case(name, 'kind')} as entity_type from customer"
    return f'select doc_id, place as "start", cast(place + length(value) as int) as "end", entity_type, value from ({inner}) t where entity_type is not null'


def case_docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return rows.selectExpr(f"{KEY} as doc_id", f"{_by_case(name, 'text')} as text")
