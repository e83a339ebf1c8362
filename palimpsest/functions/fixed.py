"""Patterns, word lists and constants that results depend on.

Patterns are written once for Java's engine; ``(?iuU)`` makes case folding and classes
Unicode-aware. Nothing here is logic.
"""

I = "(?iuU)"  # noqa: E741
U = "(?U)"

# --- Fixed values: characters that normalisation replaces one for one.
SPACES = "\u00a0\u202f\u2009\u2007\u2060\t"
DASHES = "\u2014\u2013\u2010\u2011\u2012\u2212"
#: Characters among which all of them are.
MAYBE_UNSAFE = "[\\t\u00a0\u2007-\u2212]"
REMOVED = "[\u00ad\u200b\u200c\u200d\ufeff]"

# --- Fixed values: number words.
RU_DIGITS = {"ноль": 0, "нуль": 0, "один": 1, "одна": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9}
RU_TEENS = {"десять": 10, "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19}
RU_TENS = {"двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90}
RU_HUNDREDS = {"сто": 100, "двести": 200, "дваста": 200, "триста": 300, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700, "восемьсот": 800, "девятьсот": 900}
RU_THOUSANDS = ("тысяча", "тысячи", "тысяч")
EN_DIGITS = {"zero": 0, "oh": 0, "o": 0, "nought": 0, "naught": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
EN_SPOKEN_ONLY = ("oh", "o", "nought", "naught")
EN_TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
EN_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}

# --- Fixed values: transliteration, longest first.
TRANSLIT = {
    "shch": "щ", "sch": "щ", "tch": "ч", "iya": "ия", "iyu": "ию", "iye": "ие", "yo": "ё", "ya": "я", "yu": "ю", "ye": "е", "yi": "и", "iy": "ий", "zh": "ж", "kh": "х",
    "ch": "ч", "sh": "ш", "ts": "ц", "ju": "ю", "ja": "я", "jo": "ё", "je": "е", "a": "а", "b": "б", "v": "в", "w": "в", "g": "г", "d": "д", "e": "е", "z": "з", "i": "и",
    "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "f": "ф", "h": "х", "c": "к", "j": "й", "y": "ы", "x": "кс", "q": "к", "'": "ь", "`": "ь",
}
TRANSLIT_HINTS = "ya yu yo zh kh ts sch shch tsya iy ij ju ja".split()
TRANSLIT_STOPWORDS = "ya menya mne moj moya moyo moi tvoj vash nomer zovut iz goroda gorod ulitsa dom kvartira telefon pochta let goda god rozhdeniya prozhivayu zhivu adres familiya imya otchestvo pasport seriya eto privet zdravstvujte spasibo pozhalujsta dobryj den nas vas ego ee svoj etot etogo kotoryj".split()
ENGLISH_STOPWORDS = "the and is are was were have has had will would should could this that these those with from your you their there here what when where which who whom about into over under than then them they she him her his its our for not but all any can may such been being does did".split()
LATIN_WORD = r"[A-Za-z'`]+"
TRANSLIT_WORD_MAX = 20
MAYBE_STRUCTURAL = r"[@=+]|://|www\.|[A-Za-z0-9/]{21}"
#: With all that fold to Cyrillic letters.
MAYBE_CYRILLIC = "[\u0400-\u052f\u1c80-\u1c8f]"
STRUCTURAL = r"(?U)\S*[@=+]\S*|(?:https?://|www\.)\S+|[A-Za-z0-9/]{21,}"

# --- Fixed values: keyword patterns by family.
KEYWORDS = {
    "inn": I + r"\bинн\b|налогов\w{0,12}\s+номер\w{0,8}",
    "series": I + r"\bсер(?:ия)?\b",
    "certificate": I + r"\bудостоверен\w{0,12}\b",
    "passport": I + r"паспорт\w{0,8}|загранпаспорт\w{0,8}|паспортн\w{0,8}\s+данн\w{0,8}|документ\w{0,12}\s+гражданин\w{0,12}|удостоверяющ\w{0,12}\s+личност\w{0,12}|удостоверен\w{0,12}\s+личност\w{0,12}|документ\w{0,12}\s*,?\s*(?:являющ\w{0,12}\s+)?удостоверяющ\w{0,12}\s+личност\w{0,12}|идентификатор\w{0,12}\s+личност\w{0,12}",
    "licence": I + r"водит\w{0,12}|вод\.|удостоверен\w{0,12}|вождени\w{0,8}|\bправа\b|\bгибдд\w{0,8}\b|(?:замен\w{0,12}|выдач\w{0,12}|получени\w{0,12}|лишен\w{0,12})\s+прав\w{0,8}|\bс\s+прав\w{0,8}\b|номер\w{0,8}\s+прав\w{0,8}|прав\w{0,8}\s+на\s+управлен\w{0,12}|транспортн\w{0,12}\s+средств\w{0,12}|[Вв][/\.][Уу]|\b[Вв][Уу]\b|водительск\w{0,8}\s+прав\w{0,8}",
    "oms": I + r"полис\w{0,8}\s+омс|\bомс\b|медстраховк\w{0,8}|страхов\w{0,12}\s+полис\w{0,8}|свидетельств\w{0,12}\s+омс|полис\w{0,8}\s+медицинск\w{0,16}\s+страхован\w{0,16}|полис\w{0,8}\s+обязательн\w{0,16}\s+медицинск\w{0,16}\s+страхован\w{0,16}|полис\w{0,8}\s+медицинск\w{0,16}\s+обязательн\w{0,16}\s+страхован\w{0,16}|обязательн\w{0,16}\s+медицинск\w{0,16}\s+страхован\w{0,16}|медполис\w{0,8}|полис\w{0,8}\s+обязательн\w{0,16}\s+страхован\w{0,16}",
    "card": I + r"\bvisa\b|\bmastercard\b|\bмир\b|\bpan\b|\bcvv\b|\bбанковск\w{0,12}\s+карт\w{0,12}\b|\bкредитн\w{0,12}\s+карт\w{0,12}\b|\bдебетов\w{0,12}\s+карт\w{0,12}\b|\bномер\w{0,8}\s+карт\w{0,12}\b|\bcard\b",
    "card_weak": I + r"\bкарт\w{0,12}\b|\bномер\w{0,8}\s+карт\w{0,12}\b|\bлогин\w{0,8}\b|\bпарол\w{0,8}\b|\bкод\w{0,8}\b|\bсписан\w{0,8}\b|\bначислен\w{0,8}\b|\bтариф\w{0,8}\b|\bпин\w{0,8}\b|\bpin\b|\bsms[-\s]?код\w{0,8}\b|\bоплат\w{0,12}\b|\bплат[её]ж\w{0,12}\b|\bперевод\w{0,12}\b|\bпредавторизац\w{0,12}\b|\bсписыва\w{0,12}\b|\bарендн\w{0,12}\s+плат\w{0,12}\b",
    "military": I + r"военн\w{0,12}\s+билет\w{0,8}|военн\w{0,12}\s+документ\w{0,8}|билет\w{0,8}\s+военн\w{0,12}|военник\w{0,8}|воинск\w{0,8}\s+документ\w{0,8}|документ\w{0,8}\s+воинск\w{0,8}\s+уч[её]т\w{0,8}|призывн\w{0,8}\s+удостоверен\w{0,12}|солдатск\w{0,8}\s+книжк\w{0,8}|воинск\w{0,8}\s+книжк\w{0,8}|удостоверен\w{0,12}\s+военнообязан\w{0,12}|воинск\w{0,8}\s+билет\w{0,8}|удостоверен\w{0,12}\s+военнослужащ\w{0,12}|военн(?:о|-|\s)?учетн\w{0,8}\s+документ\w{0,8}",
    "birth": I + r"свидетел\w{0,20}\s+о\s+рожд\w{0,12}|св[-\s]*во\s+о\s+рожд\w{0,12}|удостоверен\w{0,20}\s+о\s+рожд\w{0,12}|метрик\w{0,8}|загс\w{0,8}|запис\w{0,12}\s+акт\w{0,8}\s+о\s+рожд\w{0,12}",
    "account": I + r"расч[ёе]тн\w{0,6}\s+сч[ёе]т\w{0,6}|\bсч[ёе]т\w{0,6}|\bсч\.|\bр/?сч?\b|\bк/?сч?\b|корсч\w{0,6}|реквизит\w{0,6}|перечисл\w{0,8}|плат[ёе]жн\w{0,6}\s+поручени\w{0,6}",
    "bik": I + r"\bбик\w{0,3}|\bbic\b",
    "postal": I + r"\bиндекс\w{0,6}|\bинде?к\b|почтов\w{0,6}|\bпочт\w{0,5}|\bадрес\w{0,6}|\bг\.|\bгород\w{0,6}|\bул\.|\bд\.|\bкрай\b|\bобл\w{0,6}|росси\w{0,3}|проспект|шоссе",
    "postal_veto": I + r"биржев\w{0,6}",
    "postal_rival": I + r"паспорт\w{0,6}|\bсери\w{0,3}\b|заказ\w{0,6}|обращени\w{0,6}|водительск\w{0,3}|удостоверени\w{0,2}|\bву\b",
    "other_network": I + r"\bинст(?:а|е|у|ы|ой)\b|\bинстаг\b|\bинстаграм\w{0,4}|\binsta\b|\binstagram\w{0,3}",
    "mail": I + r"\bпочт\w{0,6}|\b(?:пиши|напиши)\s+на\b|\b(?:email|e-mail|mail)\b",
}
BIK_VALUE = I + r"\b(?:бик|bic)\D{0,6}((?:\d[ \t]?){8}\d)\b"

# --- Fixed values: shapes of documents' series and numbers.
LATIN_UNIT = r"(?:SHCH|ZH|KH|TS|CH|SH|YU|YA|YE|YO|JO|IO|EH|[A-Z])"
MILITARY_SERIES = rf"(?:[А-ЯЁ]{{2}}|(?:{LATIN_UNIT}){{2}})"
MILITARY_NUMBERED = I + rf"\b(?:сер(?:ия)?\s*)?(?:{MILITARY_SERIES})[\s,;:\.\-]*(?:номер|№|N)\s*(?:\d[ \t\n/._\\-]?){{6}}\d\b"
MILITARY_PLAIN = I + rf"\b(?:№\s*)?(?:{MILITARY_SERIES})\s*(?:[-\u2013\u2014]\s*)?(?:№|N)?\s*(?:\d[ \t\n/._\\-]?){{6}}\d\b"
MILITARY_STRICT = I + rf"^(?:№\s*)?({MILITARY_SERIES})\s*(?:-| )\s*(?:№\s*)?(\d{{7}})\z"
MILITARY_UNCLEAR = ("РФ", "RF", "ИИ", "II")
BIRTH_SERIES = rf"[IVXLCDM]{{1,4}}\s*[-\u2013\u2014]?\s*(?:[А-ЯЁ]{{2}}|[A-ZА-ЯЁ]{{2,6}}|(?:{LATIN_UNIT})(?:[\s\-]?(?:{LATIN_UNIT})){{1,5}})"
BIRTH_NUMBER = r"(?:\d[ \t\n/._\\-]?){5}\d"
BIRTH = I + rf"(?<!\.)\b(?:№\s*)?(?:{BIRTH_SERIES})[\s,;:\.\-]*(?:(?:номер|№|N)\s*)?(?:{BIRTH_NUMBER})\b"
BIRTH_STRICT = I + rf"^(?:№\s*)?(?:{BIRTH_SERIES})[\s,;:\.\-]*(?:(?:номер|№|N)\s*)?(?:{BIRTH_NUMBER})\z"
SERIES_AND_NUMBER = I + r"\bсер(?:ия)?\s*(?:№\s*)?(?:\d(?:[ \t\n/._\\-]?\d){1,7})[\s,;:\.\-]*(?:номер|№|N)\s*(?:\d[ \t\n/._\\-]?){5,15}\d\b"
SIGN_AND_NUMBER = I + r"№\s*(?:\d(?:[ \t/_\\-]{0,3}\d){9,18})(?![ \t/_\\-]*\d)"
LONG_NUMBER = U + r"(?<![\d-])(?<!\d )(?:\d(?:[ \t/_\\-]{0,3}\d){9,18})(?![ \t/_\\-]*\d)"

#: Candidate patterns in the order that they are tried.
CANDIDATES = [
    BIRTH,
    MILITARY_NUMBERED,
    MILITARY_PLAIN,
    U + r"(?<![\w@.])@[A-Za-z][A-Za-z0-9_]{4,31}\b",
    U + r"(?<!\d)\d{10}(?!\d)",
    U + r"(?<!\d)\d{12}(?!\d)",
    U + r"(?<![\d-])\d(?:[ \t/_\\-]{0,3}\d){19}(?![ \t/_\\-]*\d)",
    U + r"(?<![\d-])\d(?:[ \t/_\\-]{0,3}\d){8}(?![ \t/_\\-]*\d)",
    U + r"(?<![\d/_\\-])(?<!\d[ \t])\d(?:[ \t/_\\-]{0,3}\d){5}(?![ \t/_\\-]*\d)",
    SERIES_AND_NUMBER,
    SIGN_AND_NUMBER,
    LONG_NUMBER,
]
#: Entity types of number rules, in priority order; of equal scores the later type wins.
PRIORITY = ["BIRTH_CERTIFICATE", "MILITARY_ID", "SNILS", "TELEGRAM", "INN", "BANK_ACCOUNT", "BIK", "CREDIT_CARD", "OMS", "PASSPORT", "POSTAL_CODE", "DRIVER_LICENSE"]
OVER_PHONE = ["BIRTH_CERTIFICATE", "MILITARY_ID", "SNILS", "INN", "BIK", "CREDIT_CARD", "OMS", "PASSPORT", "DRIVER_LICENSE"]
PAIRWISE = [("IP_PORT", "DATE_TIME"), ("IP_ADDRESS", "DATE_TIME"), ("URL", "DATE_TIME"), ("URL", "IP_ADDRESS"), ("IP_ADDRESS", "PHONE_NUMBER"), ("IP_PORT", "IP_ADDRESS"), ("EMAIL_ADDRESS", "URL")]
MODEL_ONLY = ["PERSON", "LOCATION", "PHONE_NUMBER", "URL"]

# --- Fixed values: dates, addresses of mail and networks: (type, score, pattern).
_MONTH = r"(?:январ[ья]|феврал[ья]|март[а]?|апрел[ья]|ма[йя]|июн[ья]|июл[ья]|август[а]?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья])"
_MONTH_BARE = r"(?:январ[ья]?|феврал[ья]?|март[а]?|апрел[ья]?|ма[йя]|июн[ья]?|июл[ья]?|август[а]?|сентябр[ья]?|октябр[ья]?|ноябр[ья]?|декабр[ья]?)"
_DAY, _MON = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IPV4_PREFIX = rf"(?U)\b(?:{_OCTET}\.){{3}}{_OCTET}(?!\d)"
_H = r"[0-9a-fA-F]{1,4}"
REGEX_RULES = [
    ("DATE_TIME", 0.85, I + rf"(?<!\d)(?:([1-9]|0[1-9]|[12][0-9]|3[01])\s+{_MONTH}(?:(?:\s+\d{{4}})(?:(?:\s+(?:года|году|год))(?!\w)|(?!\d))|(?:\s+(?:года|году|год))(?!\w)|(?!\d)))"),
    ("DATE_TIME", 0.85, I + rf"(?<!\d){_DAY}\s+(?:янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек)\b\.?(?:(?:\s+\d{{4}})(?!\d)|(?!\d))"),
    ("DATE_TIME", 0.85, I + rf"(?<!\d){_DAY}-(?:го|е|ой|ему|ем)\s+{_MONTH}(?:(?:\s+\d{{4}})(?!\d)|(?!\d))"),
    ("DATE_TIME", 0.80, I + rf"(?<!\d){_DAY}[ \t]*\.[ \t]*{_MON}[ \t]*\.[ \t]*(?:19|20)\d{{2}}(?!\d)(?!(?:[ \t]*[-–—][ \t]*\d{{1,2}}(?![ \t]*[.\d]|$)))"),
    ("DATE_TIME", 0.80, I + rf"(?<!\d){_DAY}[ \t]*[-–—][ \t]*{_MON}[ \t]*[-–—][ \t]*(?:19|20)\d{{2}}(?!\d)"),
    ("DATE_TIME", 0.75, I + r"(?<!\d)(?:[0-1]?[0-9]|2[0-3])[ \t]*:[ \t]*[0-5][0-9](?:[ \t]*:[ \t]*[0-5][0-9])?(?!\d)"),
    ("DATE_TIME", 0.80, I + rf"(?<!\d){_MON}/(?:\d{{2}}|\d{{4}})(?!\d)"),
    ("DATE_TIME", 0.80, I + rf"(?<!\d){_DAY}[ \t]*/[ \t]*{_MON}[ \t]*/[ \t]*(?:\d{{2}}|\d{{4}})(?!\d)"),
    ("DATE_TIME", 0.85, I + r"(?<!\d)\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?)?(?!\d)"),
    ("DATE_TIME", 0.85, I + rf"(?<!\d)(?:19\d{{2}}|20\d{{2}}|2100)(?:[./]|[ \t]*[-–—][ \t]*){_MON}(?:[./]|[ \t]*[-–—][ \t]*){_DAY}(?!\d)(?![./]\d)"),
    ("DATE_TIME", 0.80, I + r"(?<!\d)\d{4}\s+года(?!\d)"),
    ("DATE_TIME", 0.75, I + r"(?<!\d)\d{1,2}\s+час(?:ов|а|у|ами|ам)?\b(?!\d)"),
    ("DATE_TIME", 0.80, I + rf"(?<!\d){_MONTH_BARE}\s+\d{{4}}(?!\d)"),
    ("DATE_TIME", 0.85, I + rf"(?<!\d)\d{{4}},\s+{_DAY}\s+{_MONTH}(?!\d)"),
    ("DATE_TIME", 0.85, I + r"(?<!\d)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}(?!\d)"),
    ("EMAIL_ADDRESS", 0.85, I + r"(?<![\w@.])[A-Za-z0-9_%+]+(?:\s*[.\-]\s*[A-Za-z0-9_%+]+)*\s*@\s*[A-Za-z0-9]+(?:\s*[.\-]\s*[A-Za-z0-9]+)*\s*\.\s*[A-Za-z]{2,}"),
    ("IP_ADDRESS", 0.85, I + IPV4),
    ("IP_ADDRESS", 0.90, I + rf"\b(?:{_H}:){{7}}{_H}(?:%[a-zA-Z0-9]+)?\b"),
    ("IP_ADDRESS", 0.85, I + rf"\b(?:{_H}:){{5,6}}{_H}(?:%[a-zA-Z0-9]+)?\b"),
    ("IP_ADDRESS", 0.90, I + rf"(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f:]*\d)(?:(?:{_H}:){{0,6}}{_H}::(?:{_H}:){{0,6}}{_H}|::(?:{_H}:){{0,7}}{_H}|(?:{_H}:){{0,6}}{_H}::)(?:%[a-zA-Z0-9]+)?(?![0-9A-Fa-f:])"),
    ("IP_PORT", 0.60, I + rf"(?<!\w)(?:{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}|\[[0-9a-fA-F:\.]+\]):\d{{1,5}}\b"),
]
NORMATIVE_DATE = r"(?iuU)^\d{1,2}[ \t]*\.[ \t]*\d{1,2}[ \t]*\.[ \t]*\d{4}\z"
NORMATIVE_SUFFIX = r"(?U)^[ \t]*[-–—][ \t]*\d{2,4}(?![.\d])"
NORMATIVE_PREFIX = I + r"(?:^|[\s(,;:№])(?:сп|снип|санпин|гост(?:\s*р)?|ту|тр\s*тс)\s*\z"
SERVICE_WORD = I + r"^(?:сер(?:и[ияей])?|номер\w*|ном|№|N|No)\.?\z"
BASE64 = r"[A-Za-z0-9+/]{12,}={0,2}"
BASE64_BLOBS, BASE64_CHARS, BASE64_LEAST, BASE64_PRINTABLE = 32, 20_000, 16, 0.8

# --- Fixed values: defaults of the settings.
DEFAULTS = {
    "language": "ru", "parser": "ru_core_news_sm", "model_name": "", "model_revision": None, "ner_disabled": False, "device": None, "ner_max_length": 512, "ner_stride": 128, "ner_score": 0.70,
    "mask_char": "*", "mask_count": 1_000_000_000, "mask_from_end": False, "translit": True, "english_numbers": True, "base64": True, "foreign_threshold": 0.90, "max_text_chars": 100_000, "max_texts": 64,
}
ENTITIES = ["BANK_ACCOUNT", "BIK", "BIRTH_CERTIFICATE", "CREDIT_CARD", "DATE_TIME", "DRIVER_LICENSE", "EMAIL_ADDRESS", "INN", "IP_ADDRESS", "IP_PORT", "LOCATION", "MILITARY_ID", "OMS", "PASSPORT", "PERSON", "PHONE_NUMBER", "POSTAL_CODE", "SNILS", "TELEGRAM", "URL"]
ADDRESS_LINK = r"(?iuU)^[\s,.;«»\"'()-]*(?:(?:ул|улица|улице|пр|просп|проспект|пер|переулок|наб|бул|б-р|ш|шоссе|пл|площадь|проезд|д|дом|кв|квартира|корп|корпус|стр|строение|обл|область|г|город|р-н|район|подъезд|под|этаж|офис|оф|индекс)\.?\s*)*[\s,.;«»\"'()-]*\z"
MERGE_FAMILIES, MERGE_GAP = ("ADDRESS", "PERSON"), 12
NAME_PARTS = 3
FUZZY = {"PERSON": 85.0, "LOCATION": 90.0}
MAPPING_ENTRIES, MAPPING_CHARS = 4096, 4096
