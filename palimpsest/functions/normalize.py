"""Normalisation before detection: characters natively, number words by an Arrow UDF that
sees only texts with a number word, and the transliteration test natively."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from . import fixed as X
from .spanx import clean, matches, once, part


def safe(text: Column) -> Column:
    """Space-like characters and dashes, one for one: the length stays. Only texts with such a character are translated."""
    return F.when(text.rlike(X.MAYBE_UNSAFE), F.translate(text, X.SPACES + X.DASHES, " " * len(X.SPACES) + "-" * len(X.DASHES))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Soft hyphens and zero-width characters go; runs of spaces become one (not newlines)."""
    return F.regexp_replace(F.regexp_replace(text, X.REMOVED, ""), " {2,}", " ")


class NumberWords:
    """Runs of number words of one language, read as digits or as cardinals.

    A run is cut into words. Enough spoken digits in a row are a digit string; a lone digit
    word stays; anything else is read as one cardinal after another, each by descending
    magnitude, and stays as it is if some word fits nowhere."""

    def __init__(self, digits, teens, tens, hundreds, thousands, hundred="", joiner="", gap="", spoken_only=(), neighbours=None):
        self.digits, self.teens, self.tens, self.hundreds = digits, teens, tens, hundreds
        self.units = {w: v for w, v in digits.items() if w not in spoken_only}
        self.thousands, self.hundred, self.neighbours = frozenset(thousands), hundred, neighbours
        words = {*digits, *teens, *tens, *hundreds, *thousands, *([hundred] if hundred else [])}
        self.other = words - digits.keys()
        any_word = lambda names: "|".join(sorted(map(re.escape, names), key=len, reverse=True))
        run = lambda names: re.compile(rf"(?iu)\b(?:{any_word(names)})(?:(?:{gap}|\s+{joiner}\s+)(?:{any_word(names)}))*\b")
        self.word, self.digit_word = re.compile(f"(?iu){any_word(words)}"), re.compile(f"(?iu){any_word(digits)}")
        self.run, self.digit_run = run(words), run(digits)

    def _cardinals(self, words: list[str]) -> list[int] | None:
        out, at = [], 0
        while at < len(words):
            value, used = self._cardinal(words[at:])
            if not used:
                return None
            out.append(value)
            at += used
        return out

    def _cardinal(self, words: list[str]) -> tuple[int, int]:
        value = used = 0

        def take(table) -> bool:
            nonlocal value, used
            if used < len(words) and words[used] in table:
                value += table[words[used]]
                used += 1
                return True
            return False

        if self.hundred:  # English: a hundred multiplies, and so does a thousand
            if len(words) > 1 and words[0] in self.units and words[1] == self.hundred:
                value, used = 100 * self.units[words[0]], 2
            elif words[0] == self.hundred:
                value, used = 100, 1
            if not take(self.teens):
                if take(self.tens):
                    take({w: v for w, v in self.units.items() if v})
                else:
                    take(self.units)
            if used < len(words) and words[used] in self.thousands:
                value, used = 1000 * (value or 1), used + 1
            return value, used
        if words[0] in self.thousands:
            return 1000, 1
        if self.units.get(words[0]) == 1 and len(words) > 1 and words[1] in self.thousands:
            return 1000, 2
        take(self.hundreds)
        if not take(self.teens):
            if take(self.tens):
                take(self.units)
            else:
                take(self.units)
        # A hundred followed by a word that is no part of it, such as a thousand, fits nowhere.
        if used == 1 and words[0] in self.hundreds and len(words) > 1:
            return 0, 0
        return value, used

    def digits_spelled(self, text: str) -> str:
        """Four or more spoken digits become a string of digits, unless a cardinal is next to them."""

        def put(m: re.Match) -> str:
            words = [w.lower() for w in self.digit_word.findall(m[0])]
            if len(words) < 4:
                return m[0]
            left = re.search(self.neighbours[0], m.string[: m.start()])
            right = re.match(self.neighbours[1], m.string[m.end() :])
            if any(x and x[1].lower() in self.other for x in (left, right)):
                return m[0]
            return "".join(str(self.digits[w]) for w in words)

        return self.digit_run.sub(put, text)

    def numbers(self, text: str) -> str:
        def put(m: re.Match) -> str:
            words = [w.lower() for w in self.word.findall(m[0])]
            spoken = all(w in self.digits for w in words)
            if self.hundred and spoken and len(words) >= 4:
                return "".join(str(self.digits[w]) for w in words)
            if (spoken and (not self.hundred or len(words) == 1)) or not words:
                return m[0]
            values = self._cardinals(words)
            return " ".join(map(str, values)) if values else m[0]

        return self.run.sub(put, text)


RUSSIAN = NumberWords(
    X.RU_DIGITS, X.RU_TEENS, X.RU_TENS, X.RU_HUNDREDS, X.RU_THOUSANDS, joiner="и", gap=r"[\s,\.;:\-]+", neighbours=(r"(?iu)([а-яё]+)\W*$", r"(?iu)\W*([а-яё]+)")
)
ENGLISH = NumberWords(X.EN_DIGITS, X.EN_TEENS, X.EN_TENS, {}, ("thousand",), hundred="hundred", joiner="and", gap=r"[\s,\-]+", spoken_only=X.EN_SPOKEN_ONLY)
HAS_RUSSIAN = r"(?iuU)\b(?:" + "|".join([*X.RU_DIGITS, *X.RU_TEENS, *X.RU_TENS, *X.RU_HUNDREDS, *X.RU_THOUSANDS]) + r")\b"
_EN_WORDS = [*X.EN_DIGITS, *X.EN_TEENS, *X.EN_TENS, "hundred", "thousand"]
HAS_ENGLISH = rf"(?i)(?=[{''.join(sorted({w[0] for w in _EN_WORDS}))}])\b(?:{'|'.join(_EN_WORDS)})\b"  # a first letter is told sooner than a word's edge


def russian_numbers(text: str) -> str:
    return RUSSIAN.numbers(RUSSIAN.digits_spelled(text))


def english_numbers(text: str) -> str:
    return ENGLISH.numbers(text)


@F.pandas_udf(T.StringType())
def _spelled(texts: pd.Series, russian: pd.Series, english: pd.Series) -> pd.Series:
    """Russian numbers, then English ones, in one worker; texts with neither come as nulls."""
    read = lambda t, r, e: None if t is None else (english_numbers if e else str)((russian_numbers if r else str)(t))
    return pd.Series([read(*x) for x in zip(texts, russian, english)], dtype=object)


def numbers_in_words(text: Column, english: bool = True) -> Column:
    """Runs of Russian number words end at words' edges, so whether there are English ones is known before they are read.
    Texts without a Cyrillic letter have no Russian ones."""
    russian, english_ = text.rlike(X.MAYBE_CYRILLIC) & text.rlike(HAS_RUSSIAN), text.rlike(HAS_ENGLISH) if english else F.lit(False)
    return F.coalesce(_spelled(F.when(russian | english_, text), russian, english_), text)


def normalising(english: bool = True) -> list[Callable[[Column], Column]]:
    """The steps of ``normalise``; the second reads its text several times."""
    return [lambda t: squeeze(safe(clean(t))), lambda t: numbers_in_words(t, english)]


def normalise(text: Column, english: bool = True) -> Column:
    """Null: empty. Offsets of all results index this text."""
    for step in normalising(english):
        text = step(text)
    return text


def looks_like_translit(text: Column) -> Column:
    """Russian written in Latin letters: enough Latin words, more Latin than Cyrillic letters,
    a telling word or letter pair, and not plainly English."""
    few = F.when(text.rlike(X.MAYBE_STRUCTURAL), F.regexp_replace(text, X.STRUCTURAL, " ")).otherwise(text)
    count = lambda words, ws: F.size(F.filter(words, lambda w: w.isin(ws)))

    def counted(words: Column) -> Column:
        pairs = F.exists(words, lambda w: w.rlike("|".join(X.TRANSLIT_HINTS)))
        return F.struct(F.size(words).alias("n"), count(words, X.ENGLISH_STOPWORDS).alias("english"), count(words, X.TRANSLIT_STOPWORDS).alias("russian"), pairs.alias("pairs"))

    def judged(t: Column) -> Column:
        latin = F.char_length(F.regexp_replace(t, "[^A-Za-z]+", ""))
        cyrillic = F.char_length(F.regexp_replace(t, "[^а-яА-ЯёЁ]+", ""))
        words = F.transform(F.filter(F.regexp_extract_all(t, F.lit(X.LATIN_WORD), F.lit(0)), lambda w: F.char_length(w) <= X.TRANSLIT_WORD_MAX), F.lower)
        told = lambda c: (c["n"] >= 2) & ~((c["english"] >= 2) & (c["english"] > c["russian"])) & ((c["russian"] >= 1) | c["pairs"])
        return (latin > cyrillic) & once(once(words, counted), told)

    return once(few, judged)


_LATIN, _STRUCTURE = re.compile(X.LATIN_WORD), re.compile(X.STRUCTURAL.removeprefix("(?U)"))
_PAIR = re.compile("|".join(map(re.escape, X.TRANSLIT)), re.I)


@lru_cache(maxsize=1 << 15)
def _cyrillic_word(word: str) -> str:
    return _PAIR.sub(lambda m: (lambda c: c[:1].upper() + c[1:] if m[0][0].isupper() else c)(X.TRANSLIT[m[0].lower()]), word)


def cyrillic(text: str) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """Latin words in Cyrillic, and the pieces (to, to_end, from, from_end, as it was)."""
    fixed = [m.span() for m in _STRUCTURE.finditer(text)]
    out, pieces, size, at = [], [], 0, 0
    edges = [0, *(x for m in _LATIN.finditer(text) for x in m.span()), len(text)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if a == b:
            continue
        while at < len(fixed) and fixed[at][1] <= a:
            at += 1
        word = k % 2 == 1 and not (at < len(fixed) and fixed[at][0] < b)
        new = text[a:b] if not word else _cyrillic_word(text[a:b]) if b - a <= X.TRANSLIT_WORD_MAX else _cyrillic_word.__wrapped__(text[a:b])
        pieces.append((size, size + len(new), a, b, not word))
        out.append(new)
        size += len(new)
    return "".join(out), pieces


_PIECE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("to", "to_end", "at", "at_end")] + [T.StructField("as_is", T.BooleanType())])
CYRILLIC = T.StructType([T.StructField("text", T.StringType()), T.StructField("pieces", T.ArrayType(_PIECE))])


def cyrillic_column(texts: pa.Array) -> pa.StructArray:
    """``cyrillic`` of each text. Pieces go to one flat array of numbers: as objects those of a batch take a gigabyte."""
    out, ends, flat = [], [0], array("i")
    for t in texts:
        new, pieces = cyrillic(t.as_py()) if t.is_valid else (None, [])
        out.append(new)
        flat.extend(chain.from_iterable(pieces))
        ends.append(len(flat) // 5)
    numbers = np.frombuffer(flat, dtype=np.int32).reshape(-1, 5)
    columns = [pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(4)] + [pa.array(numbers[:, 4] != 0)]
    pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["to", "to_end", "at", "at_end", "as_is"]))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pieces], names=["text", "pieces"])


@F.arrow_udf(CYRILLIC)
def _cyrillic(texts: pa.Array) -> pa.Array:
    return cyrillic_column(texts)


def to_cyrillic(text: Column, needed: Column) -> Column:
    return _cyrillic(F.when(needed, text))


def source_span(pieces: Column, start: Column, end: Column) -> Column:
    """A span of the Cyrillic text in the source: whole words where they were converted."""
    holds = lambda at: F.get(F.filter(pieces, lambda p: (p["to"] <= at) & (at < p["to_end"])), F.lit(0))
    a, b, last = holds(start), holds(end - 1), F.get(pieces, F.size(pieces) - 1)
    lo = F.when(a["as_is"], a["at"] + start - a["to"]).otherwise(a["at"])
    hi = F.coalesce(F.when(b["as_is"], b["at"] + end - b["to"]).otherwise(b["at_end"]), last["at_end"])
    return F.when((end > start) & (hi > lo), F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end")))


def base64_blobs(text: Column) -> Column:
    """Tokens that decode to printable UTF-8: start, end, decoded."""
    tokens = F.filter(matches(text, X.BASE64), lambda m: (F.char_length(m["text"]) >= X.BASE64_LEAST) & (F.char_length(m["text"]) % 4 == 0))
    raw = F.transform(tokens, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_to_binary(m["text"], F.lit("base64")).alias("raw")))
    text_ = F.filter(raw, lambda m: m["raw"].isNotNull() & F.coalesce(F.is_valid_utf8(m["raw"].cast("string")), F.lit(False)))
    out = F.transform(text_, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["raw"].cast("string").alias("decoded")))
    shown = lambda x: F.char_length(F.regexp_replace(x, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \t\n]]", ""))
    return F.filter(out, lambda m: ~m["decoded"].rlike(r"(?U)^\s*\z") & (shown(m["decoded"]) >= X.BASE64_PRINTABLE * F.char_length(m["decoded"])))


def blank_out(text: Column, spans: Column) -> Column:
    """Spans become as many spaces."""
    return F.aggregate(spans, text, lambda acc, s: F.concat(part(acc, F.lit(0), s["start"]), F.repeat(F.lit(" "), s["end"] - s["start"]), F.substring(acc, s["end"] + 1, F.lit(2**30))))
