"""Checksums of document numbers, as Column expressions over strings of digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def is_digits(text: Column, n: int | None = None) -> Column:
    return text.rlike(rf"^[0-9]{{{n}}}\z" if n else r"^[0-9]+\z")


def digit(number: Column, place: int) -> Column:
    return F.ascii(F.substring(number, place, 1)) - 48


def luhn(number: Column) -> Column:
    """Luhn's check of ten digits or more."""
    return is_digits(number) & (F.char_length(number) >= 10) & F.call_function("luhn_check", number)


def _sum(number: Column, weights: list[int], start: int = 1) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(number, start + i) * w
    return total


# Weights of each number's check digits.
INN10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN12_FIRST, INN12_SECOND = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
SNILS = [9, 8, 7, 6, 5, 4, 3, 2, 1]
ACCOUNT = [7, 1, 3]


def inn10(number: Column) -> Column:
    return is_digits(number, 10) & (_sum(number, INN10) % 11 % 10 == digit(number, 10))


def inn12(number: Column) -> Column:
    first = _sum(number, INN12_FIRST) % 11 % 10 == digit(number, 11)
    return is_digits(number, 12) & first & (_sum(number, INN12_SECOND) % 11 % 10 == digit(number, 12))


def snils(number: Column) -> Column:
    s = _sum(number, SNILS)
    control = F.when(s < 100, s).when(s <= 101, 0).otherwise(F.when(s % 101 == 100, 0).otherwise(s % 101))
    return is_digits(number, 11) & (control == digit(number, 10) * 10 + digit(number, 11))


def account(number: Column, bik: Column) -> Column:
    prefix = F.when(number.startswith("301"), F.concat(F.lit("0"), F.substring(bik, 1, 2))).otherwise(F.substring(bik, 7, 3))
    whole = F.concat(prefix, number)
    return is_digits(number, 20) & is_digits(bik, 9) & (_sum(whole, [ACCOUNT[i % 3] for i in range(23)]) % 10 == 0)


def bik(number: Column) -> Column:
    return is_digits(number, 9) & number.startswith("04") & (F.substring(number, 7, 3).cast("int") >= 50)


def postal_prefix(number: Column) -> Column:
    p = F.substring(number, 1, 3).cast("int")
    return p.between(101, 499) | p.between(600, 699)
