"""Checks of digit strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(digits: Column, i: int) -> Column:
    """Digit i (from 1) of a digit string."""
    return F.substring(digits, i, 1).try_cast("int")


def weighted(digits: Column, weights: list[int]) -> Column:
    """The sum of the first digits, each times its weight."""
    total = digit(digits, 1) * weights[0]
    for i, w in enumerate(weights[1:], 2):
        total = total + digit(digits, i) * w
    return total


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def card(digits: Column) -> Column:
    return digits.rlike("^[1-9][0-9]{12,18}$") & luhn(digits)


def business_number(digits: Column) -> Column:
    """Ten digits whose last makes the weighted sum a multiple of ten; the ninth also counts half of itself times ten."""
    total = weighted(digits, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(digit(digits, 9) * 5 / 10).cast("int")
    return digits.rlike("^[0-9]{10}$") & (F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)) == digit(digits, 10))


def resident_number(digits: Column, kinds: str) -> Column:
    """Thirteen digits, the seventh one of `kinds`, the first six a date of the century that the seventh names."""
    century = F.when(F.substring(digits, 7, 1).isin("1", "2", "5", "6"), "19").otherwise("20")
    return digits.rlike(f"^[0-9]{{6}}[{kinds}][0-9]{{6}}$") & F.try_to_date(F.concat(century, F.substring(digits, 1, 6)), "yyyyMMdd").isNotNull()


def phone(digits: Column) -> Column:
    """A national number of a known band, or its form with the country code 82."""
    own = F.when(digits.rlike("^82[0-9]{8,}$"), F.concat(F.lit("0"), F.substring(digits, 3, 40))).otherwise(digits)
    return own.rlike("^(?:010[2-9][0-9]{7}|01[16789][0-9]{7,8}|070[0-9]{8}|050[0-9]{8,9}|02[0-9]{7,8}|0(?:3[1-3]|4[1-4]|5[1-5]|6[1-4])[0-9]{7,8})$")


def clabe(digits: Column) -> Column:
    """Eighteen digits with weights 3, 7, 1, each product modulo ten, and a check digit."""
    total = sum((F.pmod(digit(digits, i + 1) * (3, 7, 1)[i % 3], F.lit(10)) for i in range(17)), F.lit(0))
    return digits.rlike("^[0-9]{18}$") & (F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)) == digit(digits, 18))


def routing_number(digits: Column) -> Column:
    return digits.rlike("^[0-9]{9}$") & (F.pmod(weighted(digits, [3, 7, 1, 3, 7, 1, 3, 7, 1]), F.lit(10)) == 0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def octets(value: Column) -> Column:
    """Whether a dotted quad has four numbers up to 255 without leading zeros."""
    return F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o))


def mailbox(value: Column) -> Column:
    """Whether the local part doesn't end in a dot, and the domain has at most 255 characters and no label that begins or ends with a hyphen."""
    domain = F.substring_index(value, "@", -1)
    return ~value.contains(".@") & (F.length(domain) <= 255) & ~domain.rlike(r"^-|-$|-\.|\.-")


def ipv6(value: Column) -> Column:
    """Whether a text is an address of eight groups of hexadecimal digits, one run of zero groups left out at most, the last two written as a dotted quad or not."""
    sides = F.split(value, "::", -1)
    groups = F.filter(F.flatten(F.transform(sides, lambda s: F.split(s, ":", -1))), lambda g: g != "")
    plain = F.forall(sides, lambda s: (s == "") | ~s.rlike("^:|:$|::"))
    last = F.try_element_at(groups, F.lit(-1))
    quad = F.when(F.size(groups) > 0, last.contains(".")).otherwise(False)
    heads = F.slice(groups, 1, F.size(groups) - quad.cast("int"))
    fine = F.forall(heads, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & (~quad | (last.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & octets(last) & ~value.endswith("::")))
    n = F.size(groups) + quad.cast("int")
    return plain & fine & F.when(F.size(sides) == 1, n == 8).when(F.size(sides) == 2, n <= 7).otherwise(False)
