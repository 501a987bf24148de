"""Checks of digit strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    """All digits of any script, in order."""
    return F.regexp_replace(value, r"(?U)\D", "")


def luhn(value: Column) -> Column:
    """Whether a string of ASCII digits has a right check digit; false for an empty one."""

    def weighed(d: Column, k: Column) -> Column:
        n = F.try_to_number(d, F.lit("9")).cast("int") * (1 + k % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(F.split(F.reverse(value), ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.when(value.rlike("^[0-9]+$"), total % 10 == 0).otherwise(False)


def octets(value: Column) -> Column:
    """Whether dotted numbers are all from 0 to 255 and without leading zeros."""
    return F.forall(F.split(value, r"\."), lambda p: ((p == "0") | ~F.startswith(p, F.lit("0"))) & (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))


def seed(value: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of a text, as a number."""
    return F.conv(F.substring(F.sha2(value.cast("binary"), 256), 1, 12), 16, 10).cast("bigint")


def signature(value: Column) -> Column:
    """Sorted distinct ASCII-letter tokens of two letters or more, in lower case."""
    found = F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) >= 2), F.lower)))


def match_case(original: Column, replacement: Column) -> Column:
    """The replacement in upper or lower case where all of the original is."""
    has_upper, has_lower = original.rlike(r"\p{Lu}"), original.rlike(r"\p{Ll}")
    return F.when(has_upper & ~has_lower, F.upper(replacement)).when(has_lower & ~has_upper, F.lower(replacement)).otherwise(replacement)
