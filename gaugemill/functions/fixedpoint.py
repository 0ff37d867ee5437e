"""Exact arithmetic on tenths: parsing, quantising, rounding half towards plus infinity, printing. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value: an optional minus, one or two digits, a point, one digit.
VALUE = r"^-?[0-9]{1,2}\.[0-9]\z"
LIMIT = 999


def whole_div(n: Column, d: Column) -> Column:
    """Integer quotient, cut towards zero."""
    return F.call_function("div", n, d)


def floor_div(n: Column, d: Column) -> Column:
    """Integer quotient, rounded down; d is positive."""
    return whole_div(n - F.pmod(n, d), d)


def ceil_div(n: Column, d: Column) -> Column:
    return floor_div(n + d - 1, d)


def parse_tenths(value: Column) -> Column:
    """Tenths of a well-formed value, null for anything else; never an error.

    A sum, not a branch: both sides are always evaluated, so generated code computes value once for them.
    """
    return F.replace(value, F.lit("."), F.lit("")).try_cast("int") + F.when(value.rlike(VALUE), 0)


def parse_double(value: Column) -> Column:
    return value.try_cast("double")


def quantise_tenths(value: Column) -> Column:
    """The nearest number of tenths of a double, ties upwards."""
    return F.floor(value * 10 + F.lit(0.5)).cast("long")


def clamp_tenths(tenths: Column, limit: int = LIMIT) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), tenths))


def mean_tenths(total: Column, count: Column) -> Column:
    """total / count rounded half towards plus infinity, in integers."""
    total, count = total.cast("long"), count.cast("long")
    return floor_div(2 * total + count, 2 * count)


def round1(x: Column) -> Column:
    """A double rounded to one decimal, half towards plus infinity, never minus zero."""
    return F.floor(x * 10 + F.lit(0.5)) / F.lit(10.0)


def format_tenths(tenths: Column) -> Column:
    """'-1.5' for -15; zero has no sign."""
    size = F.abs(tenths.cast("long"))
    return F.concat(F.when(tenths < 0, "-").otherwise(""), whole_div(size, F.lit(10)).cast("string"), F.lit("."), (size % 10).cast("string"))


def name_bytes(name: Column) -> Column:
    return F.octet_length(name).cast("long")


def valid_name(name: Column, most: int = 100) -> Column:
    """1 to most bytes without the separator or a line end."""
    return F.octet_length(name).between(1, most) & ~name.contains(";") & ~name.contains("\n")


def length_class(name: Column) -> Column:
    n = F.octet_length(name)
    return F.when(n < 8, "short").when(n < 16, "middle").otherwise("long")
