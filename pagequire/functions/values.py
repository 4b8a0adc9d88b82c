"""Small expressions with the semantics that page data has: missing, empty and zero are alike false; halves round to even."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def flag(c: Column | str) -> Column:
    """A boolean column, null as false."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def stripped(c: Column) -> Column:
    """Without white space of any script at both ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def has_text(c: Column) -> Column:
    """Whether anything but white space is there."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def first_text(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(c).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of two."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def natural_key(name: Column) -> Column:
    """A sort key of file names: runs of digits by value, whatever their length, the rest in lower case. A number is
    written behind the number of its digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda d: F.concat(F.lpad(F.length(d).cast("string"), 9, "0"), d)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(F.regexp_replace(p, "^0+", ""))).otherwise(p)), "")


def size_label(length: Column) -> Column:
    """Bytes as megabytes with one decimal."""
    return F.format_string("%.1f MB", F.bround(length / 1048576, 1))


def version_key(version: Column) -> Column:
    """The numbers of a dotted version, comparable part by part; a leading v is dropped, other parts count 0."""
    return F.transform(F.split(F.regexp_replace(version, "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
