"""Arithmetic of boxes (x, y, width, height), all as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Callable[[str], Column]


def box(prefix: str = "") -> Box:
    """Access to the fields of a box whose columns carry a prefix."""
    return lambda name: F.col(f"{prefix}{name}")


def area(b: Box) -> Column:
    return F.greatest(b("width"), F.lit(0)) * F.greatest(b("height"), F.lit(0))


def overlap_1d(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """The common length of two intervals, 0 if they are apart."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def intersection(a: Box, b: Box) -> Column:
    across = overlap_1d(a("x"), a("x") + a("width"), b("x"), b("x") + b("width"))
    return across * overlap_1d(a("y"), a("y") + a("height"), b("y"), b("y") + b("height"))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, with a union of at least one pixel."""
    both = intersection(a, b)
    return both / F.greatest(F.lit(1), area(a) + area(b) - both)


def contained(inner: Box, outer: Box) -> Column:
    """The share of the inner box that the outer one covers."""
    return intersection(inner, outer) / F.greatest(F.lit(1), area(inner))


def horizontal_share(a: Box, b: Box) -> Column:
    """The common width over the narrower width; negative where the boxes are apart."""
    shared = F.least(a("x") + a("width"), b("x") + b("width")) - F.greatest(a("x"), b("x"))
    return shared / F.greatest(F.lit(1), F.least(a("width"), b("width")))


def mark_count(page_height: Column, page_width: Column, mark_height: Column, interval: Column) -> Column:
    """How many marks a page takes: its height over the interval (0: by default sizes), at least 1 and at most 12."""
    step = F.when(interval > 0, interval.cast("double")).otherwise(F.greatest(F.lit(1600.0), page_width * 2.5, mark_height * 8.0))
    return F.greatest(F.lit(1), F.least(F.lit(12), F.bround(page_height / step).cast("int")))
