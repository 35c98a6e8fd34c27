"""Pixel and normalised rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(c: Column) -> Column:
    return F.floor(c).cast("int").bitwiseAND(F.lit(-2))


def valid(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether a normalised rectangle is finite, not empty and within the unit square."""
    finite = F.lit(True)
    for c in (x, y, w, h):
        finite = finite & c.isNotNull() & ~F.isnan(c.cast("double"))
    return F.coalesce(finite & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), F.lit(False))


def resolved(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A normalised rectangle in even pixels of an image, at least 2 by 2 and within it; null if it is not valid."""
    px, py = even(width * x), even(height * y)
    pw = F.greatest(F.least(even(width * w), even(width) - px), F.lit(2))
    ph = F.greatest(F.least(even(height * h), even(height) - py), F.lit(2))
    return F.when(valid(x, y, w, h), F.struct(px.alias("x"), py.alias("y"), pw.alias("width"), ph.alias("height")))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, tolerance: int = 0) -> Column:
    return (a0 <= b1 + tolerance) & (b0 <= a1 + tolerance)
