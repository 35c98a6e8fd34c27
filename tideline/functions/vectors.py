"""Vectors as arrays of numbers, in compiled expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 if one is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def quantised(a: Column) -> Column:
    """A unit vector in whole steps of -127..127 (``q``) and the step (``scale``); all zeros and 1 for a zero vector."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    step = F.when(top > 0, top / 127.0)
    q = F.transform(a, lambda x: F.coalesce(F.round(x.cast("double") / step), F.lit(0.0)).cast("tinyint"))
    return F.struct(q.alias("q"), F.coalesce(step / norm(a), F.lit(1.0)).alias("scale"))


def quantised_cosine(a: Column, b: Column) -> Column:
    """Cosine of two quantised vectors from whole-number products."""
    whole = F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda acc, x: acc + x)
    return whole * a["scale"] * b["scale"]
