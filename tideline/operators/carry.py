"""Windows over whole streams in two levels, so that a hot stream is many tasks: within stretches of an integer order, and over one
summary row per stretch, whose values are carried into the stretches after it. A stretch is ``WIDTH`` wide, so it holds a bounded
number of rows unless many share one value of the order. Rows whose key or order is null are kept, as one stream or stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 22
STRETCH = "_stretch"


def stretched(rows: DataFrame, order: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    return rows.withColumn(STRETCH, F.floor(F.col(order[0]) / width))


def _joined(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    summary = summary.withColumnsRenamed({key: "_key", STRETCH: "_at"})
    return rows.join(summary, F.col(key).eqNullSafe(F.col("_key")) & F.col(STRETCH).eqNullSafe(F.col("_at")), "left").drop("_key", "_at")


def previous(rows: DataFrame, key: str, order: tuple[str, ...], value: Column) -> DataFrame:
    """Stretched ``rows`` with ``_was``, a struct of the value of the row before, null at a stream's first row."""
    w, boxed = Window.partitionBy(key, STRETCH).orderBy(*order), F.struct(value.alias("v"))
    last = rows.groupBy(key, STRETCH).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    last = last.select(key, STRETCH, F.lag("_last").over(Window.partitionBy(key).orderBy(STRETCH)).alias("_last"))
    rows = rows.withColumns({"_lag": F.lag(boxed).over(w), "_first": F.row_number().over(w) == 1})
    return _joined(rows, last, key).withColumn("_was", F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_lag"))).drop("_lag", "_first", "_last")


def running(rows: DataFrame, key: str, order: tuple[str, ...], sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """Stretched ``rows`` with running sums and maxima, each up to and with its row."""
    sums, most = sums or {}, most or {}
    within = Window.partitionBy(key, STRETCH).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(key, STRETCH).agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_b_{n}") for n, c in most.items()])
    each = each.select(key, STRETCH, *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(f"_b_{n}").over(before).alias(f"_b_{n}") for n in most])
    here = rows.withColumns({n: F.sum(c).over(within) for n, c in sums.items()} | {n: F.max(c).over(within) for n, c in most.items()})
    out = _joined(here, each, key)
    out = out.withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_b_{n}") for n in most})
    return out.drop(*[f"_b_{n}" for n in (*sums, *most)])
