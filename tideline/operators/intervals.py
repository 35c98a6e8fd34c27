"""Covered periods and gaps of overlapping intervals (problem 2), on compressed run bitmaps.

Time is discrete in milliseconds; an interval sets the bits ``[start, end)``. Per entity the time axis is cut into shards of
``SHARD_MS`` bits. A shard's bitmap is kept compressed, as its set runs; whole shards inside a long interval are one run of
full shards. The union of a shard's bitmaps is taken in one window pass. Set runs become periods, clear runs gaps.

Only a summary per shard (its first and last run) is ordered within an entity, so an entity with a third of all rows is
spread over as many tasks as it has shards. Within a shard, rows are first reduced to one per start bit, so a shard hands on
at most ``SHARD_MS`` runs whatever its number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.runtime import written

SHARD_MS = 1 << 16


def run_bitmaps(intervals: DataFrame, entity: list[str], shard_ms: int = SHARD_MS) -> DataFrame:
    """Runs (entity, shard, lo, hi) of each interval (entity, start_ms, end_ms): at most three pieces of one, the bits in its
    first shard, the full shards between as one run (shard is null), the bits in its last shard. Reduced to one per start."""
    s, e, n = F.col("start_ms"), F.col("end_ms"), F.lit(shard_ms)
    a, b = F.floor(s / n), F.floor((e - 1) / n)
    piece = lambda shard, lo, hi: F.struct(shard.cast("long").alias("shard"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    pieces = F.when(a == b, F.array(piece(a, s, e))).otherwise(
        F.array(piece(a, s, (a + 1) * n), piece(F.when(b > a + 1, F.lit(None)).otherwise(b), (a + 1) * n, F.when(b > a + 1, b * n).otherwise(e)), piece(b, b * n, e))
    )
    rows = intervals.select(*entity, F.explode(pieces).alias("p")).select(*entity, "p.*")
    return rows.groupBy(*entity, "shard", "lo").agg(F.max("hi").alias("hi"))


def _union(runs: DataFrame, part: list[str]) -> DataFrame:
    """Set runs of the union of bitmaps within ``part``: overlapping and touching runs become one."""
    w = Window.partitionBy(*part).orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy(*part, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def periods_and_gaps(intervals: DataFrame, entity: list[str], shard_ms: int = SHARD_MS) -> DataFrame:
    """(entity, span, start_ms, end_ms): ``span`` is ``period`` or ``gap``.

    ``intervals`` has the entity's columns, ``start_ms`` and ``end_ms`` (whole numbers). Intervals that end at or before their
    start, or lack a bound, set no bit. Null entities are kept as one. Repeated and nested intervals do not matter.
    """
    rows = intervals.select(*entity, "start_ms", "end_ms").where("end_ms > start_ms")
    runs = run_bitmaps(rows, entity, shard_ms)
    full = _union(runs.where("shard is null").drop("shard"), entity).select(*entity, "lo", "hi", F.col("hi").alias("first_end"), F.col("lo").alias("last_start"), F.lit(True).alias("full"))
    part = [*entity, "shard"]
    set_runs = _union(runs.where("shard is not null"), part)
    w = Window.partitionBy(*part).orderBy("lo")
    first = F.min("lo").over(Window.partitionBy(*part))
    set_runs = written(set_runs.withColumns({"before": F.lag("hi").over(w), "after": F.lead("lo").over(w), "shard_lo": first}))
    # Per shard its first and last set bit, the end of its first run and the start of its last: all that is ordered in an entity.
    shards = set_runs.groupBy(*part).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("hi").alias("first_end"), F.max("lo").alias("last_start")).drop("shard")

    # Full runs lie on shard borders, so a shard is either wholly inside one, or apart from all; a shard inside counts for nothing.
    w = Window.partitionBy(*entity).orderBy("lo", F.desc("hi"), F.col("full").desc())
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = shards.withColumn("full", F.lit(False)).unionByName(full).withColumns({"cover": F.max(F.when(F.col("full"), F.col("hi"))).over(past)})
    edges = written(edges)
    inside = edges.where("not full and cover >= hi").select(*entity, "lo").withColumn("inside", F.lit(True))
    edges = edges.where("full or cover is null or cover < hi")
    edges = edges.withColumns({"reach": F.max("hi").over(past), "next": F.lead("lo").over(w)})
    # A piece begins where nothing reaches it; a run that leaves its shard's edge belongs to the piece that reached the edge.
    begins = F.coalesce(F.col("lo") > F.col("reach"), F.lit(True))
    several = F.col("last_start") > F.col("lo")
    opened = F.max(F.when(several, F.col("last_start")).when(begins, F.col("lo"))).over(past)
    edges = edges.withColumns({"begins": begins, "several": several & ~F.col("full"), "open": F.when(begins, F.col("lo")).otherwise(opened)})
    ends = F.col("next").isNull() | (F.col("next") > F.col("hi"))
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("span"), a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    out = edges.select(*entity, F.explode(F.array_compact(F.array(
        F.when(F.col("several"), span("period", F.col("open"), F.col("first_end"))),
        F.when(ends, span("period", F.when(F.col("several"), F.col("last_start")).otherwise(F.col("open")), F.col("hi"))),
        F.when(ends & F.col("next").isNotNull(), span("gap", F.col("hi"), F.col("next"))),
    ))).alias("x")).select(*entity, "x.*")
    # What lies between the first and the last run of a shard never leaves it; shards inside a full run have no gaps.
    inner = set_runs.where("before is not null")
    same = [F.col(f"i.{e}").eqNullSafe(F.col(f"s.{e}")) for e in entity] + [F.col("i.shard_lo") == F.col("s.lo")]
    inner = inner.alias("i").join(inside.alias("s"), same, "left_anti")
    own = F.array_compact(F.array(span("gap", F.col("before"), F.col("lo")), F.when(F.col("after").isNotNull(), span("period", F.col("lo"), F.col("hi")))))
    return out.unionByName(inner.select(*entity, F.explode(own).alias("x")).select(*entity, "x.*"))


def modality_intervals(moments: DataFrame) -> DataFrame:
    """(stream_id, modality, start_ms, end_ms) of ``moments``: one row per row and different modality of ``audio`` and
    ``video``; case, outer spaces and repetition do not matter. Null or empty modalities, a lacking bound and an end not
    after the start give no row."""
    rows = moments.select("moment_id", "stream_id", "start_pts_ms", "end_pts_ms", "modalities").where("moment_id is not null and end_pts_ms > start_pts_ms")
    named = F.transform("modalities", lambda m: F.lower(F.regexp_replace(m, r"^\s+|\s+$", "")))
    kinds: Column = F.array_intersect(F.array(F.lit("audio"), F.lit("video")), named)
    rows = rows.select("moment_id", "stream_id", "start_pts_ms", "end_pts_ms", kinds.alias("kinds"))
    rows = rows.select("stream_id", F.explode("kinds").alias("modality"), F.col("start_pts_ms").alias("start_ms"), F.col("end_pts_ms").alias("end_ms"))
    return rows


def covered(moments: DataFrame) -> DataFrame:
    """Periods and gaps per stream and modality. Rows present twice set the same bits twice, so they need no exchange of
    their own."""
    return periods_and_gaps(modality_intervals(moments), ["stream_id", "modality"])
