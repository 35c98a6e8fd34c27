"""Repeated consecutive events (problem 3), by differences of row numbers on canonicalised events.

An event's canonical value is whether it continues the event just before it: same type, and word sets whose Jaccard
similarity reaches the threshold. Within a part of a sequence, (row number) - (row number among events of that value) is
constant along a stretch of continuing events and equals the number of heads so far; with the head's own number among
heads it keys the run.

A session is cut into stretches of ``CHUNK_MS`` milliseconds. ``pts_ms`` is unique in a session, so no window task ever
holds more than ``CHUNK_MS`` events of one session, however long it is. Runs that touch a stretch's edge are joined in a
second pass of the same step over at most two rows per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.runtime import written

CHUNK_MS = 1 << 18


def word_set(text: Column) -> Column:
    """Distinct runs of letters or digits, lower-cased; null for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def alike(a: Column, b: Column, tenths: int) -> Column:
    """Jaccard similarity of two word sets of at least ``tenths``/10, in whole numbers. Null, or two sets without a word: false."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.coalesce(a.isNotNull() & b.isNotNull() & (either > 0) & (both * 10 >= either * tenths), F.lit(False))


def _keyed(rows: DataFrame, part: list[str], order: str, continues: Column) -> DataFrame:
    """``rows`` with the run's number within ``part``. ``continues`` may look back with ``lag`` over the same window."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", continues)
    # The row number among rows of the same value, without sorting by that value: how many of them came so far.
    among = F.when(F.col("_c"), F.count_if("_c").over(w)).otherwise(F.count_if(~F.col("_c")).over(w))
    rows = rows.withColumns({"_n": F.count("*").over(w), "_m": among})
    return rows.withColumn("run", F.when(F.col("_c"), F.col("_n") - F.col("_m")).otherwise(F.col("_m")))


def collapse(events: DataFrame, tenths: int = 7) -> DataFrame:
    """One row per run: session_id, event_type, first_id, last_id, start_ms, end_ms, duration_ms, events.

    Single events are runs of one. Rows with the same ``id`` count once (should copies differ, always the same one is kept); rows without id, session or pts are left out. A null type equals a null type; a null description is like no
    other. Ties in ``pts_ms`` are broken by ``id``. Other columns are ignored.
    """
    rows = events.select("id", "session_id", "pts_ms", "event_type", "description").where("id is not null and session_id is not null and pts_ms is not null")
    # Equal copies come to lie next to each other below. Only ids whose copies differ are looked for by id, by hashes.
    rows = rows.withColumn("h", F.xxhash64("session_id", "pts_ms", "event_type", "description"))
    differ = written(rows.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("id", "lo"))
    rows = rows.join(differ, "id", "left").where("lo is null or h = lo")
    at = F.struct("pts_ms", "id")
    rows = rows.select(
        "session_id", (F.floor(F.col("pts_ms") / CHUNK_MS)).alias("chunk"), at.alias("at"), F.struct(F.col("event_type").alias("t"), word_set(F.col("description")).alias("w")).alias("e")
    )
    part = ["session_id", "chunk"]
    w = Window.partitionBy(*part).orderBy("at")

    def goes_on(last: Column, now: Column) -> Column:
        return F.coalesce(last.isNotNull() & last["t"].eqNullSafe(now["t"]) & alike(last["w"], now["w"], tenths), F.lit(False))

    rows = rows.withColumn("copy", F.coalesce(F.lag("at").over(w) == F.col("at"), F.lit(False))).where("not copy").drop("copy")
    rows = rows.withColumn("last_in_chunk", F.lead("at").over(w).isNull())
    rows = _keyed(rows, part, "at", goes_on(F.lag("e").over(w), F.col("e")))
    pieces = rows.groupBy(*part, "run").agg(
        F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"), F.min_by("e", "at").alias("head"), F.max_by("e", "at").alias("tail"),
        F.min("_n").alias("first_n"), F.bool_or("last_in_chunk").alias("ends"),
    )
    pieces = pieces.withColumn("starts", F.col("first_n") == 1)
    inner = pieces.where("not starts and not ends").select("session_id", "a", "b", "n", F.col("head.t").alias("event_type"))

    edge = pieces.where("starts or ends").select("session_id", "a", "b", "n", "head", "tail", "starts")
    ws = Window.partitionBy("session_id").orderBy("a")
    edge = _keyed(edge, ["session_id"], "a", F.col("starts") & goes_on(F.lag("tail").over(ws), F.col("head")))
    edge = edge.groupBy("session_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.min_by("head", "a").alias("h"))
    edge = edge.select("session_id", "a", "b", "n", F.col("h.t").alias("event_type"))
    return inner.unionByName(edge).select(
        "session_id", "event_type", F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), F.col("a.pts_ms").alias("start_ms"), F.col("b.pts_ms").alias("end_ms"),
        (F.col("b.pts_ms") - F.col("a.pts_ms")).alias("duration_ms"), F.col("n").alias("events"),
    )


def repeated(events: DataFrame) -> DataFrame:
    """(session_id, first_id, last_id) of every run of at least two events."""
    return collapse(events).where("events >= 2").select("session_id", "first_id", "last_id")
