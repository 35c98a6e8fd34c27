"""Cutting long ordered streams into overlapping chunks, so that a hot stream is many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.runtime import written

WORD, CHUNK = 64, 4096


def in_chunks(rows: DataFrame, key: str, index: str, chunk: int = CHUNK, halo: int = 512) -> tuple[DataFrame, int, bool]:
    """``rows`` with ``chunk``, ``own`` and ``long``, their number, and whether any is of a long stream. A stream of more than ``chunk`` indexes is cut into
    chunks of about that many, each with at least ``halo`` present ones of its neighbours on either side (``own`` is false
    there), whatever holes the index has; another stream is chunk 0.

    Indexes are counted in words of 64 by a bit for each that is present, so repeated rows do not matter. Chunks begin at
    blocks, which hold an eighth of a chunk at most. Only the blocks of long streams are joined to the rows; the table is
    written first, so its measured size decides on a broadcast."""
    block = max(WORD, chunk // 8 // WORD * WORD)
    rows = rows.withColumns({"block": F.floor(F.col(index) / block), "word": F.floor(F.col(index) / WORD)})
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(index, F.lit(WORD)).cast("int"))
    words = rows.groupBy(key, "block", "word").agg(F.bit_count(F.bit_or(bit)).cast("long").alias("n"), F.count("*").alias("rows"))
    blocks = words.groupBy(key, "block").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    w = Window.partitionBy(key)
    blocks = blocks.withColumn("whole", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("block")) - F.col("n"))
    c = F.floor(F.col("before") / chunk)
    place = lambda k, own: F.struct(k.cast("long").alias("chunk"), F.lit(own).alias("own"))
    places = F.array_compact(F.array(
        place(c, True),
        F.when(F.col("before") + F.col("n") > (c + 1) * chunk - halo, place(c + 1, False)),
        F.when((c > 0) & (F.col("before") < c * chunk + halo), place(c - 1, False)),
    ))
    # Blocks of long streams, and one row with the number of all rows.
    long_blocks = blocks.where(F.col("whole") > chunk).select(key, "block", places.alias("places"), F.lit(0).cast("long").alias("total"))
    total = blocks.agg(F.sum("rows").alias("total")).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(None).cast("long").alias("block"), F.lit(None).cast(long_blocks.schema["places"].dataType).alias("places"), "total")
    both = written(long_blocks.unionByName(total))
    facts = both.agg(F.max("total"), F.count("block")).first()
    rows = rows.drop("word").join(both.where("block is not null").select(key, "block", "places"), [key, "block"], "left")
    rows = rows.withColumn("long", F.col("places").isNotNull()).withColumn("_p", F.explode(F.coalesce("places", F.array(place(F.lit(0), True)))))
    return rows.withColumns({"chunk": F.col("_p.chunk"), "own": F.col("_p.own")}).drop("_p", "places", "block"), facts[0] or 0, facts[1] > 0


def over_chunks(rows: DataFrame, step: Callable[[DataFrame, tuple[str, ...]], DataFrame], look_back: int, key: str = "stream_id", index: str = "frame_index", chunk: int = CHUNK) -> DataFrame:
    """``step`` (rows, keys) -> rows, a window operator that looks at most ``look_back`` rows back or ahead, per chunk instead of
    per stream, with the same result."""
    cut, _, _ = in_chunks(rows, key, index, chunk, max(look_back, WORD))
    return step(cut.drop("long"), (key, "chunk")).where("own").drop("chunk", "own")
