"""Segments whose beginnings depend on the segment before, without one task per stream.

The head of a segment alone decides where the next one begins: its *successor* is a function of the head and of the rows soon
after it. So what looks sequential is a walk along successors from a stream's first row, and successors can be found anywhere
at once. A stream is cut into chunks of ``width`` along an integer order; a chunk also gets the rows within ``reach`` after its
end. Only its first rows, within ``reach`` of its border, can be where a walk comes in. For each of these the chunk says where the
walk leaves it, how many heads it passed and which was the last: some rows per chunk, which one small ordered pass per
stream links up. Then every chunk knows its way in and marks its heads. A stream of one chunk is marked at once.

``reach``: a row whose order lies at least that far beyond a head's is always a successor if none came before. ``width`` is at
least ``reach``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.runtime import spread_groups, written

ROWS_PER_GROUP = 400_000
#: (columns, first and one-beyond-last row of each row's series) -> each row's successor, or its series' end.
Successor = Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]


def after_at_least(column: str, step: int) -> Successor:
    """The first row whose ``column``, which never falls, is at least ``step`` greater."""

    def successor(pdf: pd.DataFrame, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = pdf[column].to_numpy(np.int64)
        since = at - at[first]
        span = int(since.max()) + step + 1 if len(at) else 1
        line = np.cumsum(np.r_[0, np.diff(first) != 0]) * span + since
        return np.minimum(np.searchsorted(line, line + step, "left"), end)

    return successor


def first_that(breaks: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]) -> Successor:
    """The first row for which ``breaks(columns, heads, rows)`` holds; all heads look one row further at a time."""

    def successor(pdf: pd.DataFrame, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, head = end.copy(), np.arange(len(pdf))
        row = head + 1
        while True:
            inside = row < end[head]
            head, row = head[inside], row[inside]
            if not len(head):
                return out
            hit = breaks(pdf, head, row)
            out[head[hit]] = row[hit]
            head, row = head[~hit], row[~hit] + 1

    return successor


def _series(pdf: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows, the number of each one's series, where it begins and where it ends."""
    pdf = pdf.sort_values(["_k", "_c", *order], kind="stable", ignore_index=True)
    key = pdf[["_k", "_c"]].to_numpy()
    number = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) - 1
    begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    stop = np.r_[begin[1:], len(pdf)]
    return pdf, number, begin, stop


def _ways(width: int, reach: int, order: list[str], payload: list[str], successor: Successor):
    """Per chunk and row where a walk may come in: where it leaves, how many heads it passes, and the last of them."""

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number, begin, stop = _series(pdf, order)
        own = pdf._own.to_numpy()
        near = pdf[order[0]].to_numpy(np.int64) < pdf._c.to_numpy() * width + reach
        to = successor(pdf, begin[number], stop[number])
        owned, early = np.bincount(number[own], minlength=len(begin)), np.bincount(number[own & near], minlength=len(begin))
        enter = np.flatnonzero(own & (near | (np.arange(len(pdf)) == (begin + early)[number])))
        last, heads = enter.copy(), np.ones(len(enter), np.int64)
        leaves = to[enter]
        border = (begin + owned)[number[enter]]
        while (on := np.flatnonzero(leaves < border)).size:
            last[on] = leaves[on]
            heads[on] += 1
            leaves[on] = to[last[on]]
        n = number[enter]
        out = pdf.iloc[last][["_key", "_c", *payload]].reset_index(drop=True)
        out["_in"], out["_out"], out["_heads"], out["_n"], out["_early"] = enter - begin[n], np.where(leaves < stop[n], leaves - border, -1), heads, owned[n], early[n]
        return out

    return ways


def _link(payload: list[str]):
    """One stream's chunks in order: the way in of each (-1: none), the last head before it (anything for the first chunk, which
    begins with a head), the number of heads before it."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_c", "_in"], ignore_index=True)
        at = {(c, k): i for i, (c, k) in enumerate(zip(pdf._c, pdf._in, strict=True))}
        chunks = pdf.drop_duplicates("_c")[["_c", "_n", "_early"]].itertuples(index=False)
        held = [pdf[p].to_numpy() for p in payload]
        out, last, heads, leave, before = [], None, 0, 0, None
        for c, n, early in chunks:
            enter = 0
            if last is not None and c == before + 1:
                enter = leave if leave >= 0 else early if early < n else -1
            out.append((c, enter, heads, *(h[last or 0] for h in held)))
            if enter >= 0:
                last = at[(c, enter)]
                heads += int(pdf._heads[last])
                leave, before = int(pdf._out[last]), c
            # Without a head of its own the chunk leaves the walk as it is: it then comes in at the next chunk's first row.
        rows = pd.DataFrame(out, columns=["_c", "_enter", "_before", *(f"_h_{p}" for p in payload)])
        rows.insert(0, "_key", pdf._key.iloc[0])
        return rows

    return link


def _marks(order: list[str], payload: list[str], successor: Successor, finish, names: list[str]):
    def marks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number, begin, stop = _series(pdf, order)
        to = successor(pdf, begin[number], stop[number])
        head = np.zeros(len(pdf), bool)
        enter = pdf._enter.to_numpy()[begin]
        at = (begin + enter)[enter >= 0]
        while len(at):
            head[at] = True
            end, at = stop[number[at]], to[at]
            at = at[at < end]
        own = np.maximum.accumulate(np.where(head, np.arange(len(pdf)), -1))
        inside = own >= begin[number]
        own = np.where(inside, own, 0)
        for p in payload:
            here = pdf[p].to_numpy()[own]
            pdf[f"head_{p}"] = np.where(inside, here, pdf[f"_h_{p}"].to_numpy()) if not inside.all() else here
        pdf["is_head"], pdf["_first"] = head, np.arange(len(pdf)) == begin[number]
        passed = np.cumsum(head)
        pdf["head_number"] = pdf._before.to_numpy() + passed - (passed - head)[begin][number] - 1
        return finish(pdf)[names]

    return marks


def walked(rows: DataFrame, key: str, order: list[str], payload: list[str], successor: Successor, reach: int, width: int, finish: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``rows``, in ``order`` (its first column is an integer) within ``key``, with ``is_head``, ``head_number`` from 0
    and the head's ``payload`` columns as ``head_...``, given to ``finish`` in whole frames of many chunks; its columns named in
    ``schema`` come out behind ``key``. Rows with a null key or first order are left out; ``payload`` holds no nulls."""
    if width < reach:
        raise ValueError("a chunk is at least as wide as the reach")
    spark, o = rows.sparkSession, order[0]
    rows = rows.where(F.col(key).isNotNull() & F.col(o).isNotNull())
    rows = rows.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_k"), F.floor(F.col(o) / width).cast("long").alias("_c"), *[c for c in rows.columns if c != key])
    kind = rows.schema["_key"].dataType
    spans = rows.groupBy("_key").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"), F.count("*").alias("n"))
    total, several = spans.agg(F.sum("n"), F.count_if(F.col("lo") < F.col("hi"))).first()
    groups = spread_groups(spark, total or 0, ROWS_PER_GROUP)
    grouped = lambda df, step, out: df.withColumn("_g", F.pmod(F.xxhash64("_k", "_c"), F.lit(groups)).cast("int")).repartitionById(groups, "_g").groupBy("_g").applyInPandas(step, out)
    types = {f.name: f.dataType for f in rows.schema.fields}
    names = ["_key", *(f.name for f in T.StructType.fromDDL(schema).fields)]
    out = T.StructType([T.StructField("_key", kind), *T.StructType.fromDDL(schema).fields])
    marks = _marks(order, payload, successor, finish, names)
    none = [F.col(p).alias(f"_h_{p}") for p in payload]  # never looked at; no nulls, which would make numbers inexact
    begun = [F.lit(0).cast("long").alias("_enter"), F.lit(0).cast("long").alias("_before"), *none]
    if not several:
        return grouped(rows.select("*", *begun), marks, out).withColumnRenamed("_key", key)
    streams = written(spans.where("lo < hi").select("_key"))  # one row per stream of several chunks; its measured size decides on a broadcast
    chunked = written(rows.join(streams, "_key", "left_semi"))
    whole = grouped(rows.join(streams, "_key", "left_anti").withColumn("_c", F.lit(0).cast("long")).select("*", *begun), marks, out)
    ahead = chunked.where(F.col(o) < F.col("_c") * width + reach).withColumn("_c", F.col("_c") - 1)
    both = chunked.withColumn("_own", F.lit(True)).unionByName(ahead.withColumn("_own", F.lit(False)))
    fields = [T.StructField("_key", kind), T.StructField("_c", T.LongType())]
    held = [T.StructField(p, types[p]) for p in payload]
    counts = [T.StructField(n, T.LongType()) for n in ("_in", "_out", "_heads", "_n", "_early")]
    # Rows before a stream's chunk come only from that chunk's neighbour; a chunk without own rows gives no way.
    ways = grouped(both, _ways(width, reach, order, payload, successor), T.StructType([*fields, *held, *counts]))
    before = [T.StructField(f"_h_{p}", types[p]) for p in payload]
    ins = ways.groupBy("_key").applyInPandas(_link(payload), T.StructType([*fields, T.StructField("_enter", T.LongType()), T.StructField("_before", T.LongType()), *before]))
    parts = grouped(chunked.join(written(ins), ["_key", "_c"]), marks, out)
    return whole.unionByName(parts).withColumnRenamed("_key", key)
