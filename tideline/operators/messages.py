"""Messages delivered more than once (problem 5): Bloom filters per time bucket, then exact verification of possible repeats.

A message is one run id (ignoring case) and one sequence. Its time bucket is that of its append time, which all its copies
carry, so a message lies in one bucket. Bucketed storage is a set of segments: a bucket with many deliveries has many, chosen
by the identifier's hash, so a bucket that holds a third of all rows is spread evenly.

Every segment has a two-level Bloom filter: bits set once and bits set again. The levels are built where the rows are read
and merged per segment, so only bitmaps are exchanged, no identifiers. A delivery one of whose bits was set only once is
certainly the only one of its message. All others are possible repeats and are verified exactly, by grouping on the whole
identifier within their bucket and segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.runtime import written

BUCKET_MS = 6 * 3600 * 1000
SEGMENT_BITS, HASHES, BITS_PER_ROW = 1 << 15, 4, 16
WORDS = SEGMENT_BITS // 64


def identified(envelopes: DataFrame) -> DataFrame:
    """``envelopes`` with ``message_run`` and ``message_seq``, from whichever fields hold them: the columns, ``ce_id``
    (``run:sequence``), then ``ce_source`` (``/v1/runs/run``). Blank fields count as lacking; null where no field has it."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    of_id = F.regexp_extract(F.col("ce_id"), r"^\s*(.*):(\d{1,18})\s*$", 1)
    seq = F.regexp_extract(F.col("ce_id"), r"^\s*(.*):(\d{1,18})\s*$", 2)
    of_source = F.regexp_extract(F.col("ce_source"), r"/runs/([^/]+)\s*$", 1)
    return envelopes.withColumns({
        "message_run": F.lower(F.coalesce(filled(F.col("run_id")), filled(of_id), filled(of_source))),
        "message_seq": F.coalesce(F.col("sequence"), filled(seq).cast("long")),
    })


def _segments() -> Column:
    """Segments of a bucket of ``n`` rows: a power of two, so that a segment keeps ``BITS_PER_ROW`` bits a row."""
    need = F.col("n") * BITS_PER_ROW / SEGMENT_BITS
    return F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(need)).cast("double"))).cast("long")


def _cells(h: np.ndarray) -> np.ndarray:
    """Bit positions of each hash, ``HASHES`` a row, by double hashing. ``h``: 64-bit hashes, signed."""
    u = h.view(np.uint64)
    a, b = u & np.uint64(0xFFFF), (u >> np.uint64(16)) & np.uint64(0xFFFF) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)).astype(np.int64)


def _levels(segment: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits set at least once and at least twice, per segment, as rows of 64-bit words. A row sets each of its cells once."""
    cells = np.sort(cells, axis=1)
    own = np.ones(cells.shape, bool)
    own[:, 1:] = cells[:, 1:] != cells[:, :-1]
    at, count = np.unique((segment[:, None] * SEGMENT_BITS + cells)[own], return_counts=True)
    out = []
    for cut in (1, 2):
        bits = np.zeros(n * SEGMENT_BITS, bool)
        bits[at[count >= cut]] = True
        out.append(np.packbits(bits, bitorder="little").view(np.int64).reshape(n, WORDS))
    return out[0], out[1]


FILTER = "bucket long, segment long, once array<long>, again array<long>"


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, inverse = np.unique(pdf[["bucket", "segment"]].to_numpy(), axis=0, return_inverse=True)
        for a in range(0, len(keys), 512):
            rows = (inverse >= a) & (inverse < a + 512)
            once, again = _levels(inverse[rows] - a, _cells(pdf.h.to_numpy()[rows]), min(512, len(keys) - a))
            yield pd.DataFrame({"bucket": keys[a : a + 512, 0], "segment": keys[a : a + 512, 1], "once": list(once), "again": list(again)})


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    once, again = np.zeros(WORDS, np.int64), np.zeros(WORDS, np.int64)
    for o, g in zip(pdf.once, pdf.again, strict=True):
        again |= g | (once & o)
        once |= o
    return pd.DataFrame({"bucket": [key[0]], "segment": [key[1]], "once": [once], "again": [again]})


def filters(keyed: DataFrame) -> DataFrame:
    """One two-level filter per (bucket, segment) of ``keyed`` (bucket, segment, h)."""
    return keyed.select("bucket", "segment", "h").mapInPandas(_build, FILTER).groupBy("bucket", "segment").applyInPandas(_merge, FILTER)


def _maybe_again(words: str, h: str) -> Column:
    """Whether every cell of ``h`` is set in ``words``; the same cells as ``_cells``, in compiled code."""
    a, b = F.col(h).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(1))
    out = F.lit(True)
    for k in range(HASHES):
        cell = F.pmod(a + b * k, F.lit(SEGMENT_BITS))
        word = F.get(F.col(words), F.floor(cell / 64).cast("int"))
        out = out & (F.getbit(word, F.pmod(cell, F.lit(64)).cast("int")) == 1)
    return out


def keyed_deliveries(envelopes: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(delivery_id, message_run, message_seq, bucket, segment, h) of every delivery that names a message."""
    rows = identified(envelopes).select("delivery_id", "message_run", "message_seq", F.coalesce(F.floor(F.col("pts_ms") / bucket_ms), F.lit(-1)).alias("bucket"))
    rows = rows.where("delivery_id is not null and message_run is not null and message_seq is not null")
    # The number of buckets grows with the time that is covered, not with the deliveries.
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    counts = written(counts.select("bucket", _segments().alias("segments")))
    rows = rows.join(counts, "bucket").withColumn("h", F.xxhash64("message_run", "message_seq"))
    return rows.withColumn("segment", F.pmod(F.shiftrightunsigned("h", 32), F.col("segments"))).drop("segments")


def repeats(envelopes: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(delivery_id, first_delivery_id) of every delivery of a message except the one with the smallest ``delivery_id``.

    A delivery that names no run or no sequence belongs to no message and is kept. Copies of a message must share ``pts_ms``
    (a lacking one is a bucket of its own). A ``delivery_id`` present twice counts once. Exact: the filters only leave out
    deliveries that are certainly alone.
    """
    rows = keyed_deliveries(envelopes, bucket_ms)
    screened = rows.join(written(filters(rows)), ["bucket", "segment"]).where(_maybe_again("again", "h"))
    screened = screened.select("bucket", "segment", "message_run", "message_seq", "delivery_id")
    first = screened.groupBy("bucket", "segment", "message_run", "message_seq").agg(F.min("delivery_id").alias("first_delivery_id"), F.max("delivery_id").alias("last"))
    several = first.where("first_delivery_id < last").drop("last")
    out = screened.join(several, ["bucket", "segment", "message_run", "message_seq"]).where("delivery_id > first_delivery_id")
    return out.select("delivery_id", "first_delivery_id").distinct()


def kept(envelopes: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``envelopes`` without repeated deliveries: one delivery of each message, and all that name none."""
    return envelopes.join(repeats(envelopes, bucket_ms).select("delivery_id"), "delivery_id", "left_anti")
