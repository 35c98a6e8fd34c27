"""Other text and binary sources and sinks."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checksum_frames(lines: DataFrame) -> DataFrame:
    """Frames of checksum lists (path, position, value): ``#tb s: a/b`` gives the time base, a row is
    ``stream, dts, pts, duration, size, hash``. The hash's first 16 digits stand in for a picture hash, the next two for luma,
    two more for noise."""
    base = F.regexp_extract("value", r"^#tb\s+\d+:\s*(\d+)/(\d+)", 1)
    per = F.regexp_extract("value", r"^#tb\s+\d+:\s*(\d+)/(\d+)", 2)
    heads = lines.where("value like '#tb%'").groupBy("path").agg(F.max(base.try_cast("long")).alias("num"), F.max(per.try_cast("long")).alias("den"))
    p = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.where("value not like '#%'").select("path", "position", p.alias("p")).where(F.size("p") >= 6)
    rows = rows.select("path", "position", F.col("p")[2].try_cast("long").alias("pts"), F.lower(F.col("p")[5]).alias("sum")).where(F.col("pts").isNotNull() & F.col("sum").rlike("^[0-9a-f]{20,}$"))
    digits = lambda a, n: F.conv(F.substring("sum", a, n), 16, 10).cast("double")
    rows = rows.join(heads, "path", "left").select(
        "path", (F.row_number().over(Window.partitionBy("path").orderBy("position")) - 1).cast("long").alias("frame_index"),
        F.floor(F.col("pts") * 1000 * F.coalesce("num", F.lit(1)) / F.coalesce("den", F.lit(1000))).alias("pts_ms"), F.conv(F.substring("sum", 1, 16), 16, -10).cast("long").alias("perceptual_hash"),
        (digits(17, 2) / 255).cast("float").alias("luma_mean"), (digits(19, 2) / 255).cast("float").alias("noise_variance_score"),
    )
    return rows


def average_hashes(blobs: DataFrame) -> DataFrame:
    """(path, frame_index, hash) of 8 by 8 gray pictures that lie one after another in ``content``: a bit is set where a
    pixel is above the whole mean; pixel 0 is the lowest bit. A rest of fewer than 64 bytes is left out."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                grid = np.frombuffer(content, np.uint8)
                grid = grid[: len(grid) // 64 * 64].reshape(-1, 64)
                bits = grid > (grid.sum(axis=1, dtype=np.int64) // 64)[:, None]
                h = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel() if len(grid) else np.zeros(0, np.int64)
                yield pd.DataFrame({"path": path, "frame_index": np.arange(len(h)), "hash": h})

    return blobs.select("path", "content").where("content is not null").mapInPandas(hashes, "path string, frame_index long, hash long")


def delivery_log(spark: SparkSession, path: str) -> DataFrame:
    """Delivery records of JSON lines; an unreadable one is left out."""
    schema = "webhook_id string, seq long, state string, error string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("webhook_id is not null and seq is not null and state is not null")


def matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated table with comments; its header must be ``columns`` and no field blank."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    if df.columns != columns:
        raise ValueError(f"the header is {df.columns}, not {columns}")
    blank = F.lit(False)
    for c in columns:
        blank = blank | F.col(c).isNull() | (F.trim(c) == "")
    return df.withColumn(columns[0], F.when(blank, F.raise_error(F.lit("a field is blank"))).otherwise(F.col(columns[0])))


def in_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Raises where a value falls below the one before it."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn(value, F.when(F.col(value) < before, F.raise_error(F.lit(f"{value} goes back"))).otherwise(F.col(value)))


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


def mirror(spark: SparkSession, view: str, run_id: str | None = None) -> DataFrame:
    """All columns of a mirror table, of one run if asked for; the name is checked, the run is a parameter."""
    if not NAME.fullmatch(view):
        raise ValueError(f"not a table name: {view!r}")
    return spark.sql(f"SELECT * FROM {view}") if run_id is None else spark.sql(f"SELECT * FROM {view} WHERE run_id = :run", args={"run": run_id})


def write_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Stores ``content`` under its SHA-256 in a folder all executors share, each content once; gives (sha256, size, written).
    A task that runs again finds the file there and leaves it."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content in pdf.content:
                sha = hashlib.sha256(content).hexdigest()
                at, fresh = os.path.join(folder, sha), False
                if not os.path.exists(at):
                    part = f"{at}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(content)
                    os.replace(part, at)
                    fresh = True
                out.append((sha, len(content), fresh))
            yield pd.DataFrame(out, columns=["sha256", "size", "written"])

    once = blobs.select("content").where("content is not null").withColumn("sha", F.sha2("content", 256)).dropDuplicates(["sha"])
    return once.select("content").mapInPandas(store, "sha256 string, size long, written boolean")


SCHEMES = {"file": "local", "http": "remote", "https": "remote", "hls": "remote", "rtsp": "live", "rtsps": "live"}


def source_kind(uri: str) -> str:
    """What kind of input an address names: local, remote or live."""
    scheme, colon, rest = uri.partition("://")
    if not colon:
        scheme, rest = "file", uri
    if scheme.lower() not in SCHEMES or not rest or any(ord(c) < 32 for c in uri):
        raise ValueError(f"unsupported source: {uri!r}")
    return SCHEMES[scheme.lower()]
