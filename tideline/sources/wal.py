"""The line format of the event log: six fields between tabs, with ``\\\\``, ``\\t`` and ``\\n`` escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("seq", "run_id", "stream_id", "pts_ms", "kind", "payload")
NUMBERS = ("seq", "pts_ms")
SCHEMA = "seq long, run_id string, stream_id string, pts_ms long, kind string, payload string"


def escaped(text: str | Column) -> Column:
    c = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def plain(text: str | Column) -> Column:
    """The text of an escaped field; a backslash before another character stays. The text is cut at its double backslashes, from
    the left, so what remains between them holds single ones only; the parts are unescaped and joined by one backslash."""
    text = F.col(text) if isinstance(text, str) else text
    single = lambda x: F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    parts = F.split(text, r"\\\\", -1)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, single), "\\")).otherwise(text)


def decoded(lines: DataFrame) -> DataFrame:
    """Events of log lines (``value``); a line of fewer than six fields or with an unreadable number is left out. Tabs beyond the
    fifth belong to the payload. Text that is no UTF-8 is an error. A line is split once: its parts come out of a generator,
    which later filters and fields are not pushed through."""
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit("a log line is not UTF-8")))
    rows = lines.where("value is not null").select(F.explode(F.array(F.split(valid, "\t", 6))).alias("p")).where(F.size("p") == 6)
    cols = [F.col("p")[k].try_cast("long").alias(n) if n in NUMBERS else F.col("p")[k].alias(n) for k, n in enumerate(FIELDS)]
    rows = rows.select(*cols).where("seq >= 0 and pts_ms >= 0")
    return rows.select(*[F.col(n) if n in NUMBERS else plain(n).alias(n) for n in FIELDS])


def encoded(events: DataFrame) -> DataFrame:
    return events.select(F.concat_ws("\t", *[F.col(n).cast("string") if n in NUMBERS else escaped(F.coalesce(F.col(n), F.lit(""))) for n in FIELDS]).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log; one that is not there has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return decoded(spark.read.text(path))


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream; the checkpoint of its query keeps the place, so nothing is read twice."""
    return decoded(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def append(events: DataFrame, path: str) -> None:
    encoded(events).write.mode("append").text(path)


def write_partitioned(events: DataFrame, path: str) -> None:
    """The log as columns, by run, so that reading a run touches its own files only. Rows are put together by run first and a
    large run is split, so that no task writes many small files or one huge one."""
    events.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").parquet(path)
