"""Sinks of streaming queries: cursors, webhook deliveries and windowed counts."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, MOST_BODY = 3, 1 << 20


class EventSink(ABC):
    """Where the events of a batch go; a batch of one number may come twice and must then leave one copy."""

    @abstractmethod
    def write(self, batch: DataFrame, number: int) -> None: ...

    def attach(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ParquetSink(EventSink):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")


class WebhookSink(EventSink):
    """Delivery attempts as a log: for each event that a hook matches up to three attempts, then a dead letter. ``answer`` is a
    column that says which attempt succeeds (0: none); the request itself is left to the caller. A body that is too large is a
    dead letter at once."""

    def __init__(self, hooks: DataFrame, folder: str, answer) -> None:
        self.hooks, self.folder, self.answer = hooks, folder, answer

    def log(self, events: DataFrame) -> DataFrame:
        from tideline.operators.timeline import hook_matches

        told = hook_matches(self.hooks, events).join(events.select("run_id", "seq", "payload"), ["run_id", "seq"])
        large, at = F.octet_length(F.coalesce("payload", F.lit(""))) > MOST_BODY, self.answer
        tries = F.when(large, 0).when(at.between(1, ATTEMPTS), at).otherwise(ATTEMPTS)
        end = F.when(large, "body too large").when(~at.between(1, ATTEMPTS), "no attempt succeeded")
        state = lambda s, n, e: F.struct(F.lit(s).alias("state"), n.cast("int").alias("attempt"), e.cast("string").alias("error"))
        failed = F.transform(F.when(tries > 1, F.sequence(F.lit(1), tries - 1)).otherwise(F.array().cast("array<int>")), lambda n: state("retry", n, F.lit("failed")))
        last = F.when(end.isNull(), state("delivered", tries, F.lit(None))).otherwise(state("dead_letter", tries, end))
        return told.select("webhook_id", "seq", F.explode(F.concat(failed, F.array(last))).alias("a")).select("webhook_id", "seq", "a.*")

    def write(self, batch: DataFrame, number: int) -> None:
        self.log(batch).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events per window of media time and kind; late ones count until the watermark has passed."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", size), "kind").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "kind", "n")


def unique_events(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Events each once per (run, seq), as long as a copy comes within the watermark."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(["run_id", "seq"]).drop("_t")
