"""Messages delivered more than once, batch by batch, against what earlier batches stored.

The store is a folder all executors share. Per time bucket and segment it holds Bloom filters (one small row per batch that
wrote there) and the identifiers themselves, in files partitioned by bucket. A batch is first made unique in itself; then the
filters of just its own buckets say which deliveries are certainly new; the rest are verified against the stored identifiers of
just the matching buckets. What a batch writes lies under its number and is written over when the batch is repeated, so a
batch that was cut short can run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import messages
from tideline.runtime import written

SEGMENTS = 64


class Store:
    def __init__(self, spark: SparkSession, folder: str, bucket_ms: int = messages.BUCKET_MS, segments: int = SEGMENTS) -> None:
        self.spark, self.folder, self.bucket_ms, self.segments = spark, folder.rstrip("/"), bucket_ms, segments

    def _read(self, what: str, schema: str, batch: int) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}").where(F.col("batch") != batch)

    def _key(self, batch: DataFrame) -> DataFrame:
        rows = messages.identified(batch).withColumn("h", F.xxhash64("message_run", "message_seq"))
        return rows.withColumns({"bucket": F.coalesce(F.floor(F.col("pts_ms") / self.bucket_ms), F.lit(-1).cast("long")), "segment": F.pmod(F.shiftrightunsigned("h", 32), F.lit(self.segments).cast("long"))})

    def accept(self, batch: DataFrame, number: int) -> DataFrame:
        """The deliveries of a batch that are no repeats of one before, in it or in the store, which then holds them.
        Deliveries that name no message are all kept."""
        rows = written(self._key(batch))
        named = rows.where("message_run is not null and message_seq is not null")
        first = named.groupBy("bucket", "segment", "h", "message_run", "message_seq").agg(F.min("delivery_id").alias("delivery_id"))
        first = written(first)
        stored = self._read("filters", "bucket long, segment long, once array<long>, batch long", number)
        stored = stored.join(first.select("bucket", "segment").distinct(), ["bucket", "segment"], "left_semi")
        screened = first.join(stored.select("bucket", "segment", F.col("once").alias("bits")), ["bucket", "segment"])
        maybe = screened.where(messages._maybe_again("bits", "h")).select("bucket", "message_run", "message_seq").distinct()
        ids = self._read("ids", "message_run string, message_seq long, batch long, bucket long", number)
        seen = written(maybe.join(ids.select("bucket", "message_run", "message_seq"), ["bucket", "message_run", "message_seq"], "left_semi"))
        new = written(first.join(seen, ["bucket", "message_run", "message_seq"], "left_anti"))
        at = lambda what: f"{self.folder}/{what}/batch={number}"
        messages.filters(new).select("bucket", "segment", "once").write.mode("overwrite").parquet(at("filters"))
        new.select("message_run", "message_seq", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at("ids"))
        kept = rows.where("message_run is null or message_seq is null").unionByName(rows.join(new.select("delivery_id"), "delivery_id", "left_semi"))
        return kept.select(*batch.columns)


def dedup_stream(stream: DataFrame, store: Store, target: str):
    """A running query that writes a stream's deliveries to a parquet folder, each message once. Each batch lies under its own
    number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        store.accept(batch, number).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{store.folder}/progress").trigger(availableNow=True).start()
