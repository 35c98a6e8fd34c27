import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.operators import machines as m
from tideline.operators.fold import fold, stream_fold

SCHEMA = "stream_id string, start_ms long, end_ms long, confidence double, transcript string"
MACHINES = {
    "speech": (lambda: m.speech_pieces(10**7), ["start_ms", "end_ms", "confidence"], "a_ms long, b_ms long, c double"),
    "transcript": (m.transcript_pieces, ["start_ms", "end_ms", "transcript"], "a_ms long, b_ms long, t string"),
    "rate": (lambda: m.RateGate(2), ["start_ms", "end_ms"], "p long, i long"),
    "chunks": (lambda: m.TimeChunks(5000), ["start_ms", "end_ms"], "i long, p long, n long, s long"),
}


@pytest.mark.parametrize("name", MACHINES)
def test_late_rows_and_ends_come_as_in_batch(spark, tmp_path, name):
    """Rows out of order over the batches, within the watermark, fold as in one ordered batch, with what is due at the end."""
    machine, columns, schema = MACHINES[name]
    data = [("a" if k % 3 else "b", 400 * k + 9000, 400 * k + 9300, k / 60, ["we", "go", "now."][k % 3]) for k in range(60)]
    batches = [data[:20:2] + data[20:30], data[1:20:2] + data[30:45], data[45:], [("z", 10**8, 10**8 + 300, 0.5, "late")], [("z", 2 * 10**8, 2 * 10**8 + 300, 0.5, "on")]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream = stream.withColumn("at", F.timestamp_millis("start_ms"))
    out = stream_fold(stream, ["stream_id"], columns[:2], columns, machine, schema, "at", "10 minutes", 60_000)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = rows(spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where("stream_id != 'z'"))
    assert got == rows(fold(spark.createDataFrame(data, SCHEMA), ["stream_id"], columns[:2], columns, machine, schema))
