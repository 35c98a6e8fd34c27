import random

from conftest import rows
from pyspark.sql import functions as F

from tideline.operators import messages as ms
from tideline.streaming.dedup import Store, dedup_stream

SCHEMA = "delivery_id long, batch_id long, ce_id string, ce_source string, run_id string, sequence long, pts_ms long, h string, segment string, bucket string"


def made(spark, data):
    return spark.createDataFrame([(d, 1, i, s, r, q, p, "x", "y", "z") for d, i, s, r, q, p in data], SCHEMA)


def test_identity_from_any_field(spark):
    data = [
        (1, "Run-a:7", None, None, None, 5), (2, None, "/v1/runs/run-A", None, 7, 5), (3, "run-a:7", "/v1/runs/run-a", "RUN-A", 7, 5), (4, "run-a:8", None, " ", None, 5),
        (5, None, None, None, None, 5), (6, None, "/v1/runs/run-a", None, None, 5), (7, "run-b:7", None, None, None, 5), (None, "run-a:7", None, None, None, 5), (8, "", "", "", 7, 5),
    ]
    df = made(spark, data)
    assert rows(ms.repeats(df)) == [(2, 1), (3, 1)]
    assert [r[0] for r in rows(ms.kept(df).where("delivery_id is not null").select("delivery_id"))] == [1, 4, 5, 6, 7, 8]


def test_repeated_rows_and_empty(spark):
    df = made(spark, [(1, "r:1", None, None, None, None)] * 3)
    assert rows(ms.repeats(df)) == []
    assert rows(ms.repeats(made(spark, []))) == []


def test_many_and_a_hot_run(spark):
    rng = random.Random(1)
    data, want, seen = [], set(), {}
    for d in range(20_000):
        run, seq = ("hot" if rng.random() < 0.5 else f"r{rng.randrange(50)}"), rng.randrange(15_000)
        data.append((d, None, None, run, seq, seq * 60_000))
        if (run, seq) in seen:
            want.add((d, seen[run, seq]))
        seen.setdefault((run, seq), d)
    assert set(rows(ms.repeats(made(spark, data)))) == want
    assert set(rows(ms.repeats(made(spark, data), 1 << 50))) == want  # one bucket, many segments


def test_filters_let_no_repeat_pass(spark):
    data = [(d, None, None, "r", d // 2, 0) for d in range(3000)] + [(5000 + d, None, None, "s", d, 0) for d in range(3000)]
    keyed = ms.keyed_deliveries(made(spark, data))
    passed = keyed.join(ms.filters(keyed), ["bucket", "segment"]).where(ms._maybe_again("again", "h"))
    got = {r[0] for r in passed.select("delivery_id").collect()}
    assert set(range(3000)) <= got and len(got) < 3300


def test_batches_against_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", segments=4)
    first = made(spark, [(1, "r:1", None, None, None, 0), (2, "r:2", None, None, None, 0), (3, "r:1", None, None, None, 0), (9, None, None, None, None, 0)])
    second = made(spark, [(4, "R:2", None, None, None, 0), (5, "r:3", None, None, None, 0), (6, "r:3", None, None, None, 0)])
    ids = lambda df: sorted(r[0] for r in df.select("delivery_id").collect())
    assert ids(store.accept(first, 0)) == [1, 2, 9]
    assert ids(store.accept(second, 1)) == [5]
    assert ids(store.accept(second, 1)) == [5]  # the batch runs again
    assert ids(store.accept(first, 2)) == [9]


def test_stream_keeps_what_batch_keeps(spark, tmp_path):
    data = [(d, None, None, f"r{d % 3}", d % 7, 1000 * (d % 7)) for d in range(60)]
    for part in range(3):
        made(spark, data[part * 20 : part * 20 + 20]).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    dedup_stream(stream, Store(spark, f"file://{tmp_path}/store", segments=2), f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 21
    assert got.select(F.lower("run_id"), "sequence").distinct().count() == 21
