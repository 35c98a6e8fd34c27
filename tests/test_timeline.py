import hmac

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.functions import geometry, hashes, text
from tideline.operators import metrics as me
from tideline.operators import moments as mo
from tideline.operators import timeline as tl
from tideline.operators import windows as wi
from tideline.sources import files, wal
from tideline.streaming import sinks

EVENT = "seq long, run_id string, stream_id string, pts_ms long, kind string, payload string"


def events(spark, data):
    return spark.createDataFrame([(s, r, "st", p, k, b) for s, r, p, k, b in data], EVENT)


def test_log_lines_round_trip(spark, tmp_path):
    odd = ["a\tb\nc", "back\\slash", "\\t is no tab", "\\\\n", "", "é "]
    df = events(spark, [(k, "r", 5, "x", t) for k, t in enumerate(odd)])
    wal.append(df, f"{tmp_path}/log")
    assert [r.payload for r in wal.read(spark, f"{tmp_path}/log").orderBy("seq").collect()] == odd
    assert wal.read(spark, f"{tmp_path}/none").count() == 0
    bad = spark.createDataFrame([("1\tr\ts\t5\tk",), ("x\tr\ts\t5\tk\tp",), ("1\tr\ts\t5\tk\ta\\qb\\\\tc",)], "value string")
    assert [r.payload for r in wal.decoded(bad).collect()] == ["a\\qb\\tc"]


def test_log_stream_and_partitions(spark, tmp_path):
    wal.append(events(spark, [(1, "a", 5, "x", "p"), (2, "b", 6, "y", "q")]).coalesce(1), f"{tmp_path}/log")
    sink = sinks.ParquetSink(f"{tmp_path}/out")
    sink.attach(wal.read_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/c").awaitTermination()
    wal.append(events(spark, [(3, "a", 7, "x", "r")]).coalesce(1), f"{tmp_path}/log")
    sink.attach(wal.read_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/c").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    wal.write_partitioned(wal.read(spark, f"{tmp_path}/log"), f"{tmp_path}/parts")
    plan = spark.read.parquet(f"{tmp_path}/parts").where("run_id = 'a'")
    assert plan.count() == 2 and "PartitionFilters: [isnotnull(run_id" in plan._jdf.queryExecution().toString()


def test_state_has_no_guard_after_a_final_event(spark):
    df = events(spark, [(1, "r", 10, "run_created", '{"principal_key":"p"}'), (2, "r", 20, "run_completed", "{}"), (3, "r", 30, "inference_completed", "no json"), (4, "q", 10, "vlm", None)])
    got = {r.run_id: r for r in tl.run_summary(df).collect()}
    assert (got["r"].state, got["r"].principal, got["r"].last_ms) == ("processing", "p", 30) and (got["q"].state, got["q"].created) == ("pending", False)
    late = {r.run_id: r.state for r in tl.with_expiry(tl.run_summary(df), 10_000_000).collect()}
    assert late == {"r": "expired", "q": "expired"}
    with pytest.raises(ValueError):
        tl.with_expiry(tl.run_summary(df), 0, 5)


def test_cursors_are_exclusive_and_queries_inclusive(spark):
    df = events(spark, [(k, "r", k, "a" if k % 2 else "b", "{}") for k in range(10)])
    assert [r.seq for r in tl.after(df, 4, 3).collect()] == [5, 6, 7]
    assert [r.seq for r in tl.after(df, 4, 3, ["b"]).collect()] == [6]
    assert [r.seq for r in tl.query(df, "r", "a", 5).collect()] == [5, 7, 9]


def test_hooks_and_attempts(spark, tmp_path):
    hook = '{"webhook_id":"w","event_kinds":[" b ","b","a"]}'
    df = events(spark, [(1, "r", 1, "webhook_registered", hook), (2, "r", 2, "a", "x"), (3, "r", 3, "trigger.z", '{"trigger":{"actions":{"webhook":true}}}'), (4, "r", 4, "b", "y"), (5, "q", 5, "a", "z")])
    hooks = tl.webhooks(df)
    assert hooks.first().event_kinds == ["a", "b"]
    assert rows(tl.hook_matches(hooks, df).select("seq")) == [(2,), (4,)]
    log = sinks.WebhookSink(hooks, f"{tmp_path}/w", F.when(F.col("seq") == 2, 2).otherwise(0))
    log.write(df, 0)
    log.write(df, 0)
    got = sorted((r.seq, r.attempt, r.state) for r in spark.read.parquet(f"{tmp_path}/w").collect())
    assert got == [(2, 1, "retry"), (2, 2, "delivered"), (4, 1, "retry"), (4, 2, "retry"), (4, 3, "dead_letter")]


def test_search_bounds(spark):
    df = spark.createDataFrame([(1, "r", None, "Red Door"), (2, "r", "", "red"), (3, "r", "a red", None), (4, "r", None, None)], "seq long, run_id string, description string, summary string")
    assert [(r.seq, r.scanned, r.total_hits) for r in tl.search(df, " RED ", 1).collect()] == [(1, 4, 2)]
    for bad in ("", "x" * 1025):
        with pytest.raises(ValueError):
            tl.search(df, bad)


def test_percentile_kinds_differ(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 3, 4)] + [("n", None)], "k string, v int")
    assert rows(me.percentiles(df, "k", "v", 0.5)) == [("k", 4, 3, 2, 2, 3)]


def test_pareto_against_all_pairs(spark):
    import random

    rng = random.Random(7)
    data = [(k, rng.randrange(12), rng.randrange(12), rng.randrange(12)) for k in range(150)]
    want = [r for r in data if not any(o[1] >= r[1] and o[2] <= r[2] and o[3] <= r[3] and o[1:] != r[1:] for o in data)]
    got = rows(me.pareto(spark.createDataFrame(data, "id int, f int, c int, t int").repartition(5), "id", ("f",), ("c", "t")))
    assert got == sorted(want, key=str)


def test_greedy_matches_once(spark):
    truth = spark.createDataFrame([("r", 1, "Save button", "click"), ("r", 2, "Save button", "click")], "k string, id long, element string, action string")
    found = spark.createDataFrame([("r", 7, "save  button", "click"), ("r", 8, "other", "x")], "k string, id long, element string, action string")
    assert [r[:3] for r in rows(me.greedy_match(truth, found, "k"))] == [("r", 1, 7)]


def test_overlap_join_gives_each_pair_once(spark):
    left = spark.createDataFrame([("k", 1, 0, 35_000), ("k", 2, 36_000, 36_001)], "k string, l long, l_start long, l_end long")
    right = spark.createDataFrame([("k", 5, 5_000, 34_000), ("k", 6, 35_400, 35_500), ("k", 7, 90_000, 90_001)], "k string, r long, r_start long, r_end long")
    assert rows(mo.overlap_join(left, right, "k", 500).select("l", "r")) == [(1, 5), (1, 6), (2, 6)]


def test_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# c\na\tb\n1\t2\n")
    assert rows(files.matrix(spark, f"{tmp_path}/m.tsv", ["a", "b"])) == [("1", "2")]
    with pytest.raises(ValueError):
        files.matrix(spark, f"{tmp_path}/m.tsv", ["a"])
    (tmp_path / "d.json").write_text('{"webhook_id":"w","seq":1,"state":"delivered"}\nbad\n{"seq":2}\n')
    assert files.delivery_log(spark, f"{tmp_path}/d.json").count() == 1
    lines = spark.createDataFrame([("p", k, v) for k, v in enumerate(["#tb 0: 1/25", "#dimensions 0: 2x2", "0, 0, 0, 1, 9, " + "ff" * 8 + "80ff" + "00" * 6, "0, 1, 1, 1, 9, " + "0" * 32, "bad"])], "path string, position long, value string")
    assert [(r.frame_index, r.pts_ms, r.perceptual_hash) for r in files.checksum_frames(lines).orderBy("frame_index").collect()] == [(0, 0, -1), (1, 40, 0)]
    blobs = spark.createDataFrame([("a", bytearray(range(64)) + bytearray(5)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    assert [r.hash for r in files.average_hashes(blobs).collect()] == [-(2**32)]
    (tmp_path / "blobs").mkdir()
    twice = blobs.union(blobs)
    assert sum(r.written for r in files.write_blobs(twice, f"{tmp_path}/blobs").collect()) == 2
    assert not any(r.written for r in files.write_blobs(twice, f"{tmp_path}/blobs").collect())
    assert files.source_kind("/a/b.mp4") == "local" and files.source_kind("RTSP://x/y") == "live"
    with pytest.raises(ValueError):
        files.source_kind("ftp://x")
    blobs.createOrReplaceTempView("mirrored")
    with pytest.raises(ValueError):
        files.mirror(spark, "mirrored; DROP")


def test_text_functions(spark):
    df = spark.createDataFrame([("añb", '{"x":1', "a b c. d"), ("日本語", 'say {"a": {"b": 2}} {', "One. Two..."), (None, None, None)], "t string, j string, u string")
    got = df.select(text.cut_bytes(F.col("t"), 4).alias("c"), text.first_object(F.col("j")).alias("o"), text.complete(F.col("u")).alias("e")).collect()
    assert [r.c for r in got] == ["añb", "日", None] and [r.o for r in got] == [None, '{"a": {"b": 2}}', None] and [r.e for r in got] == ["a b c. d", "One.", None]
    assert spark.range(1).select(text.minutes_ms(F.lit("02:03.5")), text.minutes_ms(F.lit("x"))).first()[:] == (123_500, None)


def test_hashes(spark):
    df = spark.createDataFrame([("Health ok",), ("health, OK!",), ("other",), ("",), (None,)], "t string").withColumn("m", hashes.minhash("t"))
    m = [r.m for r in df.collect()]
    assert m[0] == m[1] and m[0] != m[2] and set(m[3]) == {0xFFFFFFFF} and m[4] is None
    assert hashes.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert int(hashes.mix([0])[0]) == 0xE220A8397B1DCDAF
    signed = spark.createDataFrame([("x",), (None,)], "t string").select(hashes.hmac_sha256(b"k")("t").alias("s")).collect()
    assert [r.s for r in signed] == [hmac.new(b"k", b"x", "sha256").hexdigest(), None]


def test_rectangles(spark):
    r = lambda *v: spark.range(1).select(geometry.resolved(F.lit(101), F.lit(51), *[F.lit(x) for x in v])).first()[0]
    assert r(0.0, 0.0, 1.0, 1.0)[:] == (0, 0, 100, 50) and r(0.5, 0.5, 0.001, 0.001)[:] == (50, 24, 2, 2)
    assert r(0.5, 0.0, 0.6, 1.0) is None and r(float("nan"), 0.0, 0.5, 1.0) is None


def test_loops_fire_on_ones_at_the_first_frame(spark):
    df = spark.createDataFrame([("s", 0, 0, -1), ("s", 1, 1, 0), ("s", 2, 2, 0), ("s", 3, 3, 0), ("s", 4, 4, 0)], "stream_id string, frame_index long, frame_id long, perceptual_hash long")
    assert [(r.loop, r.enters) for r in wi.loops(df).orderBy("frame_id").collect()] == [(True, True), (False, False), (False, False), (False, False), (True, True)]


def test_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "2026-01-01 00:00:01", "a"), (1, "r", "2026-01-01 00:00:01", "a"), (2, "r", "2026-01-01 00:20:00", "a")], "seq long, run_id string, t string, kind string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for k, (query, want) in enumerate([(sinks.windowed_counts(stream(), "t"), 1), (sinks.unique_events(stream(), "t"), 2)]):
        query.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start(f"{tmp_path}/o{k}").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/o{k}").count() == want


def test_windows_over_chunks_agree_with_whole_streams(spark):
    import random

    from tideline.operators.chunks import over_chunks

    rng = random.Random(9)
    index = sorted(rng.sample(range(40_000), 3000))
    data = [("hot", i, n, rng.getrandbits(63), rng.random()) for n, i in enumerate(index)] + [("b", i, 5000 + i, i, 0.5) for i in range(20)]
    df = spark.createDataFrame(data, "stream_id string, frame_index long, frame_id long, perceptual_hash long, luma_mean double")
    for step, back in ((lambda f, k=("stream_id",): wi.motion(wi.window_scores(f, keys=k), k), 16), (lambda f, k=("stream_id",): wi.loops(f, 30, keys=k), 9)):
        whole = rows(step(df))
        assert rows(over_chunks(df, step, back, chunk=256).select(step(df).columns)) == whole
