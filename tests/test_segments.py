import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.operators import machines as m
from tideline.operators import segments as sg
from tideline.operators.fold import fold


def streams(rng, n=900, hole=0.02):
    out = []
    for s in ("a", "b", "c", "d"):
        index, t, h = rng.randrange(100), rng.randrange(5000), rng.getrandbits(63)
        for _ in range({"a": n, "b": 70, "c": 1, "d": 300}[s]):
            index += 1 if rng.random() > hole else rng.choice([2, 40, 700])
            t += rng.choice([0, 33, 33, 40, 900])
            if rng.random() < 0.05:
                h = rng.getrandbits(63)
            out.append((s, index, t, h ^ (1 << rng.randrange(60)), rng.random(), rng.random() * 0.6, 0.1, rng.random() * 0.6, len(out), 1))
    return out


FRAME = "stream_id string, frame_index long, pts_ms long, perceptual_hash long, luma_mean float, flicker_score float, ghosting_score float, noise_variance_score float, frame_id long, chunk long"


@pytest.mark.parametrize("width", [1 << 16, 64, 30])
def test_gate_of_chunks_is_the_fold(spark, width):
    df = spark.createDataFrame(streams(random.Random(width)), FRAME)
    want = rows(fold(df, ["stream_id"], ["frame_index"], m.GATE_COLUMNS, m.Gate, m.GATE_SCHEMA))
    assert rows(sg.gate_decisions(df, width=width)) == want


@pytest.mark.parametrize("width", [1 << 22, 6000])
def test_rates_and_time_chunks_are_the_folds(spark, width):
    df = spark.createDataFrame(streams(random.Random(width)), FRAME)
    want = rows(fold(df, ["stream_id"], ["pts_ms", "frame_id"], ["pts_ms", "frame_id"], lambda: m.RateGate(2), "pts_ms long, frame_id long"))
    assert rows(sg.rate_limited(df, 2, "stream_id", "pts_ms", "frame_id", width)) == want
    want = rows(fold(df, ["stream_id"], ["pts_ms", "frame_id"], ["pts_ms", "frame_id"], lambda: m.TimeChunks(5000), "frame_id long, pts_ms long, chunk long, chunk_start_ms long"))
    assert rows(sg.time_chunks(df, 5000, "stream_id", "pts_ms", "frame_id", width)) == want


def test_token_windows_are_the_fold(spark):
    df = spark.createDataFrame(streams(random.Random(3)), FRAME).withColumn("text", F.repeat(F.lit("x"), (F.col("frame_index") % 50).cast("int")))
    want = rows(fold(df, ["stream_id"], ["pts_ms", "frame_id"], ["pts_ms", "frame_id", "text"], lambda: m.TokenBudget(20), "frame_id long, pts_ms long, allowed boolean, used long"))
    assert rows(sg.token_budget(df, 20, "stream_id", "pts_ms", "frame_id", "text")) == want


@pytest.mark.parametrize("width", [1 << 22, 21_000])
def test_pieces_of_chunks_are_the_fold(spark, width):
    rng, data = random.Random(width), []
    for s in ("a", "b"):
        t = 0
        for _ in range(250):
            t += rng.choice([0, 100, 400, 900, 3000])
            data.append((s, t, t + rng.choice([100, 300, 900, 25_000]), rng.random(), rng.choice(["so we go", "now.", ", then", " ", None, "why?"])))
    df = spark.createDataFrame(data, "stream_id string, start_ms long, end_ms long, confidence double, transcript string")
    order = ["start_ms", "end_ms"]
    want = rows(fold(df, ["stream_id"], [*order, "confidence"], [*order, "confidence"], lambda: m.speech_pieces(100_000), "a_ms long, b_ms long, confidence double"))
    assert rows(sg.speech_ranges(df, 100_000, width=width)) == want
    want = rows(fold(df, ["stream_id"], [*order, "transcript"], [*order, "transcript"], m.transcript_pieces, "a_ms long, b_ms long, text string"))
    assert rows(sg.transcripts(df, width=width)) == want


def test_nothing(spark):
    df = spark.createDataFrame([], FRAME)
    assert rows(sg.gate_decisions(df)) == [] and rows(sg.rate_limited(df, 2, "stream_id", "pts_ms", "frame_id")) == []
