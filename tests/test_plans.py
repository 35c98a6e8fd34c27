import json

import pytest
from conftest import rows

from tideline.operators import compose as co
from tideline.plans import frames as fr
from tideline.plans import live as lv

MOMENTS = "moment_id string, stream_id string, start_pts_ms long, end_pts_ms long, kind string, modalities array<string>, description string, confidence float"


def test_observations_of_a_stream_of_any_length_stay(spark, tmp_path):
    at = [(0, 5_000), (3_995_000, 4_005_000), (7_200_000, 7_210_000), (99_995_000, 100_005_000), (200_000_000, 200_010_000)]
    data = [(f"m{k}", "a", a, b, "speech", ["audio"], "words", 0.5) for k, (a, b) in enumerate(at)]
    spark.createDataFrame(data, MOMENTS).write.parquet(f"{tmp_path}/multimodal_moments.parquet")
    want = [(a + 700, b + 300) for a, b in at]
    assert sorted((r.start_offset_ms, r.end_offset_ms) for r in fr.audio(spark, str(tmp_path)).collect()) == want
    assert sorted((r.start_pts_ms, r.end_pts_ms) for r in fr.audio(spark, str(tmp_path)).collect()) == [(a + 1000, b + 1000) for a, b in want]
    ranges = fr.QUERIES["fold_speech_ranges"](spark, str(tmp_path))
    assert rows(ranges.selectExpr("a_ms", "b_ms")) == sorted([(a - 300, b + 300) for a, b in want], key=str)


def test_a_decoded_event_beyond_the_limit_is_seen(spark, monkeypatch):
    monkeypatch.setattr(co, "MOST_SIGNALS", 2)
    signals = [dict(frame_index=k, pts_ms=k, perceptual_hash=1, luma_mean=0.5, flicker_score=0, ghosting_score=0, noise_variance_score=1) for k in range(3)]
    data = [(1, r, "frames_decoded", json.dumps({"signals": signals[:n]})) for r, n in (("q", 2), ("r", 3))]
    df = spark.createDataFrame(data, "seq long, run_id string, kind string, payload string")
    assert rows(co.decoded_signals(df).select("run_id", "frame_index", "luma_mean")) == [("q", 0, 0.5), ("q", 1, 0.5), ("r", None, None)]
    with pytest.raises(Exception, match="more than 2 signals"):
        co.decoded_signals(df, strict=True).collect()


def test_a_stream_of_more_frames_than_an_event_holds_is_decoded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(co, "MOST_SIGNALS", 5000)
    df = spark.range(9000).selectExpr("id AS frame_id", "'a' AS stream_id", "id AS frame_index", "id * 33 AS pts_ms", "id - 5 AS perceptual_hash", *[f"0.5f AS {c}" for c in fr.SCORES])
    df.write.parquet(f"{tmp_path}/frame_signals.parquet")
    got = lv.decoded(spark, str(tmp_path)).select("run_id", "frame_index", "perceptual_hash").collect()
    assert sorted(tuple(r) for r in got) == [("a", k, k - 5) for k in range(9000)]
