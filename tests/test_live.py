import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.functions import hashes
from tideline.operators import compose as co
from tideline.operators import inference as inf
from tideline.operators import live as lv
from tideline.operators import machines as m
from tideline.operators.trigger import compile_source


def run(machine, data):
    return [x for row in data for x in machine(row)] + list(machine.finish())


def test_replay_fingerprint():
    from test_folds import REPLAY

    codes = {"keep_keyframe": "keep", "suspect_artifact": "artifact", "skip": "skip"}
    out = run(m.Gate(), REPLAY)
    assert hashes.fingerprint([(codes[x[2]], x[3], x[0]) for x in out]) == 0xBE0BC19BEDA6AD48


def test_a_frame_kept_by_the_zone_becomes_the_anchor():
    # 16 bits differ: motion for the zone, no scene cut for the gate.
    frames = [(0, 0, 0, 0.4, 0, 0, 0, True), (1, 33, 0xFFFF, 0.4, 0, 0, 0, True), (2, 66, 0xFFFF0000, 0.4, 0, 0, 0, True)]
    out = run(lv.Live(zone=m.ZoneConfig(0.2, 0.1, 1, 1)), frames)
    assert [(x[0], x[2]) for x in out] == [(0, "periodic_keepalive"), (1, "restricted_zone_activity"), (1, "zone_entered"), (2, "scene_cut")]
    blind = [(*f[:7], f[0] != 1) for f in frames]
    assert [(x[0], x[2]) for x in run(lv.Live(zone=m.ZoneConfig(0.2, 0.1, 1, 1)), blind)] == [(0, "periodic_keepalive")]


def test_loops_and_triggers_in_the_live_machine():
    program = compile_source("trigger a version 1\nwhen motion_score >= 0.1\nemit x\ncapture keyframe\nend")
    frames = [(k, 33 * k, 7 if k < 5 else 0x7FF, 0.4, 0, 0, 0, True) for k in range(6)]
    got = [(x[0], x[2]) for x in run(lv.Live(program=program), frames)]
    assert got == [(0, "periodic_keepalive"), (3, "loop_detected"), (5, "periodic_keepalive"), (5, "trigger")]


def test_audio_windows():
    frames = [(t * 48, 48_000, k) for k, t in enumerate(range(0, 1000, 100))]
    assert run(lv.AudioWindows(400), frames) == [(0, 400, 5), (500, 400, 5)]
    gap = [*frames[:3], *[(a, r, s + 5) for a, r, s in frames[5:9]]]
    assert run(lv.AudioWindows(4000), gap) == [(0, 200, 3), (0, 300, 4)]
    wrap = [(2**32 - 4800, 48_000, 65_535), (0, 48_000, 0), (9600, 48_000, 1)]
    assert run(lv.AudioWindows(300), wrap) == [(0, 300, 3)]


def test_admission_is_fair_and_ages():
    data = [(0, 1, "a", "s", 1, 9000, 100), (10, 2, "a", "s", 1, 9000, 100), (20, 3, "b", "t", 1, 9000, 100), (30, 4, "c", "u", 2, 9000, 100), (40, 5, "c", "u", 2, 60, 100)]
    assert [(x[0], x[1]) for x in run(lv.Admission(), data)] == [(1, 0), (3, 100), (2, 200), (4, 300)]


def test_edge_rollout():
    data = [("apply", "r1", 1, None), ("result", None, None, True), ("result", None, None, True), ("apply", "r0", 1, None), ("apply", "r2", 2, None), ("result", None, None, False), ("apply", "r2", 3, None)]
    assert [x[0] for x in run(lv.EdgeRollout(), data)] == ["candidate", "advanced", "advanced", "refused", "candidate", "rolled_back", "unchanged"]


def test_names(spark):
    df = spark.createDataFrame([("Voice-Over",), (" sound effect",), ("Ambient",), ("machine",), ("x",), (None,)], "k string")
    assert [r[0] for r in df.select(co.moment_kind(F.col("k"))).collect()] == ["speech", "sound_effect", "ambient", "mechanical", "other", "other"]
    df = spark.createDataFrame([(" Fork Lift",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(co.object_name(F.col("k"))).collect()] == ["fork_lift", "frame_context", "frame_context"]


def test_decoded_signals_take_the_latest_event(spark):
    one = dict(frame_index=0, pts_ms=0, perceptual_hash=2**64 - 1, luma_mean=0.5, flicker_score=0, ghosting_score=0, noise_variance_score=1)
    bad = one | {"luma_mean": 1.5}
    data = [(1, "r", "frames_decoded", json.dumps({"signals": [bad]})), (2, "r", "frames_decoded", json.dumps({"signals": [one, bad]})), (3, "r", "other", "{}"), (4, "q", "frames_decoded", "no json")]
    df = spark.createDataFrame(data, "seq long, run_id string, kind string, payload string")
    assert rows(co.decoded_signals(df)) == [("r", 0, 0, -1, 0.5, 0.0, 0.0, 1.0)]
    with pytest.raises(Exception, match="not valid"):
        co.decoded_signals(df, strict=True).collect()


def test_plane_signals(spark):
    left = np.zeros((32, 32), np.uint8)
    left[:, :16] = 255
    data = [("s", 0, 0, bytearray(left.tobytes()), 32, 32), ("s", 1, 33, bytearray(b"short"), 32, 32), ("s", 2, 66, None, 32, 32)]
    got = rows(co.plane_signals(spark.createDataFrame(data, "stream_id string, frame_index long, pts_ms long, y binary, width int, height int")))
    assert got == [("s", 0, 0, 0x0F0F0F0F0F0F0F0F, 0.5, 1.0)]


def test_shadow_samples_like_wrapping_arithmetic(spark):
    indexes = [0, 1, 2, 77, 10**6, 2**40 + 5, 2**62]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in indexes], "i long").select(co.shadow(F.col("i"), 0.5)).collect()]

    def want(i):
        x = i * 0x9E3779B97F4A7C15 % 2**64
        return ((x << 17 | x >> 47) % 2**64) % 10_000 < 5000

    assert got == [want(i) for i in indexes]


def test_inference_falls_back_on_passing_causes(spark):
    class Broken(inf.Provider):
        def __init__(self, status):
            self.status, self.name = status, f"broken{status}"

        def infer(self, model, prompt):
            raise inf.ProviderError(self.status)

    df = spark.createDataFrame([(1, "m", "hello"), (2, "m", None)], "id long, model string, prompt string")
    got = rows(inf.infer(df, [Broken(503), inf.Fixed()]).select("id", "provider", "attempts", "error"))
    assert got == [(1, "fixed", 2, None), (2, "fixed", 2, None)]
    assert {r[1] for r in rows(inf.infer(df, [Broken(400), inf.Fixed()]).select("id", "provider"))} == {"broken400"}


def test_routes_labels_and_sound_windows(spark):
    models = spark.createDataFrame([("x", 2, ["a", "b"]), ("y", 1, ["b"])], "backend string, priority int, models array<string>")
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, model string")
    assert [r[2] for r in rows(co.routed(requests, co.model_routes(models), "d"))] == ["x", "y", "d"]
    tracks = spark.createDataFrame([("t", 32_000 * 9), ("u", 3000), ("v", 32_000 * 4 + 3200)], "track string, samples long")
    assert rows(co.sound_windows(tracks)) == [("t", 0, 4000), ("t", 4000, 8000), ("t", 8000, 9000), ("v", 0, 4000), ("v", 4000, 4100)]
