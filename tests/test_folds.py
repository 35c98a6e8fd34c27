import random
from functools import partial

import numpy as np
import pytest
from conftest import rows

from tideline.operators import machines as m
from tideline.operators import trigger as tr
from tideline.operators.fold import fold, stream_fold

# The replay's frames and what is decided on them.
REPLAY = [
    (0, 0, 43690, 0.42, 0.0, 0.0, 0.0), (1, 33, 43690, 0.41, 0.61, 0.0, 0.0), (2, 66, 43690, 0.40, 0.0, 0.71, 0.0), (3, 99, -1, 0.45, 0.0, 0.0, 0.0), (4, 132, -1, 0.48, 0.0, 0.0, 0.67),
]
DECIDED = [("keep_keyframe", "initial_frame"), ("suspect_artifact", "flicker_suspected"), ("suspect_artifact", "ghosting_suspected"), ("keep_keyframe", "scene_cut"), ("suspect_artifact", "noise_variance_spike")]


def run(machine, data):
    return [x for row in data for x in machine(row)] + list(machine.finish())


def test_gate_replay():
    assert [(x[2], x[3]) for x in run(m.Gate(), REPLAY)] == DECIDED


def test_gate_compares_with_the_kept_frame():
    frames = [(0, 0, 0, 0.1, 0, 0, 0), (1, 1, 0, 0.3, 0, 0, 0), (2, 2, 0, 0.3, 0, 0, 0), (31, 3, 0, 0.3, 0, 0, 0), (32, 4, 0, 0.3, 0, 0, 0)]
    assert [x[3] for x in run(m.Gate(), frames)] == ["initial_frame", "exposure_shift", "exposure_shift", "periodic_keepalive", "no_trigger"]


def test_configs_are_checked():
    for bad in (lambda: m.GateConfig(cut_bits=65), lambda: m.ZoneConfig(enter=0.1, exit=0.2), lambda: m.Novelty(high=0.1, low=0.2)):
        with pytest.raises(ValueError):
            bad()


def test_zone_hysteresis():
    scores = [0.5, 0.1, 0.5, 0.5, 0.3, 0.1, 0.1, 0.3, 0.1, 0.1, 0.1]
    assert [(x[0], x[1]) for x in run(m.Zone(), enumerate(scores))] == [(3, "entered"), (10, "exited")]


def test_rate_chunks_and_budget():
    assert [x[1] for x in run(m.RateGate(2), [(t, t) for t in (0, 200, 499, 500, 900, 1000)])] == [0, 500, 1000]
    assert [x[2] for x in run(m.TimeChunks(100), [(t, t) for t in (5, 100, 104, 105, 300)])] == [0, 0, 0, 1, 2]
    assert [x[2] for x in run(m.TokenBudget(2), [(0, 1, "x" * 8), (10, 2, "y" * 8), (1000, 3, "z")])] == [True, False, True]


def test_speech_transcripts_and_moments():
    assert run(m.speech_pieces(100_000), [(0, 300, 0.5), (1200, 1500, 0.9), (1600, 1700, 1.0), (9000, 9500, 0.1)]) == [(0, 1800, 0.9), (8700, 9800, 0.1)]
    pieces = [(0, 100, "we go"), (200, 300, ", now."), (400, 500, "Next"), (5000, 5100, "late"), (5200, 5300, " ")]
    assert run(m.transcript_pieces(), pieces) == [(0, 300, "we go, now."), (400, 500, "Next"), (5000, 5100, "late")]
    moments = [(0, 100, "speech", "a", 1, "x"), (50, 90, "speech", "b", 2, "y"), (60, 200, "music", "a", 1, "z"), (300, 400, "music", "b", 1, "u"), (900, 1000, "music", "a", 1, "v")]
    assert sorted(k[0] for k in run(m.MomentDedup(), moments)) == ["u", "v", "y", "z"]


def test_clips():
    out = run(m.Clips(2000, 2), [(t, t // 100) for t in range(0, 5000, 100)])
    assert out == [(0, 2000, 5, 0, 20), (2500, 4500, 5, 25, 45)]
    assert run(m.Clips(1000, 1000, most=8), [(t, t) for t in range(0, 1001, 10)])[0][2] <= 9


def test_live_novelty_bounds():
    a, b = np.eye(4)[0], np.eye(4)[1]
    near = a + 0.001 * b
    out = run(m.LiveNovelty(), [(0, 1, a), (500, 2, near), (2000, 3, near), (2100, 4, b), (1000, 5, b)])
    assert [x[3] for x in out] == ["run", "reuse", "forced_refresh", "run", "forced_refresh"]


def test_novelty_admits_drops_and_escalates():
    sig, e = np.arange(64), np.eye(4)
    out = run(m.Novelty(), [(1, sig, e[0], 0), (2, sig, e[0], 0), (3, sig + 1, e[1], -1), (4, sig, e[1], 0)])
    assert [x[5] for x in out] == ["admit", "drop", "admit", "drop"]


def test_policies():
    log = [(1, 10, "policy_created", "p", None, None, None), (2, 20, "policy_created", "q", None, None, None), (3, 30, "policy_deploy_acknowledged", None, 1, "active", None), (4, 40, "policy_deploy_acknowledged", None, 2, "active", None), (5, 50, "policy_rollback_acknowledged", None, 1, None, 2)]
    assert [(x[0], x[1]) for x in run(m.Policies(), log)] == [(1, "active"), (2, "rolled_back")]
    assert m.may_promote("draft", "shadow") and not m.may_promote("draft", "active")


FRAMES = "stream_id string, frame_index long, pts_ms long, perceptual_hash long, luma_mean float, flicker_score float, ghosting_score float, noise_variance_score float, extra string"


def frames(spark, n=400):
    rng = random.Random(2)
    data = [(rng.choice("abc"), i, i * 33, rng.getrandbits(64) - 2**63 if rng.random() < 0.2 else 7, rng.random() / 3, rng.random() * 0.7, rng.random() * 0.7, rng.random() * 0.7, "x") for i in range(n)]
    return spark.createDataFrame(data, FRAMES)


def test_batch_stream_and_plain_loop_agree(spark, tmp_path):
    df = frames(spark)
    batch = rows(fold(df, ["stream_id"], ["frame_index"], m.GATE_COLUMNS, m.Gate, m.GATE_SCHEMA))
    plain = []
    for key in "abc":
        data = sorted(tuple(r[c] for c in m.GATE_COLUMNS) for r in df.where(f"stream_id = '{key}'").collect())
        plain += [(key, *x) for x in run(m.Gate(), data)]
    near = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(near, batch), key=str) == sorted(map(near, plain), key=str)
    for k in range(3):
        df.where(f"frame_index between {k * 150} and {k * 150 + 149}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream_fold(stream, ["stream_id"], ["frame_index"], m.GATE_COLUMNS, m.Gate, m.GATE_SCHEMA)
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(near, rows(spark.read.parquet(f"{tmp_path}/out"))), key=str) == sorted(map(near, batch), key=str)


def test_fold_of_nothing(spark):
    assert rows(fold(spark.createDataFrame([], FRAMES), ["stream_id"], ["frame_index"], m.GATE_COLUMNS, m.Gate, m.GATE_SCHEMA)) == []


SOURCE = """
# a door
trigger door version 3
when motion_score >= 0.4 for 2 frames
and object_count:person@bay >= 1
edge rising
cooldown 5000ms
emit opened
capture clip 100 200ms
notify webhook
end
"""


def test_trigger_source_and_machine():
    p = tr.compile_source(SOURCE)
    assert [s.op for s in p.steps] == ["load", "constant", ">=", "sustain", "load", "constant", ">=", "and", "edge", "cooldown", "jump_if_false", "emit", "capture", "notify", "halt"]
    seen = [("object_count:person@bay", 1.0)]
    sample = lambda t, x, o=seen: (t, x, None, None, None, None, o)
    fired = [x[1] for x in run(tr.Trigger(p), [sample(0, 0.5), sample(1000, 0.5), sample(2000, 0.1), sample(3000, 0.5), sample(4000, 0.5), sample(9000, 0.5), sample(9100, 0.1), sample(9200, 0.5), sample(9300, 0.5)])]
    # The edge at 4000 falls into the cooldown and is spent.
    assert fired == [False, True, False, False, False, False, False, False, True]
    assert run(tr.Trigger(p), [sample(0, None, None)])[0][1:3] == (False, True)


def test_not_over_a_missing_signal_is_true():
    steps = (tr.Step("load", ("confidence",)), tr.Step("constant", (0.5,)), tr.Step(">"), tr.Step("not"), tr.Step("jump_if_false", (6,)), tr.Step("emit", ("x",)), tr.Step("halt"))
    assert run(tr.Trigger(tr.Program("p", 1, steps)), [(0, None, None, None, None, None, None)])[0][1]


@pytest.mark.parametrize("change", [
    ("version 3", "version 0"), ("emit opened\n", ""), (">= 0.4", "=> 0.4"), ("0.4 for", "inf for"), ("2 frames", "0 frames"), ("end\n", ""), ("motion_score", "speed"), ("200ms", "70000ms"), ("5000ms", "90000000ms"), ("opened", "o p"),
    ("notify webhook", "notify sms"), ("end\n", "end\nemit y"), ("trigger door", "trigger door\nwhen confidence > 1\ntrigger"),
])
def test_bad_sources_are_refused(change):
    with pytest.raises(tr.TriggerError):
        tr.compile_source(SOURCE.replace(*change))


@pytest.mark.parametrize("steps", [
    (), (tr.Step("halt"),), (tr.Step("and"), tr.Step("emit", ("x",)), tr.Step("halt")), (tr.Step("constant", (1.0,)), tr.Step("jump_if_false", (0,)), tr.Step("emit", ("x",)), tr.Step("halt")),
    (tr.Step("constant", (1.0,)), tr.Step("jump_if_false", (3,)), tr.Step("emit", ("x",)), tr.Step("notify", ("webhook",)), tr.Step("halt")), (tr.Step("emit", ("x",)), tr.Step("emit", ("y",)), tr.Step("halt")),
    (tr.Step("constant", (1.0,)), tr.Step("edge", (16,)), tr.Step("emit", ("x",)), tr.Step("halt")), tuple([tr.Step("constant", (1.0,))] * 17) + (tr.Step("emit", ("x",)), tr.Step("halt")),
])
def test_bad_programs_are_refused(steps):
    with pytest.raises(tr.TriggerError):
        tr.verify(tr.Program("p", 1, steps))


def test_live_programs():
    ok = "trigger a version 1\nwhen motion_score > 0.1\nemit x\ncapture keyframe\nend"
    assert tr.live_only(tr.compile_source(ok))
    with pytest.raises(tr.TriggerError):
        tr.live_only(tr.compile_source(SOURCE))


def test_stateless_condition_is_necessary(spark):
    program = tr.compile_source("trigger a version 1\nwhen motion_score >= 0.4\nand confidence < 0.5\nemit x\ncapture keyframe\nend")
    data = [(0, 0.4, 0.1), (1, 0.5, 0.6), (2, None, 0.1), (3, float("nan"), 0.1), (4, 0.9, 0.49)]
    df = spark.createDataFrame(data, "pts_ms long, motion_score float, confidence float")
    kept = {r.pts_ms for r in df.where(tr.stateless_condition(program)).collect()}
    fired = {x[0] for x in run(tr.Trigger(program), [(t, a, None, c, None, None, None) for t, a, c in data]) if x[1]}
    assert kept == fired == {0, 4}


def test_partial_machines_keep_parameters(spark):
    df = frames(spark, 50)
    out = fold(df, ["stream_id"], ["frame_index"], ["pts_ms", "frame_index"], partial(m.RateGate, 1), "pts_ms long, frame_index long")
    assert 0 < out.count() < 50
