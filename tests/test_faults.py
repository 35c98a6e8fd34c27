import math
import random

import numpy as np
from conftest import rows

from tideline.operators import faults as fa

SCHEMA = "frame_id long, stream_id string, frame_index long, luma_mean float, flicker_score float, noise_variance_score float, block long, s long, g long"


def made(spark, series, start=0):
    data = [(start + i, s, i, v, 0.5 + 0.001 * (i % 5), None, 1, 2, 3) for s, values in series.items() for i, v in enumerate(values)]
    out, n = [], 0
    for row in data:
        out.append((n, *row[1:]))
        n += 1
    return spark.createDataFrame(out, SCHEMA)


def found(df, **kw):
    return {(i, f) for i, m, f in rows(fa.faults(df, **kw)) if m == "luma_mean"}


def noise(n, level=0.5, scatter=0.01, seed=0):
    rng = np.random.default_rng(seed)
    return [float(x) for x in level + scatter * rng.standard_normal(n)]


def test_impossible_readings_and_nulls(spark):
    v = noise(60)
    v[5], v[6], v[7], v[8], v[9] = math.nan, math.inf, -0.1, 1.5, None
    assert found(made(spark, {"a": v})) == {(k, "impossible") for k in (5, 6, 7, 8)}


def test_stuck_needs_ten_and_a_null_breaks_it(spark):
    v = noise(100)
    v[10:20], v[40:49], v[60:70] = [0.51] * 10, [0.49] * 9, [0.48] * 10
    v[65] = None
    assert found(made(spark, {"a": v})) == {(k, "stuck") for k in range(10, 20)}


def test_resting_value_is_not_stuck(spark):
    v = [0.0] * 200
    for k in range(0, 200, 15):
        v[k] = 0.02
    assert found(made(spark, {"a": v})) == set()


def test_spikes_held_levels_and_level_changes(spark):
    v = noise(300)
    for k in (50, 51, 52):
        v[k] = 0.9
    for k in range(100, 104):
        v[k] = 0.9
    v[150:] = [x + 0.3 for x in v[150:]]
    v[200] = 0.4
    assert found(made(spark, {"a": v})) == {(50, "spike"), (51, "spike"), (52, "spike"), (200, "spike")}


def test_wandering_stream(spark):
    rng = np.random.default_rng(3)
    v = [float(x) for x in 0.5 + np.cumsum(rng.normal(0, 0.001, 2000)) + rng.normal(0, 0.004, 2000)]
    v[700], v[1500] = v[700] + 0.1, v[1500] - 0.1
    assert found(made(spark, {"a": v})) == {(700, "spike"), (1500, "spike")}


def test_repeated_rows_count_once_and_empty(spark):
    v = noise(40)
    v[30:37] = [0.5] * 7
    df = made(spark, {"a": v})
    assert found(df.union(df)) == set()
    assert rows(fa.faults(spark.createDataFrame([], SCHEMA))) == []


def test_chunks_of_a_long_stream_agree_with_the_whole(spark):
    rng = random.Random(5)
    v = noise(6000, scatter=0.005, seed=4)
    for _ in range(25):
        k = rng.randrange(50, 5900)
        v[k] = 0.8
    v[1015:1040] = [0.51] * 25  # over a chunk's edge
    v[2044:2054] = [0.52] * 10
    df = made(spark, {"a": v, "b": noise(50)})
    whole = found(df, chunk=100_000)
    assert found(df, chunk=1024, halo=128) == whole and len(whole) >= 50


def test_chunks_of_a_resting_stream_with_holes(spark):
    v = [0.0 if k % 9 else 0.03 for k in range(3000)]
    v[1000:1030] = [0.5] * 30
    df = made(spark, {"a": v})
    wide = df.selectExpr("frame_id", "stream_id", "frame_index * 97 as frame_index", *SCHEMA_REST)
    assert found(df, chunk=512, halo=64) == found(wide, chunk=512, halo=64) == {(k, "stuck") for k in range(1000, 1030)}


SCHEMA_REST = ["luma_mean", "flicker_score", "noise_variance_score", "block", "s", "g"]


def spiked(n, at, **kw):
    v = noise(n, **kw)
    for k in at:
        v[k] = 0.9
    return v, {(k, "spike") for k in at}


def test_spikes_are_any_share_of_a_short_stream(spark):
    for n, at in ((12, (5,)), (30, (12, 13, 14)), (82, (20, 21, 22, 60, 61, 62)), (60, (9, 18, 19, 20, 30, 31, 39, 48, 49, 50))):
        v, want = spiked(n, at)
        assert found(made(spark, {"a": v})) == want
    v, want = spiked(30, (12, 13, 14))
    assert found(made(spark, {"a": [None] * 20 + v + [1.5] * 20})) == {(k + 20, f) for k, f in want} | {(k, "impossible") for k in range(50, 70)}


def test_streams_of_a_few_readings(spark):
    assert found(made(spark, {"a": [0.5, 0.9], "b": [0.5, 0.5, 0.9], "c": [0.4]})) == set()


def test_a_dense_burst_of_spikes_in_one_chunk(spark):
    for step in (40, 25, 15):  # 7.5, 12 and 20 % of a chunk's readings
        v, want = spiked(6000, [k + j for k in range(2100, 4000, step) for j in range(3)], scatter=0.01)
        assert found(made(spark, {"a": v}), chunk=1024, halo=128) == want


def test_spikes_of_a_resting_stream_beside_what_scatters_ordinarily(spark):
    rng = np.random.default_rng(8)
    v = [0.0 if rng.random() < 0.6 else 0.01 + 0.01 * float(rng.random()) for _ in range(300)]
    at = [k + j for k in range(20, 290, 30) for j in range(3)]
    for k in at:
        v[k] = 0.8
    assert found(made(spark, {"a": v})) == {(k, "spike") for k in at}


def test_a_long_stream_is_judged_by_its_own_scale_wherever_it_is_cut(spark):
    rng = np.random.default_rng(11)
    v = [float(x) for x in np.r_[0.5 + 0.002 * rng.standard_normal(6000), 0.5 + 0.02 * rng.standard_normal(6000)]]
    v[500], v[9000] = 0.55, 0.95
    df = made(spark, {"a": v})
    whole = found(df, chunk=10**9)
    assert found(df) == whole and (9000, "spike") in whole and (500, "spike") not in whole


def test_rest_is_the_whole_streams(spark):
    v = noise(3000)
    for k in range(3000):  # resting in 45 % of the first half, in 70 % of the second
        if k % 20 < (9 if k < 1500 else 14):
            v[k] = 0.4
    df = made(spark, {"a": v})
    assert found(df, chunk=512, halo=64) == found(df, chunk=10**9)
