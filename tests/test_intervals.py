import random

import pytest
from conftest import rows

from tideline.operators import intervals as iv

MOMENT = "moment_id string, stream_id string, start_pts_ms long, end_pts_ms long, modalities array<string>, inner string, lo long"


def brute(data):
    out = []
    for key in {d[0] for d in data}:
        spans = sorted((a, b) for k, a, b in data if k == key and b > a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(key, "period", a, b) for a, b in merged] + [(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shard", [1, 7, 64, 1000])
def test_random_intervals_match_brute_force(spark, seed, shard):
    rng = random.Random(seed)
    data = []
    for _ in range(120):
        a = rng.randrange(-300, 3000)
        data.append((rng.choice("ab"), a, a + rng.choice([0, 1, 5, shard, 2 * shard, 3 * shard + 1, rng.randrange(400)])))
    df = spark.createDataFrame(data, "k string, start_ms long, end_ms long")
    assert rows(iv.periods_and_gaps(df, ["k"], shard)) == brute(data)


def test_touching_nested_swapped_and_lacking_bounds(spark):
    data = [("a", 0, 10), ("a", 10, 20), ("a", 12, 13), ("a", 30, 30), ("a", 50, 40), ("a", None, 5), ("a", 5, None), ("a", 100, 200_000)]
    df = spark.createDataFrame(data, "k string, start_ms long, end_ms long")
    assert rows(iv.periods_and_gaps(df, ["k"])) == [("a", "gap", 20, 100), ("a", "period", 0, 20), ("a", "period", 100, 200_000)]


def test_modalities_dirt_and_clashing_columns(spark):
    data = [("m1", "s", 0, 5, [" Audio", "audio", "VIDEO "], "x", 1), ("m1", "s", 0, 5, [" Audio", "audio", "VIDEO "], "x", 1), ("m2", "s", 7, 9, ["video", None, "smell"], "x", 1), ("m3", "s", 1, 2, None, None, None), ("m4", "s", 1, 2, [], None, None), (None, "s", 90, 99, ["audio"], None, None)]
    got = rows(iv.covered(spark.createDataFrame(data, MOMENT)))
    assert got == [("s", "audio", "period", 0, 5), ("s", "video", "gap", 5, 7), ("s", "video", "period", 0, 5), ("s", "video", "period", 7, 9)]


def test_empty(spark):
    assert rows(iv.covered(spark.createDataFrame([], MOMENT))) == []
    assert rows(iv.covered(spark.createDataFrame([("m", None, 1, 3, ["audio"], None, None)], MOMENT))) == [(None, "audio", "period", 1, 3)]
