import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline.llm import near

FRAME = "frame_id long, stream_id string, perceptual_hash long, h long, s long"
EVENT = "id long, run_id string, description string, node long, g string, key string"


def frames(spark, data):
    return spark.createDataFrame([(*d, 1, 2) for d in data], FRAME)


def events(spark, data):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in data], EVENT)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("bits,wide", [(6, 2), (6, 3), (6, 4), (0, 2), (3, 2)])
def test_every_pair_within_the_distance(bits, wide):
    rng = np.random.default_rng(bits + wide)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    h = np.repeat(base, 8)
    for k in range(len(h)):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            h[k] ^= np.uint64(1) << np.uint64(b)
    s = np.arange(len(h)) % 5
    m = bits + wide
    found = []
    for first in range(bits + 1):
        for a, b in near._pairs_in(h, s, np.full(len(h), first, np.int8), np.full(len(h), -1, np.int8), bits, m, wide):
            found += [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if s[i] != s[j] and (int(h[i]) ^ int(h[j])).bit_count() <= bits}
    assert len(found) == len(set(found)) and set(found) == want


def test_blocks_cover_all_bits():
    for m in range(2, 13):
        assert sum(w for _, w in near._blocks(m)) == 64
    assert near._matched_blocks(10**6, 6) == 2 and near._matched_blocks(10**7, 6) == 3


def test_frames_of_different_streams(spark):
    data = [(1, "a", 0), (2, "b", 0b111111), (3, "b", 0b1111111), (4, "a", 1), (5, "b", None), (6, None, 0), (None, "b", 0), (7, "c", signed(2**63)), (1, "a", 0), (8, "d", -1)]
    got = rows(near.frame_pairs(frames(spark, data)))
    assert got == [(1, 2), (1, 7), (2, 4), (3, 4), (4, 7)]


def test_a_crowded_block_is_split(spark):
    rng = random.Random(3)
    data = [(i, f"s{i % 7}", signed((rng.getrandbits(50) << 14 if i % 3 else rng.getrandbits(6)))) for i in range(600)]
    df = frames(spark, data).selectExpr("perceptual_hash as h", "xxhash64(stream_id) as s").distinct()
    key = lambda r: tuple(sorted([(r[0], r[1]), (r[2], r[3])]))
    one, split = ([key(r) for r in near.hash_pairs(df, 6, c).collect()] for c in (10**9, 20))
    assert len(one) == len(set(one)) == len(split) and set(one) == set(split) and one


def long_text(rng, n=30):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def grams(text):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:])) if len(w) >= 15 else None


def brute(data):
    out = set()
    for i, (a, r, t) in enumerate(data):
        for b, q, u in data[i + 1 :]:
            x, y = grams(t), grams(u)
            if a != b and r != q and x and y and 2 * len(x & y) >= len(x | y):
                out.add((min(a, b), max(a, b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [4096, 5])
def test_texts_with_edits(spark, most):
    rng, data = random.Random(4), []
    for k in range(60):
        base = long_text(rng)
        for c in range(4):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = "edit"
            data.append((10 * k + c, f"run{rng.randrange(6)}", ", ".join(t).upper() if c else " ".join(t)))
    links, members = near.text_links(events(spark, data), "id", "run_id", "description", most=most)
    by = {}
    for i, g, n in members.collect():
        by.setdefault(n, []).append((i, g))
    got = {(min(x, y), max(x, y)) for a, b in [tuple(r) for r in links.collect()] + [(n, n) for n in by] for x, g in by[a] for y, h in by[b] if x != y and g != h}
    assert sorted(got, key=str) == brute(data)


def test_a_crowded_key_is_spread_and_loses_no_pair(spark):
    rng = random.Random(8)
    base = long_text(rng, 40)
    data = []
    for k in range(80):
        t = list(base)
        t[rng.randrange(40)] = f"edit{k}"
        data.append((k, f"run{k % 4}", " ".join(t)))
    got = {m: rows(near.text_pairs(events(spark, data), "id", "run_id", "description", **({} if m else {"similarity": 0.5}))) for m in (0, 1)}
    links, _ = near.text_links(events(spark, data), "id", "run_id", "description", most=30)
    whole, _ = near.text_links(events(spark, data), "id", "run_id", "description")
    assert got[0] == got[1] == brute(data)
    pair = lambda df: {tuple(sorted(r)) for r in df.collect()}
    assert pair(links) == pair(whole) and links.count() == whole.count() > 2000


def test_text_edges(spark):
    words = " ".join(f"w{k}" for k in range(15))
    very_long = " ".join(f"v{k}" for k in range(20_000))
    data = [(1, "a", words), (2, "b", words.upper() + "!"), (3, "b", None), (4, "c", ""), (5, "c", "w0 " * 14), (6, None, words), (7, "a", very_long), (8, "b", very_long + " end"), (1, "a", words), (9, "a", words), (None, "z", words)]
    assert rows(near.text_pairs(events(spark, data), "id", "run_id", "description")) == [(1, 2), (2, 9), (7, 8)]


def test_nothing(spark):
    assert rows(near.found(frames(spark, []), events(spark, []))) == []
    assert rows(near.classes(frames(spark, []), events(spark, []))) == []


@pytest.mark.parametrize("shape,hub", [("line", 10**6), ("star", 10**6), ("star", 7), ("random", 3)])
def test_components(spark, shape, hub):
    rng = random.Random(6)
    edges = {"line": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 80)] + [(500, 501)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]}[shape]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = dict(tuple(r) for r in near.components(spark.createDataFrame([*edges, edges[0], (3, 3)], "a long, b long"), hub).collect())
    assert got == {k: top(k) for k in root}


def test_classes_are_components(spark):
    f = [(1, "a", 0), (2, "b", 0b111), (3, "c", 0b111111000), (4, "d", -1), (9, "d", None)]
    t = " ".join(f"w{k}" for k in range(20))
    e = [(5, "r", t), (6, "q", t), (7, "q", t + " x"), (8, "p", "alone " * 20), (10, "p", None), (11, None, t)]
    got = rows(near.classes(frames(spark, f), events(spark, e)))
    assert got == sorted([("frame", 1, 1, 2), ("frame", 2, 1, 1), ("frame", 3, 1, 1), ("frame", 4, 4, 0), ("frame", 9, 9, 0), ("event", 5, 5, 1), ("event", 6, 5, 1), ("event", 7, 5, 1), ("event", 8, 8, 0), ("event", 10, 10, 0), ("event", 11, 11, 0)], key=str)


def test_recall_beyond_the_number_of_nodes_that_changes_the_bands(spark, monkeypatch):
    rng, data = random.Random(12), []
    for k in range(150):
        base = long_text(rng, 40)
        for c in range(2):
            t = list(base)
            for at in rng.sample(range(40), 4 if c else 0):
                t[at] = f"edit{k}{at}"
            data.append((2 * k + c, f"run{c}", " ".join(t)))
    want = brute(data)
    assert len(want) > 60 and near.banding(300, 0.5)[0] == 3
    monkeypatch.setattr(near, "NODES_PER_KEY", 30)
    assert near.banding(300, 0.5)[0] == 5
    got = rows(near.text_pairs(events(spark, data), "id", "run_id", "description"))
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert set(got) <= set(rows(near.text_pairs(events(spark, data), "id", "run_id", "description", agree=1)))


def test_banding_keeps_its_recall_at_any_size():
    for n in (10, 10**6, 10**8):
        r, b = near.banding(n, 0.5)
        p = 0.5**r
        assert 1 - (1 - p) ** b - b * p * (1 - p) ** (b - 1) > 0.994


@pytest.mark.parametrize("most", [4096, 2])
def test_runs_of_equal_32_bit_hash_are_different_runs(spark, most):
    same = spark.range(200_000).selectExpr("concat('run-', id) AS r").groupBy(F.hash("r").bitwiseOR(F.lit(1)).alias("x")).agg(F.collect_list("r").alias("r")).where("size(r) > 1").first().r[:2]
    t = " ".join(f"w{k}" for k in range(20))
    e = events(spark, [(1, same[0], t), (2, same[1], t + " x"), (3, same[0], t + " y")])
    links, members = near.text_links(e, "id", "run_id", "description", most=most)
    node = {r.node: r.id for r in members.collect()}
    assert {tuple(sorted((node[r.a], node[r.b]))) for r in links.collect()} == {(1, 2), (2, 3)}
