import random

import pytest
from conftest import rows

from tideline.llm import runs

SCHEMA = "id long, session_id string, pts_ms long, event_type string, description string, run string, chunk long, e string, at long"


def made(spark, data):
    return spark.createDataFrame([(*d, "x", 1, "y", 2) for d in data], SCHEMA)


def brute(data):
    out, by = [], {}
    for d in {x[0]: x for x in data}.values():
        by.setdefault(d[1], []).append(d)
    for s, ds in by.items():
        ds.sort(key=lambda d: (d[2], d[0]))
        run = []
        for d in [*ds, None]:
            a, b = (set(x[4].split()) if x and x[4] is not None else None for x in (run[-1] if run else None, d))
            if d and run and run[-1][3] == d[3] and a and b and len(a & b) * 10 >= 7 * len(a | b):
                run.append(d)
                continue
            if len(run) > 1:
                out.append((s, run[0][0], run[-1][0]))
            run = [d]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [runs.CHUNK_MS, 50, 7])
def test_random_sessions(spark, chunk, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK_MS", chunk)
    rng, data = random.Random(chunk), []
    for s in "ab":
        t = -40
        for _ in range(150):
            t += rng.choice([1, 1, 3, 60])
            text = " ".join(rng.sample(["one", "two", "three", "four"], 4)[: rng.choice([3, 4, 4, 4])]) if rng.random() > 0.05 else None
            data.append((len(data), s, t, rng.choice(["x", "x", "x", "y"]), text))
    assert rows(runs.repeated(made(spark, data + data[::7]))) == brute(data)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    data = [
        (1, "s", 1, "x", "Hello, World"), (2, "s", 2, "x", "hello world!"), (3, "s", 3, None, "hello world"), (4, "s", 4, None, "hello world"), (5, "s", 5, "x", None), (6, "s", 6, "x", None),
        (7, "s", 7, "x", ""), (8, "s", 8, "x", ""), (9, "s", 9, "x", long), (10, "s", 10, "x", long), (11, "s", None, "x", "a"), (12, None, 1, "x", "a"), (None, "s", 11, "x", "a"), (1, "s", 1, "x", "Hello, World"),
    ]
    assert rows(runs.repeated(made(spark, data))) == [("s", 1, 2), ("s", 3, 4), ("s", 9, 10)]
    assert rows(runs.repeated(made(spark, []))) == []


def test_counts_and_durations(spark):
    data = [(k, "s", 10 * k, "x", "a b") for k in range(5)] + [(9, "s", 100, "y", "a b")]
    assert rows(runs.collapse(made(spark, data))) == [("s", "x", 0, 4, 0, 40, 40, 5), ("s", "y", 9, 9, 100, 100, 0, 1)]


def test_copies_that_differ_count_once(spark):
    data = [(1, "s", 10, "x", "a b"), (2, "s", 20, "x", "a b"), (2, "s", 90, "x", "a b"), (3, "s", 30, "x", "a b"), (3, "s", 30, "x", "a b")]
    got = rows(runs.collapse(made(spark, data)))
    assert got in ([("s", "x", 1, 3, 10, 30, 20, 3)], [("s", "x", 1, 2, 10, 90, 80, 3)])
