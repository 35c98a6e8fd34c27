import random

import pytest
from conftest import rows

from tideline.operators import windows as w

FRAME = "stream_id string, frame_index long, frame_id long, pts_ms long, event_type string, confidence double, text string, pts long"


def made(spark):
    rng, data = random.Random(2), []
    for s, n in (("a", 300), ("b", 3), ("c", 40)):
        index = rng.randrange(50)
        for _ in range(n):
            index += rng.choice([1, 1, 1, 2, 90])
            data.append((s, index, len(data), index * 40 + rng.randrange(90), rng.choice("xy"), rng.random(), rng.choice(["one two", "one two", "three", " ", None]), index * 3600 + rng.randrange(9000)))
    return spark.createDataFrame(data, FRAME)


OPERATORS = {
    "normal_time": lambda f, n: w.normal_time(f, 1, 90_000, n).select("frame_id", "normal_ms"),
    "emitted": lambda f, n: w.emitted(f, "stream_id", "text", ("frame_index", "frame_id"), n).select("frame_id", "suppressed"),
    "transitions": lambda f, n: w.transitions(f, "stream_id", "text", ("frame_index", "frame_id"), width=n).select("frame_id", "similarity"),
    "segments": lambda f, n: w.segments(f, width=n),
    "chunks": lambda f, n: w.chunks(f, 7, n).select("frame_id", "chunk"),
    "fps": lambda f, n: w.fps(f, n),
    "index_runs": lambda f, n: w.index_runs(f, "stream_id", "frame_index", n),
    "collapsed": lambda f, n: w.collapsed(f, "stream_id", "text", ("frame_index", "frame_id"), n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stretches_give_what_the_whole_stream_gives(spark, name):
    f = made(spark)
    whole = rows(OPERATORS[name](f, 1 << 40))
    assert rows(OPERATORS[name](f, 16)) == whole and whole


def test_run_expression():
    assert w.run_expression([(0, 0), (3, 9)]) == "eq(n,0)+between(n,3,9)" and w.run_expression([]) == "0"
