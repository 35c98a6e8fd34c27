"""Faulty readings (problem 4): physical limits, run-length counters and robust exponentially weighted control charts.

Per stream and measure a chart follows level and scale with exponential weights. A reading further than ``SUSPECT`` scales
from the level is suspected: it updates neither, however many there are, and is counted. After more than ``LONGEST`` suspected
readings in a row the chart takes their level as the new one, and that run is no spike. Charts run forwards and backwards;
a spike is a short run that departs from the level on both of its sides, so neither a change of level nor its return is one.
The departure is then held exactly against ``LIMIT`` times the standard deviation of the stream's ordinary readings.

What a stream is held against is the stream's, whatever its length: the value it rests at and the deviation of its ordinary
readings. The deviation comes from a mergeable table, the readings' distances from their neighbours in octaves with number,
sum of squares, least and most of each. Short streams are judged in one pass. A stream of more than ``CHUNK`` frames is cut into
chunks of about that many, each with ``HALO`` frames of its neighbours on either side to warm the charts up and complete
stuck runs; its resting value and its octaves are first merged over all chunks, then each chunk's own frames are judged. So a
stream with a third of all rows is many tasks. The charts of a group of streams, of all measures and both ways, advance together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.chunks import in_chunks
from tideline.runtime import spread_groups, written

MEASURES = ("luma_mean", "flicker_score", "noise_variance_score")
SUSPECT, LIMIT, LONGEST = 6.0, 10.0, 3
LEVEL_WEIGHT, SCALE_WEIGHT, CLIP = 0.2, 0.02, 3.0
STUCK = 10
CHUNK, HALO = 4096, 512
ROWS_PER_GROUP = 400_000
SMALLEST = 1e-6
REACH = 4  # neighbours on either side that give a reading's level for its distance
OCTAVES = 22  # 0: at most SMALLEST; distances of readings in [0, 1] end in the last but one


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """For each position the length of its run, where ``same[k]`` says that ``k`` goes on with ``k - 1``'s run."""
    number = np.cumsum(~same) - 1
    return np.bincount(number)[number] if len(same) else np.zeros(0, np.int64)


def _starts(series: np.ndarray) -> np.ndarray:
    """Where each series begins, and the end of the last."""
    return np.r_[np.flatnonzero(np.r_[True, series[1:] != series[:-1]]), len(series)] if len(series) else np.zeros(1, np.int64)


def _neighbour_median(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Median of up to ``2 * REACH + 1`` readings around each of its series; series lie one after another."""
    lengths = np.diff(starts)
    step, rest = np.arange(len(value)) - np.repeat(starts[:-1], lengths), None
    rest = np.repeat(lengths, lengths) - 1 - step
    near = np.full((len(value), 2 * REACH + 1), np.inf, np.float32)
    for k in range(-REACH, REACH + 1):
        a, b = max(0, -k), len(value) - max(0, k)
        if a < b:
            inside = (step[a:b] >= -k) if k < 0 else (rest[a:b] >= k)
            near[a:b, k + REACH] = np.where(inside, value[a + k : b + k], np.inf)
    near.sort(axis=1)  # lacking ones go last
    count = np.minimum(step, REACH) + np.minimum(rest, REACH) + 1
    at = np.arange(len(value))
    return (near[at, (count - 1) // 2].astype(float) + near[at, count // 2]) / 2


def _octaves(value: np.ndarray, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(series, octave, 4) with number, sum of squares, least and most of the own readings' distances from their neighbours.
    Two distances in one octave differ by less than twice, so a jump of the sorted distances lies between two octaves."""
    n = len(starts) - 1
    size = np.abs(value - _neighbour_median(value, starts))[own]
    series = np.repeat(np.arange(n), np.diff(starts))[own]
    octave = np.where(size <= SMALLEST, 0, np.clip(np.frexp(np.maximum(size, SMALLEST))[1] + 20, 1, OCTAVES - 1))
    cell = series * OCTAVES + octave
    out = np.zeros((n * OCTAVES, 4))
    out[:, 0] = np.bincount(cell, minlength=len(out))
    out[:, 1] = np.bincount(cell, size**2, minlength=len(out))
    out[:, 2] = np.inf
    np.minimum.at(out[:, 2], cell, size)
    np.maximum.at(out[:, 3], cell, size)
    return out.reshape(n, OCTAVES, 4)


def _ordinary_scale(octaves: np.ndarray) -> np.ndarray:
    """Standard deviation of the ordinary readings about the level, per series. Ordered by size, ordinary readings end where the
    next one departs by at least ``LIMIT`` times the deviation of all before it and twice as far as the last of them. They are
    more than half of the readings that are off the level at all, and more than ``LONGEST``, as fewer hold no level."""
    number, squares, least, most = np.moveaxis(octaves, 2, 0)
    count, whole = np.cumsum(number, axis=1), number.sum(axis=1, keepdims=True)
    deviation = np.sqrt(np.cumsum(squares, axis=1) / np.maximum(count, 1))
    last = np.maximum.accumulate(most, axis=1)
    after = np.minimum.accumulate(np.c_[least[:, 1:], np.full((len(least), 1), np.inf)][:, ::-1], axis=1)[:, ::-1]
    # Most readings of a resting series are on its level, so half of the others counts; a few beyond all others always may be spikes.
    half = np.minimum((whole + number[:, :1]) // 2 + 1, np.ceil(0.93 * whole))
    # Where the ordinary ones do not scatter at all, any other value would be a jump; then only a few may lie beyond it.
    enough = np.maximum(np.where(deviation > SMALLEST, half, 0.99 * whole - LONGEST), LONGEST + 1)
    jump = (number > 0) & (after >= LIMIT * np.maximum(deviation, SMALLEST)) & (after >= 2 * last) & (count >= enough) & (count < whole)
    at = np.where(jump.any(axis=1), jump.argmax(axis=1), OCTAVES - 1)
    return np.maximum(np.take_along_axis(deviation, at[:, None], 1)[:, 0], SMALLEST)


def _spikes(value: np.ndarray, starts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Which readings are spikes; ``scale`` is per series. The readings of one step of all charts lie together, charts by
    falling length, both ways of a series side by side, so that a step is one slice and nothing is padded."""
    lengths = np.diff(starts)
    if not len(value):
        return np.zeros(0, bool)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")
    offset = 2 * np.r_[0, np.cumsum(active)]
    step = np.arange(len(value)) - np.repeat(starts[:-1], lengths)
    column = 2 * np.repeat(rank, lengths)
    ahead = offset[step] + column
    back = offset[np.repeat(lengths, lengths) - 1 - step] + column + 1
    x = np.empty(2 * len(value))
    x[ahead], x[back] = value, value
    n = 2 * len(order)
    s0 = np.repeat(scale[order], 2)
    first = np.full((2 * LONGEST + 9, n), np.inf)
    for t in range(min(len(first), len(active))):
        first[t, : 2 * active[t]] = x[offset[t] : offset[t + 1]]
    first.sort(axis=0)
    held = np.minimum(np.repeat(lengths[order], 2), len(first))
    m = (first[(held - 1) // 2, np.arange(n)] + first[held // 2, np.arange(n)]) / 2
    v, least, counter = s0**2, s0 / 2, np.zeros(n, np.int64)
    level, odd_at = np.empty(len(x)), np.empty(len(x), bool)
    for t, k in enumerate(2 * active):
        a = offset[t]
        s = np.maximum(np.sqrt(v[:k]), least[:k])
        r = x[a : a + k] - m[:k]
        odd = np.abs(r) > SUSPECT * s
        level[a : a + k], odd_at[a : a + k] = m[:k], odd
        limit = CLIP * s
        r = np.minimum(np.maximum(r, -limit), limit)
        r[odd] = 0.0
        m[:k] += LEVEL_WEIGHT * r
        change = SCALE_WEIGHT * (r * r - v[:k])
        change[odd] = 0.0
        v[:k] += change
        if odd.any():
            counter[:k] = (counter[:k] + 1) * odd
            full = np.flatnonzero(counter[:k] > LONGEST)
            if len(full):
                m[full] = sum(x[offset[t - j] + full] for j in range(LONGEST + 1)) / (LONGEST + 1)
                counter[full] = 0
        else:
            counter[:k] = 0
    spike, new = np.ones(len(value), bool), step == 0
    bound = LIMIT * np.repeat(scale, lengths)
    for at in (ahead, back):
        odd = odd_at[at]
        same = np.zeros(len(value), bool)
        same[1:] = odd[1:] == odd[:-1]
        same &= ~new
        spike &= odd & (_run_lengths(same) <= LONGEST) & (np.abs(value - level[at]) >= bound)
    return spike


class _Readings:
    """The readings of whole series (stream and chunk) in order, each frame once, and what can be said of them at once."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(["s", "chunk", "frame_index", "frame_id"], kind="stable")
        key = pdf[["s", "chunk", "frame_index", "frame_id"]].to_numpy()
        self.pdf = pdf = pdf[np.r_[True, (key[1:] != key[:-1]).any(axis=1)]]
        key = pdf[["s", "chunk"]].to_numpy()
        self.new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        self.series, self.own = np.cumsum(self.new) - 1, pdf.own.to_numpy()
        self.first = np.flatnonzero(self.new)
        self.value, self.present, self.possible, self.held = {}, {}, {}, {}
        for m in MEASURES:
            v, present = pdf[m].to_numpy(np.float32), ~pdf[f"no_{m}"].to_numpy()
            with np.errstate(invalid="ignore"):
                possible = present & (v >= 0) & (v <= 1)
            same = np.zeros(len(v), bool)
            same[1:] = possible[1:] & possible[:-1] & (v[1:] == v[:-1]) & ~self.new[1:]
            self.value[m], self.present[m], self.possible[m], self.held[m] = v, present, possible, possible & (_run_lengths(same) >= STUCK)

    def resting(self, m: str) -> np.ndarray:
        """Per series the value that more than half of its frames show (so the middle of the possible ones), or NaN."""
        v, n, possible = self.value[m], len(self.first), self.possible[m]
        at = np.flatnonzero(possible)
        at = at[np.lexsort((v[at], self.series[at]))]
        begin, end = (np.searchsorted(self.series[at], np.arange(n), side) for side in ("left", "right"))
        middle = np.full(n, np.nan, np.float32)
        some = end > begin
        middle[some] = v[at[(begin[some] + end[some]) // 2]]
        with np.errstate(invalid="ignore"):
            shown = np.bincount(self.series[possible & (v == middle[self.series])], minlength=n)
        return np.where(2 * shown > np.bincount(self.series, minlength=n), middle, np.float32(np.nan))

    def free(self, rest: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The readings that charts follow, of all measures one after another: which row, which series, value. Impossible and
        stuck ones are none; those at the resting value are."""
        rows, series = [], []
        for k, m in enumerate(MEASURES):
            with np.errstate(invalid="ignore"):
                resting = self.value[m] == rest[m][self.series]
            at = np.flatnonzero(self.possible[m] & (~self.held[m] | resting))
            rows.append(at)
            series.append(self.series[at] + k * len(self.first))
        value = np.concatenate([self.value[m][at] for m, at in zip(MEASURES, rows, strict=True)]).astype(float)
        return np.concatenate(rows), np.concatenate(series), value

    def faults(self, rest: dict[str, np.ndarray], rows: np.ndarray, series: np.ndarray, spike: np.ndarray) -> pd.DataFrame:
        parts, number = [], series // max(len(self.first), 1)
        frame = self.pdf.frame_id.to_numpy()
        for k, m in enumerate(MEASURES):
            with np.errstate(invalid="ignore"):
                stuck = self.held[m] & ~(self.value[m] == rest[m][self.series])
            peak = np.zeros(len(frame), bool)
            peak[rows[(number == k) & spike]] = True
            for fault, where in (("impossible", self.present[m] & ~self.possible[m]), ("spike", peak), ("stuck", stuck)):
                parts.append(pd.DataFrame({"frame_id": frame[where & self.own], "measure": m, "fault": fault}))
        return pd.concat(parts)


def _judge_whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """Faults of streams that are here as a whole."""
    r = _Readings(pdf)
    rest = {m: r.resting(m) for m in MEASURES}
    rows, series, value = r.free(rest)
    starts = _starts(series)
    scale = _ordinary_scale(_octaves(value, starts, np.ones(len(value), bool)))
    return r.faults(rest, rows, series, _spikes(value, starts, scale))


def _given(r: _Readings, what: str) -> dict[str, np.ndarray]:
    return {m: r.pdf[f"{what}_{m}"].to_numpy(np.float32 if what == "rest" else float)[r.first] for m in MEASURES}


def _judge_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Faults of the own frames of chunks, with their stream's resting values and scales."""
    r = _Readings(pdf)
    rest = _given(r, "rest")
    rows, series, value = r.free(rest)
    starts = _starts(series)
    scale = np.concatenate(list(_given(r, "scale").values()))[series[starts[:-1]]] if len(value) else np.zeros(0)
    return r.faults(rest, rows, series, _spikes(value, starts, scale))


def _octaves_of_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Octaves of the own readings of chunks, one row per stream, measure and octave."""
    r = _Readings(pdf)
    rows, series, value = r.free(_given(r, "rest"))
    starts = _starts(series)
    octaves = _octaves(value, starts, r.own[rows])
    which, octave = np.nonzero(octaves[:, :, 0])
    of = series[starts[:-1]][which]
    out = pd.DataFrame(octaves[which, octave], columns=["n", "squares", "least", "most"])
    out["stream_id"] = r.pdf.stream_id.to_numpy()[r.first[of % len(r.first)]]
    out["measure"], out["octave"] = of // len(r.first), octave
    return out.groupby(["stream_id", "measure", "octave"], as_index=False).agg({"n": "sum", "squares": "sum", "least": "min", "most": "max"})


def _scales(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    octaves = np.zeros((len(MEASURES), OCTAVES, 4))
    octaves[:, :, 2] = np.inf
    octaves[pdf.measure, pdf.octave] = pdf[["n", "squares", "least", "most"]].to_numpy()
    return pd.DataFrame([(key[0], *_ordinary_scale(octaves))], columns=["stream_id", *(f"scale_{m}" for m in MEASURES)])


def _rests(chunked: DataFrame) -> DataFrame:
    """(stream_id, rest_...) of long streams whose frames lie in ``chunked``. A value that more than half of the frames show
    holds the ranks about 45 % or about 55 % of the possible values; so two sketched quantiles are all there is to count."""
    own = chunked.where("own")
    possible = lambda m: F.when(F.col(m).between(0, 1), F.col(m))
    guess = own.groupBy("stream_id").agg(*[F.percentile_approx(possible(m), [0.45, 0.55], 1000).alias(f"q_{m}") for m in MEASURES])
    shown = own.join(guess, "stream_id").groupBy("stream_id").agg(
        F.count("*").alias("frames"), *[F.first(f"q_{m}").alias(f"q_{m}") for m in MEASURES], *[F.count_if(F.col(m) == F.col(f"q_{m}")[k]).alias(f"n{k}_{m}") for m in MEASURES for k in (0, 1)]
    )
    rest = lambda m: F.when(2 * F.col(f"n0_{m}") > F.col("frames"), F.col(f"q_{m}")[0]).when(2 * F.col(f"n1_{m}") > F.col("frames"), F.col(f"q_{m}")[1])
    return written(shown.select("stream_id", *[rest(m).alias(f"rest_{m}") for m in MEASURES]))


FAULT = "frame_id long, measure string, fault string"


def faults(frames: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """(frame_id, measure, fault) of every faulty reading; ``fault`` is ``impossible``, ``stuck`` or ``spike``.

    A null reading is no fault and breaks a run of equal ones. NaN and infinity are impossible. Rows present twice with one
    ``frame_id`` count once; rows without ``frame_id``, ``stream_id`` or ``frame_index`` are left out; frames that share an
    index are ordered by ``frame_id``. A stuck value that more than half of the stream's frames show is its rest.
    """
    spark = frames.sparkSession
    rows = frames.select("frame_id", "stream_id", "frame_index", *MEASURES).where("frame_id is not null and stream_id is not null and frame_index is not null")
    rows, total, any_long = in_chunks(rows, "stream_id", "frame_index", chunk, halo)
    groups = spread_groups(spark, total, ROWS_PER_GROUP)
    sent = ["s", "chunk", "own", "frame_id", "frame_index", *MEASURES, *(f"no_{m}" for m in MEASURES)]
    rows = rows.withColumns({"g": F.pmod(F.xxhash64("stream_id", "chunk"), F.lit(groups)).cast("int"), "s": F.xxhash64("stream_id"), **{f"no_{m}": F.col(m).isNull() for m in MEASURES}})
    grouped = lambda df, step, schema: df.repartitionById(groups, "g").groupBy("g").applyInPandas(step, schema)
    whole = grouped(rows.where("not long").select("g", *sent), _judge_whole, FAULT)
    if not any_long:
        return whole
    chunked = written(rows.where("long").select("g", "stream_id", *sent).dropDuplicates(["stream_id", "chunk", "frame_id"]))
    # One row per long stream: the planner broadcasts these tables by their measured size.
    with_rest = chunked.join(_rests(chunked), "stream_id")
    octave = "stream_id string, measure int, octave int, n double, squares double, least double, most double"
    octaves = grouped(with_rest, _octaves_of_chunks, octave).groupBy("stream_id", "measure", "octave").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))
    scales = written(octaves.groupBy("stream_id").applyInPandas(_scales, "stream_id string, " + ", ".join(f"scale_{m} double" for m in MEASURES)))
    return whole.unionByName(grouped(with_rest.join(scales, "stream_id"), _judge_chunks, FAULT))
