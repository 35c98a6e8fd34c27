"""Segments along a stream, by walks over successors (``orbit``): gate decisions, rate limits, chunks of time, token windows,
and pieces of speech joined over short holes. The machines of the same names give the same rows one at a time, for streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import orbit
from tideline.operators.machines import ARTIFACT, CLOSING, ENDING, GATE_COLUMNS, GATE_SCHEMA, KEEP, SKIP, GateConfig

INDEX_WIDTH, TIME_WIDTH = 1 << 16, 1 << 22  # frame indexes and ms of a chunk: some ten thousand rows


def gate_decisions(frames: DataFrame, config: GateConfig = GateConfig(), key: str = "stream_id", width: int = INDEX_WIDTH) -> DataFrame:  # noqa: B008
    """Decisions of the gate for every frame: a frame is a keyframe if it differs by ``cut_bits`` from the last keyframe or comes
    ``keepalive_frames`` indexes after it. That is all that makes the next keyframe, so keyframes are the heads of a walk, and
    every other frame is judged against its head. Frames of one index are ordered by their other columns."""

    def breaks(pdf: pd.DataFrame, head: np.ndarray, row: np.ndarray) -> np.ndarray:
        h, index = pdf.perceptual_hash.to_numpy(), pdf.frame_index.to_numpy()
        return (np.bitwise_count((h[head] ^ h[row]).view(np.uint64)) >= config.cut_bits) | (index[row] - index[head] >= config.keepalive_frames)

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        f32, c = np.float32, config
        begins = pdf.is_head.to_numpy() & (pdf.head_number.to_numpy() == 0)
        # A head is held against the head before it, which is the last row's head.
        before = {n: np.roll(pdf[f"head_{n}"].to_numpy(), 1) for n in ("frame_index", "perceptual_hash", "luma_mean")}
        anchor = {n: np.where(pdf.is_head, np.where(pdf._first, pdf[f"_h_{n}"], before[n]), pdf[f"head_{n}"]) for n in before}
        at = np.where(begins, pdf.perceptual_hash, anchor["perceptual_hash"]).astype(np.int64)
        bits = np.bitwise_count((at ^ pdf.perceptual_hash.to_numpy(np.int64)).view(np.uint64))
        late = pdf.frame_index.to_numpy() - np.where(begins, pdf.frame_index, anchor["frame_index"]).astype(np.int64) >= c.keepalive_frames
        shift = np.abs(np.where(begins, 0, anchor["luma_mean"]).astype(f32) - pdf.luma_mean.to_numpy(f32))
        scores = [(shift, c.luma_shift, "exposure_shift")] + [(pdf[n].to_numpy(f32), limit, reason) for n, limit, reason in (
            ("flicker_score", c.flicker, "flicker_suspected"), ("ghosting_score", c.ghosting, "ghosting_suspected"), ("noise_variance_score", c.noise, "noise_variance_spike"))]
        cut = (bits >= c.cut_bits) & ~begins
        tests = [begins, cut, late, *(s >= f32(limit) for s, limit, _ in scores)]
        pdf["reason"] = np.select(tests, ["initial_frame", "scene_cut", "periodic_keepalive", *(r for _, _, r in scores)], "no_trigger")
        pdf["event_type"] = np.select([tests[0] | tests[1] | tests[2], np.logical_or.reduce(tests[3:])], [KEEP, ARTIFACT], SKIP)
        sure = [np.ones(len(pdf)), bits / 64, np.ones(len(pdf)), *(np.clip(s, 0, 1) for s, _, _ in scores)]
        pdf["confidence"] = np.select(tests, sure, 0.0).astype(f32)
        return pdf

    order = ["frame_index", "pts_ms", *GATE_COLUMNS[2:]]
    rows = frames.select(key, *GATE_COLUMNS)
    held = ["frame_index", "perceptual_hash", "luma_mean"]
    return orbit.walked(rows, key, order, held, orbit.first_that(breaks), config.keepalive_frames, max(width, config.keepalive_frames), judged, GATE_SCHEMA)


def rate_limited(rows: DataFrame, fps: int, key: str, time: str, id_col: str, width: int = TIME_WIDTH) -> DataFrame:
    """(key, pts_ms, id) of the rows kept when at least ``1000 // fps`` ms must pass since the last kept one."""
    step = 1000 // max(fps, 1)
    out = _timed(rows, key, time, id_col, step, width)
    return out.where("is_head").select(key, F.col("_t").alias("pts_ms"), F.col("_i").alias(id_col))


def time_chunks(rows: DataFrame, window_ms: int, key: str, time: str, id_col: str, width: int = TIME_WIDTH) -> DataFrame:
    """(key, id, pts_ms, chunk, chunk_start_ms): windows that begin at a row and take the rows less than ``window_ms`` after it."""
    out = _timed(rows, key, time, id_col, window_ms, width)
    return out.select(key, F.col("_i").alias(id_col), F.col("_t").alias("pts_ms"), F.col("head_number").alias("chunk"), F.col("head__t").alias("chunk_start_ms"))


def _timed(rows: DataFrame, key: str, time: str, id_col: str, step: int, width: int, cost: Column | None = None) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.select(key, F.col(time).cast("long").alias("_t"), F.col(id_col).alias("_i"), (F.lit(0) if cost is None else cost).cast("long").alias("cost"))
    schema = f"_t long, _i {kind}, cost long, is_head boolean, head_number long, head__t long"
    return orbit.walked(rows, key, ["_t", "_i"], ["_t"], orbit.after_at_least("_t", step), step, max(width, step), lambda pdf: pdf, schema)


def token_budget(rows: DataFrame, tokens: int, key: str, time: str, id_col: str, text: str, window_ms: int = 1000) -> DataFrame:
    """(key, id, pts_ms, allowed, used): outputs are made while fewer than ``tokens`` estimated tokens (a quarter of the
    characters) were used in their window of time. ``used`` counts only outputs that were made, so a window's use is the least of
    what all would have used and of the first sum that is not below the budget."""
    placed = _timed(rows, key, time, id_col, window_ms, TIME_WIDTH, F.floor(F.coalesce(F.length(text), F.lit(0)) / 4))
    w = Window.partitionBy(key, "head_number").orderBy("_t", "_i")
    placed = placed.withColumn("_all", F.sum("cost").over(w)).withColumn("allowed", F.col("_all") - F.col("cost") < tokens)
    return placed.select(key, F.col("_i").alias(id_col), F.col("_t").alias("pts_ms"), "allowed", F.max(F.when(F.col("allowed"), F.col("_all"))).over(w).alias("used"))


def _joined_pieces(rows: DataFrame, key: str, gap: int, span: int, ends: Column, width: int) -> DataFrame:
    """``rows`` (key, a, b, ends, ...) with the number of their group: one begins after a hole of more than ``gap``, at a piece
    that would make the group longer than ``span``, and after a piece that ``ends`` one."""

    def breaks(pdf: pd.DataFrame, head: np.ndarray, row: np.ndarray) -> np.ndarray:
        a, b, closed = pdf.a.to_numpy(), pdf.b.to_numpy(), pdf._ends.to_numpy(bool)
        return (a[row] - b[row - 1] > gap) | (b[row] - a[head] > span) | closed[row - 1]

    names = [c for c in rows.columns if c != key]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", head_number long"
    reach = max(gap, span) + 1
    return orbit.walked(rows.withColumn("_ends", ends), key, ["a", "b", *(n for n in names if n not in ("a", "b"))], ["a"], orbit.first_that(breaks), reach, max(width, reach), lambda pdf: pdf, schema)


def speech_ranges(pieces: DataFrame, duration: int, key: str = "stream_id", least: int = 250, gap: int = 1000, span: int = 20_000, pad: int = 300, width: int = TIME_WIDTH) -> DataFrame:
    """(key, a_ms, b_ms, confidence): ranges of speech (start_ms, end_ms, confidence), cut to ``[0, duration]``, without those
    shorter than ``least``, joined over holes of at most ``gap`` up to a length of ``span``, widened by ``pad`` on both sides."""
    within = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.lit(duration))).cast("long")
    rows = pieces.select(key, within("start_ms").alias("a"), within("end_ms").alias("b"), F.col("confidence").cast("double").alias("confidence")).where(F.col("b") - F.col("a") >= least)
    groups = _joined_pieces(rows, key, gap, span, F.lit(False), width).groupBy(key, "head_number")
    out = groups.agg(F.min("a").alias("a"), F.max_by("b", F.struct("a", "b", "confidence")).alias("b"), F.max("confidence").alias("confidence"))
    return out.select(key, F.greatest(F.lit(0).cast("long"), F.col("a") - pad).alias("a_ms"), F.least(F.lit(duration).cast("long"), F.col("b") + pad).alias("b_ms"), "confidence")


def transcripts(pieces: DataFrame, key: str = "stream_id", gap: int = 750, span: int = 8000, width: int = TIME_WIDTH) -> DataFrame:
    """(key, a_ms, b_ms, text): transcript pieces (start_ms, end_ms, transcript) joined over holes of at most ``gap``, up to ``span``
    and to the end of a sentence. Blank and empty pieces are left out; no blank goes before a closing mark."""
    said = F.trim(F.regexp_replace(F.coalesce("transcript", F.lit("")), r"\s+", " "))
    rows = pieces.select(key, F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), said.alias("text")).where("text != '' and b > a")
    groups = _joined_pieces(rows, key, gap, span, F.col("text").rlike(f"[{ENDING}]$"), width).groupBy(key, "head_number")
    out = groups.agg(F.array_sort(F.collect_list(F.struct("a", "b", "text"))).alias("p"))
    blank = lambda x, k: F.when((k == 0) | x["text"].rlike(f"^[{CLOSING}]"), "").otherwise(" ")
    glued = F.array_join(F.transform("p", lambda x, k: F.concat(blank(x, k), x["text"])), "")
    return out.select(key, F.col("p")[0]["a"].alias("a_ms"), F.element_at("p", -1)["b"].alias("b_ms"), glued.alias("text"))
