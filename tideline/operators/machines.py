"""Fold machines over ordered frames, clips, speech ranges, transcripts and moments."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial

import numpy as np

from tideline.operators.fold import Machine


@dataclass(frozen=True)
class GateConfig:
    keepalive_frames: int = 30
    cut_bits: int = 18
    luma_shift: float = 0.15
    flicker: float = 0.55
    ghosting: float = 0.55
    noise: float = 0.55

    def __post_init__(self) -> None:
        if self.keepalive_frames < 1 or not 0 <= self.cut_bits <= 64:
            raise ValueError("keepalive_frames must be positive and cut_bits in [0, 64]")
        if any(not 0 <= x <= 1 for x in (self.luma_shift, self.flicker, self.ghosting, self.noise)):
            raise ValueError("thresholds must be in [0, 1]")


KEEP, ARTIFACT, SKIP = "keep_keyframe", "suspect_artifact", "skip"
GATE_COLUMNS = ["frame_index", "pts_ms", "perceptual_hash", "luma_mean", "flicker_score", "ghosting_score", "noise_variance_score"]
GATE_SCHEMA = "frame_index long, pts_ms long, event_type string, reason string, confidence float"
F32 = np.float32


def _unit(x: float) -> float:
    return float(min(max(x, 0.0), 1.0))


class Gate(Machine):
    """Keeps a frame that differs from the last kept one, flags artifacts, skips the rest. The first rule that holds wins.
    Only a kept frame becomes the one to compare with."""

    def __init__(self, config: GateConfig = GateConfig()) -> None:  # noqa: B008
        self.config, self.anchor = config, None

    def decide(self, row: tuple) -> tuple[str, str, float]:
        index, _, h, luma, flicker, ghosting, noise = row
        c, at = self.config, self.anchor or (0, 0, F32(0))
        bits, shift = ((at[1] ^ h) & (2**64 - 1)).bit_count(), abs(F32(at[2]) - F32(luma))
        if self.anchor is None:
            return KEEP, "initial_frame", 1.0
        if bits >= c.cut_bits:
            return KEEP, "scene_cut", bits / 64
        if max(index - at[0], 0) >= c.keepalive_frames:
            return KEEP, "periodic_keepalive", 1.0
        for score, limit, reason in ((shift, c.luma_shift, "exposure_shift"), (flicker, c.flicker, "flicker_suspected"), (ghosting, c.ghosting, "ghosting_suspected"), (noise, c.noise, "noise_variance_spike")):
            if F32(score) >= F32(limit):
                return ARTIFACT, reason, _unit(score)
        return SKIP, "no_trigger", 0.0

    def keep(self, row: tuple) -> None:
        self.anchor = (row[0], row[2], F32(row[3]))

    def __call__(self, row: tuple) -> Iterable[tuple]:
        kind, reason, confidence = self.decide(row)
        if kind == KEEP:
            self.keep(row)
        return [(row[0], row[1], kind, reason, confidence)]


@dataclass(frozen=True)
class ZoneConfig:
    enter: float = 0.4
    exit: float = 0.2
    enter_frames: int = 2
    exit_frames: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.exit <= self.enter <= 1 or min(self.enter_frames, self.exit_frames) < 1:
            raise ValueError("need 0 <= exit <= enter <= 1 and positive streaks")


class Zone(Machine):
    """Activity in a zone with hysteresis: enters after a streak of scores at or above one bound, leaves after a streak at or
    below the other. Row: (pts_ms, score)."""

    def __init__(self, config: ZoneConfig = ZoneConfig()) -> None:  # noqa: B008
        self.config, self.active, self.streak = config, False, 0

    def __call__(self, row: tuple) -> Iterable[tuple]:
        pts, score = row
        c = self.config
        hit = F32(score) <= F32(c.exit) if self.active else F32(score) >= F32(c.enter)
        self.streak = self.streak + 1 if hit else 0
        if self.streak < (c.exit_frames if self.active else c.enter_frames):
            return ()
        out = (pts, "exited" if self.active else "entered", float(score), self.streak)
        self.active, self.streak = not self.active, 0
        return [out]


ZONE_SCHEMA = "pts_ms long, transition string, motion_score float, streak int"


class RateGate(Machine):
    """Keeps a row when at least ``1000 // fps`` ms have passed since the last kept one. Row: (pts_ms, id)."""

    def __init__(self, fps: int = 1) -> None:
        self.step, self.last = 1000 // max(fps, 1), None

    def __call__(self, row: tuple) -> Iterable[tuple]:
        if self.last is not None and max(row[0] - self.last, 0) < self.step:
            return ()
        self.last = row[0]
        return [row]


class TimeChunks(Machine):
    """Numbers windows that begin at a row and take the rows less than ``window_ms`` after it. Row: (pts_ms, id)."""

    def __init__(self, window_ms: int) -> None:
        self.window, self.start, self.number = window_ms, None, -1

    def __call__(self, row: tuple) -> Iterable[tuple]:
        if self.start is None or row[0] - self.start >= self.window:
            self.start, self.number = row[0], self.number + 1
        return [(row[1], row[0], self.number, self.start)]


class Clips(Machine):
    """Clips of at least ``length_ms``, from frames kept at most ``fps`` a second, thinned to ``most`` evenly spaced slots.
    Between two clips at least ``delay_ms`` of media time pass; while they have not, the oldest frame is let go.
    Row: (pts_ms, frame_index)."""

    def __init__(self, length_ms: int = 2000, fps: int = 2, delay_ms: int = 0, most: int = 64) -> None:
        self.length, self.step, self.delay, self.most = length_ms, 1000 // max(fps, 1), delay_ms, most
        self.kept, self.last, self.emitted = deque(), None, None

    def __call__(self, row: tuple) -> Iterable[tuple]:
        pts = row[0]
        if self.last is not None and max(pts - self.last, 0) < self.step:
            return ()
        self.last = pts
        self.kept.append(row)
        start = self.kept[0][0]
        if len(self.kept) > self.most:
            slot = max(self.length / self.most, 1)
            self.kept = deque({int((r[0] - start) // slot): r for r in reversed(self.kept)}[k] for k in sorted({int((r[0] - start) // slot) for r in self.kept}))
        if pts - start < self.length:
            return ()
        if self.emitted is not None and pts - self.emitted < self.delay:
            self.kept.popleft()
            return ()
        rows, self.kept, self.emitted = self.kept, deque(), pts
        return [(rows[0][0], rows[-1][0], len(rows), rows[0][1], rows[-1][1])]


CLIP_SCHEMA = "start_ms long, end_ms long, frames int, first_frame long, last_frame long"


class TokenBudget(Machine):
    """Whether an output may be made: at most ``tokens`` estimated tokens (a quarter of the characters) in each window of one
    second that begins at the first output after the last window. Row: (pts_ms, id, text)."""

    def __init__(self, tokens: int) -> None:
        self.tokens, self.start, self.used = tokens, None, 0

    def __call__(self, row: tuple) -> Iterable[tuple]:
        pts, key, text = row
        if self.start is None or pts - self.start >= 1000:
            self.start, self.used = pts, 0
        allowed = self.used < self.tokens
        cost = len(text or "") // 4
        if allowed:
            self.used += cost
        return [(key, pts, allowed, self.used)]


# Marks that end a sentence, and those that no blank goes before.
ENDING, CLOSING = ".?!", ",.?!;:'-"


class Pieces(Machine):
    """Groups of timed pieces, one at a time: a piece goes on with the group while the hole before it is at most ``gap``, the
    group stays within ``span``, and the last piece does not close it. ``read`` makes a piece (start, end, value) of a row, or
    None; ``close`` says whether a value ends its group; ``whole`` makes a group's output."""

    def __init__(self, gap: int, span: int, read, whole, close=None) -> None:
        self.gap, self.span, self.read, self.whole, self.close, self.group = gap, span, read, whole, close, []

    def _goes_on(self, piece: tuple) -> bool:
        last = self.group[-1]
        hole, length = piece[0] - last[1], piece[1] - self.group[0][0]
        return hole <= self.gap and length <= self.span and not (self.close and self.close(last[2]))

    def __call__(self, row: tuple) -> Iterable[tuple]:
        piece = self.read(row)
        if piece is None:
            return ()
        if self.group and self._goes_on(piece):
            self.group.append(piece)
            return ()
        out, self.group = self.finish(), [piece]
        return out

    def finish(self) -> Iterable[tuple]:
        return [self.whole(self.group)] if self.group else ()


def _clipped(duration: int, least: int, row: tuple) -> tuple | None:
    a, b = (min(max(x, 0), duration) for x in row[:2])
    return (a, b, row[2]) if b - a >= least else None


def _widened(duration: int, pad: int, group: list[tuple]) -> tuple:
    return max(group[0][0] - pad, 0), min(group[-1][1] + pad, duration), max(p[2] for p in group)


def speech_pieces(duration: int, least: int = 250, gap: int = 1000, span: int = 20_000, pad: int = 300) -> Pieces:
    """Ranges of speech joined over short holes and widened. Row: (start, end, confidence), by start."""
    return Pieces(gap, span, partial(_clipped, duration, least), partial(_widened, duration, pad))


def _said(row: tuple) -> tuple | None:
    text = " ".join((row[2] or "").split())
    return (row[0], row[1], text) if text and row[1] > row[0] else None


def _spoken(group: list[tuple]) -> tuple:
    text = "".join(t if k == 0 or t[0] in CLOSING else f" {t}" for k, (_, _, t) in enumerate(group))
    return group[0][0], group[-1][1], text


def _ends(text: str) -> bool:
    return text[-1] in ENDING


def transcript_pieces(gap: int = 750, span: int = 8000) -> Pieces:
    """Transcript pieces joined up to the end of a sentence. Row: (start, end, text), by start."""
    return Pieces(gap, span, _said, _spoken, _ends)


class MomentDedup(Machine):
    """Drops a moment of the same kind that overlaps a kept one within a tolerance and says the same (speech always does); the
    one of more modalities stays in its place. Row: (start, end, kind, description, modalities, id), by start, end, kind.
    A kept moment is let go once no later one can overlap it, so the state is as long as the overlap, not the stream."""

    def __init__(self, tolerance: int = 250) -> None:
        self.tolerance, self.kept = tolerance, []

    def __call__(self, row: tuple) -> Iterable[tuple]:
        out = [k for k in self.kept if k[1] + self.tolerance < row[0]]
        self.kept = [k for k in self.kept if k[1] + self.tolerance >= row[0]]
        for i, k in enumerate(self.kept):
            if k[2] == row[2] and row[1] + self.tolerance >= k[0] and (k[3] == row[3] or row[2] == "speech"):
                if row[4] > k[4]:
                    self.kept[i] = row
                return [(k[5], k[0], k[1], k[2]) for k in out]
        self.kept.append(row)
        return [(k[5], k[0], k[1], k[2]) for k in out]

    def finish(self) -> Iterable[tuple]:
        return [(k[5], k[0], k[1], k[2]) for k in self.kept]


def quantised(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector in whole steps of -127..127, and the step."""
    v = np.asarray(v, F32)
    norm = np.sqrt(np.sum(v * v, dtype=F32))
    if not norm > 0:
        return np.zeros(len(v), np.int32), 1.0
    u = v / norm
    step = F32(np.abs(u).max() / F32(127))
    return np.clip(np.rint(u / step), -127, 127).astype(np.int32), float(step)


class LiveNovelty(Machine):
    """Reuses the last description while the embedding hardly moved, for a limited time and a limited sum of small moves.
    A run or a forced refresh becomes the new anchor. Row: (pts_ms, id, embedding)."""

    def __init__(self, threshold: float = 0.01, reuse_ms: int = 2000, drift: float = 0.5) -> None:
        self.threshold, self.reuse_ms, self.most_drift = threshold, reuse_ms, drift
        self.anchor, self.at, self.drift = None, None, 0.0

    def __call__(self, row: tuple) -> Iterable[tuple]:
        pts, key, embedding = row
        q, step = quantised(embedding)
        novelty = 1.0
        if self.anchor is not None:
            novelty = _unit(1 - float(F32(int(q @ self.anchor[0])) * F32(step) * F32(self.anchor[1])))
        outcome = "run"
        if F32(novelty) <= F32(self.threshold):
            self.drift += novelty
            late = pts < self.at or pts - self.at >= self.reuse_ms
            outcome = "forced_refresh" if late or self.drift >= self.most_drift else "reuse"
        if outcome != "reuse":
            self.anchor, self.at, self.drift = (q, step), pts, 0.0
        return [(key, pts, novelty, outcome)]


class Novelty(Machine):
    """Fuses text, embedding and hash novelty against the last kept chunks; admits, escalates or drops. Admitted chunks are
    kept, escalated ones if ``keep_escalated``. Row: (id, signature, embedding, hash)."""

    def __init__(self, weights: tuple = (0.5, 0.4, 0.1), high: float = 0.45, low: float = 0.12, window: int = 8, keep_escalated: bool = False) -> None:
        if not 0 <= low < high <= 1 or window < 1 or min(weights) < 0 or sum(weights) > 1 + 1e-6:
            raise ValueError("need 0 <= low < high <= 1, a window and weights that add up to at most 1")
        self.weights, self.high, self.low, self.keep_escalated = weights, high, low, keep_escalated
        self.kept: deque = deque(maxlen=window)

    def __call__(self, row: tuple) -> Iterable[tuple]:
        key, sig, embedding, h = row
        sig, (q, step) = np.asarray(sig), quantised(embedding)
        parts = (1.0, 1.0, 1.0)
        if self.kept:
            text = max(float(np.mean(sig == k[0])) for k in self.kept)
            cosine = max(float(q @ k[1]) * step * k[2] for k in self.kept)
            bits = min(((h ^ k[3]) & (2**64 - 1)).bit_count() for k in self.kept)
            parts = (_unit(1 - text), _unit(1 - cosine), bits / 64)
        fused = _unit(math.fsum(w * n for w, n in zip(self.weights, parts, strict=True)))
        decision = "admit" if fused >= self.high else "drop" if fused <= self.low else "escalate"
        if decision == "admit" or decision == "escalate" and self.keep_escalated:
            self.kept.append((sig, q, step, h))
        return [(key, *parts, fused, decision)]


class Policies(Machine):
    """Revisions of a policy from its events. Row: (seq, pts_ms, kind, prompt, revision, status, from_revision)."""

    def __init__(self) -> None:
        self.revisions: dict = {}

    def _retire(self, but: int, pts: int) -> None:
        for key, r in self.revisions.items():
            if key != but and r[0] == "active":
                self.revisions[key] = ("retired", *r[1:3], pts)

    def _set(self, key: int, status: str, pts: int) -> None:
        if key in self.revisions:
            self.revisions[key] = (status, *self.revisions[key][1:3], pts)

    def __call__(self, row: tuple) -> Iterable[tuple]:
        seq, pts, kind, prompt, revision, status, source = row
        if kind == "policy_created":
            self.revisions[seq] = ("draft", prompt, pts, pts)
        elif kind == "policy_deploy_acknowledged" and revision is not None and status is not None:
            if status == "active":
                self._retire(revision, pts)
            self._set(revision, status, pts)
        elif kind == "policy_rollback_acknowledged" and revision is not None:
            if source is not None:
                self._set(source, "rolled_back", pts)
            self._retire(revision, pts)
            self._set(revision, "active", pts)
        return ()

    def finish(self) -> Iterable[tuple]:
        return [(k, *r) for k, r in sorted(self.revisions.items())]


POLICY_SCHEMA = "revision long, status string, prompt string, created_at_ms long, updated_at_ms long"
PROMOTIONS = (("draft", "shadow"), ("shadow", "canary"), ("canary", "active"))


def may_promote(now: str, to: str) -> bool:
    return (now, to) in PROMOTIONS
