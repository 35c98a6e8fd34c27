"""The live stream's machines: one composite per frame, audio windows, and scheduling replayed offline."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from tideline.operators.fold import Machine
from tideline.operators.machines import F32, GATE_COLUMNS, KEEP, Gate, GateConfig, Zone, ZoneConfig
from tideline.operators.trigger import Program, Trigger, live_only

LIVE_COLUMNS = [*GATE_COLUMNS, "encodes"]
LIVE_SCHEMA = "frame_index long, pts_ms long, output string, confidence double, novelty double, motion double, loop_active boolean"
MASK = 2**64 - 1


class Live(Machine):
    """Loop check, scores, zone and trigger on every frame, then the keep test. A frame is kept if the gate, an entered zone or
    a fired trigger asks for it and its picture encodes; then it becomes the frame to compare with, also when it was not the
    gate that asked. Outputs: ``loop_detected`` at a loop's first frame, the kept frame's type, ``zone_entered`` and
    ``trigger`` with it.

    Row: the frame's columns, and whether its picture encodes."""

    def __init__(self, gate: GateConfig = GateConfig(), zone: ZoneConfig | None = None, program: Program | None = None, window: int = 16, weights: tuple = (0.45, 0.35, 0.20), loop_bits: int = 6, loop_repeats: int = 3) -> None:  # noqa: B008
        self.gate, self.zone, self.trigger = Gate(gate), Zone(zone) if zone else None, Trigger(live_only(program)) if program else None
        self.weights, self.loop_bits, self.loop_repeats = weights, loop_bits, loop_repeats
        self.near: deque = deque(maxlen=max(window, 2))
        self.ring, self.looping = deque([MASK] * 8, maxlen=8), False

    def _loop(self, h: int) -> bool:
        same = sum(((x ^ h) & MASK).bit_count() < self.loop_bits for x in self.ring)
        self.ring.append(h)
        before, self.looping = self.looping, same >= self.loop_repeats
        return self.looping and not before

    def _scores(self, h: int, luma: float) -> tuple[float, float, float]:
        if not self.near:
            return 1.0, 1.0, 0.0
        n = len(self.near)
        novelty = sum(((x ^ h) & MASK).bit_count() / 64 for x, _ in self.near) / n
        stability = min(max(1 - sum(abs(y - luma) for _, y in self.near) / n, 0.0), 1.0)
        return novelty, stability, ((self.near[-1][0] ^ h) & MASK).bit_count() / 64

    def __call__(self, row: tuple) -> Iterable[tuple]:
        index, pts, h, luma = row[:4]
        out = [(index, pts, "loop_detected", 1.0, 0.0, 0.0, True)] if self._loop(h) else []
        kind, reason, _ = self.gate.decide(row[:7])
        novelty, stability, motion = self._scores(h, luma)
        self.near.append((h, luma))
        a, b, c = self.weights
        confidence = min(max(a * novelty + b * (1 - stability) + c * motion, 0.0), 1.0)
        entered = self.zone is not None and any(x[1] == "entered" for x in self.zone((pts, motion)))
        fired = self.trigger is not None and any(x[1] for x in self.trigger((pts, F32(motion), F32(novelty), F32(confidence), None, None, None)))
        if not (kind == KEEP or entered or fired) or not row[7]:
            return out
        self.gate.keep(row[:7])
        name = "scene_cut" if reason == "scene_cut" else "restricted_zone_activity" if entered and kind != KEEP else "periodic_keepalive"
        told = [name] + ["zone_entered"] * entered + ["trigger"] * fired
        return out + [(index, pts, x, confidence, novelty, motion, self.looping) for x in told]


class AudioWindows(Machine):
    """Windows of an audio track. A window closes when it spans ``window_ms``, and before a frame whose sequence number does
    not follow or whose clock differs (then only if it has more than one frame, and the track begins anew). The last one
    counts from 250 ms. Row: (timestamp of 32 bits, clock rate, sequence number of 16 bits or None)."""

    def __init__(self, window_ms: int = 4000, least_ms: int = 250) -> None:
        self.window, self.least, self.rate, self.seq, self.anchor, self.start, self.last, self.n = window_ms, least_ms, None, None, 0, 0, 0, 0

    def _ms(self, a: int, b: int) -> int:
        return (a - b) % (1 << 32) * 1000 // self.rate

    def _close(self) -> tuple:
        out = (self._ms(self.start, self.anchor), self._ms(self.last, self.start), self.n)
        self.n = 0
        return out

    def __call__(self, row: tuple) -> Iterable[tuple]:
        at, rate, seq = row
        if not rate:
            return ()
        first = self.rate is None
        follows = first or self.rate == rate and (self.seq is None or seq is None or (self.seq + 1) % (1 << 16) == seq)
        out = []
        if not follows and self.n > 1:
            out = [self._close()]
        if first or not follows:
            self.rate, self.anchor, self.n = rate, at, 0
        if not self.n:
            self.start = at
        self.seq, self.last, self.n = seq, at, self.n + 1
        if follows and not first and self._ms(at, self.start) >= self.window:
            out.append(self._close())
        return out

    def finish(self) -> Iterable[tuple]:
        return [self._close()] if self.n and self._ms(self.last, self.start) >= self.least else ()


AUDIO_SCHEMA = "start_ms long, duration_ms long, frames int"


class Admission(Machine):
    """Replays a scheduler of limited slots on ordered requests. When a slot is free, of the waiting requests whose latest start
    has not passed and whose principal is below its own limit the first by class (one better per 250 ms waited), not the
    principal or stream served last, latest start, then order, is begun. Row: (arrive_ms, id, principal, stream, class,
    latest_ms, takes_ms), in order of arrival."""

    def __init__(self, slots: int = 1, per_principal: int = 1, aging_ms: int = 250) -> None:
        self.slots, self.per, self.aging = slots, per_principal, aging_ms
        self.waiting, self.running, self.last, self.n, self.now = [], [], (None, None), 0, 0

    def _until(self, now: int | None) -> list[tuple]:
        out = []
        while True:
            out += self._begin()
            if not self.running or now is not None and min(self.running)[0] > now:
                break
            self.running.sort()
            self.now = max(self.now, self.running.pop(0)[0])
        if now is not None:
            self.now = max(self.now, now)
        return out

    def _begin(self) -> list[tuple]:
        out = []
        while len(self.running) < self.slots:
            busy = [p for _, p in self.running]
            free = [w for w in self.waiting if self.now < w[5] and busy.count(w[2]) < self.per]
            if not free:
                break
            w = min(free, key=lambda w: (max(w[4] - (self.now - w[0]) // self.aging, 0), w[2] == self.last[0], w[3] == self.last[1], w[5], w[7]))
            self.waiting.remove(w)
            self.running.append((self.now + w[6], w[2]))
            self.last = (w[2], w[3])
            out.append((w[1], self.now, self.now - w[0]))
        self.waiting = [w for w in self.waiting if self.now < w[5]]
        return out

    def __call__(self, row: tuple) -> Iterable[tuple]:
        out = self._until(row[0])
        self.waiting.append((*row, self.n))
        self.n += 1
        return out + self._begin()

    def finish(self) -> Iterable[tuple]:
        return self._until(None)


ADMISSION_SCHEMA = "id long, start_ms long, waited_ms long"


class EdgeRollout(Machine):
    """A device's model releases: a newer one becomes a candidate, goes from shadow to canary to active on good results, and a
    bad one is rejected for good. Row: (kind, release, sequence, good): ``apply`` or ``result``."""

    def __init__(self) -> None:
        self.current, self.previous, self.candidate, self.rejected, self.highest = None, None, None, None, 0

    def _state(self, what: str) -> tuple:
        return (what, self.current, self.candidate[0] if self.candidate else None, self.candidate[1] if self.candidate else None, self.highest)

    def __call__(self, row: tuple) -> Iterable[tuple]:
        kind, release, sequence, good = row
        if kind == "apply":
            if release in (self.current, self.candidate and self.candidate[0], self.rejected):
                return [self._state("unchanged")]
            if sequence <= self.highest:
                return [self._state("refused")]
            self.candidate, self.highest = (release, "shadow"), sequence
            return [self._state("candidate")]
        if not self.candidate:
            return [self._state("unchanged")]
        if not good:
            self.rejected, self.candidate = self.candidate[0], None
            return [self._state("rolled_back")]
        if self.candidate[1] == "shadow":
            self.candidate = (self.candidate[0], "canary")
            return [self._state("advanced")]
        self.previous, self.current, self.candidate = self.current, self.candidate[0], None
        return [self._state("advanced")]


EDGE_SCHEMA = "outcome string, current string, candidate string, stage string, highest long"
