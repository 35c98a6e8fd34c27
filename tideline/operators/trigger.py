"""The trigger language: source text to a checked stack program, and the machine that runs it over ordered samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.operators.fold import Machine

# The limits of a program.
ISA, MOST_STEPS, MOST_STACK, MOST_SLOTS, MOST_ACTIONS, MOST_ID, MOST_CAPTURE_MS, MOST_COOLDOWN_MS, MOST_SUSTAIN = 1, 64, 16, 16, 8, 128, 60_000, 86_400_000, 10_000
SCALARS = ("motion_score", "novelty_score", "confidence", "model_uncertainty", "teacher_disagreement")
BARE = (*SCALARS, "speech_confidence", "audio_novelty_score", "cognition_gate_score")
COMPARE: dict[str, Callable] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
LOGIC: dict[str, Callable] = {"and": lambda a, b: a and b, "or": lambda a, b: a or b}
ACTIONS = ("emit", "capture", "notify")
# Items taken from and put on the stack, by operation.
EFFECT = {"load": (0, 1), "constant": (0, 1), "not": (1, 1), "sustain": (1, 1), "edge": (1, 1), "cooldown": (1, 1), "jump_if_false": (1, 0)} | {k: (2, 1) for k in (*COMPARE, *LOGIC)} | {k: (0, 0) for k in (*ACTIONS, "halt")}


class TriggerError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    """One instruction; what ``args`` holds depends on ``op``: a signal, a value, (slot, limit), a target, an action's words."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Program:
    name: str
    version: int
    steps: tuple[Step, ...] = field(default_factory=tuple)
    isa: int = ISA


def _identifier(text: str, what: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._:\-]{1,%d}" % MOST_ID, text):
        raise TriggerError(f"{what} must be 1 to {MOST_ID} letters, digits or . _ : -")
    return text


def _number(text: str, what: str, line: int, kind: type = int):
    try:
        return kind(text)
    except ValueError:
        raise TriggerError(f"line {line}: {what} must be a number") from None


def _signal(text: str, line: int) -> tuple:
    if text in BARE:
        return (text,)
    kind, colon, rest = text.partition(":")
    shapes = {"object_count": r"([^@]+)(?:@(.+))?", "minimum_distance_mm": r"([^,]+),(.+)", "time_to_collision_ms": r"([^,]+),(.+)", "dwell_ms": r"([^@]+)@(.+)", "audio_event": r"(.+)"}
    match = re.fullmatch(shapes[kind], rest) if colon and kind in shapes else None
    if not match:
        raise TriggerError(f"line {line}: unknown signal {text!r}")
    return ("audio_event_confidence" if kind == "audio_event" else kind, *match.groups())


def _milliseconds(text: str, line: int) -> int:
    return _number(text.removesuffix("ms"), "a duration in milliseconds", line)


def _condition(words: list[str], line: int) -> list[Step]:
    if len(words) not in (4, 7) or len(words) == 7 and (words[4], words[6]) != ("for", "frames"):
        raise TriggerError(f"line {line}: expected <signal> <comparison> <value> [for <n> frames]")
    if words[2] not in COMPARE:
        raise TriggerError(f"line {line}: unknown comparison {words[2]!r}")
    out = [Step("load", _signal(words[1], line)), Step("constant", (float(np.float32(_number(words[3], "a condition's value", line, float))),)), Step(words[2])]
    return out + ([Step("sustain", (_number(words[5], "a frame count", line),))] if len(words) == 7 else [])


def _action(words: list[str], line: int) -> Step:
    match words:
        case ["emit", kind]:
            return Step("emit", (kind,))
        case ["capture", "keyframe"]:
            return Step("capture", ("keyframe", 0, 0))
        case ["capture", "clip", before, after]:
            return Step("capture", ("clip", _milliseconds(before, line), _milliseconds(after, line)))
        case ["notify", ("webhook" | "local_output") as channel]:
            return Step("notify", (channel,))
    raise TriggerError(f"line {line}: unrecognised statement")


def compile_source(source: str) -> Program:
    """A checked program from its line-oriented source."""
    head, conditions, actions, edge, cooldown, ended = None, [], [], False, None, False
    for line, raw in enumerate(source.splitlines(), 1):
        words = raw.partition("#")[0].split()
        if not words:
            continue
        if ended:
            raise TriggerError(f"line {line}: text after end")
        match words:
            case ["trigger", name, "version", version] if head is None:
                head = (name, _number(version, "a version", line))
            case ["when" | "and", *_]:
                if head is None:
                    raise TriggerError(f"line {line}: a condition comes before the header")
                conditions.append(_condition(words, line))
            case ["edge", "rising"]:
                edge = True
            case ["cooldown", time]:
                cooldown = _milliseconds(time, line)
            case ["end"]:
                ended = True
            case _:
                actions.append(_action(words, line))
    if head is None or not conditions or not ended:
        raise TriggerError("a trigger needs a header, a condition and an end")
    steps, slot = [], 0
    for k, condition in enumerate(conditions):
        for step in condition:
            if step.op == "sustain":
                step, slot = Step("sustain", (slot, *step.args)), slot + 1
            steps.append(step)
        if k:
            steps.append(Step("and"))
    if edge:
        steps.append(Step("edge", (slot,)))
        slot += 1
    if cooldown is not None:
        steps.append(Step("cooldown", (slot, cooldown)))
    halt = len(steps) + 1 + len(actions)
    return verify(Program(*head, (*steps, Step("jump_if_false", (halt,)), *actions, Step("halt"))))


def _check_step(k: int, step: Step, n: int) -> None:
    if step.op not in EFFECT:
        raise TriggerError(f"step {k}: unknown operation {step.op!r}")
    if step.op in ("sustain", "edge", "cooldown") and not 0 <= step.args[0] < MOST_SLOTS:
        raise TriggerError(f"step {k}: slot out of range")
    wrong = {
        "constant": lambda v: not np.isfinite(v), "sustain": lambda _, frames: not 1 <= frames <= MOST_SUSTAIN, "cooldown": lambda _, ms: not 0 <= ms <= MOST_COOLDOWN_MS,
        "jump_if_false": lambda to: not k < to < n, "capture": lambda _, before, after: before + after > MOST_CAPTURE_MS,
    }.get(step.op)
    if wrong and wrong(*step.args):
        raise TriggerError(f"step {k}: {step.op} {step.args} out of range")
    if step.op == "emit":
        _identifier(step.args[0], "event type")
    if step.op == "load":
        for part in step.args[1:]:
            if part is not None:
                _identifier(part, "label")


def verify(program: Program) -> Program:
    """Returns the program if it is well formed: bounded, forward-only, one emit, actions in one block before the only halt,
    and at every step one stack depth on all ways to it."""
    steps = program.steps
    n = len(steps)
    if program.isa != ISA or program.version < 1 or not 1 <= n <= MOST_STEPS:
        raise TriggerError("unsupported version or number of steps")
    _identifier(program.name, "program name")
    for k, step in enumerate(steps):
        _check_step(k, step, n)
    ops = [s.op for s in steps]
    if ops.count("halt") != 1 or ops[-1] != "halt":
        raise TriggerError("a program ends with its only halt")
    if ops.count("emit") != 1 or sum(op in ACTIONS for op in ops) > MOST_ACTIONS:
        raise TriggerError(f"a program has one emit and at most {MOST_ACTIONS} actions")
    block = next(k for k, op in enumerate(ops) if op in ACTIONS)
    if any(op not in ACTIONS for op in ops[block:-1]):
        raise TriggerError("actions form one block before halt")
    if any(s.op == "jump_if_false" and block < s.args[0] < n - 1 for s in steps):
        raise TriggerError("a jump leads into the action block")
    # Steps only lead forward, so one pass in order meets every way to a step before the step.
    depth: list[int | None] = [0] + [None] * (n - 1)
    for k, step in enumerate(steps):
        if depth[k] is None:
            raise TriggerError(f"step {k} is never reached")
        takes, puts = EFFECT[step.op]
        after = depth[k] - takes + puts
        if depth[k] < takes or after > MOST_STACK:
            raise TriggerError(f"step {k}: stack depth {depth[k]}")
        for to in {k + 1, *(step.args if step.op == "jump_if_false" else ())} if step.op != "halt" else ():
            if depth[to] not in (None, after):
                raise TriggerError(f"step {to}: stack depths {depth[to]} and {after}")
            depth[to] = after
    return program


def live_only(program: Program) -> Program:
    """Returns the program if a live stream can run it: the three frame signals, one keyframe capture, no clip."""
    captures = [s.args[0] for s in program.steps if s.op == "capture"]
    if captures != ["keyframe"] or any(s.op == "load" and s.args[0] not in ("motion_score", "novelty_score", "confidence") for s in program.steps):
        raise TriggerError("live programs use motion, novelty and confidence, and capture one keyframe")
    return program


def _true(x: float) -> bool:
    return bool(np.isfinite(x) and x != 0)


SAMPLE_COLUMNS = ["pts_ms", *SCALARS, "observations"]
FIRED_SCHEMA = "pts_ms long, fired boolean, missing_signal boolean, actions array<string>"


class Trigger(Machine):
    """Row: (pts_ms, the five scalar scores or None, observations: list of (signal text, value) or None)."""

    def __init__(self, program: Program) -> None:
        self.program = verify(program)
        self.streak, self.before, self.fired_at = [0] * MOST_SLOTS, [False] * MOST_SLOTS, [None] * MOST_SLOTS

    def _read(self, row: tuple, signal: tuple) -> float | None:
        value = row[1 + SCALARS.index(signal[0])] if signal[0] in SCALARS else None
        if value is None:
            name = signal_text(signal)
            value = next((o[1] for o in (row[6] if row[6] is not None else ()) if o[0] == name), None)
        return value

    def __call__(self, row: tuple) -> Iterable[tuple]:
        stack, k, missing, done = [], 0, False, []
        while (step := self.program.steps[k]).op != "halt":
            op, args = step.op, step.args
            if op == "load":
                value = self._read(row, args)
                missing |= value is None
                stack.append(np.float32(np.nan if value is None else value))
            elif op == "constant":
                stack.append(np.float32(args[0]))
            elif op in COMPARE or op in LOGIC:
                b, a = stack.pop(), stack.pop()
                stack.append(float(COMPARE[op](a, b) if op in COMPARE else LOGIC[op](_true(a), _true(b))))
            elif op in ACTIONS:
                done.append(" ".join(map(str, (op, *args))))
            else:
                held = _true(stack.pop())
                if op == "jump_if_false":
                    if not held:
                        k = args[0]
                        continue
                else:
                    stack.append(float(self._stateful(op, args, held, row[0])))
            k += 1
        return [(row[0], bool(done), missing, done)]

    def _stateful(self, op: str, args: tuple, held: bool, pts: int) -> bool:
        if op == "not":
            return not held
        slot = args[0]
        if op == "sustain":
            self.streak[slot] = self.streak[slot] + 1 if held else 0
            return self.streak[slot] >= args[1]
        if op == "edge":
            rising, self.before[slot] = held and not self.before[slot], held
            return rising
        last = self.fired_at[slot]
        allowed = held and (last is None or max(pts - last, 0) >= args[1])
        if allowed:
            self.fired_at[slot] = pts
        return allowed


def signal_text(signal: tuple) -> str:
    """A signal as the source writes it."""
    if len(signal) == 1:
        return signal[0]
    kind = "audio_event" if signal[0] == "audio_event_confidence" else signal[0]
    between = "," if kind in ("minimum_distance_mm", "time_to_collision_ms") else "@"
    return f"{kind}:" + between.join(p for p in signal[1:] if p is not None)


def stateless_condition(program: Program) -> Column:
    """The conjunction of a compiled program's comparisons as a column: a necessary condition that Catalyst can push down.
    Only scalar signals are held; a null score is no match, as in the machine."""
    out, steps = F.lit(True), program.steps
    for load, constant, compare in zip(steps, steps[1:], steps[2:], strict=False):
        if load.op == "load" and constant.op == "constant" and compare.op in COMPARE and load.args[0] in SCALARS:
            value, bound = F.col(load.args[0]), F.lit(constant.args[0]).cast("float")
            # NaN orders above all in SQL but compares false in the machine.
            out = out & value.isNotNull() & ~F.isnan(value) & COMPARE[compare.op](value, bound)
    return out
