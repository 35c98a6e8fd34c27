"""Driver-side configuration: processing profiles, ranges, backends and label dictionaries."""

from __future__ import annotations

import json
import math
import os
import re
import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def _within(name: str, value: float, low: float, high: float) -> None:
    if not (math.isfinite(value) and low <= value <= high):
        raise ValueError(f"{name} must be in [{low}, {high}], not {value}")


@dataclass(frozen=True)
class Processing:
    """How a source is sampled and summarised."""

    mode: str = "balanced"
    fps: float = 1.0
    segment_s: int = 60
    summary_chars: int = 250
    min_confidence: float = 0.35
    sampling_rate: int = 4
    fallback: bool = True
    keep_alive_min: int = 35

    # Lowest and highest value of each setting.
    RANGES: ClassVar = (("fps", 0.2, 4.0), ("segment_s", 5, 600), ("summary_chars", 10, 500), ("min_confidence", 0.0, 1.0), ("sampling_rate", 1, 30), ("keep_alive_min", 30, 45))

    def __post_init__(self) -> None:
        if self.mode not in ("balanced", "detailed", "efficiency", "custom"):
            raise ValueError(f"unknown mode {self.mode!r}")
        for name, low, high in self.RANGES:
            _within(name, getattr(self, name), low, high)


# The profiles.
PROFILES = {
    "balanced": Processing(),
    "detailed": Processing("detailed", 2.5, 45, 400, 0.3, 8),
    "efficiency": Processing("efficiency", 0.5, 90, 150, 0.45, 2, False),
    "custom": Processing("custom", fallback=False),
}


@dataclass(frozen=True)
class ClipSettings:
    fps: int = 2
    length_s: float = 2.0
    delay_s: float = 0.0

    def __post_init__(self) -> None:
        _within("fps", self.fps, 1, 30)
        _within("length_s", self.length_s, 0.1, 60)
        _within("delay_s", self.delay_s, 0, 60)
        if math.floor(self.fps * self.length_s) < 3:
            raise ValueError("a clip has at least 3 frames")


def with_environment(text: str) -> str:
    """``${NAME}`` replaced by the variable's value; one that is not set stays as it is."""
    return re.sub(r"\$\{([^}]*)\}", lambda m: os.environ.get(m[1], m[0]), text)


def _expanded(value):
    if isinstance(value, str):
        return with_environment(value)
    if isinstance(value, list):
        return [_expanded(v) for v in value]
    return {k: _expanded(v) for k, v in value.items()} if isinstance(value, dict) else value


def settings(path: str) -> dict:
    """A TOML file, its texts with the environment's values."""
    return _expanded(tomllib.loads(Path(path).read_text()))


def backends(spark: SparkSession, path: str) -> DataFrame:
    """(backend, priority, models) of a settings file's ``[[backends]]``."""
    rows = [(b["name"], int(b.get("priority", 100)), [m for m in (b.get("model"), *b.get("models", [])) if m]) for b in settings(path).get("backends", [])]
    return spark.createDataFrame(rows, "backend string, priority int, models array<string>")


def labels(spark: SparkSession, path: str | None, what: str = "events") -> tuple[DataFrame, DataFrame]:
    """Tenants' label names (tenant, label, name) and the default's (label, name) of a JSON file; none for no path."""
    file = json.loads(Path(path).read_text()) if path and path.strip() else {}
    own = [(t, k, v) for t, m in file.get("tenants", {}).items() for k, v in m.get(what, {}).items()]
    rest = list(file.get("default", {}).get(what, {}).items())
    return spark.createDataFrame(own, "tenant string, label string, name string"), spark.createDataFrame(rest, "label string, name string")
