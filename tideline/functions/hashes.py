"""64-bit hashes with wrap-around arithmetic, on whole Arrow batches."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a's offset and prime, and the mixing constants of splitmix64.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SLOTS = 64
TOKEN = re.compile(r"[^\W_]+")


def fnv1a(data: bytes, offset: int = FNV_OFFSET) -> int:
    h = offset
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers."""
    z = np.asarray(z, np.uint64) + np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def signature(text: str | None) -> np.ndarray:
    """Minima of 64 hashes over the tokens of a text; all ones for a text without any."""
    tokens = {t.encode().lower() for t in TOKEN.findall(text or "")}
    if not tokens:
        return np.full(SLOTS, 0xFFFFFFFF, np.int64)
    base = np.array([fnv1a(t) for t in tokens], np.uint64)
    seeds = mix(np.arange(1, SLOTS + 1, dtype=np.uint64))
    return (mix(base[:, None] ^ seeds) & np.uint64(0xFFFFFFFF)).min(axis=0).astype(np.int64)


@F.pandas_udf(T.LongType())
def fnv1a_lower(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else int(np.uint64(fnv1a(t.encode().lower())).view(np.int64)) for t in texts], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(texts: pd.Series) -> pd.Series:
    known = {t: signature(t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


def agreement(a: str | Column, b: str | Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / SLOTS


def hmac_sha256(key: bytes):
    """A column function: hexadecimal HMAC-SHA256 of texts."""

    @F.pandas_udf(T.StringType())
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts], dtype=object)

    return sign


def fingerprint(rows: list[tuple[str, str, int]], offset: int = 1469598103934665603) -> int:
    """FNV-1a over ``code:reason`` and the little-endian frame index of gate decisions in order."""
    h = offset
    for code, reason, index in rows:
        h = fnv1a(f"{code}:{reason}".encode() + index.to_bytes(8, "little"), h)
    return h
