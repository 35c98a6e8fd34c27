"""Text, time and number helpers as column expressions; the rest as functions on whole Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def cut_bytes(text: Column, size: int) -> Column:
    """The longest beginning of at most ``size`` bytes that ends between characters."""
    # A cut that splits a character of up to four bytes is whole again at most three bytes before.
    starts = [F.substring(F.encode(text, "UTF-8"), 1, size - k).cast("string") for k in range(min(4, size))]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in starts])
    return F.when(F.octet_length(text) <= size, text).otherwise(whole)


def unit(c: Column) -> Column:
    """Within [0, 1]; NaN and null give 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


def minus(a: Column, b: Column) -> Column:
    """Difference that does not go below 0."""
    return F.greatest(a - b, F.lit(0))


def minutes_ms(text: Column) -> Column:
    """Milliseconds of ``MM:SS`` or ``HH:MM:SS``; null for other texts."""
    parts = F.split(text, ":")
    value = F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when(F.size(parts).between(2, 3), F.round(value * 1000).cast("long"))


def rtp_ms(ticks: Column) -> Column:
    """Ticks of 90 kHz in ms."""
    return F.floor(ticks / 90)


def wrapped_since(a: Column, b: Column, bits: int = 32) -> Column:
    """``a - b`` on a counter that wraps around."""
    return F.pmod(a - b, F.lit(1 << bits))


def unreliable(text: Column, seconds: Column) -> Column:
    """Whether a transcript is too dense or repeats itself: more than 8 words a second (16 at least), or fewer than 0.45 of its
    word triples different."""
    t = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    n = F.size(t)
    triples = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(t, i, 3), " "))
    return F.coalesce((n > F.greatest(F.lit(16), F.round(seconds * 8))) | ((n >= 9) & (F.size(F.array_distinct(triples)) / F.size(triples) < 0.45)), F.lit(False))


def complete(text: Column) -> Column:
    """A transcript that breaks off, cut after its last full sentence; empty if it has none."""
    broken = F.endswith(text, F.lit("...")) | F.endswith(text, F.lit("…"))
    return F.when(broken, F.trim(F.regexp_extract(F.substring(text, F.lit(1), F.length(text) - 3), r"^(?s)(.*[.?!])\s", 1))).otherwise(text)


def _first_object(text: str | None) -> str | None:
    at = (text or "").find("{")
    decoder = json.JSONDecoder()
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        if isinstance(value, dict):
            return text[at:end]
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first complete JSON object in free text; null if there is none."""
    return pd.Series([_first_object(t) for t in texts], dtype=object)


def parsed_or_raw(payload: Column) -> Column:
    """A payload that is JSON as it is, another as ``{"raw": …}``."""
    return F.when(F.try_parse_json(payload).isNotNull(), payload).otherwise(F.to_json(F.struct(payload.alias("raw"))))
