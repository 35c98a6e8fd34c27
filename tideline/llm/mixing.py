"""Mixing sources to target weights (problem 7), by pivotal dependent rounding.

Each document of a source should be used ``f`` times, where ``f`` is the source's wanted tokens over its tokens: ``floor(f)``
times for certain, and once more with the remaining probability. Two documents with fractional probabilities transfer token
mass, one way or the other at random so that neither's expectation changes, until one of them is 0 or 1; the other goes on
to the next. So the tokens taken stay what was asked for, up to the one document left at the end.

A source is split by a hash of ``doc_id`` into buckets of about ``BUCKET_DOCS`` documents, each settled in one pass; every
bucket hands on at most one unsettled document, and these are combined ``FAN_IN`` buckets at a time until one is left. The
random numbers depend on the seed and the bucket only, so a task that runs again gives the same result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.runtime import written

BUCKET_DOCS, FAN_IN = 20_000, 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document; a null text has 0 tokens. ``path``: ranks of a byte-level BPE vocabulary
    (``base64 rank`` a line), read where the task runs."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        enc = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "tokens": np.array(n, np.int64)})

    return docs.select("doc_id", "source", "text").where("doc_id is not null and source is not null").mapInPandas(count, "doc_id long, source string, tokens long")


def plan(targets: list[dict], total: float | None = None, starved_share: float = 0.0) -> list[dict]:
    """How many times each source is used. ``targets``: source, target_share, max_repeats, documents, tokens.

    ``total``: tokens wanted; by default the most at which every source that has tokens reaches its share within its repeats. A
    caller may let sources that would allow least, and hold at most ``starved_share`` of the shares together, be passed over. A
    source that cannot reach its share (one without documents never can) gives all it may, is marked as starved, and its share
    is reported as it is.
    """
    most = {t["source"]: t["max_repeats"] * t["tokens"] / t["target_share"] for t in targets if t["target_share"] > 0}
    if total is None:
        passed, total = 0.0, 0.0
        for t in sorted((t for t in targets if t["target_share"] > 0), key=lambda t: (most[t["source"]], t["source"])):
            passed += t["target_share"] if most[t["source"]] > 0 else 0.0
            if most[t["source"]] > 0 and passed > starved_share + 1e-9:
                total = most[t["source"]]
                break
            total = max(total, most[t["source"]])
    out = []
    for t in targets:
        times = min(t["target_share"] * total / t["tokens"], t["max_repeats"]) if t["tokens"] else 0.0
        out.append(t | {"times": times, "starved": bool(t["target_share"] * total > t["max_repeats"] * t["tokens"] * (1 + 1e-9))})
    return out


def _settle(seed: int, level: int):
    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}:{level}:{key}"))
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        p, w, coin = pdf.p.to_numpy(float).copy(), pdf.tokens.to_numpy(float), rng.random(len(pdf))
        open_at = -1
        for j in range(len(p)):
            if not 0 < p[j] < 1:
                continue
            if w[j] == 0:
                p[j] = float(coin[j] < p[j])
                continue
            if open_at < 0:
                open_at = j
                continue
            i = open_at
            up, down = min((1 - p[i]) * w[i], p[j] * w[j]), min(p[i] * w[i], (1 - p[j]) * w[j])
            move = up if coin[j] * (up + down) < down else -down
            p[i], p[j] = p[i] + move / w[i], p[j] - move / w[j]
            for k in (i, j):
                p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
            open_at = next((k for k in (i, j) if 0 < p[k] < 1), -1)
        pdf["p"] = p
        return pdf[["doc_id", "source", "tokens", "base", "p", "bucket"]]

    return settle


SCHEMA = "doc_id long, source string, tokens long, base long, p double, bucket long"


def _targets(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry per target. The targets are a stated table of few rows; counts are pre-aggregated per source."""
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(have, "source", "left").na.fill(0, ["documents", "tokens", "max_repeats"]).na.fill(0.0, ["target_share"]).orderBy("source")
    return [r.asDict() for r in rows.toLocalIterator()]


def copies(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, path: str | None = None, starved_share: float = 0.0) -> tuple[DataFrame, list[dict]]:
    """(doc_id, source, tokens, copies) of every document of a targeted source, and the plan by source.

    Documents without id, source or target take no part. A repeated row is a document of its own. An empty text has no
    tokens and is used as often as its source. Empty tables give no rows.
    """
    spark = docs.sparkSession
    sizes = written(with_tokens(docs, path))
    planned = plan(_targets(sizes, targets), total, starved_share)
    per = spark.createDataFrame([(t["source"], float(t["times"])) for t in planned], "source string, times double")
    buckets = max(1, math.ceil(sum(t["documents"] for t in planned) / BUCKET_DOCS))
    rows = sizes.join(F.broadcast(per), "source").select(
        "doc_id", "source", "tokens", F.floor(F.col("times") + 1e-9).alias("base"), F.greatest(F.col("times") - F.floor(F.col("times") + 1e-9), F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).alias("bucket"),
    )
    level, done = 0, None
    while True:
        rows = written(rows.groupBy("source", "bucket").applyInPandas(_settle(seed, level), SCHEMA))
        settled, rows = rows.where("p = 0 or p = 1"), rows.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        done = settled if done is None else done.unionByName(settled)
        if buckets == 1:
            break
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
    last = rows.withColumn("p", (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20) < F.col("p")).cast("double"))
    out = done.unionByName(last).select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("long")).alias("copies"))
    return out, planned


def shares(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, path: str | None = None, starved_share: float = 0.0) -> DataFrame:
    """Per target: documents and tokens there, tokens taken, the share reached, the most copies of one document."""
    out, planned = copies(docs, targets, total, seed, path, starved_share)
    taken = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.sum("copies").alias("taken_documents"), F.max("copies").alias("most_copies"))
    names = "source string, target_share double, max_repeats int, documents long, tokens long, starved boolean"
    base = docs.sparkSession.createDataFrame([(t["source"], float(t["target_share"]), int(t["max_repeats"]), int(t["documents"]), int(t["tokens"]), t["starved"]) for t in planned], names)
    rows = base.join(taken, "source", "left").na.fill(0, ["taken_tokens", "taken_documents", "most_copies"])
    all_tokens = F.sum("taken_tokens").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("taken_tokens").cast("double"), all_tokens), F.lit(0.0)))
