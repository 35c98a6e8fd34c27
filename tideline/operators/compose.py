"""Composition of frame metadata, normalised names, decoded signals and picture planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of events and what is said of them, the words that make a moment's kind, processing profiles.
SAID = {
    "scene_cut": "Hard transition detected from pass-1 gate", "artifact_suspected": "Temporal artifact signal elevated",
    "keyframe_keep": "Keyframe retained by deterministic gate", "context_observation": "No hard trigger; contextual metadata only",
}
KINDS = (
    ("speech", ("speech",), ("dialog", "voice", "spoken")), ("sound_effect", ("sound_effect",), ("effect", "beep", "tone", "impact")), ("music", (), ("music",)),
    ("ambient", (), ("ambient", "background")), ("interaction", (), ("interaction",)), ("mechanical", (), ("mechanical", "machine")),
)
SCORES = ("luma_mean", "flicker_score", "ghosting_score", "noise_variance_score")
RUN_ID = r"^run-([0-9a-f]{16}|[0-9a-f]{32})$"
MOST_SIGNALS = 500_000


def event_name(raw: Column) -> Column:
    name = F.lower(F.trim(raw))
    return F.when(name.isin(*SAID), name).otherwise("context_observation")


def object_name(raw: Column) -> Column:
    name = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(name, F.lit("")) == "", "frame_context").otherwise(name)


def moment_kind(raw: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    out = F.lit("other")
    for kind, whole, parts in reversed(KINDS):
        hit = F.lit(False)
        for w in whole:
            hit = hit | (name == w)
        for p in parts:
            hit = hit | F.contains(name, F.lit(p))
        out = F.when(hit, kind).otherwise(out)
    return out


def frame_metadata(rows: DataFrame, segment_ms: int = 250) -> DataFrame:
    """Nested metadata of frames (run_id, stream_id, frame_index, pts_ms, event_type, reason, novelty, stability, motion,
    confidence) with an optional ``overlay`` struct (event_type, object_label, description, summary, confidence)."""
    cut, artifact, keep = F.col("reason") == "scene_cut", F.col("event_type") == "suspect_artifact", F.col("event_type") == "keep_keyframe"
    name = F.when(cut, "scene_cut").when(artifact, "artifact_suspected").when(keep, "keyframe_keep").otherwise("context_observation")
    said = F.element_at(F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv]), name)
    o = "overlay"
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f"{o}.confidence", "confidence").cast("double")))
    start = F.floor(F.col("pts_ms") / segment_ms) * segment_ms
    text = F.coalesce(F.col(f"{o}.summary"), F.format_string("novelty=%.3f, stability=%.3f, motion=%.3f", "novelty", "stability", "motion"))
    window = F.struct(start.alias("start_ms"), (start + segment_ms).alias("end_ms"), F.format_string("seg-%08x", F.floor(F.col("pts_ms") / segment_ms)).alias("segment_id"), F.lit("frame").alias("source"))
    objects = F.array(F.struct(F.coalesce(F.col(f"{o}.object_label"), F.when(keep, "keyframe_candidate").otherwise("frame_context")).alias("label"), confidence.alias("score")))
    events = F.array(F.struct(F.coalesce(F.col(f"{o}.event_type"), name).alias("type"), confidence.alias("score"), F.coalesce(F.col(f"{o}.description"), said).alias("description")))
    return rows.select(
        "run_id", "stream_id", "frame_index", "pts_ms", window.alias("window"), F.struct(text.alias("summary"), objects.alias("objects"), events.alias("events")).alias("annotations"), confidence.alias("confidence"),
        F.concat_ws(":", "run_id", F.col("pts_ms").cast("string"), F.col("frame_index").cast("string")).alias("ordering_key"), F.format_string("span-%016x", "frame_index").alias("span_id"),
    )


def decoded_signals(events: DataFrame, strict: bool = False) -> DataFrame:
    """The signals of each run's latest ``frames_decoded`` event, one row each. A hash is an unsigned number in the JSON and the
    same 64 bits, signed, here. An unreadable signal, or a score beyond [0, 1], is left out, or raises if ``strict``. An event of
    more than ``MOST_SIGNALS`` is not taken apart: its run gives one row with nothing but ``run_id``, or raises if ``strict``."""
    last = events.where("kind = 'frames_decoded'").groupBy("run_id").agg(F.max_by("payload", "seq").alias("payload"))
    schema = "struct<signals: array<struct<frame_index: bigint, pts_ms: bigint, perceptual_hash: string, luma_mean: double, flicker_score: double, ghosting_score: double, noise_variance_score: double>>>"
    rows = last.select("run_id", F.from_json("payload", schema, {"allowNonNumericNumbers": "false"})["signals"].alias("p"))
    rows = rows.withColumn("over", F.coalesce(F.size("p") > MOST_SIGNALS, F.lit(False)))
    rows = rows.withColumn("p", F.when(F.col("over"), F.array(F.lit(None).cast(rows.schema["p"].dataType.elementType))).otherwise(F.col("p")))
    rows = rows.select("run_id", "over", F.posexplode("p").alias("position", "s")).select("run_id", "over", "position", "s.*")
    rows = rows.withColumn("perceptual_hash", F.conv("perceptual_hash", 10, -10).cast("long"))
    ok = F.lit(True)
    for c in ("frame_index", "pts_ms", "perceptual_hash"):
        ok = ok & F.col(c).isNotNull()
    for c in SCORES:
        ok = ok & F.coalesce(F.col(c).between(0, 1), F.lit(False))
    said = F.when(F.col("over"), f"a decoded event holds more than {MOST_SIGNALS} signals").otherwise("a decoded signal is not valid")
    rows = rows.withColumn("frame_index", F.when(ok, F.col("frame_index")).otherwise(F.raise_error(said))) if strict else rows.where(ok | F.col("over"))
    return rows.select("run_id", "frame_index", "pts_ms", "perceptual_hash", *[F.col(c).cast("float").alias(c) for c in SCORES])


def plane_signals(planes: DataFrame) -> DataFrame:
    """(stream_id, frame_index, pts_ms, perceptual_hash, luma_mean, noise_variance_score) of luma planes (``y`` binary, width,
    height): every fourth pixel for mean and variance, 8 by 8 block means of every fourth pixel and row for the hash. A plane
    of odd size, or shorter than its size, is left out. Changes since the frame before are a window's work."""

    def one(y: bytes, w: int, h: int) -> tuple[int, float, float] | None:
        if not w or not h or w % 2 or h % 2 or len(y) < w * h:
            return None
        plane = np.frombuffer(y, np.uint8)[: w * h]
        some = plane[::4].astype(np.float64)
        mean = some.mean()
        bits = 0
        if w >= 8 and h >= 8:
            grid = plane.reshape(h, w)[: h // 8 * 8, : w // 8 * 8].reshape(8, h // 8, 8, w // 8)[:, ::4, :, ::4]
            cells = grid.sum(axis=(1, 3), dtype=np.int64).ravel() // (grid.shape[1] * grid.shape[3])
            bits = int(np.packbits(cells > cells.sum() // 64, bitorder="little").view(np.int64)[0])
        return bits, mean / 255, min((np.square(some).mean() - mean * mean) / 4096, 1.0)

    def signals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(a, b, c, *s) for a, b, c, y, w, h in pdf.itertuples(index=False) if (s := one(y, w, h)) is not None]
            yield pd.DataFrame(out, columns=["stream_id", "frame_index", "pts_ms", "perceptual_hash", "luma_mean", "noise_variance_score"])

    rows = planes.select("stream_id", "frame_index", "pts_ms", "y", "width", "height").where("y is not null and width is not null and height is not null")
    return rows.mapInPandas(signals, "stream_id string, frame_index long, pts_ms long, perceptual_hash long, luma_mean float, noise_variance_score float")


def shadow(frame_index: Column, rate: float) -> Column:
    """A share of frames, always the same ones: the index times an odd constant modulo 2**64, turned left by 17 bits, as an
    unsigned number modulo 10000. The product is put together from halves, as a plain one would overflow."""
    if rate <= 0 or rate >= 1:
        return F.lit(rate >= 1)
    golden = 0x9E3779B97F4A7C15
    half, lo, hi = (1 << 32) - 1, golden & ((1 << 32) - 1), golden >> 32
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    a, b = frame_index.bitwiseAND(F.lit(half)).cast("decimal(20,0)"), F.shiftrightunsigned(frame_index, 32).cast("decimal(20,0)")
    two = 1 << 64
    product = F.pmod(F.pmod(a * F.lit(lo).cast("decimal(10,0)"), wide(two)) + F.pmod((a * F.lit(hi).cast("decimal(10,0)") + b * F.lit(lo).cast("decimal(10,0)")) % wide(1 << 32), wide(1 << 32)) * F.lit(1 << 32).cast("decimal(10,0)"), wide(two))
    top = F.floor(product / wide(1 << 47)).cast("decimal(38,0)")
    turned = F.pmod(product, wide(1 << 47)) * F.lit(1 << 17).cast("decimal(6,0)") + top
    return F.pmod(turned, wide(10_000)) < int(np.float32(rate) * np.float32(10_000))


def model_routes(models: DataFrame) -> DataFrame:
    """For each model the backend of lowest priority number, then name (backend, priority, models array)."""
    rows = models.select("backend", "priority", F.explode("models").alias("model"))
    return rows.groupBy("model").agg(F.min_by("backend", F.struct("priority", "backend")).alias("backend"))


def routed(requests: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """Requests (id, model) with their backend; a model without a route goes to the default."""
    return requests.join(routes, "model", "left").select("id", "model", F.coalesce("backend", F.lit(default)).alias("backend"))


def valid_run_id(c: Column) -> Column:
    return F.coalesce(c.rlike(RUN_ID), F.lit(False))


def ranked_labels(rows: DataFrame, key: str, names: DataFrame, threshold: float) -> DataFrame:
    """Of each key's scored labels (label, score) those at or above a threshold by their mapped name, each name with its best
    score. ``names`` (label, name) is stated configuration; labels without a name are left out."""
    hit = rows.where(F.col("score") >= threshold).join(names, "label")
    return hit.groupBy(key, "name").agg(F.max("score").alias("score"))


def sound_windows(tracks: DataFrame, window_s: int = 4, rate: int = 32_000) -> DataFrame:
    """Windows of tracks (track, samples): four seconds each, the last shorter, none below a tenth of a second."""
    size = window_s * rate
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("samples") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = tracks.select("track", "samples", F.explode(starts).alias("a")).withColumn("b", F.least("samples", F.col("a") + size))
    rows = rows.where(F.col("b") - F.col("a") >= rate // 10)
    return rows.select("track", F.round(F.col("a") * 1000 / rate).cast("long").alias("start_ms"), F.round(F.col("b") * 1000 / rate).cast("long").alias("end_ms"))


def model_name(raw: Column, aliases: dict[str, str]) -> Column:
    """A model's own name: trimmed, and by ``aliases`` (lower-case name -> name) whatever its case; another stays as it is."""
    name = F.trim(raw)
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    return name if known is None else F.coalesce(F.try_element_at(known, F.lower(name)), name)


def longest_edge(width: Column, height: Column, most: int) -> Column:
    """(width, height) of a picture made to fit ``most`` pixels on its longer side, even and not enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.floor(x * scale / 2).cast("int") * 2, F.lit(2))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def with_pictures(frames: DataFrame, pictures: DataFrame, key: str = "stream_id") -> DataFrame:
    """Frames that have a picture (key, frame_index, content), with it; of several of one index the smallest by digest."""
    one = pictures.where("content is not null").groupBy(key, "frame_index").agg(F.min_by("content", F.sha2("content", 256)).alias("content"))
    return frames.join(one, [key, "frame_index"])


def in_request_order(replies: DataFrame, request: str = "request_id", position: str = "position") -> DataFrame:
    """A batch's replies in the order of its requests; a position answered twice counts once, by the smallest attempt."""
    rows = replies.groupBy(request, position).agg(F.min_by(F.struct("text", "attempt"), "attempt").alias("r"))
    return rows.select(request, position, "r.text", "r.attempt").orderBy(request, position)


def overlay_choice(provider: Column, top_moment: Column, local_audio: Column) -> Column:
    """The overlay of a chunk: the most confident moment where local audio must back it, else the provider's."""
    return F.when(F.coalesce(local_audio, F.lit(False)), top_moment).otherwise(provider)


def strict_overlay(text: Column) -> Column:
    """An overlay decoded from JSON text; null unless it is an object with a non-blank type, label and description. A lacking
    confidence is 0.5; one beyond [0, 1] is cut to it."""
    o = F.from_json(text, "event_type string, object_label string, description string, summary string, confidence double")
    whole = F.lit(True)
    for name in ("event_type", "object_label", "description"):
        whole = whole & F.coalesce(F.trim(o[name]) != "", F.lit(False))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(o["confidence"], F.lit(0.5))))
    return F.when(whole, F.struct(*[F.trim(o[n]).alias(n) for n in ("event_type", "object_label", "description")], o["summary"].alias("summary"), confidence.alias("confidence")))


def guided_items(payload: Column, at: str, most: int = 32) -> Column:
    """The objects of a guided answer (a JSON array, or one object) at a path, as texts, the first ``most`` of them."""
    got = F.get_json_object(payload, at)
    several = F.from_json(F.when(got.startswith("{"), F.concat(F.lit("["), got, F.lit("]"))).otherwise(got), "array<string>")
    return F.slice(F.coalesce(F.filter(several, lambda x: F.coalesce(x.startswith("{"), F.lit(False))), F.array().cast("array<string>")), 1, most)


def decoded_by_schema(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows with their answer decoded by the schema the request asked for, and whether it had all of its fields."""
    out = rows.withColumn("answer", F.from_json(payload, schema))
    fields = out.schema["answer"].dataType.fieldNames()
    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | F.col("answer")[f].isNull()
    return out.withColumn("complete", F.coalesce(F.col("answer").isNotNull() & ~lacking, F.lit(False)))
