"""Per-stream window operators over ordered frames and events, in compiled expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import cut_bytes
from tideline.operators import carry

FRAME = ["stream_id", "frame_index", "frame_id"]
ALL_ONES = -1
INDEX_WIDTH = 1 << 16


def ordered(*keys: str, by: tuple[str, ...] = ("frame_index", "frame_id")):
    return Window.partitionBy(*keys).orderBy(*by)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes, as a share."""
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def motion(frames: DataFrame, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Share of hash bits that changed since the frame before; 0 at the first."""
    w = ordered(*keys)
    return frames.withColumn("motion", F.coalesce(distance(F.col("perceptual_hash"), F.lag("perceptual_hash").over(w)), F.lit(0.0)))


def window_scores(frames: DataFrame, size: int = 16, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Novelty (mean share of differing bits) and stability (1 - mean change of luma) against up to ``size`` frames before;
    both 1 at the first."""
    if not 2 <= size <= 256:
        raise ValueError("a window has 2 to 256 frames")
    near = F.collect_list(F.struct(F.col("perceptual_hash").alias("h"), F.col("luma_mean").alias("l"))).over(ordered(*keys).rowsBetween(-size, -1))
    mean = lambda f: F.aggregate("near", F.lit(0.0), lambda acc, x: acc + f(x)) / F.size("near")
    rows = frames.withColumn("near", near)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    novelty = F.when(F.size("near") == 0, 1.0).otherwise(unit(mean(lambda x: distance(F.col("perceptual_hash"), x["h"]))))
    stability = F.when(F.size("near") == 0, 1.0).otherwise(unit(1 - mean(lambda x: F.abs(x["l"].cast("double") - F.col("luma_mean").cast("double")))))
    return rows.withColumns({"novelty": novelty, "stability": stability}).drop("near")


def confidence(novelty: Column, stability: Column, motion: Column, weights: tuple[float, float, float] = (0.45, 0.35, 0.20)) -> Column:
    """Weighted blend; all weights 0 gives 0, as the file path's default does."""
    a, b, c = weights
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), novelty * a + (1 - stability) * b + motion * c))


def deltas(frames: DataFrame, live: bool = True, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Change of luma and noise since the frame before. At the first frame 0 live, from 0 in files."""
    w = ordered(*keys)
    first = (lambda c: F.coalesce(F.lag(c).over(w), F.col(c))) if live else (lambda c: F.lag(c, 1, 0.0).over(w))
    return frames.withColumns({"luma_delta": F.abs(F.col("luma_mean") - first("luma_mean")), "noise_delta": F.abs(F.col("noise_variance_score") - first("noise_variance_score"))})


def normal_time(frames: DataFrame, num: int, den: int, width: int = INDEX_WIDTH) -> DataFrame:
    """Media time in ms from ticks of ``num / den`` seconds: from the first frame, never going back."""
    order = ("frame_index", "frame_id")
    first = frames.groupBy(F.col("stream_id").alias("_s")).agg(F.min_by("pts", F.struct(*order)).alias("_t0"))
    since = F.greatest((F.col("pts") - F.col("_t0")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    ms = F.floor(since * F.lit(num * 1000).cast("decimal(20,0)") / F.lit(den)).cast("long")
    rows = frames.join(first, F.col("stream_id").eqNullSafe(F.col("_s"))).withColumn("_ms", ms).drop("_t0", "_s")
    return carry.running(carry.stretched(rows, order, width), "stream_id", order, most={"normal_ms": F.col("_ms")}).drop("_ms", carry.STRETCH)


def loops(frames: DataFrame, bits: int = 6, repeats: int = 3, ring: int = 8, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Whether at least ``repeats`` of the last ``ring`` hashes are nearer than ``bits``; before the first frames the ring holds
    all-ones. ``enters`` marks a loop's first frame."""
    w = ordered(*keys)
    past = F.collect_list("perceptual_hash").over(w.rowsBetween(-ring, -1))
    near = F.size(F.filter(F.col("past"), lambda h: F.bit_count(h.bitwiseXOR(F.col("perceptual_hash"))) < bits))
    pad = F.when(F.bit_count(F.col("perceptual_hash").bitwiseXOR(F.lit(ALL_ONES).cast("long"))) < bits, ring - F.size("past")).otherwise(0)
    rows = frames.withColumn("past", past).withColumn("loop", near + pad >= repeats).drop("past")
    return rows.withColumn("enters", F.col("loop") & ~F.coalesce(F.lag("loop").over(w), F.lit(False)))


def emitted(events: DataFrame, key: str, text: str, order: tuple[str, ...], width: int = carry.WIDTH) -> DataFrame:
    """Events without those that say just what the one before said, each with the number suppressed so far."""
    rows = carry.previous(carry.stretched(events, order, width), key, order, F.col(text))
    rows = rows.withColumn("_new", F.col("_was").isNull() | ~F.col(text).eqNullSafe(F.col("_was.v"))).drop("_was")
    rows = carry.running(rows, key, order, {"suppressed": F.when(F.col("_new"), 0).otherwise(1)})
    return rows.where("_new").drop("_new", carry.STRETCH)


def words(text: Column, most: int = 128) -> Column:
    return F.array_distinct(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, most))


def transitions(events: DataFrame, key: str, text: str, order: tuple[str, ...], below: float = 0.5, kept_bytes: int = 200, width: int = carry.WIDTH) -> DataFrame:
    """Events whose words are less alike than ``below`` (Jaccard) to the words of the one before, cut to ``kept_bytes`` at the end of
    a character; the first of a key, and one after an empty text, is none. Two texts without words are alike."""
    rows = carry.previous(carry.stretched(events, order, width), key, order, F.col(text))
    rows = rows.withColumn("_l", F.nullif(F.col("_was.v"), F.lit(""))).withColumns({"_w": words(F.col(text)), "_p": words(cut_bytes(F.col("_l"), kept_bytes))})
    either = F.size(F.array_union("_w", "_p"))
    alike = F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect("_w", "_p")) / either)
    return rows.withColumn("similarity", alike).where(F.col("_p").isNotNull() & (F.col("similarity") < below)).drop("_w", "_p", "_l", "_was", carry.STRETCH)


def segments(frames: DataFrame, key: str = "stream_id", kind: str = "event_type", width: int = INDEX_WIDTH) -> DataFrame:
    """Runs of one type on consecutive frames: number from 0, first and last frame and time, mean confidence, frames."""
    order = ("frame_index", "pts_ms")
    rows = carry.previous(carry.stretched(frames, order, width), key, order, F.struct(F.col(kind).alias("kind"), "frame_index"))
    goes_on = F.coalesce((F.col("_was.v.kind") == F.col(kind)) & (F.col("frame_index") <= F.col("_was.v.frame_index") + 1), F.lit(False))
    rows = carry.running(rows.withColumn("_new", F.when(goes_on, 0).otherwise(1)), key, order, {"segment": F.col("_new")})
    return rows.withColumn("segment", F.col("segment") - 1).groupBy(key, "segment").agg(
        F.first(kind).alias(kind), F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.min("pts_ms").alias("start_ms"), F.max("pts_ms").alias("end_ms"),
        F.avg(F.col("confidence").cast("double")).alias("confidence"), F.count("*").alias("frames"),
    )


def lifecycle(segs: DataFrame, key: str = "stream_id", sure: float = 0.7, correct_frames: int = 3) -> DataFrame:
    """Markers of segments: exact or provisional, and a finalized one that joins a provisional with a near successor."""
    w = Window.partitionBy(key).orderBy("segment")
    nxt = F.lead(F.struct("event_type", "start_frame", "end_frame", "end_ms", "confidence")).over(w)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    exact = (conf >= sure) | (F.col("event_type") == "scene_cut")
    name = lambda prefix: F.format_string(prefix + "-%08x", F.col("segment"))
    rows = segs.withColumns({"n": nxt, "c": conf, "exact": exact})
    one = F.struct(
        name("mk").alias("marker_id"), F.when(F.col("exact"), "exact").otherwise("provisional").alias("status"), F.col("end_frame").alias("end_frame"), F.col("end_ms").alias("end_ms"),
        F.col("c").alias("confidence"), F.lit(None).cast("string").alias("supersedes"),
    )
    joined = F.struct(
        name("mkf").alias("marker_id"), F.lit("finalized").alias("status"), F.col("n.end_frame").alias("end_frame"), F.col("n.end_ms").alias("end_ms"),
        ((F.col("c") + F.col("n.confidence")) / 2).alias("confidence"), name("mk").alias("supersedes"),
    )
    joins = ~F.col("exact") & F.coalesce((F.col("n.event_type") == F.col("event_type")) & (F.greatest(F.col("n.start_frame") - F.col("end_frame"), F.lit(0)) <= correct_frames), F.lit(False))
    both = rows.select(key, "event_type", "start_frame", "start_ms", F.explode(F.when(joins, F.array(one, joined)).otherwise(F.array(one))).alias("m"))
    return both.select(key, "event_type", "start_frame", "start_ms", "m.*")


def chunks(frames: DataFrame, size: int, width: int = INDEX_WIDTH) -> DataFrame:
    """Frames with the number of their chunk of ``size``."""
    order = ("frame_index", "frame_id")
    rows = carry.running(carry.stretched(frames, order, width), "stream_id", order, {"_n": F.lit(1)})
    return rows.withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n", carry.STRETCH)


def tumbling(pts: Column, ms: int = 250) -> Column:
    if not 50 <= ms <= 60_000:
        raise ValueError("a segment has 50 to 60000 ms")
    return F.floor(pts / ms) * ms


def fps(frames: DataFrame, width: int = INDEX_WIDTH) -> DataFrame:
    """Frames per second of each stream from the mean positive step of time, within [0.2, 120]; 1 if there is none."""
    order = ("frame_index", "frame_id")
    rows = carry.previous(carry.stretched(frames, order, width), "stream_id", order, F.col("pts_ms"))
    rows = rows.withColumn("_s", F.col("pts_ms") - F.col("_was.v"))
    mean = F.avg(F.when(F.col("_s") > 0, F.col("_s")))
    return rows.groupBy("stream_id").agg(F.coalesce(F.greatest(F.lit(0.2), F.least(F.lit(120.0), 1000 / mean)), F.lit(1.0)).alias("fps"))


def spaced(n: int, length: Column) -> Column:
    """Positions of ``n`` evenly spaced items of ``length``: all if there are no more, the middle one for 1."""
    whole = F.sequence(F.lit(0), length - 1)
    if n == 1:
        return F.when(length < 1, F.array().cast("array<int>")).otherwise(F.array(F.floor(length / 2).cast("int")))
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (length - 1) / (n - 1)).cast("int")))
    return F.when(length < 1, F.array().cast("array<int>")).when(length <= n, whole).otherwise(some)


def index_runs(rows: DataFrame, key: str, index: str, width: int = INDEX_WIDTH) -> DataFrame:
    """Runs of consecutive numbers: first, last, how many."""
    each = carry.stretched(rows.select(key, index).distinct(), (index,), width)
    marked = carry.running(each, key, (index,), {"_n": F.lit(1)}).withColumn("_k", F.col(index) - F.col("_n"))
    return marked.groupBy(key, "_k").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("_k")


def run_expression(runs: list[tuple[int, int]], name: str = "n") -> str:
    """A condition on a frame's number that holds for the given runs (first, last)."""
    return "+".join(f"eq({name},{a})" if a == b else f"between({name},{a},{b})" for a, b in runs) or "0"


def collapsed(rows: DataFrame, key: str, text: str, order: tuple[str, ...], width: int = carry.WIDTH) -> DataFrame:
    """Runs of equal texts; a blank one ends a run and is in none."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    marked = carry.previous(carry.stretched(rows, order, width), key, order, F.col(text))
    marked = marked.withColumns({"_b": blank, "_new": F.when(F.col("_was").isNotNull() & F.col(text).eqNullSafe(F.col("_was.v")), 0).otherwise(1)}).drop("_was")
    marked = carry.running(marked, key, order, {"_g": F.col("_new")}).where("not _b")
    return marked.groupBy(key, "_g").agg(F.first(text).alias(text), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("_g")