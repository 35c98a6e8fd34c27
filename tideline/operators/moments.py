"""Moments and audio observations: normalisation and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of moments by label, and kinds that need audio.
AMBIENT = ("silence", "inside_small_room", "outside_urban_or_manmade", "outside_rural_or_natural")
MECHANICAL = ("engine", "engine_starting", "idling", "mechanisms", "tools", "vehicle")
NEEDS_AUDIO = ("speech", "sound_effect", "music", "ambient", "mechanical")


def audio_kind(kind: Column, label: Column) -> Column:
    return F.when(kind == "speech", "speech").when(label == "music", "music").when(label.isin(*AMBIENT), "ambient").when(label.isin(*MECHANICAL), "mechanical").otherwise("sound_effect")


def audio_moments(observations: DataFrame) -> DataFrame:
    """Moments of observations (source_start_ms, source_end_ms, start_offset_ms, end_offset_ms, kind, label, transcript,
    confidence), cut to their source; voice activity and empty ones are left out."""
    length = F.greatest(F.col("source_end_ms") - F.col("source_start_ms"), F.lit(0))
    a = F.least("start_offset_ms", length)
    rows = observations.where("kind != 'voice_activity'").withColumns({"_a": a, "_b": F.least(F.greatest(F.col("end_offset_ms"), a), length)}).where("_b > _a")
    said = F.coalesce(F.trim("transcript") != "", F.lit(False))
    return rows.select(
        "stream_id", "observation_id", F.col("_a").alias("start_offset_ms"), F.col("_b").alias("end_offset_ms"), (F.col("source_start_ms") + F.col("_a")).alias("start_pts_ms"),
        (F.col("source_start_ms") + F.col("_b")).alias("end_pts_ms"), audio_kind(F.col("kind"), F.col("label")).alias("kind"),
        F.when(said, F.concat(F.lit("Speaker: "), "transcript")).otherwise(F.col("label")).alias("description"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))).alias("confidence"),
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str, tolerance: int, bin_ms: int = 10_000) -> DataFrame:
    """Rows of ``left`` (l_start, l_end) and ``right`` (r_start, r_end) of one key that overlap within a tolerance.

    Both sides are put into the time bins they touch, so the join is an equality on (key, bin) that spreads a hot key over
    its bins; a pair is given in the first bin both touch, so it comes once."""
    bins = lambda a, b: F.sequence(F.floor(a / bin_ms), F.floor(b / bin_ms))
    l = left.where("l_end >= l_start").withColumn("bin", F.explode(bins(F.col("l_start") - tolerance, F.col("l_end") + tolerance)))  # noqa: E741
    r = right.where("r_end >= r_start").withColumn("bin", F.explode(bins(F.col("r_start"), F.col("r_end"))))
    rows = l.join(r, [key, "bin"]).where((F.col("l_start") <= F.col("r_end") + tolerance) & (F.col("r_start") <= F.col("l_end") + tolerance))
    first = F.greatest(F.floor((F.col("l_start") - tolerance) / bin_ms), F.floor(F.col("r_start") / bin_ms))
    return rows.where(F.col("bin") == first).drop("bin")


def grounded(moments: DataFrame, observations: DataFrame, key: str = "stream_id", tolerance: int = 500) -> DataFrame:
    """Moments (moment_id, start_ms, end_ms, kind, modalities, description) held against local audio observations
    (observation_id, start_ms, end_ms, kind, label, transcript, confidence).

    A moment that needs audio stays only if an observation overlaps it within the tolerance: speech a speech observation with
    a transcript, of which it takes the one of longest overlap, then highest confidence, then last; others an audio event,
    whose labels it names in order of start and id. Moments without need of audio stay as they are."""
    needs = F.coalesce(F.array_contains("modalities", "audio"), F.lit(False)) | F.coalesce(F.col("kind").isin(*NEEDS_AUDIO), F.lit(False))
    rows = moments.withColumn("needs", needs)
    l = rows.where("needs").select(key, "moment_id", F.col("kind").alias("m_kind"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))  # noqa: E741
    said = F.coalesce(F.trim("transcript") != "", F.lit(False))
    r = observations.where("kind = 'audio_event'").unionByName(observations.where((F.col("kind") == "speech") & said))
    r = r.select(key, "observation_id", F.col("kind").alias("o_kind"), "label", "transcript", "confidence", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(l, r, key, tolerance).where("(m_kind = 'speech') = (o_kind = 'speech')")
    overlap = F.greatest(F.least("l_end", "r_end") - F.greatest("l_start", "r_start"), F.lit(0))
    best = met.groupBy("moment_id").agg(
        F.max_by(F.struct("r_start", "r_end", "transcript"), F.struct(overlap, "confidence", "r_start", "observation_id")).alias("s"),
        F.array_sort(F.collect_set(F.struct("r_start", "observation_id", "label"))).alias("labels"), F.count("*").alias("support"),
    )
    named = F.array_join(F.transform("labels", lambda x: x["label"]), ", ")
    speech = F.col("kind") == "speech"
    text = F.when(speech, F.concat(F.lit("Speaker: "), F.substring(F.trim("s.transcript"), 1, 1000))).otherwise(
        F.concat(F.when(F.array_contains("modalities", "video"), "Visible activity overlaps local audio event: ").otherwise("Local audio event: "), named)
    )
    out = rows.join(best, "moment_id", "left").where("not needs or support is not null")
    pick = lambda a, b: F.when(F.col("needs") & speech, F.col(a)).otherwise(F.col(b))
    return out.select(key, "moment_id", "kind", pick("s.r_start", "start_ms").alias("start_ms"), pick("s.r_end", "end_ms").alias("end_ms"), F.when(F.col("needs"), text).otherwise(F.col("description")).alias("description"), F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def top_moment(moments: DataFrame, key: str) -> DataFrame:
    """Per key the most confident moment, the last of several alike by start and id."""
    return moments.groupBy(key).agg(F.max_by("moment_id", F.struct("confidence", "start_ms", "moment_id")).alias("moment_id"), F.max("confidence").alias("confidence"))


def best_observations(rows: DataFrame, keys: list[str], most: int, per: str) -> DataFrame:
    """The most confident of equal observations, then the first ``most`` of each ``per`` by start, confidence and label."""
    one = rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy(per).orderBy("start_ms", F.desc("confidence"), "label")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mapped_label(rows: DataFrame, tenant_labels: DataFrame, default_labels: DataFrame) -> DataFrame:
    """Rows (tenant, label) with the tenant's name for the label, else the default's, else itself. The label lists are stated
    configuration; the planner broadcasts them if their size allows."""
    own = tenant_labels.select("tenant", "label", F.col("name").alias("own"))
    rest = default_labels.select("label", F.col("name").alias("general"))
    out = rows.join(own, ["tenant", "label"], "left").join(rest, "label", "left")
    return out.withColumns({"mapped": F.coalesce("own", "general", "label"), "used_fallback": F.col("own").isNull()}).drop("own", "general")
