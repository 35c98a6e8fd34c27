"""Window, fold and moment queries over ``frame_signals``, ``agent_events``, ``multimodal_moments`` and ``embeddings``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import hashes
from tideline.operators import machines as m
from tideline.operators import moments as mo
from tideline.operators import segments as sg
from tideline.operators import trigger as tr
from tideline.operators import windows as w
from tideline.operators.chunks import over_chunks
from tideline.operators.fold import fold
from tideline.runtime import table

SCORES = ("luma_mean", "flicker_score", "ghosting_score", "noise_variance_score")
NO_END = (1 << 63) - 1  # the tables do not say where a source ends, so no time is beyond it
PROGRAM = """
trigger moving version 1
when motion_score >= 0.10 for 2 frames
and confidence < 0.9
edge rising
cooldown 3000ms
emit moving
capture keyframe
end
"""


def frames(s: SparkSession, d: str) -> DataFrame:
    """Valid frames, each once: a hash and all scores in [0, 1]."""
    rows = table(s, d, "frame_signals").select("frame_id", "stream_id", "frame_index", "pts_ms", "perceptual_hash", *SCORES)
    ok = F.col("perceptual_hash").isNotNull()
    for c in SCORES:
        ok = ok & F.col(c).between(0, 1)
    return rows.where(ok).distinct()


F_SQL = """f AS (SELECT DISTINCT frame_id, stream_id, frame_index, pts_ms, perceptual_hash AS h, luma_mean AS luma, flicker_score AS flicker, ghosting_score AS ghosting, noise_variance_score AS noise
  FROM frame_signals WHERE perceptual_hash IS NOT NULL AND luma_mean BETWEEN 0 AND 1 AND flicker_score BETWEEN 0 AND 1 AND ghosting_score BETWEEN 0 AND 1 AND noise_variance_score BETWEEN 0 AND 1)"""
OVER = "(PARTITION BY stream_id ORDER BY frame_index, frame_id)"


def agents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "agent_events").select("id", "session_id", "run_id", "frame_index", "pts_ms", "event_type", "confidence", "description").distinct()


A_SQL = "a AS (SELECT DISTINCT id, session_id, run_id, frame_index, pts_ms, event_type, confidence, description FROM agent_events)"


def spread(s: SparkSession, d: str, step, look_back: int = 1) -> DataFrame:
    """A window operator over all frames, long streams in chunks."""
    return over_chunks(frames(s, d), step, look_back)


def scored(s: SparkSession, d: str) -> DataFrame:
    return spread(s, d, lambda f, k: w.motion(w.window_scores(f, keys=k), k), 16)


def gate(s: SparkSession, d: str) -> DataFrame:
    return sg.gate_decisions(frames(s, d))


def kept(s: SparkSession, d: str) -> DataFrame:
    """Markers' input: events of each session as typed frames."""
    return agents(s, d).where("confidence is not null")


def moments(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "multimodal_moments").select("moment_id", "stream_id", "start_pts_ms", "end_pts_ms", "kind", "modalities", "description", "confidence").distinct()
    rows = rows.where("end_pts_ms > start_pts_ms")
    return rows.select("moment_id", "stream_id", F.col("start_pts_ms").alias("start_ms"), F.col("end_pts_ms").alias("end_ms"), "kind", F.coalesce("modalities", F.array().cast("array<string>")).alias("modalities"), F.coalesce("description", F.lit("")).alias("description"), "confidence")


M_SQL = """m AS (SELECT DISTINCT moment_id, stream_id, start_pts_ms AS start_ms, end_pts_ms AS end_ms, kind, coalesce(modalities, []) AS modalities, coalesce(description, '') AS description, confidence
  FROM multimodal_moments WHERE end_pts_ms > start_pts_ms)"""


def observations(s: SparkSession, d: str) -> DataFrame:
    """Moments in the role of local audio observations."""
    rows = moments(s, d).where("kind != 'interaction'")
    kind = F.when(F.col("kind") == "speech", "speech").when(F.col("kind") == "other", "voice_activity").otherwise("audio_event")
    return rows.select(F.col("moment_id").alias("observation_id"), "stream_id", (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") + 300).alias("end_ms"), kind.alias("kind"), F.col("kind").alias("label"), "description", "confidence", F.when(F.col("kind") == "speech", F.col("description")).alias("transcript")).where("end_ms >= start_ms")


O_SQL = M_SQL + """, o AS (SELECT moment_id AS observation_id, stream_id, start_ms + 700 AS start_ms, end_ms + 300 AS end_ms, CASE kind WHEN 'speech' THEN 'speech' WHEN 'other' THEN 'voice_activity' ELSE 'audio_event' END AS kind,
  kind AS label, confidence, CASE WHEN kind = 'speech' THEN description END AS transcript FROM m WHERE kind <> 'interaction' AND end_ms + 300 >= start_ms + 700)"""


def audio(s: SparkSession, d: str) -> DataFrame:
    rows = observations(s, d).select("stream_id", "observation_id", F.lit(1000).cast("long").alias("source_start_ms"), F.lit(NO_END).alias("source_end_ms"), F.col("start_ms").alias("start_offset_ms"), F.col("end_ms").alias("end_offset_ms"), "kind", "label", "transcript", "confidence")
    return mo.audio_moments(rows).select("observation_id", "start_offset_ms", "end_offset_ms", "start_pts_ms", "end_pts_ms", "kind", "description")


def _unnested(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("items").alias("position", "item"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select((F.col("vec_id") % 16).alias("stream"), (F.col("vec_id") * 400).alias("pts_ms"), "vec_id", "embedding")


def novelty(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    hash_ = F.xxhash64("vec_id")
    rows = vectors(s, d).join(texts, "vec_id", "left").select("stream", "vec_id", hashes.minhash(F.coalesce("text", F.lit(""))).alias("signature"), "embedding", hash_.alias("h"))
    return fold(rows, ["stream"], ["vec_id"], ["vec_id", "signature", "embedding", "h"], m.Novelty, "vec_id long, n_text double, n_embed double, n_hash double, fused double, decision string")


def triggers(s: SparkSession, d: str) -> DataFrame:
    rows = spread(s, d, w.motion).select(
        "stream_id", "frame_index", "pts_ms", F.col("motion").cast("float").alias("motion_score"), F.lit(None).cast("float").alias("novelty_score"), F.col("luma_mean").alias("confidence"),
        F.lit(None).cast("float").alias("model_uncertainty"), F.lit(None).cast("float").alias("teacher_disagreement"), F.lit(None).cast("array<struct<signal:string,value:float>>").alias("observations"),
    )
    return fold(rows, ["stream_id"], ["frame_index"], tr.SAMPLE_COLUMNS, partial(tr.Trigger, tr.compile_source(PROGRAM)), tr.FIRED_SCHEMA).where("fired").select("stream_id", "pts_ms", "missing_signal", F.size("actions").alias("actions"))


def policies(s: SparkSession, d: str) -> DataFrame:
    from tideline.plans.timeline import log

    k = F.col("k")
    kind = F.when(F.col("kind") == "ingest_received", "policy_created").when(F.col("kind") == "inference_completed", "policy_deploy_acknowledged").otherwise("policy_rollback_acknowledged")
    rows = log(s, d).withColumn("kind", kind)
    prior = lambda n: F.lag("seq", n).over(w.ordered("run_id", by=("seq",)))
    rows = rows.select("run_id", "seq", "pts_ms", "kind", F.concat(F.lit("p"), k).alias("prompt"), prior(1).alias("revision"), F.when(k % 2 == 0, "active").otherwise("shadow").alias("status"), prior(2).alias("from_revision"))
    return fold(rows, ["run_id"], ["seq"], ["seq", "pts_ms", "kind", "prompt", "revision", "status", "from_revision"], m.Policies, m.POLICY_SCHEMA)


def _fold(rows: DataFrame, key: str, order: list[str], columns: list[str], machine, schema: str) -> DataFrame:
    return fold(rows, [key], order, columns, machine, schema)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 12) for c in columns})


def budget(s: SparkSession, d: str) -> DataFrame:
    return sg.token_budget(agents(s, d), 20, "session_id", "pts_ms", "id", "description")


QUERIES = {
    "fr_motion": lambda s, d: rounded(spread(s, d, w.motion).select("frame_id", "motion"), "motion"),
    "fr_window_scores": lambda s, d: rounded(spread(s, d, lambda f, k: w.window_scores(f, keys=k), 16).select("frame_id", "novelty", "stability"), "novelty", "stability"),
    "fr_confidence": lambda s, d: rounded(scored(s, d).select("frame_id", w.confidence(F.col("novelty"), F.col("stability"), F.col("motion")).alias("confidence")), "confidence"),
    "fr_deltas_live": lambda s, d: rounded(spread(s, d, lambda f, k: w.deltas(f, keys=k)).select("frame_id", "luma_delta", "noise_delta"), "luma_delta", "noise_delta"),
    "fr_deltas_file": lambda s, d: rounded(spread(s, d, lambda f, k: w.deltas(f, False, k)).select("frame_id", "luma_delta", "noise_delta"), "luma_delta", "noise_delta"),
    "fr_normal_time": lambda s, d: w.normal_time(frames(s, d).withColumn("pts", F.col("pts_ms") * 90), 1, 90_000).select("frame_id", "normal_ms"),
    "fr_loops": lambda s, d: spread(s, d, lambda f, k: w.loops(f, keys=k), 9).select("frame_id", "loop", "enters"),
    "fr_emitted": lambda s, d: w.emitted(agents(s, d), "session_id", "description", ("pts_ms", "id")).select("id", "suppressed"),
    "fr_transitions": lambda s, d: rounded(w.transitions(agents(s, d), "session_id", "description", ("pts_ms", "id")).select("id", "similarity"), "similarity"),
    "fr_context": lambda s, d: agents(s, d).select("id", F.lag("description").over(w.ordered("session_id", by=("pts_ms", "id"))).alias("previous")),
    "fr_segments": lambda s, d: rounded(w.segments(kept(s, d), "session_id"), "confidence"),
    "fr_lifecycle": lambda s, d: rounded(w.lifecycle(w.segments(kept(s, d), "session_id"), "session_id"), "confidence"),
    "fr_chunks": lambda s, d: w.chunks(frames(s, d), 32).groupBy("stream_id", "chunk").agg(F.count("*").alias("frames"), F.min("pts_ms").alias("start_ms"), F.max("pts_ms").alias("end_ms")),
    "fr_tumbling": lambda s, d: frames(s, d).groupBy("stream_id", w.tumbling(F.col("pts_ms")).alias("segment_ms")).agg(F.count("*").alias("frames")),
    "fr_fps": lambda s, d: rounded(w.fps(frames(s, d)), "fps"),
    "fr_spaced": lambda s, d: frames(s, d).groupBy("stream_id").agg(F.count("*").cast("int").alias("n")).select("stream_id", F.explode(w.spaced(8, F.col("n"))).alias("position")),
    "fr_index_runs": lambda s, d: w.index_runs(frames(s, d), "stream_id", "frame_index"),
    "fr_collapsed": lambda s, d: w.collapsed(agents(s, d), "session_id", "description", ("pts_ms", "id")),
    "fold_gate": lambda s, d: rounded(gate(s, d).select("stream_id", "frame_index", "event_type", "reason", "confidence"), "confidence"),
    "fold_zone": lambda s, d: rounded(_fold(spread(s, d, w.motion), "stream_id", ["frame_index"], ["pts_ms", "motion"], partial(m.Zone, m.ZoneConfig(0.1, 0.03)), m.ZONE_SCHEMA), "motion_score"),
    "fold_rate": lambda s, d: sg.rate_limited(frames(s, d), 2, "stream_id", "pts_ms", "frame_id"),
    "fold_time_chunks": lambda s, d: sg.time_chunks(frames(s, d), 5000, "stream_id", "pts_ms", "frame_id"),
    "fold_clips": lambda s, d: _fold(frames(s, d), "stream_id", ["frame_index"], ["pts_ms", "frame_index"], m.Clips, m.CLIP_SCHEMA),
    "fold_token_budget": budget,
    "fold_speech_ranges": lambda s, d: rounded(sg.speech_ranges(observations(s, d).where("kind = 'speech'"), NO_END), "confidence"),
    "fold_transcript": lambda s, d: sg.transcripts(observations(s, d).where("kind = 'speech'")),
    "fold_moment_dedup": lambda s, d: _fold(moments(s, d).withColumn("n", F.size("modalities")), "stream_id", ["start_ms", "end_ms", "kind", "moment_id"], ["start_ms", "end_ms", "kind", "description", "n", "moment_id"], m.MomentDedup, "moment_id string, a_ms long, b_ms long, kind string"),
    "fold_live_novelty": lambda s, d: rounded(_fold(vectors(s, d), "stream", ["pts_ms"], ["pts_ms", "vec_id", "embedding"], m.LiveNovelty, "vec_id long, pts_ms long, novelty double, outcome string"), "novelty"),
    "fold_novelty": lambda s, d: rounded(novelty(s, d), "n_text", "n_embed", "n_hash", "fused"),
    "fold_trigger": triggers,
    "fold_policies": policies,
    "mo_audio": audio,
    "mo_grounded": lambda s, d: mo.grounded(moments(s, d), observations(s, d)),
    "mo_top": lambda s, d: rounded(mo.top_moment(moments(s, d), "stream_id"), "confidence"),
    "mo_best_observations": lambda s, d: rounded(mo.best_observations(observations(s, d), ["stream_id", "start_ms", "end_ms", "kind", "label"], 5, "stream_id"), "confidence"),
}

GATE_SQL = f"""WITH RECURSIVE {F_SQL}, n AS MATERIALIZED (SELECT *, row_number() OVER {OVER} AS i FROM f),
  g AS (SELECT stream_id, frame_index, i, h AS ah, luma AS al, frame_index AS ai, 'initial_frame' AS reason, CAST(1 AS DOUBLE) AS confidence FROM n WHERE i = 1
  UNION ALL SELECT stream_id, frame_index, i, CASE WHEN r IN ('scene_cut', 'periodic_keepalive') THEN h ELSE ah END, CASE WHEN r IN ('scene_cut', 'periodic_keepalive') THEN luma ELSE al END,
    CASE WHEN r IN ('scene_cut', 'periodic_keepalive') THEN frame_index ELSE ai END, r,
    CAST(CASE r WHEN 'scene_cut' THEN bit_count(xor(h, ah)) / 64.0 WHEN 'periodic_keepalive' THEN 1 WHEN 'exposure_shift' THEN abs(al - luma) WHEN 'flicker_suspected' THEN flicker WHEN 'ghosting_suspected' THEN ghosting
      WHEN 'noise_variance_spike' THEN noise ELSE 0 END AS DOUBLE)
  FROM (SELECT n.*, g.ah, g.al, g.ai, CASE WHEN bit_count(xor(n.h, g.ah)) >= 18 THEN 'scene_cut' WHEN n.frame_index - g.ai >= 30 THEN 'periodic_keepalive' WHEN abs(g.al - n.luma) >= CAST(0.15 AS FLOAT) THEN 'exposure_shift'
    WHEN n.flicker >= CAST(0.55 AS FLOAT) THEN 'flicker_suspected' WHEN n.ghosting >= CAST(0.55 AS FLOAT) THEN 'ghosting_suspected' WHEN n.noise >= CAST(0.55 AS FLOAT) THEN 'noise_variance_spike' ELSE 'no_trigger' END AS r
    FROM g JOIN n ON n.stream_id = g.stream_id AND n.i = g.i + 1))
  SELECT stream_id, frame_index, CASE WHEN reason IN ('initial_frame', 'scene_cut', 'periodic_keepalive') THEN 'keep_keyframe' WHEN reason = 'no_trigger' THEN 'skip' ELSE 'suspect_artifact' END AS event_type, reason, round(confidence, 12) AS confidence FROM g"""
MOTION = f"mo AS (SELECT *, coalesce(bit_count(xor(h, lag(h) OVER {OVER})) / 64.0, 0) AS motion, row_number() OVER {OVER} AS i FROM f)"
WIN = f"""wi AS (SELECT *, list(h) OVER {OVER[:-1]} ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS hs, list(CAST(luma AS DOUBLE)) OVER {OVER[:-1]} ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS ls, lag(h) OVER {OVER} AS ph FROM f),
  sc AS (SELECT frame_id, CASE WHEN hs IS NULL OR len(hs) = 0 THEN 1 ELSE list_avg(list_transform(hs, lambda x: bit_count(xor(x, h)) / 64.0)) END AS novelty,
  CASE WHEN ls IS NULL OR len(ls) = 0 THEN 1 ELSE greatest(0, least(1, 1 - list_avg(list_transform(ls, lambda x: abs(x - CAST(luma AS DOUBLE)))))) END AS stability, coalesce(bit_count(xor(h, ph)) / 64.0, 0) AS motion FROM wi)"""
SEG = f"""{A_SQL}, b AS (SELECT * FROM a WHERE confidence IS NOT NULL), sg AS (SELECT *, CASE WHEN lag(event_type) OVER k = event_type AND frame_index <= lag(frame_index) OVER k + 1 THEN 0 ELSE 1 END AS fresh FROM b WINDOW k AS (PARTITION BY session_id ORDER BY frame_index, pts_ms)),
  si AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY frame_index, pts_ms) - 1 AS BIGINT) AS segment FROM sg),
  se AS (SELECT session_id, segment, min(event_type) AS event_type, min(frame_index) AS start_frame, max(frame_index) AS end_frame, min(pts_ms) AS start_ms, max(pts_ms) AS end_ms, avg(CAST(confidence AS DOUBLE)) AS confidence, count(*) AS frames FROM si GROUP BY 1, 2)"""
WORDS_SQL = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"


def step_sql(first: str, then: str, source: str) -> str:
    return f"WITH RECURSIVE {F_SQL}, n AS MATERIALIZED (SELECT *, row_number() OVER {OVER} AS i FROM f), g AS ({first} UNION ALL {then}) {source}"


SQL = {
    "fr_motion": f"WITH {F_SQL}, {MOTION} SELECT frame_id, round(motion, 12) AS motion FROM mo",
    "fr_window_scores": f"WITH {F_SQL}, {WIN} SELECT frame_id, round(CAST(novelty AS DOUBLE), 12) AS novelty, round(CAST(stability AS DOUBLE), 12) AS stability FROM sc",
    "fr_confidence": f"WITH {F_SQL}, {WIN} SELECT frame_id, round(greatest(0, least(1, CAST(novelty AS DOUBLE) * 0.45::DOUBLE + (1 - CAST(stability AS DOUBLE)) * 0.35::DOUBLE + CAST(motion AS DOUBLE) * 0.2::DOUBLE)), 12) AS confidence FROM sc",
    "fr_deltas_live": f"WITH {F_SQL} SELECT frame_id, round(CAST(abs(luma - coalesce(lag(luma) OVER {OVER}, luma)) AS DOUBLE), 12) AS luma_delta, round(CAST(abs(noise - coalesce(lag(noise) OVER {OVER}, noise)) AS DOUBLE), 12) AS noise_delta FROM f",
    "fr_deltas_file": f"WITH {F_SQL} SELECT frame_id, round(CAST(abs(luma - coalesce(lag(luma) OVER {OVER}, 0::FLOAT)) AS DOUBLE), 12) AS luma_delta, round(CAST(abs(noise - coalesce(lag(noise) OVER {OVER}, 0::FLOAT)) AS DOUBLE), 12) AS noise_delta FROM f",
    "fr_normal_time": f"WITH {F_SQL}, p AS (SELECT *, greatest(pts_ms - first_value(pts_ms) OVER {OVER}, 0) AS r FROM f) SELECT frame_id, max(r) OVER {OVER} AS normal_ms FROM p",
    "fr_loops": f"""WITH {F_SQL}, p AS (SELECT *, list(h) OVER {OVER[:-1]} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS hs FROM f),
        q AS (SELECT frame_id, stream_id, frame_index, len(list_filter(coalesce(hs, []), lambda x: bit_count(xor(x, h)) < 6)) + CASE WHEN bit_count(h) > 58 THEN 8 - len(coalesce(hs, [])) ELSE 0 END >= 3 AS lp FROM p)
        SELECT frame_id, lp AS loop, lp AND NOT coalesce(lag(lp) OVER {OVER}, false) AS enters FROM q""",
    "fr_emitted": f"""WITH {A_SQL}, p AS (SELECT id, session_id, pts_ms, row_number() OVER k = 1 OR description IS DISTINCT FROM lag(description) OVER k AS fresh FROM a WINDOW k AS (PARTITION BY session_id ORDER BY pts_ms, id)),
        q AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY pts_ms, id) AS BIGINT) AS suppressed FROM p) SELECT id, suppressed FROM q WHERE fresh""",
    "fr_transitions": f"""WITH {A_SQL}, p AS (SELECT id, description AS d, nullif(lag(description) OVER (PARTITION BY session_id ORDER BY pts_ms, id), '') AS l FROM a), bb AS (SELECT id, d, CASE WHEN octet_length(encode(l)) <= 200 THEN l ELSE list_filter(list_transform(range(201, 0, -1), lambda n: substr(l, 1, n)), lambda x: octet_length(encode(x)) <= 200)[1] END AS b FROM p), q AS (SELECT id, {WORDS_SQL.format('d')} AS x, {WORDS_SQL.format('b')} AS y FROM bb WHERE d IS NOT NULL AND b IS NOT NULL),
        r AS (SELECT id, CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS v FROM q) SELECT id, round(v, 12) AS similarity FROM r WHERE v < 0.5""",
    "fr_context": f"WITH {A_SQL} SELECT id, lag(description) OVER (PARTITION BY session_id ORDER BY pts_ms, id) AS previous FROM a",
    "fr_segments": f"WITH {SEG} SELECT * REPLACE (round(confidence, 12) AS confidence) FROM se",
    "fr_lifecycle": f"""WITH {SEG}, l AS (SELECT *, 'mk-' || lpad(printf('%x', segment), 8, '0') AS id, confidence >= 0.7 OR event_type = 'scene_cut' AS exact, lead(event_type) OVER k AS nt, lead(start_frame) OVER k AS nf, lead(end_frame) OVER k AS ne, lead(end_ms) OVER k AS nm, lead(confidence) OVER k AS nc
        FROM se WINDOW k AS (PARTITION BY session_id ORDER BY segment)) SELECT session_id, event_type, start_frame, start_ms, id AS marker_id, CASE WHEN exact THEN 'exact' ELSE 'provisional' END AS status, end_frame, end_ms, round(confidence, 12) AS confidence, NULL AS supersedes FROM l
        UNION ALL SELECT session_id, event_type, start_frame, start_ms, 'mkf' || substr(id, 3), 'finalized', ne, nm, round((confidence + nc) / 2, 12), id FROM l WHERE NOT exact AND nt = event_type AND greatest(nf - end_frame, 0) <= 3""",
    "fr_chunks": f"WITH {F_SQL}, c AS (SELECT *, (row_number() OVER {OVER} - 1) // 32 AS chunk FROM f) SELECT stream_id, chunk, count(*) AS frames, min(pts_ms) AS start_ms, max(pts_ms) AS end_ms FROM c GROUP BY 1, 2",
    "fr_tumbling": f"WITH {F_SQL} SELECT stream_id, pts_ms // 250 * 250 AS segment_ms, count(*) AS frames FROM f GROUP BY 1, 2",
    "fr_fps": f"WITH {F_SQL}, d AS (SELECT stream_id, pts_ms - lag(pts_ms) OVER {OVER} AS s FROM f) SELECT stream_id, round(coalesce(greatest(0.2, least(120, 1000 / avg(s) FILTER (WHERE s > 0))), 1), 12) AS fps FROM d GROUP BY 1",
    "fr_spaced": f"WITH {F_SQL}, c AS (SELECT stream_id, count(*) AS n FROM f GROUP BY 1) SELECT DISTINCT stream_id, CAST(i * (n - 1) // 7 AS INT) AS position FROM c, (SELECT unnest(range(8)) AS i) WHERE n > 8 UNION ALL SELECT stream_id, CAST(unnest(range(n)) AS INT) FROM c WHERE n <= 8",
    "fr_index_runs": f"WITH {F_SQL}, d AS (SELECT DISTINCT stream_id, frame_index FROM f), k AS (SELECT *, frame_index - row_number() OVER (PARTITION BY stream_id ORDER BY frame_index) AS g FROM d) SELECT stream_id, min(frame_index) AS first, max(frame_index) AS last, count(*) AS n FROM k GROUP BY stream_id, g",
    "fr_collapsed": f"""WITH {A_SQL}, p AS (SELECT *, CASE WHEN row_number() OVER k > 1 AND description IS NOT DISTINCT FROM lag(description) OVER k THEN 0 ELSE 1 END AS fresh FROM a WINDOW k AS (PARTITION BY session_id ORDER BY pts_ms, id)),
        q AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY pts_ms, id) AS g FROM p) SELECT session_id, min(description) AS description, min(pts_ms) AS first, max(pts_ms) AS last, count(*) AS n FROM q WHERE trim(description) <> '' GROUP BY session_id, g""",
    "fold_gate": GATE_SQL,
    "fold_zone": f"""WITH RECURSIVE {F_SQL}, {MOTION}, n AS MATERIALIZED (SELECT stream_id, i, pts_ms, CAST(motion AS DOUBLE) AS motion FROM mo),
        g AS (SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pts_ms, CAST(0 AS DOUBLE) AS motion, false AS active, 0 AS streak, 0 AS shown FROM n WHERE i = 1
        UNION ALL SELECT stream_id, i, pts_ms, motion, CASE WHEN st >= need THEN NOT active ELSE active END, CASE WHEN st >= need THEN 0 ELSE st END, CASE WHEN st >= need THEN st ELSE 0 END FROM (SELECT n.stream_id, n.i, n.pts_ms, n.motion, g.active, CASE WHEN g.active THEN 3 ELSE 2 END AS need,
          CASE WHEN CASE WHEN g.active THEN CAST(n.motion AS FLOAT) <= CAST(0.03 AS FLOAT) ELSE CAST(n.motion AS FLOAT) >= CAST(0.1 AS FLOAT) END THEN g.streak + 1 ELSE 0 END AS st FROM g JOIN n ON n.stream_id = g.stream_id AND n.i = g.i + 1))
        SELECT stream_id, pts_ms, CASE WHEN active THEN 'entered' ELSE 'exited' END AS transition, round(motion, 12) AS motion_score, shown AS streak FROM g WHERE shown > 0""",
    "fold_rate": step_sql(
        "SELECT stream_id, i, pts_ms, frame_id, pts_ms AS l, true AS kept FROM n WHERE i = 1",
        "SELECT n.stream_id, n.i, n.pts_ms, n.frame_id, CASE WHEN n.pts_ms - g.l >= 500 THEN n.pts_ms ELSE g.l END, n.pts_ms - g.l >= 500 FROM g JOIN n ON n.stream_id = g.stream_id AND n.i = g.i + 1",
        "SELECT stream_id, pts_ms, frame_id FROM g WHERE kept",
    ),
    "fold_time_chunks": step_sql(
        "SELECT stream_id, i, frame_id, pts_ms, CAST(0 AS BIGINT) AS chunk, pts_ms AS chunk_start_ms FROM n WHERE i = 1",
        "SELECT n.stream_id, n.i, n.frame_id, n.pts_ms, CASE WHEN n.pts_ms - g.chunk_start_ms >= 5000 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN n.pts_ms - g.chunk_start_ms >= 5000 THEN n.pts_ms ELSE g.chunk_start_ms END FROM g JOIN n ON n.stream_id = g.stream_id AND n.i = g.i + 1",
        "SELECT stream_id, frame_id, pts_ms, chunk, chunk_start_ms FROM g",
    ),
    "fold_token_budget": f"""WITH RECURSIVE {A_SQL}, n AS MATERIALIZED (SELECT session_id, id, pts_ms, coalesce(length(description), 0) // 4 AS cost, row_number() OVER (PARTITION BY session_id ORDER BY pts_ms, id) AS i FROM a),
        g AS (SELECT session_id, id, pts_ms, i, pts_ms AS start, true AS allowed, cost AS used FROM n WHERE i = 1
        UNION ALL SELECT session_id, id, pts_ms, i, CASE WHEN fresh THEN pts_ms ELSE start END, fresh OR used < 20, CASE WHEN fresh THEN cost WHEN used < 20 THEN used + cost ELSE used END FROM (SELECT n.*, g.start, g.used, n.pts_ms - g.start >= 1000 AS fresh FROM g JOIN n ON n.session_id = g.session_id AND n.i = g.i + 1))
        SELECT session_id, id, pts_ms, allowed, CAST(used AS BIGINT) AS used FROM g""",
    "fold_speech_ranges": f"""WITH RECURSIVE {O_SQL}, n AS MATERIALIZED (SELECT stream_id, start_ms AS a, end_ms AS b, CAST(confidence AS DOUBLE) AS c, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, confidence) AS i FROM o WHERE kind = 'speech' AND end_ms - start_ms >= 250),
        g AS (SELECT *, a AS s, 0 AS k FROM n WHERE i = 1 UNION ALL SELECT stream_id, a, b, c, i, CASE WHEN j THEN s ELSE a END, CASE WHEN j THEN k ELSE k + 1 END FROM (SELECT n.*, g.s, g.k, n.a - g.b <= 1000 AND n.b - g.s <= 20000 AS j FROM g JOIN n ON n.stream_id = g.stream_id AND n.i = g.i + 1))
        SELECT stream_id, greatest(min(a) - 300, 0) AS a_ms, arg_max(b, i) + 300 AS b_ms, round(max(c), 12) AS confidence FROM g GROUP BY stream_id, k""",
    "fold_transcript": f"""WITH RECURSIVE {O_SQL}, p AS (SELECT stream_id, start_ms AS a, end_ms AS b, trim(regexp_replace(transcript, '\\s+', ' ', 'g')) AS t FROM o WHERE kind = 'speech' AND end_ms > start_ms),
        n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY a, b, t) AS i FROM p WHERE t <> ''),
        g AS (SELECT *, a AS s, 0 AS k, true AS h FROM n WHERE i = 1 UNION ALL SELECT stream_id, a, b, t, i, CASE WHEN j THEN s ELSE a END, CASE WHEN j THEN k ELSE k + 1 END, NOT j
          FROM (SELECT n.*, g.s, g.k, n.a - g.b <= 750 AND n.b - g.s <= 8000 AND NOT regexp_matches(g.t, '[.?!]$') AS j FROM g JOIN n ON n.stream_id = g.stream_id AND n.i = g.i + 1))
        SELECT stream_id, min(a) AS a_ms, arg_max(b, i) AS b_ms, string_agg(CASE WHEN h OR regexp_matches(t, '^[,.?!;:''-]') THEN '' ELSE ' ' END || t, '' ORDER BY i) AS text FROM g GROUP BY stream_id, k""",
    "mo_audio": f"""WITH {O_SQL} SELECT observation_id, least(start_ms, 3999000) AS start_offset_ms, least(end_ms, 3999000) AS end_offset_ms, 1000 + least(start_ms, 3999000) AS start_pts_ms, 1000 + least(end_ms, 3999000) AS end_pts_ms,
        CASE WHEN kind = 'speech' THEN 'speech' WHEN label = 'music' THEN 'music' ELSE 'sound_effect' END AS kind, CASE WHEN trim(transcript) <> '' THEN 'Speaker: ' || transcript ELSE label END AS description
        FROM o WHERE kind <> 'voice_activity' AND least(end_ms, 3999000) > least(start_ms, 3999000)""",
    "mo_grounded": f"""WITH {O_SQL}, nd AS (SELECT *, list_contains(modalities, 'audio') OR kind IN ('speech', 'sound_effect', 'music', 'ambient', 'mechanical') AS needs FROM m),
        j AS (SELECT nd.moment_id, o.start_ms AS rs, o.end_ms AS re, o.observation_id AS oid, o.label, o.transcript, greatest(least(nd.end_ms, o.end_ms) - greatest(nd.start_ms, o.start_ms), 0) AS ov, o.confidence FROM nd JOIN o ON nd.stream_id = o.stream_id AND nd.start_ms <= o.end_ms + 500 AND o.start_ms <= nd.end_ms + 500
          WHERE nd.needs AND CASE WHEN nd.kind = 'speech' THEN o.kind = 'speech' AND trim(o.transcript) <> '' ELSE o.kind = 'audio_event' END),
        b AS (SELECT moment_id, count(*) AS support, string_agg(label, ', ' ORDER BY rs, oid) AS labels FROM j GROUP BY 1), s AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY moment_id ORDER BY ov DESC, confidence DESC, rs DESC, oid DESC) = 1)
        SELECT nd.stream_id, nd.moment_id, nd.kind, CASE WHEN needs AND kind = 'speech' THEN rs ELSE start_ms END AS start_ms, CASE WHEN needs AND kind = 'speech' THEN re ELSE end_ms END AS end_ms,
        CASE WHEN NOT needs THEN description WHEN kind = 'speech' THEN 'Speaker: ' || substr(trim(transcript), 1, 1000) WHEN list_contains(modalities, 'video') THEN 'Visible activity overlaps local audio event: ' || labels ELSE 'Local audio event: ' || labels END AS description, coalesce(support, 0) AS support
        FROM nd LEFT JOIN b USING (moment_id) LEFT JOIN s USING (moment_id) WHERE NOT needs OR support IS NOT NULL""",
    "mo_top": f"WITH {M_SQL} SELECT stream_id, arg_max(moment_id, (confidence, start_ms, moment_id)) AS moment_id, round(CAST(max(confidence) AS DOUBLE), 12) AS confidence FROM m GROUP BY 1",
    "mo_best_observations": f"""WITH {O_SQL}, x AS (SELECT stream_id, start_ms, end_ms, kind, label, max(confidence) AS confidence FROM o GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, confidence DESC, label) AS INT) AS rank FROM x)
        SELECT * REPLACE (round(CAST(confidence AS DOUBLE), 12) AS confidence) FROM r WHERE rank <= 5""",
}
