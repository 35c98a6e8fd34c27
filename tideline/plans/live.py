"""Queries of live machines, composition, the log's format and scalar functions, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import hashes, vectors
from tideline.functions import text as tx
from tideline.operators import compose as co
from tideline.operators import inference as inf
from tideline.operators import live as lv
from tideline.operators import machines as m
from tideline.operators import timeline as tl
from tideline.operators import trigger as tr
from tideline.operators import windows as w
from tideline.operators.fold import fold
from tideline.plans import frames as fr
from tideline.plans import timeline as tp
from tideline.runtime import table
from tideline.sources import wal


SIGNALS = 4096  # frame indexes of one decoded event


def live(s: SparkSession, d: str) -> DataFrame:
    rows = fr.frames(s, d).withColumn("encodes", F.col("frame_index") % 50 != 0)
    machine = partial(lv.Live, zone=m.ZoneConfig(0.1, 0.03), program=tr.compile_source(fr.PROGRAM))
    return fr.rounded(fold(rows, ["stream_id"], ["frame_index"], lv.LIVE_COLUMNS, machine, lv.LIVE_SCHEMA), "confidence", "novelty", "motion")


def metadata(s: SparkSession, d: str) -> DataFrame:
    keys = ["stream_id", "frame_index"]
    rows = fr.gate(s, d).drop("confidence", "pts_ms").join(fr.scored(s, d), keys)
    rows = rows.withColumn("confidence", w.confidence(F.col("novelty"), F.col("stability"), F.col("motion"))).withColumn("run_id", F.replace("stream_id", F.lit("stream"), F.lit("run")))
    none = F.lit(None).cast("struct<event_type:string,object_label:string,description:string,summary:string,confidence:double>")
    out = co.frame_metadata(rows.withColumn("overlay", none))
    e = F.col("annotations.events")[0]
    return out.select("stream_id", "frame_index", F.col("window.start_ms").alias("start_ms"), F.col("window.segment_id").alias("segment_id"), e["type"].alias("type"), e["description"].alias("said"), F.col("annotations.objects")[0]["label"].alias("label"), "ordering_key", "span_id")


def decoded(s: SparkSession, d: str) -> DataFrame:
    """Each stream's frames as decoded events of a bounded stretch each, taken apart again. A stretch counts as a run of its own."""
    one = F.struct("frame_index", "pts_ms", F.when(F.col("perceptual_hash") >= 0, F.col("perceptual_hash").cast("decimal(20,0)")).otherwise(F.col("perceptual_hash").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).alias("perceptual_hash"), *fr.SCORES)
    body = F.to_json(F.struct(F.collect_list(one).alias("signals")))
    stretch = F.struct("stream_id", F.floor(F.col("frame_index") / SIGNALS).alias("stretch"))
    events = fr.frames(s, d).groupBy(stretch.alias("run_id")).agg(body.alias("payload")).select(F.lit(1).cast("long").alias("seq"), "run_id", F.lit("frames_decoded").alias("kind"), "payload")
    return fr.rounded(co.decoded_signals(events).withColumn("run_id", F.col("run_id.stream_id")), *fr.SCORES)


def admission(s: SparkSession, d: str) -> DataFrame:
    rows = tp.log(s, d).select(F.lit("all").alias("lane"), (F.col("seq") * 40).alias("arrive"), "seq", F.get_json_object("payload", "$.principal_key").alias("principal"), "stream_id", (F.col("k") % 3).alias("class"), (F.col("seq") * 40 + 2000).alias("latest"), (F.col("k") + 1).cast("long").alias("takes"))
    rows = rows.withColumn("lane", F.concat(F.lit("lane-"), F.col("seq").cast("string").substr(-1, 1)))
    return fold(rows, ["lane"], ["arrive", "seq"], ["arrive", "seq", "principal", "stream_id", "class", "latest", "takes"], partial(lv.Admission, 2, 1), lv.ADMISSION_SCHEMA)


def edge(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = tp.log(s, d).select("run_id", "seq", F.when(k % 3 == 0, "apply").otherwise("result").alias("kind"), F.concat(F.lit("r"), k).alias("release"), (F.col("seq") * 7 % 5000).alias("sequence"), (k % 5 != 0).alias("good"))
    return fold(rows, ["run_id"], ["seq"], ["kind", "release", "sequence", "good"], lv.EdgeRollout, lv.EDGE_SCHEMA)


def audio_windows(s: SparkSession, d: str) -> DataFrame:
    rows = fr.frames(s, d).select("stream_id", "frame_index", (F.col("pts_ms") * 48 % (1 << 32)).alias("at"), F.lit(48_000).alias("rate"), (F.col("frame_index") % (1 << 16)).alias("number"))
    return fold(rows, ["stream_id"], ["frame_index"], ["at", "rate", "number"], partial(lv.AudioWindows, 4000), lv.AUDIO_SCHEMA)


def inferred(s: SparkSession, d: str) -> DataFrame:
    rows = fr.agents(s, d).select("id", F.lit("small").alias("model"), F.col("description").alias("prompt"))
    return inf.infer(rows, [inf.Fixed()])


def cosines(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(s, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    rows = a.join(b, "vec_id").select("vec_id", vectors.cosine(F.col("a"), F.col("b")).alias("cosine"), vectors.quantised_cosine(vectors.quantised(F.col("a")), vectors.quantised(F.col("b"))).alias("whole"))
    return rows.select("vec_id", F.round("cosine", 9).alias("cosine"), (F.abs(F.col("whole") - F.col("cosine")) < 0.02).alias("close"))


def json_text(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "cloud_envelopes").select("delivery_id", "ce_data")
    said = F.concat(F.lit("answer: "), F.col("ce_data"), F.lit(" {open"))
    return rows.select("delivery_id", tx.first_object(said).alias("object"), (tx.parsed_or_raw(F.col("ce_data")) == F.col("ce_data")).alias("whole"), F.get_json_object("ce_data", "$.frame_index").cast("long").alias("frame_index"))


def routes(s: SparkSession, d: str) -> DataFrame:
    models = table(s, d, "supplier").select(F.col("s_name").alias("backend"), (F.col("s_suppkey") % 4).cast("int").alias("priority"), F.array(F.concat(F.lit("m"), F.col("s_nationkey")), F.concat(F.lit("m"), F.col("s_suppkey") % 7)).alias("models"))
    requests = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("m"), F.col("c_custkey") % 40).alias("model"))
    return co.routed(requests, co.model_routes(models), "default")


def slots(s: SparkSession, d: str) -> DataFrame:
    """Whether each principal may begin another stream, of four."""
    return tl.active_runs(tl.run_summary(tp.log(s, d))).select("principal", "active", (F.col("active") < 4).alias("may_begin"))


def latest(s: SparkSession, d: str) -> DataFrame:
    """The latest 20 events of the client's list, each event once."""
    rows = fr.agents(s, d).dropDuplicates(["session_id", "pts_ms", "event_type", "description", "frame_index", "confidence"])
    return rows.orderBy(F.desc("pts_ms"), F.desc("id")).limit(20).select("id", "pts_ms")


def pictured(s: SparkSession, d: str) -> DataFrame:
    """Every third frame has a picture, some two."""
    f = fr.frames(s, d).select("frame_id", "stream_id", "frame_index")
    one = f.where("frame_index % 3 = 0").select("stream_id", "frame_index", F.encode(F.concat("stream_id", F.lit("/"), F.col("frame_index").cast("string")), "UTF-8").alias("content"))
    return co.with_pictures(f, one.unionByName(one.where("frame_index % 2 = 0"))).select("frame_id", F.sha2("content", 256).alias("sha"))


def ordered_replies(s: SparkSession, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("seq")
    rows = tp.log(s, d).select(F.floor(e / 16).alias("request_id"), (e % 8).alias("position"), F.concat(F.lit("t"), k).alias("text"), F.floor(e % 16 / 8).alias("attempt"))
    return co.in_request_order(rows)


def overlays(s: SparkSession, d: str) -> DataFrame:
    """Envelopes' data as providers' answers, strictly decoded; where audio is asked for, a moment made of the type."""
    rows = table(s, d, "cloud_envelopes").select("delivery_id", "ce_type", "pts_ms")
    k = F.col("delivery_id") % 7
    text = F.concat(F.lit('{"event_type":"'), "ce_type", F.lit('","object_label":"'), F.when(k == 0, " ").otherwise("gate"), F.lit('","description":"seen"'), F.when(k == 1, ',"confidence":3').when(k == 2, ',"confidence":0.25').otherwise(""), F.when(k == 3, "").otherwise("}"))
    said = co.strict_overlay(text)
    rows = rows.select("delivery_id", co.overlay_choice(said["event_type"], F.concat(F.lit("moment:"), "ce_type"), F.col("delivery_id") % 5 == 0).alias("event_type"), said["confidence"].alias("confidence"))
    return rows


def guided(s: SparkSession, d: str) -> DataFrame:
    rows = tp.log(s, d).select("seq", F.concat(F.lit('{"out":['), F.array_join(F.transform(F.sequence(F.lit(0), F.col("k").cast("int")), lambda x: F.concat(F.lit('{"n":'), x.cast("string"), F.lit("}"))), ","), F.lit(',5]}')).alias("payload"))
    return rows.select("seq", F.explode(co.guided_items(F.col("payload"), "$.out")).alias("item"))


def answers(s: SparkSession, d: str) -> DataFrame:
    rows = tp.log(s, d).select("seq", F.concat(F.lit('{"label":"a"'), F.when(F.col("k") % 2 == 0, F.concat(F.lit(',"n":'), F.col("k").cast("string"))).otherwise(""), F.when(F.col("k") % 10 == 9, "").otherwise("}")).alias("payload"))
    return co.decoded_by_schema(rows, "payload", "label string, n int").select("seq", "answer.label", "answer.n", "complete")


QUERIES = {
    "co_pictures": pictured,
    "co_ordered_replies": ordered_replies,
    "co_overlays": overlays,
    "co_guided": guided,
    "co_answers": answers,
    "co_models": lambda s, d: table(s, d, "customer").select("c_custkey", co.model_name(F.concat(F.lit(" "), F.initcap("c_mktsegment")), {"building": "site-2", "machinery": "site-3"}).alias("model")),
    "co_longest_edge": lambda s, d: table(s, d, "part").select("p_partkey", co.longest_edge(F.col("p_size") * 100 + 1, F.lit(1081), 768).alias("r")).select("p_partkey", "r.*"),
    "lv_live": live,
    "lv_admission": admission,
    "lv_edge": edge,
    "lv_audio_windows": audio_windows,
    "lv_inferred": inferred,
    "lv_slots": slots,
    "lv_latest": latest,
    "co_metadata": metadata,
    "co_decoded": decoded,
    "co_kinds": lambda s, d: table(s, d, "multimodal_moments").select("moment_id", co.moment_kind(F.col("kind")).alias("moment_kind"), co.object_name(F.col("description")).alias("object_name"), co.event_name(F.col("kind")).alias("event_name")).distinct(),
    "co_routes": routes,
    "co_sound_windows": lambda s, d: co.sound_windows(table(s, d, "orders").select(F.col("o_orderkey").alias("track"), F.floor(F.col("o_totalprice")).cast("long").alias("samples"))),
    "co_ranked_labels": lambda s, d: co.ranked_labels(table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score")), "l_orderkey", s.createDataFrame([("A", "fly"), ("R", "fly"), ("N", "drive")], "label string, name string"), 0.03),
    "wal_lines": lambda s, d: wal.encoded(tp.log(s, d).select("seq", "run_id", "stream_id", "pts_ms", "kind", F.concat("payload", F.lit("\t\\n\n")).alias("payload"))),
    "wal_round_trip": lambda s, d: wal.decoded(wal.encoded(tp.log(s, d).select("seq", "run_id", "stream_id", "pts_ms", "kind", F.concat("payload", F.lit("\t\\n\n")).alias("payload")))),
    "fn_shadow": lambda s, d: fr.frames(s, d).select("frame_id", co.shadow(F.col("frame_id"), 0.01).alias("shadow")),
    "fn_cosine": cosines,
    "fn_json": json_text,
    "fn_fnv": lambda s, d: table(s, d, "agent_events").select("id", hashes.fnv1a_lower("description").alias("hash")).distinct(),
    "fn_minhash": lambda s, d: table(s, d, "documents").select("doc_id", F.slice(hashes.minhash("text"), 1, 4).alias("minima")),
}

SQL = {
    "co_pictures": f"WITH {fr.F_SQL} SELECT frame_id, sha256(stream_id || '/' || frame_index) AS sha FROM f WHERE frame_index % 3 = 0",
    "co_ordered_replies": f"WITH {tp.LOG} SELECT seq // 16 AS request_id, seq % 8 AS position, arg_min('t' || k, seq % 16 // 8) AS text, min(seq % 16 // 8) AS attempt FROM t GROUP BY 1, 2",
    "co_overlays": """SELECT delivery_id, CASE WHEN delivery_id % 5 = 0 THEN 'moment:' || ce_type WHEN delivery_id % 7 IN (0, 3) THEN NULL ELSE ce_type END AS event_type,
        CASE delivery_id % 7 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM cloud_envelopes""",
    "co_guided": f"""WITH {tp.LOG} SELECT seq, '{{"n":' || unnest(range(0, least(k + 1, 32))) || '}}' AS item FROM t""",
    "co_answers": f"WITH {tp.LOG} SELECT seq, CASE WHEN k % 10 <> 9 THEN 'a' END AS label, CASE WHEN k % 10 <> 9 AND k % 2 = 0 THEN CAST(k AS INT) END AS n, k % 10 <> 9 AND k % 2 = 0 AS complete FROM t",
    "co_models": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'site-2' WHEN 'MACHINERY' THEN 'site-3' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS model FROM customer",
    "co_longest_edge": """WITH p AS (SELECT p_partkey, p_size * 100 + 1 AS w, 1081 AS h FROM part), q AS (SELECT *, least(1.0::DOUBLE, 768.0::DOUBLE / greatest(w, h)) AS s FROM p)
        SELECT p_partkey, CAST(greatest(floor(w * s / 2) * 2, 2) AS INT) AS width, CAST(greatest(floor(h * s / 2) * 2, 2) AS INT) AS height FROM q""",
    "lv_slots": f"WITH {tp.SUMMARY}, a AS (SELECT principal, count(*) FILTER (WHERE NOT deleted AND state NOT IN ('completed', 'failed', 'cancelled')) AS active FROM sm GROUP BY 1) SELECT principal, active, active < 4 AS may_begin FROM a",
    "lv_latest": f"WITH {fr.A_SQL} SELECT id, pts_ms FROM a ORDER BY pts_ms DESC, id DESC LIMIT 20",
    "co_metadata": f"""WITH x AS ({fr.GATE_SQL}), {fr.F_SQL} SELECT stream_id, frame_index, pts_ms // 250 * 250 AS start_ms, 'seg-' || lpad(printf('%x', pts_ms // 250), 8, '0') AS segment_id,
        CASE WHEN reason = 'scene_cut' THEN 'scene_cut' WHEN event_type = 'suspect_artifact' THEN 'artifact_suspected' WHEN event_type = 'keep_keyframe' THEN 'keyframe_keep' ELSE 'context_observation' END AS type,
        CASE WHEN reason = 'scene_cut' THEN 'Hard transition detected from pass-1 gate' WHEN event_type = 'suspect_artifact' THEN 'Temporal artifact signal elevated' WHEN event_type = 'keep_keyframe' THEN 'Keyframe retained by deterministic gate' ELSE 'No hard trigger; contextual metadata only' END AS said,
        CASE WHEN event_type = 'keep_keyframe' THEN 'keyframe_candidate' ELSE 'frame_context' END AS label, replace(stream_id, 'stream', 'run') || ':' || pts_ms || ':' || frame_index AS ordering_key, 'span-' || lpad(printf('%x', frame_index), 16, '0') AS span_id FROM x JOIN f USING (stream_id, frame_index)""",
    "co_decoded": f"WITH {fr.F_SQL} SELECT stream_id AS run_id, frame_index, pts_ms, h AS perceptual_hash, round(CAST(luma AS DOUBLE), 12) AS luma_mean, round(CAST(flicker AS DOUBLE), 12) AS flicker_score, round(CAST(ghosting AS DOUBLE), 12) AS ghosting_score, round(CAST(noise AS DOUBLE), 12) AS noise_variance_score FROM f",
    "co_kinds": "SELECT DISTINCT moment_id, kind AS moment_kind, CASE WHEN coalesce(trim(description), '') = '' THEN 'frame_context' ELSE replace(lower(trim(description)), ' ', '_') END AS object_name, 'context_observation' AS event_name FROM multimodal_moments",
    "co_routes": """WITH u AS (SELECT s_name AS backend, s_suppkey % 4 AS priority, unnest(['m' || s_nationkey, 'm' || s_suppkey % 7]) AS model FROM supplier), r AS (SELECT model, arg_min(backend, (priority, backend)) AS backend FROM u GROUP BY 1)
        SELECT c_custkey AS id, 'm' || c_custkey % 40 AS model, coalesce(backend, 'default') AS backend FROM customer LEFT JOIN r ON model = 'm' || c_custkey % 40""",
    "co_sound_windows": """WITH t AS (SELECT o_orderkey AS track, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), w AS (SELECT track, n, unnest(range(0, greatest(n - 1, 0) + 1, 128000)) AS a FROM t), v AS (SELECT track, a, least(n, a + 128000) AS b FROM w)
        SELECT track, CAST(round(a * 1000 / 32000) AS BIGINT) AS start_ms, CAST(round(b * 1000 / 32000) AS BIGINT) AS end_ms FROM v WHERE b - a >= 3200""",
    "co_ranked_labels": "SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'drive' ELSE 'fly' END AS name, max(l_discount) AS score FROM lineitem WHERE l_discount >= 0.03 GROUP BY 1, 2",
    "wal_lines": f"WITH {tp.LOG} SELECT seq || chr(9) || run_id || chr(9) || stream_id || chr(9) || pts_ms || chr(9) || kind || chr(9) || payload || '\\t\\\\n\\n' AS value FROM t",
    "wal_round_trip": f"WITH {tp.LOG} SELECT seq, run_id, stream_id, pts_ms, kind, payload || chr(9) || '\\n' || chr(10) AS payload FROM t",
    "fn_shadow": f"WITH {fr.F_SQL}, p AS (SELECT frame_id, CAST(frame_id AS HUGEINT) * 11400714819323198485 % 18446744073709551616 AS x FROM f) SELECT frame_id, (x % 140737488355328 * 131072 + x // 140737488355328) % 10000 < 100 AS shadow FROM p",
    "fn_cosine": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine, true AS close FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "fn_json": "SELECT delivery_id, trim(ce_data, ' ' || chr(9) || chr(10) || chr(13)) AS object, true AS whole, CAST(json_extract_string(ce_data, '$.frame_index') AS BIGINT) AS frame_index FROM cloud_envelopes",
}
