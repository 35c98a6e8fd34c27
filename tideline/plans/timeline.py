"""Timeline queries over ``events`` and ``agent_events`` in the roles of an event log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import timeline as tl
from tideline.runtime import table

NOW = 1_735_000_000_000
SHA = "0A0B"


def log(s: SparkSession, d: str) -> DataFrame:
    """``events`` as a timeline: user as run and stream, type and number as kind, a payload made of them."""
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "signup", "run_created").when(F.col("event_type") == "view", "ingest_received").when(F.col("event_type") == "click", "keepalive_refreshed")
        .when(F.col("event_type") == "purchase", "inference_completed").when(k % 8 == 0, "run_failed").when(k % 8 == 1, "stop_requested").when(k % 8 == 2, "run_completed").when(k % 8 == 3, "run_deleted")
        .when(k % 8 == 4, "webhook_registered").when(k % 8 == 5, "webhook_deleted").when(k % 8 == 6, "operator_feedback_submitted").otherwise("trigger.zone")
    )
    payload = F.concat(
        F.lit('{"principal_key":"p'), k % 5, F.lit('","source_uri":"file:///m'), k % 13, F.lit('","index_name":"i'), k % 3, F.lit('","confidence":0.'), F.lpad(k.cast("string"), 2, "0"), F.lit(',"rating":'), k % 11,
        F.lit(',"webhook_id":"w'), F.col("user_id"), F.lit('","event_kinds":["ingest_received","inference_completed"],"trigger":{"actions":{"webhook":'), F.when(k % 16 == 7, "true").otherwise("false"),
        F.lit('}},"sha256":"0'), F.when(k % 2 == 0, "a").otherwise("A"), F.lit("0"), F.when(k % 4 == 0, "b").otherwise("C"), F.lit('"}'),
    )
    # The number comes out of a generator, so that it is parsed once and not once per use.
    once = table(s, d, "events").select("event_id", "user_id", "ts", "event_type", F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k"))
    return once.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("run-"), "user_id").alias("run_id"), F.concat(F.lit("stream-"), "user_id").alias("stream_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("pts_ms"), kind.alias("kind"), payload.alias("payload"), k,
    )


LOG = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
t AS (SELECT event_id AS seq, 'run-' || user_id AS run_id, 'stream-' || user_id AS stream_id, epoch_us(ts) // 1000 AS pts_ms, k,
  CASE event_type WHEN 'signup' THEN 'run_created' WHEN 'view' THEN 'ingest_received' WHEN 'click' THEN 'keepalive_refreshed' WHEN 'purchase' THEN 'inference_completed' ELSE
    CASE k % 8 WHEN 0 THEN 'run_failed' WHEN 1 THEN 'stop_requested' WHEN 2 THEN 'run_completed' WHEN 3 THEN 'run_deleted' WHEN 4 THEN 'webhook_registered' WHEN 5 THEN 'webhook_deleted'
    WHEN 6 THEN 'operator_feedback_submitted' ELSE 'trigger.zone' END END AS kind,
  '{"principal_key":"p' || k % 5 || '","source_uri":"file:///m' || k % 13 || '","index_name":"i' || k % 3 || '","confidence":0.' || lpad(CAST(k AS VARCHAR), 2, '0') || ',"rating":' || k % 11 || ',"webhook_id":"w' || user_id
  || '","event_kinds":["ingest_received","inference_completed"],"trigger":{"actions":{"webhook":' || CASE WHEN k % 16 = 7 THEN 'true' ELSE 'false' END
  || '}},"sha256":"0' || CASE WHEN k % 2 = 0 THEN 'a' ELSE 'A' END || '0' || CASE WHEN k % 4 = 0 THEN 'b' ELSE 'C' END || '"}' AS payload FROM e)"""

SUMMARY = LOG + """,
st AS (SELECT *, CASE kind WHEN 'run_created' THEN 'pending' WHEN 'ingest_received' THEN 'processing' WHEN 'inference_completed' THEN 'processing' WHEN 'keepalive_refreshed' THEN 'processing'
  WHEN 'run_completed' THEN 'completed' WHEN 'run_failed' THEN 'failed' WHEN 'stop_requested' THEN 'cancelled' END AS s FROM t),
sm AS (SELECT run_id, bool_or(kind = 'run_created') AS created, bool_or(kind = 'run_deleted') AS deleted,
  coalesce(arg_max(json_extract_string(payload, '$.principal_key'), seq) FILTER (WHERE kind = 'run_created'), 'public') AS principal,
  coalesce(arg_max(s, seq) FILTER (WHERE s IS NOT NULL), 'pending') AS state, min(pts_ms) AS first_ms, max(pts_ms) AS last_ms,
  arg_min(pts_ms, seq) FILTER (WHERE kind = 'run_created') AS created_ms, arg_min('file:///m' || k % 13, seq) FILTER (WHERE kind = 'ingest_received') AS source_uri FROM st GROUP BY run_id)"""
EXPIRED = f"""SELECT run_id, created, deleted, principal, CASE WHEN state NOT IN ('completed', 'failed', 'cancelled') AND last_ms > 0 AND {NOW} - last_ms > 3600000 THEN 'expired' ELSE state END AS state,
  first_ms, last_ms, created_ms, source_uri FROM sm"""
ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
HOOKS = """h AS (SELECT json_extract_string(payload, '$.webhook_id') AS webhook_id, max(seq) AS registered_seq, arg_max(kind, seq) AS kind, arg_max(run_id, seq) AS run_id
  FROM t WHERE kind IN ('webhook_registered', 'webhook_deleted') GROUP BY 1)"""


def deliveries(s: SparkSession, d: str) -> DataFrame:
    """A delivery log: one attempt per event."""
    k = F.col("k")
    state = F.when(k % 10 < 6, "delivered").when(k % 10 == 6, "dead_letter").when(k % 10 == 7, "checkpoint").otherwise("retry")
    return log(s, d).select(F.col("run_id").alias("webhook_id"), "seq", state.alias("state"), F.concat(F.lit("e"), k).alias("error"), F.col("seq").alias("line"))


def new_rows(s: SparkSession, d: str) -> DataFrame:
    """One event to append per supplier, for the run of its key."""
    return table(s, d, "supplier").select(F.concat(F.lit("run-"), "s_suppkey").alias("run_id"), F.concat(F.lit("stream-"), "s_suppkey").alias("stream_id"), F.lit("vlm").alias("kind"), F.lit("{}").alias("payload"), F.col("s_suppkey").alias("position"))


def records(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "agent_events").select("id", "run_id", "description", "event_type").distinct()
    return rows.select(F.col("id").alias("seq"), "run_id", "description", F.col("event_type").alias("summary"))


def agent_runs(s: SparkSession, d: str) -> DataFrame:
    """``runs`` as summaries: live ones and every other length of name are one principal's."""
    mine = (F.col("capture_mode") == "live") | (F.length("run_id") % 2 == 0)
    return table(s, d, "runs").select("run_id", F.lit(True).alias("created"), F.lit(False).alias("deleted"), F.when(mine, "acme").otherwise("other").alias("principal"))


def inferred(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).where("kind = 'inference_completed'")
    return rows.select("run_id", (F.col("k") % 20).alias("chunk_index"), F.concat(F.lit("i"), F.col("k") % 3).alias("index_name"), "pts_ms", F.when(F.col("k") % 4 > 0, F.sequence(F.lit(1), F.col("k") % 4)).alias("items"))


def timings(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).where("kind = 'ingest_received'")
    return rows.select("run_id", (F.col("k") % 25).alias("chunk_index"), "seq", (F.col("k") * 10).cast("long").alias("start_ms"), (F.col("k") * 10 + 5).cast("long").alias("end_ms"))


def marker_log(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).where("kind = 'keepalive_refreshed'")
    body = F.to_json(F.struct(
        F.format_string("mk-%08x", "seq").alias("marker_id"), F.when(F.col("k") % 7 != 0, F.concat(F.lit("t"), F.col("k") % 3)).alias("event_type"), F.when(F.col("k") % 2 == 0, "exact").otherwise("provisional").alias("status"),
        F.col("seq").alias("start_frame"), (F.col("seq") + F.col("k")).alias("end_frame"), (F.col("k") / 100).alias("confidence"),
    ))
    return rows.select("seq", "run_id", F.lit("marker_emitted").alias("kind"), body.alias("payload"))


def _summary(s: SparkSession, d: str) -> DataFrame:
    return tl.run_summary(log(s, d))


def _commands(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.concat(F.lit("run-"), "c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, "delete").otherwise("stop").alias("command"))
    return tl.command_allowed(tl.with_expiry(_summary(s, d), NOW), c)


QUERIES = {
    "tl_query": lambda s, d: tl.query(log(s, d), "run-7", "ingest_received", 100),
    "tl_after": lambda s, d: tl.after(log(s, d), 500, 1000, ["run_created", "run_failed"]).select("seq", "run_id", "kind"),
    "tl_by_index": lambda s, d: tl.by_index(log(s, d), "run-7", "i1").select("seq", "kind"),
    "tl_tail": lambda s, d: tl.tail(log(s, d), 20).select("run_id", "seq", "kind"),
    "tl_missing": lambda s, d: tl.missing_from(log(s, d), log(s, d).where("k % 10 != 0")).select("seq", "run_id"),
    "tl_before_deletion": lambda s, d: tl.before_deletion(log(s, d)).select("seq", "run_id", "kind"),
    "tl_run_summary": _summary,
    "tl_expiry": lambda s, d: tl.with_expiry(_summary(s, d), NOW),
    "tl_active_runs": lambda s, d: tl.active_runs(_summary(s, d)),
    "tl_list_runs": lambda s, d: tl.list_runs(_summary(s, d)),
    "tl_search": lambda s, d: tl.search(records(s, d), "  Amber ", 500),
    "tl_markers": lambda s, d: tl.markers(marker_log(s, d), "exact", None, 1000, 200_000).select("seq", "marker_id", "event_type", "start_frame", "end_frame"),
    "tl_interactions_of": lambda s, d: tl.interactions(inferred(s, d), timings(s, d), "run-7", "i1"),
    "tl_search_owned": lambda s, d: tl.search(records(s, d), "amber", 500, runs=tl.owned_runs(agent_runs(s, d), "acme")),
    "tl_stream": lambda s, d: tl.stream_from(log(s, d), "run-7", 100, ["ingest_received", "run_failed"])[0],
    "tl_stream_cursor": lambda s, d: tl.stream_from(log(s, d), "run-7", 100, ["run_created"])[1],
    "tl_kinds_refused": lambda s, d: log(s, d).select("seq", tl.event_kinds_error(F.array(F.concat(F.lit(" "), "kind"), F.repeat(F.lit("x"), F.col("k").cast("int") + 1))).alias("refused")),
    "tl_interactions": lambda s, d: tl.interactions(inferred(s, d), timings(s, d)),
    "tl_feedback": lambda s, d: tl.feedback(log(s, d), _summary(s, d).where("created and not deleted")),
    "tl_webhooks": lambda s, d: tl.webhooks(log(s, d)).select("webhook_id", "run_id", "registered_seq", F.size("event_kinds").alias("kinds")),
    "tl_hook_matches": lambda s, d: tl.hook_matches(tl.webhooks(log(s, d)), log(s, d)),
    "tl_delivery_state": lambda s, d: tl.delivery_state(deliveries(s, d)),
    "tl_policy_replay": lambda s, d: tl.policy_replay(log(s, d), 0.4, 10, None, "inference_completed"),
    "tl_append": lambda s, d: tl.appended(log(s, d), new_rows(s, d), NOW),
    "tl_cloud_event": lambda s, d: tl.cloud_event(log(s, d), "timeline.").select("seq", "id", "type", "subject", "time"),
    "tl_commands": _commands,
    "tl_blob_allowed": lambda s, d: tl.blob_allowed(log(s, d), SHA, {"ingest_received": "$.sha256", "run_failed": "$.sha256"}),
}

SQL = {
    "tl_query": f"WITH {LOG} SELECT seq, pts_ms, kind, payload FROM t WHERE run_id = 'run-7' AND kind = 'ingest_received' AND seq >= 100",
    "tl_after": f"WITH {LOG} SELECT seq, run_id, kind FROM (SELECT * FROM t WHERE seq > 500 ORDER BY seq LIMIT 1000) WHERE kind IN ('run_created', 'run_failed')",
    "tl_by_index": f"WITH {LOG} SELECT seq, kind FROM t WHERE run_id = 'run-7' AND k % 3 = 1",
    "tl_tail": f"WITH {LOG} SELECT run_id, seq, kind FROM t QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 20",
    "tl_missing": f"WITH {LOG} SELECT seq, run_id FROM t WHERE k % 10 = 0",
    "tl_before_deletion": f"WITH {LOG}, z AS (SELECT run_id, min(seq) AS z FROM t WHERE kind = 'run_deleted' GROUP BY 1) SELECT seq, run_id, kind FROM t LEFT JOIN z USING (run_id) WHERE z IS NULL OR seq <= z",
    "tl_run_summary": f"WITH {SUMMARY} SELECT * FROM sm",
    "tl_expiry": f"WITH {SUMMARY} {EXPIRED}",
    "tl_active_runs": f"WITH {SUMMARY} SELECT principal, count(*) FILTER (WHERE NOT deleted AND state NOT IN ('completed', 'failed', 'cancelled')) AS active FROM sm GROUP BY 1",
    "tl_list_runs": f"WITH {SUMMARY} SELECT run_id, principal, state, {ISO.format('created_ms')} AS created_at, {ISO.format('last_ms')} AS updated_at, source_uri FROM sm WHERE created AND NOT deleted",
    "tl_search": """WITH a AS (SELECT DISTINCT id, run_id, description, event_type FROM agent_events), m AS (SELECT id AS seq, run_id, coalesce(description, event_type) AS text FROM a)
        SELECT seq, run_id, text, (SELECT count(*) FROM m) AS scanned, (SELECT count(*) FROM m WHERE contains(lower(text), 'amber')) AS total_hits FROM m WHERE contains(lower(text), 'amber') ORDER BY seq LIMIT 500""",
    "tl_markers": f"""WITH {LOG} SELECT seq, 'mk-' || lpad(printf('%x', seq), 8, '0') AS marker_id, 't' || k % 3 AS event_type, seq AS start_frame, seq + k AS end_frame FROM t
        WHERE kind = 'keepalive_refreshed' AND k % 7 <> 0 AND k % 2 = 0 AND seq + k >= 1000 AND seq <= 200000""",
    "tl_interactions_of": f"""WITH {LOG}, c AS (SELECT run_id, k % 20 AS chunk_index, pts_ms, k FROM t WHERE kind = 'inference_completed' AND run_id = 'run-7' AND k % 3 = 1),
        g AS (SELECT k % 25 AS chunk_index, arg_max(k * 10, seq) AS a, arg_max(k * 10 + 5, seq) AS b FROM t WHERE kind = 'ingest_received' AND run_id = 'run-7' GROUP BY 1)
        SELECT run_id, chunk_index, CAST(coalesce(a, pts_ms) AS BIGINT) AS start_ms, CAST(coalesce(b, pts_ms) AS BIGINT) AS end_ms, CAST(unnest(CASE WHEN k % 4 > 0 THEN range(1, k % 4 + 1) ELSE [NULL] END) AS INT) AS item FROM c LEFT JOIN g USING (chunk_index)""",
    "tl_search_owned": """WITH a AS (SELECT DISTINCT id, run_id, description, event_type FROM agent_events WHERE run_id IN (SELECT run_id FROM runs WHERE capture_mode = 'live' OR length(run_id) % 2 = 0)), m AS (SELECT id AS seq, run_id, coalesce(description, event_type) AS text FROM a)
        SELECT seq, run_id, text, (SELECT count(*) FROM m) AS scanned, (SELECT count(*) FROM m WHERE contains(lower(text), 'amber')) AS total_hits FROM m WHERE contains(lower(text), 'amber') ORDER BY seq LIMIT 500""",
    "tl_stream": f"WITH {LOG} SELECT seq, pts_ms, kind, payload FROM t WHERE run_id = 'run-7' AND seq > 100 AND kind IN ('ingest_received', 'run_failed')",
    "tl_stream_cursor": f"WITH {LOG} SELECT max(seq) AS cursor FROM t WHERE run_id = 'run-7' AND seq > 100",
    "tl_kinds_refused": f"WITH {LOG} SELECT seq, CASE WHEN k + 1 > 96 THEN 'a kind has 1 to 96 bytes' WHEN kind LIKE 'webhook~_%' ESCAPE '~' THEN 'events about hooks are not delivered' END AS refused FROM t",
    "tl_interactions": f"""WITH {LOG}, c AS (SELECT run_id, k % 20 AS chunk_index, pts_ms, k FROM t WHERE kind = 'inference_completed' AND k % 3 < 3),
        g AS (SELECT run_id, k % 25 AS chunk_index, arg_max(k * 10, seq) AS a, arg_max(k * 10 + 5, seq) AS b FROM t WHERE kind = 'ingest_received' GROUP BY 1, 2),
        j AS (SELECT run_id, chunk_index, k, coalesce(a, pts_ms) AS start_ms, coalesce(b, pts_ms) AS end_ms FROM c LEFT JOIN g USING (run_id, chunk_index))
        SELECT run_id, chunk_index, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, CAST(unnest(CASE WHEN k % 4 > 0 THEN range(1, k % 4 + 1) ELSE [NULL] END) AS INT) AS item FROM j""",
    "tl_feedback": f"""WITH {SUMMARY} SELECT seq, run_id, CAST(k % 11 AS INT) AS rating, 'general' AS category, '' AS text, pts_ms * 1000 AS created_us FROM t JOIN sm USING (run_id)
        WHERE kind = 'operator_feedback_submitted' AND created AND NOT deleted""",
    "tl_webhooks": f"WITH {LOG}, {HOOKS} SELECT webhook_id, run_id, registered_seq, 2 AS kinds FROM h WHERE kind = 'webhook_registered'",
    "tl_hook_matches": f"WITH {LOG}, {HOOKS} SELECT h.webhook_id, t.seq, t.run_id, t.kind FROM h JOIN t USING (run_id) WHERE h.kind = 'webhook_registered' AND t.seq > registered_seq AND t.kind IN ('ingest_received', 'inference_completed')",
    "tl_delivery_state": f"""WITH {LOG} SELECT run_id AS webhook_id, count(*) FILTER (WHERE k % 10 < 6) AS delivered, count(*) FILTER (WHERE k % 10 = 6) AS dead_letters,
        coalesce(max(seq) FILTER (WHERE k % 10 < 8), 0) AS last_terminal_seq, arg_max('e' || k, seq) FILTER (WHERE k % 10 = 6) AS last_error FROM t GROUP BY 1""",
    "tl_policy_replay": f"""WITH {LOG}, c AS (SELECT k / 100.0 AS score FROM t WHERE kind = 'inference_completed' AND seq >= 10) SELECT count(*) AS candidates,
        count(*) FILTER (WHERE CAST(score AS DOUBLE) >= CAST(CAST(0.4 AS FLOAT) AS DOUBLE)) AS accepted, count(*) FILTER (WHERE CAST(score AS DOUBLE) < CAST(CAST(0.4 AS FLOAT) AS DOUBLE)) AS rejected, CAST(0 AS BIGINT) AS without_score FROM c""",
    "tl_append": f"""WITH {LOG}, n AS (SELECT 'run-' || s_suppkey AS run_id, 'stream-' || s_suppkey AS stream_id, s_suppkey FROM supplier WHERE 'run-' || s_suppkey NOT IN (SELECT run_id FROM t WHERE kind = 'run_deleted'))
        SELECT (SELECT max(seq) FROM t) + row_number() OVER (ORDER BY s_suppkey) AS seq, run_id, stream_id, {NOW} AS pts_ms, 'vlm' AS kind, '{{}}' AS payload FROM n""",
    "tl_cloud_event": f"WITH {LOG} SELECT seq, run_id || ':' || seq AS id, 'timeline.' || kind AS type, stream_id AS subject, {ISO.format('pts_ms')} AS time FROM t",
    "tl_commands": f"""WITH {SUMMARY}, x AS ({EXPIRED}), c AS (SELECT 'run-' || c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'delete' ELSE 'stop' END AS command FROM customer)
        SELECT run_id, command, CASE WHEN state IS NULL THEN 404 WHEN command = 'delete' THEN 202 WHEN deleted THEN 404 WHEN state IN ('completed', 'failed', 'cancelled', 'expired') THEN 409 ELSE 202 END AS status FROM c LEFT JOIN x USING (run_id)""",
    "tl_blob_allowed": f"WITH {LOG} SELECT DISTINCT run_id FROM t WHERE kind IN ('ingest_received', 'run_failed') AND lower(json_extract_string(payload, '$.sha256')) = '{SHA.lower()}'",
}
