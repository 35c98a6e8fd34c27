"""Reads and folds of the event timeline: (seq, run_id, stream_id, pts_ms, kind, payload).

Every function takes and gives DataFrames, states its filters on plain columns so that they reach the scan, and folds runs by
order-free aggregates (``max_by`` over ``seq``), so that no run's events are held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.runtime import written

# Which kinds set a run's state, and which states are final.
STATE_OF = {
    "run_created": "pending", "ingest_received": "processing", "analysis_generated": "processing", "inference_completed": "processing",
    "keepalive_refreshed": "processing", "run_completed": "completed", "run_failed": "failed", "stop_requested": "cancelled",
}
APPENDED = 1 << 18  # positions of a range of appended events
FINAL = ("completed", "failed", "cancelled", "expired")
TTL_BOUNDS, TTL_DEFAULT = (60, 86_400), 3600


def path(payload: str | Column, at: str) -> Column:
    """The text at a JSON path; null where the payload is no JSON or lacks it."""
    return F.get_json_object(payload, at)


def query(events: DataFrame, run_id: str, kind: str | None = None, from_seq: int | None = None) -> DataFrame:
    """A run's events of a kind from a sequence on (inclusive), in order."""
    rows = events.where(F.col("run_id") == run_id)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if from_seq is not None:
        rows = rows.where(F.col("seq") >= from_seq)
    return rows.select("seq", "pts_ms", "kind", "payload").orderBy("seq")


def after(events: DataFrame, cursor: int, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """The next ``limit`` events after a cursor (exclusive); a kind filter does not hold the cursor back."""
    rows = events.where(F.col("seq") > cursor).orderBy("seq").limit(limit)
    return rows.where(F.col("kind").isin(kinds)) if kinds else rows


def by_index(events: DataFrame, run_id: str, index: str | None = None, at: str = "$.index_name") -> DataFrame:
    """A run's events, with an index only those whose payload names it."""
    rows = events.where(F.col("run_id") == run_id)
    return rows.where(path("payload", at) == index) if index is not None else rows


def tail(events: DataFrame, most: int = 256) -> DataFrame:
    """The ``most`` events of highest sequence of each run; an event present twice counts once."""
    w = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    # rank() <= n lets each task keep only its own n before the exchange.
    return events.dropDuplicates(["run_id", "seq"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def missing_from(log: DataFrame, index: DataFrame) -> DataFrame:
    """Events of the log that the index lacks."""
    return log.join(index.select("seq"), "seq", "left_anti")


def before_deletion(events: DataFrame) -> DataFrame:
    """Events without those that follow their run's deletion."""
    end = events.where("kind = 'run_deleted'").groupBy("run_id").agg(F.min("seq").alias("_end"))
    return events.join(end, "run_id", "left").where("_end is null or seq <= _end").drop("_end")


def run_summary(events: DataFrame, principal_path: str = "$.principal_key", source_path: str = "$.source_uri") -> DataFrame:
    """Per run: created, deleted, principal of the latest creation that names one (``public`` if none does), state set by the last
    event that sets one (also after a final one), first and last time, time of the first creation, source of the first input."""
    state = F.create_map(*[x for k, v in STATE_OF.items() for x in (F.lit(k), F.lit(v))])
    rows = events.select("run_id", "seq", "pts_ms", "kind", F.try_element_at(state, F.col("kind")).alias("s"), F.when(F.col("kind") == "run_created", path("payload", principal_path)).alias("p"), F.when(F.col("kind") == "ingest_received", path("payload", source_path)).alias("u"))
    made = F.col("kind") == "run_created"
    return rows.groupBy("run_id").agg(
        F.bool_or(F.col("kind") == "run_created").alias("created"), F.bool_or(F.col("kind") == "run_deleted").alias("deleted"),
        F.coalesce(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("seq"))), F.lit("public")).alias("principal"),
        F.coalesce(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("seq"))), F.lit("pending")).alias("state"),
        F.min("pts_ms").alias("first_ms"), F.max("pts_ms").alias("last_ms"), F.min_by("pts_ms", F.when(made, F.col("seq"))).alias("created_ms"),
        F.min_by("u", F.when(F.col("u").isNotNull(), F.col("seq"))).alias("source_uri"),
    )


def with_expiry(summary: DataFrame, now_ms: int, ttl_s: int = TTL_DEFAULT) -> DataFrame:
    """States with ``expired`` for a run that is not final and was idle for longer than the time to live (0: never)."""
    if ttl_s and not TTL_BOUNDS[0] <= ttl_s <= TTL_BOUNDS[1]:
        raise ValueError(f"time to live must be 0 or in {TTL_BOUNDS} seconds")
    idle = (~F.col("state").isin(*FINAL)) & (F.col("last_ms") > 0) & (F.lit(now_ms) - F.col("last_ms") > ttl_s * 1000) & F.lit(ttl_s > 0)
    return summary.withColumn("state", F.when(idle, "expired").otherwise(F.col("state")))


def active_runs(summary: DataFrame) -> DataFrame:
    """Runs per principal that are neither deleted nor final."""
    return summary.groupBy("principal").agg(F.count_if(~F.col("deleted") & ~F.col("state").isin(*FINAL)).alias("active"))


def iso(ms: str | Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def list_runs(summary: DataFrame, principal: str | None = None) -> DataFrame:
    rows = summary.where("created and not deleted")
    rows = rows.where(F.col("principal") == principal) if principal is not None else rows
    return rows.select("run_id", "principal", "state", iso("created_ms").alias("created_at"), iso("last_ms").alias("updated_at"), "source_uri").orderBy("created_at", "run_id")


def owned(events: DataFrame, runs: DataFrame) -> DataFrame:
    return events.join(runs.select("run_id"), "run_id", "left_semi")


def owned_runs(summary: DataFrame, principal: str) -> DataFrame:
    """Runs that a principal created and that are not deleted."""
    return summary.where("created and not deleted").where(F.col("principal") == principal).select("run_id")


def stream_from(events: DataFrame, run_id: str, after_seq: int = 0, kinds: list[str] | None = None, until_seq: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a reader of a run's event stream gets after its cursor (exclusive), in order, and the cursor it then holds: the last
    sequence of the run that was looked at, so that a filter of kinds does not hold it back. ``until_seq`` is how far the log was
    read; the rest comes live, from the cursor on."""
    rows = events.where((F.col("run_id") == run_id) & (F.col("seq") > after_seq))
    rows = rows.where(F.col("seq") <= until_seq) if until_seq is not None else rows
    cursor = rows.agg(F.coalesce(F.max("seq"), F.lit(after_seq).cast("long")).alias("cursor"))
    told = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    return told.select("seq", "pts_ms", "kind", "payload").orderBy("seq"), cursor


def search(records: DataFrame, text: str, limit: int = 50, run_id: str | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Records (seq, run_id, description, summary), of ``runs`` only if they are given, whose description, else summary, contains a text whatever its case; the
    first ``limit`` by sequence, each with the number scanned and the number of all hits."""
    text = text.strip()
    if not 1 <= len(text.encode()) <= 1024 or not 1 <= limit <= 500:
        raise ValueError("a search text has 1 to 1024 bytes and a limit of 1 to 500")
    rows = records.where(F.col("run_id") == run_id) if run_id is not None else records
    rows = owned(rows, runs) if runs is not None else rows
    said = F.coalesce(F.col("description"), F.col("summary"))
    hit = F.coalesce(F.contains(F.lower(said), F.lit(text.lower())), F.lit(False))
    marked = rows.select("seq", "run_id", said.alias("text"), hit.alias("hit"))
    totals = marked.agg(F.count("*").alias("scanned"), F.count_if("hit").alias("total_hits"))
    first = marked.where("hit").orderBy("seq").limit(limit).drop("hit")
    return first.crossJoin(F.broadcast(totals))  # totals is one row


def markers(events: DataFrame, status: str | None = None, event_type: str | None = None, from_frame: int | None = None, to_frame: int | None = None) -> DataFrame:
    """Markers whose frames overlap a range (a side left out is open); an unreadable one is dropped."""
    schema = "marker_id string, event_type string, status string, start_frame long, end_frame long, confidence double"
    # One parse: the marker comes out of a generator, which the tests below are not pushed through.
    rows = events.where("kind = 'marker_emitted'").select("seq", "run_id", F.explode(F.array(F.from_json("payload", schema))).alias("m")).select("seq", "run_id", "m.*")
    rows = rows.where("marker_id is not null and event_type is not null and status is not null and start_frame is not null and end_frame is not null")
    for wanted, column in ((status, "status"), (event_type, "event_type")):
        rows = rows.where(F.col(column) == wanted) if wanted is not None else rows
    rows = rows.where(F.col("end_frame") >= from_frame) if from_frame is not None else rows
    rows = rows.where(F.col("start_frame") <= to_frame) if to_frame is not None else rows
    return rows.orderBy("start_frame", "end_frame", "marker_id")


def interactions(chunks: DataFrame, timings: DataFrame, run_id: str | None = None, index: str | None = None) -> DataFrame:
    """Inferred chunks (run_id, chunk_index, index_name, pts_ms, items array), of one run or index if asked for, with the last known
    timing (run_id, chunk_index, start_ms, end_ms) of their run and number (seq decides, whatever index it names), their own time
    where there is none; one row per item, one without for a chunk that has none."""
    if run_id is not None:
        chunks, timings = (df.where(F.col("run_id") == run_id) for df in (chunks, timings))
    chunks = chunks.where(F.col("index_name") == index) if index is not None else chunks
    last = timings.groupBy("run_id", "chunk_index").agg(F.max_by(F.struct("start_ms", "end_ms"), "seq").alias("t"))
    rows = chunks.join(last, ["run_id", "chunk_index"], "left")
    return rows.select("run_id", "chunk_index", F.coalesce("t.start_ms", "pts_ms").alias("start_ms"), F.coalesce("t.end_ms", "pts_ms").alias("end_ms"), F.explode_outer("items").alias("item"))


def feedback(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback on known runs, with defaults for what it lacks; time in microseconds."""
    rows = owned(events.where("kind = 'operator_feedback_submitted'"), runs)
    return rows.select(
        "seq", "run_id", F.coalesce(path("payload", "$.rating").cast("int"), F.lit(0)).alias("rating"), F.coalesce(path("payload", "$.category"), F.lit("general")).alias("category"),
        F.coalesce(path("payload", "$.text"), F.lit("")).alias("text"), (F.col("pts_ms") * 1000).alias("created_us"),
    )


def feedback_error(rating: Column, category: Column, text: Column) -> Column:
    """Why feedback is refused; null if it is not."""
    size = F.octet_length(category)
    return F.when(~rating.between(0, 10), "rating").when(~size.between(1, 64), "category").when(F.octet_length(text) > 65_536, "text")


def blob_allowed(events: DataFrame, sha: str, paths: dict[str, str]) -> DataFrame:
    """Runs whose events of a trusted kind refer to a blob, whatever the digits' case."""
    where = F.lit(False)
    for kind, at in paths.items():
        where = where | ((F.col("kind") == kind) & (F.lower(path("payload", at)) == sha.lower()))
    return events.where(where).select("run_id").distinct()


# ---- webhooks -----------------------------------------------------------------------------------------------------


MOST_KINDS, KIND_BYTES = 32, 96  # fixed values


def event_kinds_error(kinds: Column) -> Column:
    """Why a filter of kinds is refused; null if it is not: more than 32 of them, one of no or more than 96 bytes, one about hooks."""
    trimmed = F.transform(kinds, lambda k: F.trim(k))
    return (
        F.when(F.size(kinds) > MOST_KINDS, "too many kinds").when(F.exists(trimmed, lambda k: k.isNull() | ~F.octet_length(k).between(1, KIND_BYTES)), "a kind has 1 to 96 bytes")
        .when(F.exists(trimmed, lambda k: k.startswith("webhook_")), "events about hooks are not delivered")
    )


def event_kinds(kinds: Column) -> Column:
    """A filter's kinds: trimmed, each once, in order. Raises for one that is refused."""
    why = event_kinds_error(kinds)
    return F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.array_sort(F.array_distinct(F.transform(kinds, lambda k: F.trim(k)))))


def webhooks(events: DataFrame) -> DataFrame:
    """Registered hooks whose last event is no deletion."""
    rows = events.where("kind in ('webhook_registered', 'webhook_deleted')").withColumn("webhook_id", path("payload", "$.webhook_id"))
    last = rows.where("webhook_id is not null").groupBy("webhook_id").agg(F.max_by(F.struct("seq", "kind", "run_id", "payload"), "seq").alias("e"))
    last = last.where("e.kind = 'webhook_registered'")
    kinds = F.coalesce(F.from_json(path("e.payload", "$.event_kinds"), "array<string>"), F.array().cast("array<string>"))
    return last.select("webhook_id", F.col("e.run_id").alias("run_id"), F.col("e.seq").alias("registered_seq"), event_kinds(kinds).alias("event_kinds"))


def hook_matches(hooks: DataFrame, events: DataFrame) -> DataFrame:
    """(webhook_id, seq) of the events a hook is told: of its run, after its cursor, of its kinds (none: all), no event about
    hooks, and of triggers only those that ask for it."""
    e = events.where(~F.col("kind").startswith("webhook_"))
    e = e.where(~F.col("kind").startswith("trigger.") | F.coalesce(path("payload", "$.trigger.actions.webhook") == "true", F.lit(False)))
    rows = e.join(hooks, "run_id").where("seq > registered_seq")
    return rows.where((F.size("event_kinds") == 0) | F.array_contains("event_kinds", F.col("kind"))).select("webhook_id", "seq", "run_id", "kind")


def delivery_state(log: DataFrame) -> DataFrame:
    """Per hook from its delivery log (webhook_id, seq, state, error, line): deliveries, dead letters, the highest finished
    sequence and the error of the last dead letter."""
    dead = F.col("state") == "dead_letter"
    return log.groupBy("webhook_id").agg(
        F.count_if(F.col("state") == "delivered").alias("delivered"), F.count_if(dead).alias("dead_letters"),
        F.coalesce(F.max(F.when(F.col("state").isin("delivered", "dead_letter", "checkpoint"), F.col("seq"))), F.lit(0).cast("long")).alias("last_terminal_seq"),
        F.max_by("error", F.when(dead, F.col("line"))).alias("last_error"),
    )


def policy_replay(events: DataFrame, threshold: float | None, from_seq: int = 0, to_seq: int | None = None, kind: str = "restricted_zone_activity_entered") -> DataFrame:
    """How many persisted candidates a threshold accepts. It is held as a 32-bit number and compared as a 64-bit one."""
    rows = events.where((F.col("kind") == kind) & (F.col("seq") >= from_seq))
    rows = rows.where(F.col("seq") <= to_seq) if to_seq is not None else rows
    score = F.coalesce(path("payload", "$.confidence"), path("payload", "$.assertion.trigger.score")).try_cast("double")
    bound = F.lit(threshold).cast("float").cast("double")
    rows = rows.select(score.alias("score"))
    return rows.agg(
        F.count("*").alias("candidates"), F.count_if(score_ok := F.col("score") >= bound).alias("accepted"), F.count_if(~score_ok).alias("rejected"),
        F.count_if(F.col("score").isNull() | bound.isNull()).alias("without_score"),
    )


# ---- writing ------------------------------------------------------------------------------------------------------


def appended(log: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """``new`` (run_id, stream_id, kind, payload, position) as events that follow the log's: sequences go on densely in order
    of position. Events of runs that were deleted are refused. Rows are numbered within ranges of positions, each range after the
    counts of those before it, so no task holds them all."""
    gone = log.where("kind = 'run_deleted'").select("run_id").distinct()
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("_top"))
    rows = written(new.join(gone, "run_id", "left_anti").withColumn("_part", F.floor(F.col("position") / APPENDED)))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    rows = rows.join(parts, "_part").crossJoin(F.broadcast(top))  # top is one row
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("position"))
    return rows.select((F.col("_top") + number).alias("seq"), "run_id", "stream_id", F.lit(now_ms).cast("long").alias("pts_ms"), "kind", "payload")


def cloud_event(events: DataFrame, type_prefix: str) -> DataFrame:
    """Events in a CloudEvents envelope."""
    return events.select(
        "seq", F.lit("1.0").alias("specversion"), F.concat_ws(":", "run_id", F.col("seq").cast("string")).alias("id"), F.concat(F.lit("/v1/runs/"), "run_id").alias("source"),
        F.concat(F.lit(type_prefix), "kind").alias("type"), F.col("stream_id").alias("subject"), iso("pts_ms").alias("time"), F.col("payload").alias("data"),
    )


def command_allowed(summary: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands`` (run_id, command) with a status: 404 unknown run, 409 final state (a deletion may be repeated), 202 else."""
    rows = commands.join(summary.select("run_id", "state", "deleted"), "run_id", "left")
    status = F.when(F.col("state").isNull(), 404).when(F.col("command") == "delete", 202).when(F.col("deleted"), 404).when(F.col("state").isin(*FINAL), 409).otherwise(202)
    return rows.select("run_id", "command", status.alias("status"))
