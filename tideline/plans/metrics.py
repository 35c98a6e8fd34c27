"""Metric queries over the star schema and ``events``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import geometry
from tideline.functions import text as tx
from tideline.operators import metrics as me
from tideline.operators import moments as mo
from tideline.runtime import table

BOUNDS = (10, 25, 50, 100, 250)
THRESHOLDS = [round(k / 100, 2) for k in range(1, 51)]
PRICES = [("amber", 0.25, 1.5), ("amber pallet", 0.5, 3.0), ("camera", 0.3, 2.5), ("gauge", 1.5, 7.5)]


def calls(s: SparkSession, d: str) -> DataFrame:
    """Events as provider calls: type as provider, value as latency."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("provider"), F.col("value").alias("latency_ms"), k.alias("k"))


C_SQL = "c AS (SELECT event_id, user_id, event_type AS provider, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
HIST = C_SQL + """, b AS (SELECT * FROM (VALUES (0, 10, '10'), (1, 25, '25'), (2, 50, '50'), (3, 100, '100'), (4, 250, '250'), (5, 1e300, '+Inf')) v(position, bound, le)),
  h AS (SELECT provider, position, le, count(*) FILTER (WHERE latency_ms <= bound) AS cumulative, count(*) AS n, sum(latency_ms) AS total FROM c, b GROUP BY ALL)"""


def hist(s: SparkSession, d: str) -> DataFrame:
    return me.histogram(calls(s, d), "provider", "latency_ms", BOUNDS)


def suppliers(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as runs to choose between: balance as quality, two sums over their lines as cost and time."""
    lines = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_tax"), 2).alias("cost"), F.round(F.sum("l_quantity"), 2).alias("time"))
    return table(s, d, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.col("s_acctbal").alias("quality"), "cost", "time")


def priced(s: SparkSession, d: str) -> DataFrame:
    prices = s.createDataFrame(PRICES, "key string, in_rate double, out_rate double")
    rows = table(s, d, "agent_events").select("id", "description", "frame_index").distinct().where("description is not null")
    rows = me.longest_key(rows, "description", prices)
    prompt, seen, total = F.col("frame_index") % 1000, F.length("description"), F.col("frame_index") % 1000 + F.length("description") * 2
    return rows.select("id", F.round(me.cost(prompt, me.billed(prompt, seen, total), F.col("in_rate"), F.col("out_rate")), 12).alias("cost"))


def matched(s: SparkSession, d: str) -> DataFrame:
    """The first label (``K54-J9``) that events of a session name: even ids as labelled interactions, odd ones as detections."""
    label = F.regexp_extract(F.coalesce("description", F.lit("")), r"[A-Za-z]\d+(?:-[A-Za-z]\d+)?", 0)
    rows = table(s, d, "agent_events").select("session_id", "id", F.when(label != "", label).otherwise(F.col("event_type")).alias("element"), F.col("event_type").alias("action")).distinct()
    return me.greedy_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "session_id")


def quality(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("truths"), F.count_if(F.col("o_orderstatus") != "P").alias("founds"), F.count_if(F.col("o_orderstatus") == "F").alias("matched"))
    return rows.select("o_orderpriority", *[F.round(c, 12).alias(n) for n, c in me.quality(F.col("truths"), F.col("founds"), F.col("matched")).items()])


def changes(s: SparkSession, d: str) -> DataFrame:
    lines = lambda until: calls(s, d).where(F.col("event_id") < until).groupBy("provider", "user_id").agg(F.count("*").alias("n")).select(F.format_string('calls{provider="%s",user="%d"} %d', "provider", "user_id", "n").alias("value"))
    return me.changes(me.metric_lines(lines(1 << 40)), me.metric_lines(lines(5000)))


def tiers(s: SparkSession, d: str) -> DataFrame:
    base = calls(s, d)
    one = base.select(F.col("event_id").alias("id"), F.lit("small").alias("model"), F.concat(F.lit("a"), "k").alias("text"), (F.col("k") / 100).alias("confidence"), F.lit(10).cast("long").alias("tokens"))
    two = base.where("k % 5 != 0").select(F.col("event_id").alias("id"), F.when(F.col("k") % 7 == 0, "small").otherwise("large").alias("model"), F.concat(F.lit("b"), "k").alias("text"), F.lit(0.9).alias("confidence"), F.lit(100).cast("long").alias("tokens"), (F.col("k") % 11 == 0).alias("failed"))
    return me.tiered(one, two)


def attempts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    status = F.when(k % 4 == 0, 200).when(k % 4 == 1, 429).when(k % 4 == 2, 503).otherwise(400)
    return me.fallback(calls(s, d).select(F.floor(F.col("event_id") / 4).alias("request_id"), (F.col("event_id") % 4).alias("priority"), "provider", status.alias("status"), F.when(k % 9 == 0, "transport").alias("cause")))


def rollout(s: SparkSession, d: str) -> DataFrame:
    rows = calls(s, d).select("user_id", "latency_ms", (F.col("k") % 10 != 0).alias("ok"), F.col("k").alias("rss"))
    return me.rollout(rows, "user_id", 60, 0.88, 300.0, 99).withColumn("success", F.round("success", 12))


def detections(s: SparkSession, d: str) -> DataFrame:
    rows = calls(s, d).select("provider", F.lit(1).alias("truths"), (F.col("k") % 3).cast("long").alias("founds"), (F.col("k") % 2).cast("long").alias("matched"), "latency_ms", F.lit(30).alias("frames"), F.lit(2.0).alias("seconds"))
    return me.detection_summary(rows, "provider").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "mean_ms", "fps")})


def sweep(s: SparkSession, d: str) -> DataFrame:
    rows = calls(s, d).select((F.col("k") / 100).alias("score"), (F.col("k") > 45).alias("truth"))
    out = me.sweep(rows, "score", "truth", THRESHOLDS, 800.0, 40.0)
    return out.select("threshold", *[F.round(c, 12).alias(c) for c in ("reuse", "recall", "speedup")], "best")


def labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("tenant"), F.col("c_mktsegment").alias("label"), "c_custkey")
    own = table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("tenant"), F.lit("BUILDING").alias("label"), F.col("n_name").alias("name"))
    return mo.mapped_label(rows, own, s.createDataFrame([("BUILDING", "b"), ("MACHINERY", "m")], "label string, name string")).select("c_custkey", "mapped", "used_fallback")


def crops(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = calls(s, d).withColumns({"x": k / 200, "y": k / 400, "w": 0.5 - k / 400, "h": 0.25 + k / 800})
    return rows.select("event_id", geometry.resolved(F.lit(1921), F.lit(1081), F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("r")).select("event_id", "r.*")


def token_totals(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = me.counters(calls(s, d), "provider", {"errors": k % 10 == 0, "fallbacks": k % 10 == 1}, {"tokens": k.cast("long") * 10_000}, {"error_rate": ("errors", "calls")})
    return rows.withColumn("error_rate", F.round("error_rate", 12)).withColumnRenamed("calls", "chunks")


def texts(s: SparkSession, d: str) -> DataFrame:
    t = F.col("description")
    rows = table(s, d, "agent_events").select("id", "description", "pts_ms").distinct().where("description is not null")
    return rows.select("id", tx.cut(t, 20).alias("cut"), tx.cut_bytes(t, 20).alias("cut_bytes"), tx.unreliable(t, F.lit(2.0)).alias("unreliable"), tx.minutes_ms(F.lit("01:30")).alias("minutes_ms"), tx.rtp_ms(F.col("pts_ms")).alias("rtp_ms"), tx.wrapped_since(F.col("pts_ms"), F.lit(4_294_967_000)).alias("since"), F.sha2(t, 256).alias("sha"))


QUERIES = {
    "me_histogram": lambda s, d: hist(s, d).withColumn("total", F.round("total", 2)),
    "me_exposition": lambda s, d: me.exposition(hist(s, d), "latency_ms", "provider"),
    "me_percentiles": lambda s, d: me.percentiles(calls(s, d), "provider", "latency_ms", 0.95),
    "me_percentiles_lines": lambda s, d: me.percentiles(table(s, d, "lineitem"), "l_returnflag", "l_quantity", 0.99),
    "me_saturation": lambda s, d: me.saturation(calls(s, d), "user_id", "latency_ms", 300, 0.95),
    "me_quantile_bound": lambda s, d: me.quantile_bound(hist(s, d), "provider", 0.5),
    "me_quantile_linear": lambda s, d: me.quantile_linear(hist(s, d), "provider", 0.5).withColumn("quantile", F.round("quantile", 9)),
    "me_pareto": lambda s, d: me.pareto(suppliers(s, d), "s_suppkey", ("quality",), ("cost", "time")),
    "me_cost": priced,
    "me_greedy_match": matched,
    "me_quality": quality,
    "me_changes": changes,
    "me_tiered": tiers,
    "me_fallback": attempts,
    "me_rollout": rollout,
    "me_sweep": sweep,
    "me_token_totals": token_totals,
    "me_chunk_progress": lambda s, d: calls(s, d).select(F.when(F.col("k") % 3 > 0, F.col("k")).alias("chunk"), "provider").transform(lambda x: me.chunk_progress(x, "provider", "chunk")),
    "me_detection_summary": detections,
    "fn_label": labels,
    "fn_crop": crops,
    "fn_text": texts,
}

PCT = """SELECT {key}, n, v[CAST(floor((n - 1) * {p}::DOUBLE + 0.5) AS INT) + 1] AS nearest, v[CAST((n - 1) * {pc} // 100 AS INT) + 1] AS floor, v[CAST(greatest(ceil(n * {p}::DOUBLE) - 1, 0) AS INT) + 1] AS disc,
  v[CAST(ceil((n - 1) * {p}::DOUBLE) AS INT) + 1] AS ceil FROM (SELECT {key}, count(*) AS n, list_sort(list({value})) AS v FROM {t} GROUP BY {key})"""

SQL = {
    "me_histogram": f"WITH {HIST} SELECT provider, position, le, cumulative, n, round(total, 2) AS total FROM h",
    "me_exposition": f"""WITH {HIST} SELECT provider, position, 'latency_ms_bucket{{provider="' || provider || '",le="' || le || '"}} ' || cumulative AS line FROM h
        UNION ALL SELECT provider, 6, 'latency_ms_sum{{provider="' || provider || '"}} ' || printf('%.3f', total) FROM h WHERE position = 5 UNION ALL SELECT provider, 7, 'latency_ms_count{{provider="' || provider || '"}} ' || n FROM h WHERE position = 5""",
    "me_percentiles": f"WITH {C_SQL} " + PCT.format(key="provider", value="latency_ms", p="0.95", pc="95", t="c"),
    "me_percentiles_lines": PCT.format(key="l_returnflag", value="l_quantity", p="0.99", pc="99", t="lineitem"),
    "me_saturation": f"WITH {C_SQL} SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE latency_ms <= 300) AS within, count(*) >= 10 AND count(*) FILTER (WHERE latency_ms <= 300) < count(*) * 0.95 AS saturated FROM c GROUP BY 1",
    "me_quantile_bound": f"WITH {HIST} SELECT provider, min(CAST(bound AS DOUBLE)) FILTER (WHERE cumulative >= n * 0.5 AND le <> '+Inf') AS bound FROM h JOIN b USING (position, le) GROUP BY 1",
    "me_quantile_linear": f"""WITH {HIST}, q AS (SELECT provider, position, CAST(bound AS DOUBLE) AS hi, lag(CAST(bound AS DOUBLE), 1, 0) OVER w AS lo, cumulative, lag(cumulative, 1, 0) OVER w AS before, n * 0.5 AS target FROM h JOIN b USING (position, le) WHERE le <> '+Inf' WINDOW w AS (PARTITION BY provider ORDER BY position)),
        r AS (SELECT provider, position, CASE WHEN cumulative = before THEN hi ELSE lo + (target - before) / (cumulative - before) * (hi - lo) END AS v FROM q WHERE cumulative >= target) SELECT provider, round(arg_min(v, position), 9) AS quantile FROM r GROUP BY 1""",
    "me_pareto": """WITH s AS (SELECT s_suppkey, s_acctbal AS quality, round(sum(l_tax), 2) AS cost, round(sum(l_quantity), 2) AS time FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2)
        SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.quality >= a.quality AND b.cost <= a.cost AND b.time <= a.time AND (b.quality > a.quality OR b.cost < a.cost OR b.time < a.time))""",
    "me_cost": """WITH a AS (SELECT DISTINCT id, description, frame_index FROM agent_events WHERE description IS NOT NULL), p AS (SELECT * FROM (VALUES ('amber', 0.25::DOUBLE, 1.5::DOUBLE), ('amber pallet', 0.5, 3.0), ('camera', 0.3, 2.5), ('gauge', 1.5, 7.5)) v(key, i, o)),
        b AS (SELECT id, max_by((i, o), (length(key), key)) AS r FROM a JOIN p ON contains(lower(description), key) GROUP BY 1) SELECT a.id, round((frame_index % 1000 * coalesce(r[1], 0::DOUBLE) + greatest(length(description), length(description) * 2) * coalesce(r[2], 0::DOUBLE)) / 1000000.0, 12) AS cost FROM a LEFT JOIN b USING (id)""",
    "me_quality": """WITH q AS (SELECT o_orderpriority, count(*) AS t, count(*) FILTER (WHERE o_orderstatus <> 'P') AS f, count(*) FILTER (WHERE o_orderstatus = 'F') AS m FROM orders GROUP BY 1), r AS (SELECT o_orderpriority, m / f AS p, m / t AS r FROM q)
        SELECT o_orderpriority, round(p, 12) AS precision, round(r, 12) AS recall, round(2 * p * r / (p + r), 12) AS f1 FROM r""",
    "me_changes": f"""WITH {C_SQL} SELECT 'calls' AS name, 'provider="' || provider || '",user="' || user_id || '"' AS labels, CAST(count(*) FILTER (WHERE event_id >= 5000) AS DOUBLE) AS growth FROM c GROUP BY provider, user_id""",
    "me_tiered": f"""WITH {C_SQL}, r AS (SELECT *, k % 5 <> 0 AND k % 7 <> 0 AND k / 100.0 < 0.7 AS asked FROM c), u AS (SELECT *, asked AND k % 11 <> 0 AS used FROM r)
        SELECT event_id AS id, CASE WHEN used THEN 'b' || k ELSE 'a' || k END AS text, CAST(CASE WHEN used THEN 0.9 ELSE k / 100.0 END AS DOUBLE) AS confidence, asked AS second_pass, CAST(CASE WHEN used THEN 110 ELSE 10 END AS BIGINT) AS tokens FROM u""",
    "me_fallback": f"""WITH {C_SQL}, a AS (SELECT event_id // 4 AS request_id, event_id % 4 AS priority, provider, k % 4 IN (1, 2) OR k % 9 = 0 AS passing FROM c) SELECT request_id, coalesce(arg_min(provider, priority) FILTER (WHERE NOT passing), arg_max(provider, priority)) AS provider, count(*) FILTER (WHERE passing) AS passed_over FROM a GROUP BY 1""",
    "me_rollout": f"""WITH {C_SQL}, g AS (SELECT user_id, count(*) AS samples, avg(CASE WHEN k % 10 <> 0 THEN 1.0 ELSE 0.0 END) AS success, max(k) AS rss, list_sort(list(latency_ms))[CAST(ceil(count(*) * 0.95::DOUBLE) AS INT)] AS p95_ms FROM c GROUP BY 1)
        SELECT user_id, samples, round(success, 12) AS success, rss, p95_ms, CASE WHEN samples < 60 THEN 'wait' WHEN success >= 0.88 AND p95_ms <= 300 AND rss <= 99 THEN 'advance' ELSE 'roll_back' END AS decision FROM g""",
    "me_sweep": f"""WITH {C_SQL}, t AS (SELECT unnest(range(1, 51)) AS t), x AS (SELECT t / 100.0 AS threshold, count(*) AS n, count(*) FILTER (WHERE k > 45) AS m, count(*) FILTER (WHERE k > t) AS run, count(*) FILTER (WHERE k > t AND k > 45) AS hit FROM c, t GROUP BY t),
        y AS (SELECT CAST(threshold AS DOUBLE) AS threshold, (n - run) / n AS reuse, hit / m AS recall, n * 800.0::DOUBLE / (run * 800.0::DOUBLE + n * 40.0::DOUBLE) AS speedup FROM x)
        SELECT threshold, round(reuse, 12) AS reuse, round(recall, 12) AS recall, round(speedup, 12) AS speedup, row_number() OVER (ORDER BY recall >= 0.98 DESC, speedup DESC, threshold) = 1 AND recall >= 0.98 AS best FROM y""",
    "me_token_totals": f"WITH {C_SQL} SELECT provider, CAST(least(sum(CAST(k AS BIGINT) * 10000), 4294967295) AS BIGINT) AS tokens, count(*) AS chunks, count(*) FILTER (WHERE k % 10 = 0) AS errors, count(*) FILTER (WHERE k % 10 = 1) AS fallbacks, round(count(*) FILTER (WHERE k % 10 = 0) / count(*), 12) AS error_rate FROM c GROUP BY 1",
    "me_chunk_progress": f"WITH {C_SQL} SELECT provider, count(DISTINCT k) FILTER (WHERE k % 3 > 0) AS chunks, count(*) FILTER (WHERE k % 3 = 0) AS without FROM c GROUP BY 1",
    "me_detection_summary": f"""WITH {C_SQL}, g AS (SELECT provider, count(*) AS t, sum(k % 3) AS f, sum(k % 2) AS m, min(latency_ms) AS least_ms, avg(latency_ms) AS mean_ms, max(latency_ms) AS most_ms FROM c GROUP BY 1), r AS (SELECT *, m / f AS p, m / t AS r FROM g)
        SELECT provider, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, least_ms, round(mean_ms, 9) AS mean_ms, most_ms, 15.0::DOUBLE AS fps FROM r""",
    "fn_label": """SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' AND n_regionkey = 1 THEN n_name END, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END, c_mktsegment) AS mapped, NOT coalesce(c_mktsegment = 'BUILDING' AND n_regionkey = 1, false) AS used_fallback FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "fn_crop": f"""WITH {C_SQL}, r AS (SELECT event_id, k / 200.0 AS x, k / 400.0 AS y, 0.5 - k / 400.0 AS w, 0.25 + k / 800.0 AS h FROM c), q AS (SELECT event_id, CAST(floor(1921 * x) AS INT) & -2 AS px, CAST(floor(1081 * y) AS INT) & -2 AS py, CAST(floor(1921 * w) AS INT) & -2 AS pw, CAST(floor(1081 * h) AS INT) & -2 AS ph FROM r)
        SELECT event_id, px AS x, py AS y, greatest(least(pw, (1921 & -2) - px), 2) AS width, greatest(least(ph, (1081 & -2) - py), 2) AS height FROM q""",
    "fn_text": """WITH a AS (SELECT DISTINCT id, description AS d, pts_ms FROM agent_events WHERE description IS NOT NULL), w AS (SELECT *, list_filter(string_split_regex(lower(d), '\\s+'), lambda x: x <> '') AS t FROM a),
        g AS (SELECT *, list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS tri FROM w)
        SELECT id, substr(d, 1, 20) AS cut, list_filter(list_transform(range(20, -1, -1), lambda n: substr(d, 1, n)), lambda x: octet_length(encode(x)) <= 20)[1] AS cut_bytes, len(t) > 16 OR (len(t) >= 9 AND len(list_distinct(tri)) / len(tri) < 0.45) AS unreliable, CAST(90000 AS BIGINT) AS minutes_ms, pts_ms // 90 AS rtp_ms, (pts_ms - 4294967000 + 4294967296) % 4294967296 AS since, sha256(d) AS sha FROM g""",
}
