"""All queries outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.operators import faults, intervals, messages
from tideline.plans import frames, live, metrics, timeline
from tideline.runtime import table

DATA = {
    "p2_found": lambda s, d: intervals.covered(table(s, d, "multimodal_moments")),
    "p4_found": lambda s, d: faults.faults(table(s, d, "frame_signals")),
    "p5_found": lambda s, d: messages.repeats(table(s, d, "cloud_envelopes")).select("delivery_id"),
    "p5_kept": lambda s, d: messages.kept(table(s, d, "cloud_envelopes")).select("delivery_id", "batch_id", "ce_type"),
}

MESSAGES = """m AS (SELECT delivery_id, batch_id, ce_type, lower(coalesce(run_id, regexp_extract(ce_id, '^(.*):[0-9]+$', 1), regexp_extract(ce_source, '/runs/([^/]+)$', 1))) AS run,
    coalesce(sequence, CAST(regexp_extract(ce_id, ':([0-9]+)$', 1) AS BIGINT)) AS seq FROM cloud_envelopes),
    n AS (SELECT *, row_number() OVER (PARTITION BY run, seq ORDER BY delivery_id) AS n FROM m)"""

DATA_SQL = {
    "p2_found": """
        WITH m AS (SELECT DISTINCT stream_id, lower(trim(x)) AS modality, start_pts_ms AS s, end_pts_ms AS e FROM (SELECT *, unnest(modalities) AS x FROM multimodal_moments) WHERE end_pts_ms > start_pts_ms),
        r AS (SELECT *, max(e) OVER (PARTITION BY stream_id, modality ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m WHERE modality IN ('audio', 'video')),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, modality ORDER BY s, e) AS k FROM r),
        p AS (SELECT stream_id, modality, k, min(s) AS a, max(e) AS b FROM g GROUP BY ALL),
        q AS (SELECT *, lead(a) OVER (PARTITION BY stream_id, modality ORDER BY a) AS nxt FROM p)
        SELECT stream_id, modality, 'period' AS span, a AS start_ms, b AS end_ms FROM q
        UNION ALL SELECT stream_id, modality, 'gap', b, nxt FROM q WHERE nxt IS NOT NULL""",
    "p5_found": f"WITH {MESSAGES} SELECT delivery_id FROM n WHERE n > 1",
    "p5_kept": f"WITH {MESSAGES} SELECT delivery_id, batch_id, ce_type FROM n WHERE n = 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return DATA | timeline.QUERIES | frames.QUERIES | metrics.QUERIES | live.QUERIES


def oracle_sql() -> dict[str, str]:
    return DATA_SQL | timeline.SQL | frames.SQL | metrics.SQL | live.SQL
