"""Queries of this subpackage: name -> (spark, folder of tables) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import forms, leaks, mixing, near, runs
from tideline.runtime import table


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.item_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.copies(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: near.found(table(s, d, "frame_signals"), table(s, d, "agent_events")),
        "p1_classes": lambda s, d: near.classes(table(s, d, "frame_signals"), table(s, d, "agent_events")),
        "p3_found": lambda s, d: runs.repeated(table(s, d, "agent_events")),
        "p3_collapsed": lambda s, d: runs.collapse(table(s, d, "agent_events")),
        "p6_found": lambda s, d: leaks.leaked(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_overlaps": lambda s, d: leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_report": p6_report,
        "p7_copies": p7_copies,
        "p7_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: forms.look_alikes(table(s, d, "documents")),
        "p8_classes": lambda s, d: forms.form_classes(table(s, d, "documents")),
        "p8_forms": lambda s, d: forms.with_forms(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "normal_form", F.length("appearance").alias("visible_chars")),
    }


WORDS = "list_distinct(regexp_extract_all(lower(description), '[\\p{L}\\p{N}]+'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(text: str) -> str:
    """The appearance of a text in SQL: characters that show nothing removed, ligatures written out, the rest character by
    character between two compositions. Covers the characters of the basic plane that stand for one other, and Latin ligatures."""
    gone = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in forms.IGNORABLE)
    out = f"regexp_replace({text}, '[{gone}]', '', 'g')"
    for c in range(0xFB00, 0xFB07):
        out = f"replace({out}, '{chr(c)}', '{forms.appearance_of(chr(c))}')"
    pairs = [(chr(c), forms.appearance_of(chr(c))) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return f"nfc_normalize(translate(nfc_normalize({out}), {_quoted(''.join(a for a, _ in pairs))}, {_quoted(''.join(b for _, b in pairs))}))"


def oracle_sql() -> dict[str, str]:
    chain = f"""
        WITH e AS (SELECT DISTINCT ON (id) id, session_id, pts_ms, event_type, description, {WORDS} AS w FROM agent_events ORDER BY id),
        l AS (SELECT *, lag(event_type) OVER s AS lt, lag(w) OVER s AS lw, row_number() OVER s AS n FROM e WINDOW s AS (PARTITION BY session_id ORDER BY pts_ms)),
        c AS (SELECT *, CASE WHEN n > 1 AND lt IS NOT DISTINCT FROM event_type AND w IS NOT NULL AND lw IS NOT NULL AND len(w) + len(lw) > 0
              AND 10 * len(list_intersect(w, lw)) >= 7 * (len(w) + len(lw) - len(list_intersect(w, lw))) THEN 0 ELSE 1 END AS head FROM l),
        g AS (SELECT *, sum(head) OVER (PARTITION BY session_id ORDER BY pts_ms) AS run FROM c),
        r AS (SELECT session_id, arg_min(event_type, pts_ms) AS event_type, arg_min(id, pts_ms) AS first_id, arg_max(id, pts_ms) AS last_id, min(pts_ms) AS start_ms, max(pts_ms) AS end_ms,
              max(pts_ms) - min(pts_ms) AS duration_ms, count(*) AS events FROM g GROUP BY session_id, run)"""
    grams = lambda w, n: f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
    looks = f"f AS (SELECT doc_id, text, {form_sql('text')} AS form FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)), v AS (SELECT * FROM f WHERE regexp_matches(form, '\\S'))"
    near = f"""
        WITH h AS (SELECT DISTINCT frame_id, stream_id, perceptual_hash AS h FROM frame_signals WHERE perceptual_hash IS NOT NULL), b AS (SELECT *, unnest(range(7)) AS i FROM h), k AS (SELECT *, (h >> (9 * i)) & 511 AS v FROM b),
        fp AS (SELECT DISTINCT x.frame_id AS id_a, y.frame_id AS id_b FROM k x JOIN k y ON x.i = y.i AND x.v = y.v AND x.frame_id < y.frame_id AND x.stream_id <> y.stream_id WHERE bit_count(xor(x.h, y.h)) <= 6),
        e AS (SELECT DISTINCT id, run_id, regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}]+') AS w FROM agent_events WHERE description IS NOT NULL), s AS (SELECT id, run_id, list_distinct({grams('w', 3)}) AS g FROM e WHERE len(w) >= 15),
        u AS (SELECT id, run_id, len(g) AS n, unnest(g) AS x FROM s), c AS (SELECT p.id AS id_a, q.id AS id_b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS shared FROM u p JOIN u q ON p.x = q.x AND p.id < q.id AND p.run_id <> q.run_id GROUP BY 1, 2)"""
    return {
        "p1_found": near + " SELECT 'frame' AS record_kind, id_a, id_b FROM fp UNION ALL SELECT 'event', id_a, id_b FROM c WHERE 2 * shared >= n + m - shared",
        "p6_found": f"""WITH {looks}, d AS (SELECT doc_id, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') AS w FROM v), i AS (SELECT item_id, regexp_extract_all(lower({form_sql('item_text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items),
            dg AS (SELECT doc_id, unnest({grams('w', 13)}) AS g FROM d WHERE len(w) >= 13), ig AS (SELECT item_id, unnest({grams('w', 13)}) AS g FROM i WHERE len(w) >= 13) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p8_found": f"WITH {looks} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
        "p8_classes": f"""WITH {looks}, c AS (SELECT form, min(doc_id) AS class_id, count(*) AS documents, count(DISTINCT text) AS strings FROM v GROUP BY form), m AS (SELECT doc_id, class_id, documents, strings FROM v JOIN c USING (form))
            SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(documents, 1) AS documents, coalesce(strings, 1) AS strings FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN m USING (doc_id)""",
        "p3_found": chain + " SELECT session_id, first_id, last_id FROM r WHERE events >= 2",
        "p3_collapsed": chain + " SELECT * FROM r",
    }
