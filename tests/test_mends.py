"""Refusals, whole results and single passes."""

import sys

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tideline import runtime
from tideline.operators import metrics as me
from tideline.operators import timeline as tl
from tideline.operators import windows as w
from tideline.sources import wal


def test_a_machine_local_folder_is_refused_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_a_broken_import_in_the_optional_part_is_an_error(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "tideline.llm.forms", None)
    monkeypatch.delitem(sys.modules, "tideline.llm.queries", raising=False)
    monkeypatch.delitem(sys.modules, "tideline.llm", raising=False)
    try:
        importlib.import_module("tideline.llm")
    except ModuleNotFoundError:
        pytest.skip("the optional part is not there")
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)


def test_log_lines_keep_what_they_hold(spark):
    data = [("1\tr\ts\t5\tk\ta\x00b",), ("2\tr\ts\t5\tk\tp\tq\tr",), ("3\tr\ts\t5\tk",), ("x\tr\ts\t5\tk\tp",), ("4\tr\ts\t5\tk\t" + r"\\t\t\\\n\x\\",), (None,), ("-1\tr\ts\t5\tk\tp",)]
    got = {r.seq: r.payload for r in wal.decoded(spark.createDataFrame(data, "value string")).collect()}
    assert got == {1: "a\x00b", 2: "p\tq\tr", 4: "\\t\t\\\n\\x\\"}
    back = wal.decoded(wal.encoded(wal.decoded(spark.createDataFrame(data, "value string"))))
    assert {r.seq: r.payload for r in back.collect()} == got


def test_lines_that_are_no_text_are_an_error(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"1\tr\ts\t5\tk\t\xff\xfe\n")
    with pytest.raises(Exception, match="not UTF-8"):
        wal.read(spark, str(tmp_path / "log")).collect()


def test_a_line_is_split_once(spark):
    plan = wal.decoded(spark.createDataFrame([("a",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") - plan.count("split(p#") <= 6 and plan.count(", \t, 6)") == 1


def test_kinds_are_refused_not_cut(spark):
    kinds = lambda k: spark.createDataFrame([(k,)], "k array<string>").select(tl.event_kinds(F.col("k")).alias("k"))
    assert kinds([" b ", "a", "b"]).first().k == ["a", "b"] and kinds([]).first().k == []
    for bad in ([f"k{n}" for n in range(33)], ["x" * 97], [" "], ["webhook_registered"]):
        with pytest.raises(Exception):
            kinds(bad).collect()


def test_the_last_creation_that_names_a_principal(spark):
    e = spark.createDataFrame([(1, "r", 5, "run_created", '{"principal_key":"p"}'), (2, "r", 9, "run_created", "{}"), (0, "r", 1, "vlm", "{}"), (3, "r", 10, "ingest_received", '{"source_uri":"u"}')], "seq long, run_id string, pts_ms long, kind string, payload string")
    got = tl.run_summary(e).first()
    assert (got.principal, got.created_ms, got.first_ms, got.source_uri) == ("p", 5, 1, "u")


def test_interactions_keep_runs_apart(spark):
    chunks = spark.createDataFrame([("a", 3, "i", 100, [1]), ("b", 3, "j", 200, None)], "run_id string, chunk_index int, index_name string, pts_ms long, items array<int>")
    times = spark.createDataFrame([("b", 3, 1, 7, 8), ("b", 3, 2, 9, 10)], "run_id string, chunk_index int, seq long, start_ms long, end_ms long")
    assert rows(tl.interactions(chunks, times)) == [("a", 3, 100, 100, 1), ("b", 3, 9, 10, None)]
    assert rows(tl.interactions(chunks, times, index="j")) == [("b", 3, 9, 10, None)] and rows(tl.interactions(chunks, times, "a")) == [("a", 3, 100, 100, 1)]


def test_appended_numbers_are_dense_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(tl, "APPENDED", 4)
    log = spark.createDataFrame([(7, "gone", "run_deleted")], "seq long, run_id string, kind string")
    new = spark.createDataFrame([(f"r{k % 3}" if k % 5 else "gone", "s", "k", "{}", 3 * k) for k in range(30)], "run_id string, stream_id string, kind string, payload string, position long")
    got = tl.appended(log, new, 1).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(8, 32)) and [r.run_id for r in got] == [f"r{k % 3}" for k in range(30) if k % 5]


def test_transitions_cut_bytes_and_keep_silent_after_an_empty_text(spark):
    long = "ä" * 99 + " one"  # 198 bytes, then a blank and one letter more
    data = [("s", 1, ""), ("s", 2, "a b"), ("s", 3, long), ("s", 4, "ä" * 99 + " o")]
    got = rows(w.transitions(spark.createDataFrame(data, "k string, n long, t string"), "k", "t", ("n",)).select("n", "similarity"))
    assert got == [(3, 0.0)]


def test_whole_percents(spark):
    df = spark.range(101).selectExpr("'a' AS k", "id AS v")
    for p in (0.29, 0.57, 0.58):
        assert me.percentiles(df, "k", "v", p, ("floor",)).first().floor == round(p * 100)
