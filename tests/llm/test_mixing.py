import pytest
from conftest import rows

from tideline.llm import mixing

DOC = "doc_id long, text string, source string, tokens long, p string, bucket string"
TARGET = "source string, target_share double, max_repeats int, tokens string"


def docs(spark, data):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in data], DOC)


def targets(spark, data):
    return spark.createDataFrame([(*d, "x") for d in data], TARGET)


def test_plan_reaches_shares_within_repeats():
    t = [dict(source="a", target_share=0.5, max_repeats=1, documents=10, tokens=1000), dict(source="b", target_share=0.48, max_repeats=4, documents=10, tokens=300), dict(source="c", target_share=0.02, max_repeats=3, documents=1, tokens=1), dict(source="d", target_share=0.0, max_repeats=3, documents=1, tokens=5)]
    p = {x["source"]: x for x in mixing.plan(t, starved_share=0.05)}
    assert p["a"]["times"] == pytest.approx(1.0) and p["b"]["times"] == pytest.approx(3.2)
    assert p["c"]["times"] == 3 and p["c"]["starved"] and not p["a"]["starved"] and p["d"]["times"] == 0
    assert mixing.plan([]) == []
    p = {x["source"]: x for x in mixing.plan([*t, dict(source="none", target_share=0.1, max_repeats=4, documents=0, tokens=0)])}
    assert p["c"]["times"] == pytest.approx(3) and p["a"]["times"] == pytest.approx(0.075) and not p["c"]["starved"] and p["none"]["starved"]


@pytest.mark.parametrize("bucket", [mixing.BUCKET_DOCS, 40])
def test_shares_and_caps(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    data = [(k, "word " * (1 + k % 37), "big" if k % 3 else "small") for k in range(900)]
    out, planned = mixing.copies(docs(spark, data), targets(spark, [("big", 0.3, 1), ("small", 0.7, 2)]))
    got = out.collect()
    assert len(got) == 900 and len({r.doc_id for r in got}) == 900
    tokens = {s: sum(r.tokens * r.copies for r in got if r.source == s) for s in ("big", "small")}
    most = {s: max(r.copies for r in got if r.source == s) for s in ("big", "small")}
    whole = sum(tokens.values())
    assert most["big"] <= 1 and most["small"] <= 2
    assert abs(tokens["big"] / whole - 0.3) < 40 / whole and abs(tokens["small"] / whole - 0.7) < 40 / whole
    again = mixing.copies(docs(spark, data), targets(spark, [("big", 0.3, 1), ("small", 0.7, 2)]))[0]
    assert rows(again) == rows(out)


def test_expected_copies_do_not_depend_on_size(spark):
    data = [(k, "word " * (1 if k % 2 else 50), "a") for k in range(2000)]
    total = mixing.with_tokens(docs(spark, data)).groupBy().sum("tokens").first()[0] * 0.3
    out = mixing.copies(docs(spark, data), targets(spark, [("a", 1.0, 1)]), total=total)[0].collect()
    small, large = ([r.copies for r in out if (r.doc_id % 2 == 1) == odd] for odd in (True, False))
    assert abs(sum(small) / len(small) - 0.3) < 0.07 and abs(sum(large) / len(large) - 0.3) < 0.07


def test_edges(spark):
    data = [(1, None, "a"), (2, "", "a"), (3, "some text here", "a"), (4, "other", None), (5, "other", "z"), (None, "x", "a"), (6, "y " * 50_000, "a"), (7, "aaaa" * 5000, "a")]
    t = targets(spark, [("a", 0.9, 2), ("none", 0.1, 4), (None, 0.0, 1)])
    out = mixing.copies(docs(spark, data), t)[0]
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 6, 7}
    share = {r.source: r for r in mixing.shares(docs(spark, data), t).collect()}
    assert share["none"].starved and share["none"].actual_share == 0 and share["a"].actual_share == 1
    assert rows(mixing.copies(docs(spark, []), t)[0]) == [] and mixing.shares(docs(spark, []), targets(spark, [])).count() == 0
