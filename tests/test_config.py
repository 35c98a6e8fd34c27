import json

import pytest
from conftest import rows

from tideline.operators import moments as mo
from tideline.sources import config as cf


def test_profiles_and_ranges():
    assert cf.PROFILES["detailed"].fps == 2.5 and not cf.PROFILES["efficiency"].fallback and cf.PROFILES["custom"].keep_alive_min == 35
    for bad in (dict(fps=5.0), dict(fps=float("nan")), dict(mode="x"), dict(keep_alive_min=29), dict(segment_s=601)):
        with pytest.raises(ValueError):
            cf.Processing(**bad)
    for bad in ((1, 2.0, 0.0), (31, 2.0, 0.0), (2, 61.0, 0.0), (2, 2.0, -1.0)):
        with pytest.raises(ValueError):
            cf.ClipSettings(*bad)


def test_settings_take_the_environment(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDE_MODEL", "m1")
    (tmp_path / "b.toml").write_text('[[backends]]\nname = "x-${NOT_SET_HERE}"\nmodel = "${TIDE_MODEL}"\npriority = 2\n[[backends]]\nname = "y"\nmodels = ["a", "b"]\n')
    assert rows(cf.backends(spark, f"{tmp_path}/b.toml")) == [("x-${NOT_SET_HERE}", 2, ["m1"]), ("y", 100, ["a", "b"])]


def test_label_dictionaries(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"default": {"events": {"cut": "general"}}, "tenants": {"t": {"events": {"cut": "own"}}}}))
    own, rest = cf.labels(spark, f"{tmp_path}/l.json")
    data = spark.createDataFrame([("t", "cut"), ("u", "cut"), ("u", "other")], "tenant string, label string")
    assert [(r.mapped, r.used_fallback) for r in mo.mapped_label(data, own, rest).orderBy("tenant", "label").collect()] == [("own", False), ("general", True), ("other", True)]
    assert [df.count() for df in cf.labels(spark, None)] == [0, 0]
