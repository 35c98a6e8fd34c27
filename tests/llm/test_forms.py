import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import forms

SAME = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ１２", "Full width12"), ("café", "café"), ("ze​ro﻿", "zero"), ("so­ft", "soft"), ("a b c d e", "a b c d e"), ("ﬁne ﬂow", "fine flow"),
    ("Тhe соре", "The cope"), ("ΑΒΕ ο", "ABE o"), ("й", "й"), ("ё", "ë"), ("が", "が"), ("word⁠joiner‌‍", "wordjoiner"), ("가", "가"),
]
DIFFERENT = [("Case", "case"), ("a\nb", "a b"), ("l0g", "log"), ("resume", "résumé"), ("x²", "x2"), ("①", "1"), ("пн", "nh"), ("a  b", "a b"), ("З", "3"), ("ß", "ss")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_appearance(a, b):
    assert forms.appearance_of(a) == forms.appearance_of(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_appearance(a, b):
    assert forms.appearance_of(a) != forms.appearance_of(b)


def test_normal_form_folds_more():
    assert forms.normal_form_of("ＳＴＲＡẞＥ ①") == "strasse 1"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_idempotent(text):
    once = forms.appearance_of(text)
    assert forms.appearance_of(once) == once
    once = forms.normal_form_of(text)
    assert forms.normal_form_of(once) == once


SCHEMA = "doc_id long, text string, form string, string string, a string"


def made(spark, data):
    return spark.createDataFrame([(*d, "x", "y", "z") for d in data], SCHEMA)


def test_pairs(spark):
    data = [(1, "same"), (2, "ѕame"), (3, "same"), (4, None), (5, ""), (6, "​"), (7, " "), (8, " "), (9, "Same"), (1, "same"), (None, "ѕame"), (10, "x" * 300_000), (11, "х" * 300_000)]
    assert rows(forms.look_alikes(made(spark, data))) == [(1, 2), (10, 11), (2, 3)]
    assert rows(forms.look_alikes(made(spark, []))) == []


def test_classes_and_forms(spark):
    data = [(1, "same"), (2, "ѕame"), (3, "same"), (4, None), (5, ""), (9, "Same")]
    assert rows(forms.form_classes(made(spark, data))) == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (4, 4, 1, 1), (5, 5, 1, 1), (9, 9, 1, 1)]
    got = rows(forms.with_forms(made(spark, data)).select("doc_id", "normal_form"))
    assert got[3] == (4, None) and got[4] == (5, "")


def test_look_alikes_are_confusable_in_unicodes_table(spark):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shape = lambda c: checker.getSkeleton(0, c)
    other = {a for a, b in forms.LOOK_ALIKE.items() if shape(a) != shape(b) or a.isupper() != b.isupper()}
    assert other == {"Ԛ", "ӏ"}  # two that look like Q and l all the same


def test_copies_of_a_text_and_one_twin(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id = 77 THEN 'ѕame' ELSE 'same' END AS text")
    pairs = forms.look_alikes(df)
    assert pairs.count() == 19_999 and pairs.where("doc_id_a = 77 OR doc_id_b = 77").count() == 19_999
