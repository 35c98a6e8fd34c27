import random

from conftest import rows

from tideline.llm import leaks

DOC = "doc_id long, text string, item_id long, exact_words string"
ITEM = "item_id long, suite string, split_name string, item_text string, doc_id string"


def docs(spark, data):
    return spark.createDataFrame([(*d, 1, "x") for d in data], DOC)


def items(spark, data):
    return spark.createDataFrame([(i, "s", "test", t, "x") for i, t in data], ITEM)


def words(n, tag="w"):
    return [f"{tag}{k}" for k in range(n)]


def test_thirteen_words_and_twelve(spark):
    w = words(30)
    d = [(1, "x " + " ".join(w[5:18]) + " y"), (2, " ".join(w[5:17])), (3, " ".join(w).upper()), (4, None), (5, ""), (6, " ".join(w[:12] + ["zz"] + w[13:])), (3, " ".join(w).upper()), (None, " ".join(w))]
    got = rows(leaks.leaked(docs(spark, d), items(spark, [(7, " ".join(w)), (8, " ".join(w[:12])), (9, None), (7, " ".join(w))])))
    assert got == [(1, 7), (3, 7), (6, 7)]


def test_differences_that_cannot_be_seen(spark):
    w = words(13, "Wоrd")  # with a Cyrillic letter
    text = " ".join(x[:2] + "​" + x[2:].replace("d", "ｄ") for x in w)
    assert rows(leaks.leaked(docs(spark, [(1, text)]), items(spark, [(2, " ".join(words(13, "word")))]))) == [(1, 2)]


def test_substitutions_are_tolerated_and_reported(spark):
    w = words(60)
    t = list(w)
    for k in (5, 14, 23, 32, 41, 50):
        t[k] = "other"
    got = rows(leaks.leaks(docs(spark, [(1, " ".join(t))]), items(spark, [(2, " ".join(w))])))
    assert got == [(1, 2, 9, 60, 54)] or (got[0][:2] == (1, 2) and got[0][2] < 13 and got[0][3] >= 50)


def test_random_against_brute_force_in_blocks(spark):
    rng = random.Random(1)
    vocabulary = words(40)
    stated = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 40)))) for k in range(30)]
    d = []
    for k in range(200):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.4:
            source = rng.choice(stated)[1].split()
            a = rng.randrange(len(source))
            text[5:5] = source[a : a + rng.randrange(8, 20)]
        d.append((k, " ".join(text)))
    want = set()
    for i, t in stated:
        w = t.split()
        for a in range(len(w) - 12):
            for k, text in d:
                if f" {' '.join(w[a : a + 13])} " in f" {text} ":
                    want.add((k, i))
    for size in (leaks.SCREEN_BITS, 64):  # with the small screen almost every window passes
        got = leaks.leaks(docs(spark, d), items(spark, stated), screen_bits=size).where("exact_words >= 13").select("doc_id", "item_id")
        assert {tuple(r) for r in got.collect()} == want and want


def test_report_and_empty_tables(spark):
    w = " ".join(words(20))
    report = leaks.item_report(docs(spark, [(1, w), (2, w)]), items(spark, [(5, w), (6, "short")]))
    assert rows(report.select("item_id", "exact_documents", "documents", "longest_words")) == [(5, 2, 2, 20), (6, 0, 0, 0)]
    assert rows(leaks.leaked(docs(spark, []), items(spark, [(5, w)]))) == []
    assert rows(leaks.leaked(docs(spark, [(1, w)]), items(spark, []))) == []


def test_a_very_long_text(spark):
    w = words(20)
    assert rows(leaks.leaked(docs(spark, [(1, "a " * 200_000 + " ".join(w))]), items(spark, [(2, " ".join(w))]))) == [(1, 2)]
