"""Language and quality: held-out rows of the given tables, and odd tables."""

import os

import numpy as np
import pytest

from labelgauge.llm import langid, quality_nb
from labelgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@given
def test_language_of_held_out_documents(spark):
    found = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 150
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.1 * len(rows)


@given
def test_quality_of_held_out_documents(spark):
    found = QUERIES["op10_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows) > 90
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_of_odd_rows(spark):
    rows = [("der Hund und die Katze schlafen", "de"), ("the dog and the cat are asleep", "en"), (None, "fr"), ("", "fr"), ("chat", None)] * 3
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    odd = [(None,), ("",), (" \n12 -- !",), ("der Hund und",), ("Ж",), ("the cat are " * 50_000,)]
    odd = spark.createDataFrame([(t, i, "o") for i, (t,) in enumerate(odd)], "text string, t int, lang_pred string")
    got = {r.t: r for r in langid.classify(odd, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "de", got[4].lang_pred, "en"]
    assert got[4].lang_pred in ("de", "en") and [got[i].score for i in range(3)] == [0, 0, 0]
    assert langid.fit(spark.createDataFrame([], "text string, lang string")) is None
    assert {r.lang_pred for r in langid.classify(odd, None).collect()} == {"und"}
    assert langid.classify(odd.limit(0), model).collect() == []


def test_quality_of_odd_rows(spark):
    good, bad = "plain words in good order here", "$$$ buy!!! now### cheap%%%"
    rows = [(i, f"{good} {i}", 1) for i in range(20)] + [(100 + i, f"{bad} {i}", 0) for i in range(20)]
    rows += [(900, None, 1), (901, "", 0), (902, "x", None), (903, "y", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality_nb.fit(table, key="doc_id")
    odd = spark.createDataFrame([(None, 1, 0.0), ("", 2, 0.0), (good, 3, 0.0), (bad, 4, 0.0), (f"{good} " * 20_000, 5, 0.0)], "text string, t int, score double")
    got = {r.t: r.score for r in quality_nb.score(odd, model).collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[4] and got[5] > 0.5
    assert quality_nb.fit(table.where("y = 1")) is None and quality_nb.fit(table.limit(0)) is None
    assert {r.score for r in quality_nb.score(odd, None).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, None), (None, 1), (100, 0)], "doc_id long, quality int")
    assert {(r.doc_id, r.y) for r in quality_nb.labelled(table.drop("y"), labels).collect()} == {(0, 1), (100, 0)}


def test_indicators_are_the_n_grams_of_each_text():
    import pyarrow as pa

    texts = ["abcab xyz", "", None, "abc", "é", "abcab xyz"]
    sets = {}
    for a, _, rows, features in quality_nb.indicators(pa.array(texts)):
        for r, f in zip(rows, features, strict=True):
            sets.setdefault(a + r, set()).add(int(f))
    alone = {}
    for i, t in enumerate(texts):
        for _, _, _, features in quality_nb.indicators(pa.array([t])):
            alone[i] = set(map(int, features))
    assert {k: v for k, v in alone.items() if v} == sets and sets[0] == sets[5] and sets[3] <= sets[0] | {*sets[3]}


def test_dual_descent_separates_and_keeps_its_bounds():
    r = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([r.integers(10, 40, 5), [i % 2]])) for i in range(80)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(80)])
    weights, bias = quality_nb.dual_descent(sets, y, np.ones(50), cost=10, epochs=60)
    margins = np.array([weights[s].sum() / np.sqrt(len(s)) + bias for s in sets])
    assert ((margins > 0) == (y > 0)).all()
