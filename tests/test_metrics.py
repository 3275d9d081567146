"""Metrics against published cells and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from labelgauge.functions.scores import round4
from labelgauge.operators import metrics
from labelgauge.schema import LABELS

# n=268: label -> (TP, FP, TN, FN), (accuracy, precision, recall, F1, weighted F1)
CELLS_268 = {
    "stereotype": ((54, 61, 136, 17), (0.7090, 0.4696, 0.7606, 0.5806, 0.7251)),
    "vilification": ((9, 14, 176, 69), (0.6903, 0.3913, 0.1154, 0.1782, 0.6256)),
    "dehumanization": ((7, 19, 229, 13), (0.8806, 0.2692, 0.3500, 0.3043, 0.8877)),
    "extreme_language": ((15, 35, 183, 35), (0.7388, 0.3000, 0.3000, 0.3000, 0.7388)),
    "lack_of_empathy": ((5, 11, 228, 24), (0.8694, 0.3125, 0.1724, 0.2222, 0.8523)),
    "invalidation": ((27, 106, 112, 23), (0.5187, 0.2030, 0.5400, 0.2951, 0.5712)),
}
CELLS_30 = {
    "stereotype": (17, 5, 6, 2),
    "vilification": (13, 5, 5, 7),
    "dehumanization": (1, 5, 22, 2),
    "extreme_language": (7, 13, 8, 2),
    "lack_of_empathy": (3, 13, 9, 5),
    "invalidation": (1, 1, 19, 9),
}


def from_cells(spark, cells):
    """One row per id with the cells spread over the rows of each label."""
    columns = {}
    for name, (tp, fp, tn, fn) in cells.items():
        columns[name] = [(1, 1)] * tp + [(0, 1)] * fp + [(0, 0)] * tn + [(1, 0)] * fn
    n = len(columns["stereotype"])
    rows = [
        (i, *[columns[c][i][0] for c in LABELS], *[columns[c][i][1] for c in LABELS])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ["id", *LABELS, *[f"pred_{c}" for c in LABELS]])


def test_published_label_metrics(spark):
    df = from_cells(spark, {k: v[0] for k, v in CELLS_268.items()})
    counted = metrics.tallies(df)
    got = {r["label"]: r for r in metrics.label_metrics(counted, rounded=True).collect()}
    for name, (cells, values) in CELLS_268.items():
        row = got[name]
        assert (row.tp, row.fp, row.tn, row.fn) == cells
        found = (row.accuracy, row.precision, row.recall, row.f1, row.weighted_f1)
        assert found == pytest.approx(values, abs=1e-9)
    macro = metrics.macro(counted, round_first=True).first()
    assert macro.f1 == pytest.approx(0.3134, abs=5e-5)
    assert macro.accuracy == pytest.approx(0.7345, abs=5e-5)
    assert macro.weighted_f1 == pytest.approx(0.73345)  # shown as 0.7335


def test_published_averages(spark):
    counted = metrics.tallies(from_cells(spark, CELLS_30))
    micro = metrics.micro(counted).first()
    assert (micro.tp, micro.fp, micro.tn, micro.fn) == (42, 42, 69, 27)
    assert micro.f1 == pytest.approx(0.549019607843)
    macro = metrics.macro(counted).first()
    assert macro.f1 == pytest.approx(0.439187721430)
    assert macro.precision == pytest.approx(0.4498526936026936)
    assert macro.recall == pytest.approx(0.5218079922027291)
    support = {r.label: r.support for r in metrics.label_metrics(counted).collect()}
    assert [support[c] for c in LABELS] == [19, 20, 3, 9, 8, 10]


def four_rows(spark):
    truth = ["1010", "0101", "1100", "1011", "0011", "1110"]
    rows = []
    for i in range(4):
        t = [int(column[i]) for column in truth]
        rows.append((i, *t, *(t if i < 2 else [i - 2] * 6)))
    return spark.createDataFrame(rows, ["id", *LABELS, *[f"pred_{c}" for c in LABELS]])


def test_evaluator_contract(spark):
    counted = metrics.tallies(four_rows(spark))
    got = {r["label"]: r for r in metrics.evaluator_report(counted).collect()}
    assert set(got) == {"overall", *LABELS}
    assert got["overall"].accuracy == pytest.approx(17 / 24)
    assert metrics.subset_accuracy(counted).first().subset_accuracy == 0.5
    assert got["stereotype"].false_negatives == 1 and got["stereotype"].false_positives == 1


def test_zero_division_gives_zero(spark):
    rows = [(i, *[0] * 12) for i in range(3)]
    df = spark.createDataFrame(rows, ["id", *LABELS, *[f"pred_{c}" for c in LABELS]])
    counted = metrics.tallies(df)
    row = metrics.label_metrics(counted).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0, 0, 0, 1)
    assert row.weighted_f1 == 1
    empty = metrics.tallies(df.where("id < 0"))
    assert metrics.macro(empty).first().f1 == 0
    assert metrics.subset_accuracy(empty).first().subset_accuracy == 0


def test_null_predictions_are_skipped(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, None), (1, None)], "a int, pred_a int")
    row = metrics.answered_accuracy(metrics.tallies(df, ["a"])).first()
    assert (row.correct, row.total, row.accuracy) == (1, 2, 0.5)


def test_tallies_match_brute_force_by_group(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), *[rng.randint(0, 1) for _ in range(12)]) for i in range(300)]
    names = ["id", "g", *LABELS, *[f"pred_{c}" for c in LABELS]]
    counted = metrics.tallies(spark.createDataFrame(rows, names), by=["g"]).collect()
    assert len(counted) == 3
    for group in counted:
        mine = [dict(zip(names, r)) for r in rows if r[1] == group.g]
        assert group.n == len(mine)
        assert group.exact == sum(all(r[c] == r[f"pred_{c}"] for c in LABELS) for r in mine)
        for cell in group.cells:
            pairs = [(r[cell.label], r[f"pred_{cell.label}"]) for r in mine]
            want = [pairs.count(x) for x in ((1, 1), (0, 1), (0, 0), (1, 0))]
            assert [cell.tp, cell.fp, cell.tn, cell.fn] == want
        for pair in group.joint:
            a, b = pair.label_a, pair.label_b
            both = sum(r[a] != r[f"pred_{a}"] and r[b] != r[f"pred_{b}"] for r in mine)
            assert pair.n_both == both


def test_rounding_takes_ties_to_even(spark):
    df = spark.createDataFrame([(0.03125,), (0.71875,), (0.12344999,)], "x double")
    assert [r[0] for r in df.select(F.expr(round4("x"))).collect()] == [0.0312, 0.7188, 0.1234]


def test_binary_report(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] * 2 + [(0, 0)] * 4 + [(1, 0)]
    df = spark.createDataFrame(rows, "label int, pred_label int")
    got = {r["class"]: r for r in metrics.binary_report(metrics.tallies(df, ["label"])).collect()}
    assert got["1"].precision == pytest.approx(0.6) and got["1"].recall == pytest.approx(0.75)
    assert got["0"].precision == pytest.approx(0.8) and got["0"].recall == pytest.approx(4 / 6)
    assert got["macro avg"].precision == pytest.approx(0.7)
    assert got["weighted avg"].precision == pytest.approx(0.72)
    assert got["1"].support == 4 and got["0"].support == 6


def test_detection_rate(spark):
    df = spark.range(120).selectExpr("int(id < 113) AS predicted")
    row = metrics.detection_rate(df).first()
    assert (row.total, row.detected, row.missed, row.detection_rate) == (120, 113, 7, 0.9417)
    assert round(row.detected_pct, 1) == 94.2 and round(row.missed_pct, 1) == 5.8


def test_mean_score_counts_failures_as_zero(spark):
    df = spark.createDataFrame([(1.0,), (None,), (0.5,)], "score double")
    assert metrics.mean_score(df).first().mean_score == pytest.approx(0.5)
    assert metrics.mean_score(df.where("score > 9")).first().mean_score == 0.0


def test_category_counts_keep_raw_strings(spark):
    rows = [("", 1), ("A", 1), ("a", 1), ("A", 1), ("A", 0), (None, 1)]
    df = spark.createDataFrame(rows, "trigger string, predicted int")
    got = [(r.trigger, r.n) for r in metrics.category_counts(df).collect()]
    assert got == [("A", 2), ("", 1), ("a", 1)]


def test_hundreds_of_labels(spark):
    """300 labels against counting by hand, and a short list counted both ways."""
    import random
    import time
    from collections import Counter
    from itertools import combinations

    from labelgauge.operators import metrics
    from labelgauge.operators.errors import error_pairs, pair_counts

    rng = random.Random(4)
    labels = [f"l{i * 7 % 300}" for i in range(300)]
    rows = []
    for i in range(40):
        truth = [int(rng.random() < 0.05) for _ in labels]
        pred = [None if rng.random() < 0.01 else t if rng.random() < 0.97 or i < 3 else 1 - t for t in truth]
        rows.append((i, i % 2, *truth, *(truth if i == 1 else pred)))
    df = spark.createDataFrame(rows, "id int, part int, " + ", ".join([f"{c} int" for c in labels] + [f"pred_{c} int" for c in labels]))
    start = time.time()
    counted = metrics.tallies(df, labels, by=["part"])
    counted._jdf.queryExecution().executedPlan()
    assert time.time() - start < 5
    for got in counted.collect():
        mine = [r for r in rows if r[1] == got.part]
        cells, both, exact = Counter(), Counter(), 0
        for r in mine:
            t, p = r[2:302], r[302:]
            exact += t == p
            for name, x, y in zip(labels, t, p):
                if y is not None:
                    cells[name, ("tn", "fp", "fn", "tp")[2 * x + y]] += 1
            wrong = sorted(n for n, x, y in zip(labels, t, p) if y is not None and x != y)
            both.update(combinations(wrong, 2))
        assert (got.n, got.exact) == (len(mine), exact)
        assert [c.label for c in got.cells] == labels
        assert all(c[x] == cells[c.label, x] for c in got.cells for x in metrics.CELLS)
        assert {(j.label_a, j.label_b): j.n_both for j in got.joint} == both
        order = list(combinations(sorted(labels), 2))
        assert all(order[j.ord] == (j.label_a, j.label_b) for j in got.joint)
    pairs = Counter((r.label_a, r.label_b) for r in error_pairs(df, labels=labels).collect())
    assert pairs == {(r.label_a, r.label_b): r.n_both for r in pair_counts(metrics.tallies(df, labels)).collect()}
    few = labels[:6]
    short = metrics.tallies(df, few).first()
    wide = metrics._wide_tallies(df, few, "", "pred_", ()).first()
    assert (short.n, short.exact, short.cells) == (wide.n, wide.exact, wide.cells)
    assert [j for j in short.joint if j.n_both] == wide.joint
    none = metrics.tallies(df.where("id < 0"), labels).first()
    assert none.n == 0 and none.exact == 0 and len(none.cells) == 300 and none.joint == []
