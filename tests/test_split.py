"""Samples and splits against sorting the whole list."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from labelgauge.operators import split

IDS = random.Random(1).sample(range(10**9), 700)


def ordered(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, int(k % 5 == 0)) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "id long, label int").repartition(6).cache()


def ids(df):
    return {r.id for r in df.collect()}


def test_shuffle_order(table):
    assert [r.id for r in split.shuffled(table).collect()] == ordered(IDS)


@pytest.mark.parametrize("n", [0, 1, 2, 350, 699, 700, 5000])
def test_sample_sizes(table, n):
    assert ids(split.sample_n(table, n)) == set(ordered(IDS)[:n])
    assert ids(split.sample_n(table, n, seed=7)) == set(ordered(IDS, 7)[:n])


@pytest.mark.parametrize("train,val", [(60, 30), (0, 5), (5, 0), (600, 300), (690, 10)])
def test_head_split(table, train, val):
    got = split.train_val_split(table, train, val)
    first = ordered(IDS)
    assert ids(got.where("split = 'train'")) == set(first[:train])
    assert ids(got.where("split = 'val'")) == set(first[train : train + val])


def test_split_falls_back_to_seventy_percent(table):
    got = split.train_val_split(table, 600, 101, fallback=True)
    first = ordered(IDS)
    assert ids(got.where("split = 'train'")) == set(first[: int(700 * 0.7)])
    assert ids(got.where("split = 'val'")) == set(first[int(700 * 0.7) :])
    exact = split.train_val_split(table, 600, 100, fallback=True)
    assert ids(exact.where("split = 'train'")) == set(first[:600])


def test_holdout_and_empty(table):
    got = split.holdout_split(table, 50)
    assert ids(got.where("split = 'test'")) == set(ordered(IDS)[:50])
    assert got.count() == 700
    none = table.where("id < 0")
    assert split.sample_n(none, 5).count() == 0
    assert split.train_val_split(none, 5, 5, fallback=True).count() == 0
    assert split.first_k(none, 5).count() == 0


def test_one_bucket_is_enough(spark, table, monkeypatch):
    """All rows in one bucket, as if the hashes were badly spread: still exact."""
    monkeypatch.setattr(split, "BUCKET_DIGITS", 0)
    assert ids(split.sample_n(table, 123)) == set(ordered(IDS)[:123])


def test_balance(table):
    got = split.balanced(table)
    assert ids(got.where("label = 1")) == set(IDS[::5])
    rest = [i for k, i in enumerate(IDS) if k % 5]
    assert ids(got.where("label = 0")) == set(ordered(rest)[:140])


def test_balance_with_one_class_missing(table):
    ones = table.where("label = 1")
    assert ids(split.balanced(ones)) == ids(ones)


def test_first_and_lowest(spark, table):
    from pyspark.sql import functions as F

    assert ids(split.first_k(table, 10)) == set(sorted(IDS)[:10])
    by_label = sorted((int(k % 5 == 0), i) for k, i in enumerate(IDS))
    assert ids(split.lowest_k(table, 7, F.col("label"))) == {i for _, i in by_label[:7]}
    demos = split.demonstrations(table, 8, F.col("label"), 1)
    assert ids(demos) == set(sorted(IDS[::5])[:8])


def test_first_rows_are_exactly_k(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (4, 4), (1, 5), (1, 6), (1, 7), (2, 8)], "id int, n int")
    for k in range(9):
        assert split.first_k(rows, k).count() == k
        assert split.lowest_k(rows, k, F.col("n") % 2).count() == k
        assert split.demonstrations(rows, k, F.col("n"), 3).count() == min(k, 6)
    known = rows.where("id IS NOT NULL")
    assert sorted(r.id for r in split.first_k(known, 2).collect()) == [1, 1]
    assert [r.n for r in split.first_k(known, 4, then=("n",)).collect()] == [5, 6, 7, 8]
    assert [r.n for r in split.first_k(rows, 3, then=("n",)).collect()] == [1, 2, 5]


def test_balance_takes_the_classes_from_the_data(spark):
    rows = spark.createDataFrame([(i, "abbccc"[i % 6]) for i in range(60)] + [(99, None)], "id int, label string")
    got = split.balanced(rows).groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in got} == {("a", 10), ("b", 10), ("c", 10)}
    assert {r.label for r in split.balanced(rows, classes=("b", "c")).collect()} == {"b", "c"}


def test_cut_of_any_order(spark):
    """Every kind of column, with nulls, ties and values that no part of a range tells apart."""
    import datetime
    from decimal import Decimal

    rng = random.Random(3)
    odd = [None, float("-inf"), -1e308, -1.5, -0.0, 0.0, 1e-300, 2.5, 1e308, float("inf"), float("nan")]
    rows = []
    for i in range(400):
        day = datetime.date(1960, 1, 1) + datetime.timedelta(rng.choice([0, 1, 2, 30_000]))
        at = datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=rng.choice([0, 1, 10**15]))
        word = rng.choice([None, "", "http://a/", "http://a/b", "http://a/é", "http://a/~", "zz" * rng.randint(0, 9), str(i)])
        rows.append((i, rng.choice([None, -(2**63), 2**63 - 1, 0, 1, i]), rng.choice(odd), word, day, at, rng.random() < 0.5, rng.choice([None, Decimal("1.10"), Decimal("-3")])))
    kinds = "id long, n long, d double, s string, day date, at timestamp, yes boolean, money decimal(10,2)"
    df = spark.createDataFrame(rows, kinds).repartition(5).cache()
    for order in (["n", "id"], ["d", "id"], ["s", "d"], ["day", "at"], ["at", "n"], ["yes", "money", "s"], ["yes"]):
        columns = [F.col(c) for c in order]
        want = [tuple(r)[:-1] for r in df.select(*columns, F.col("id").alias("_")).orderBy(*columns).collect()]
        for k in (57, 200, 400):
            got = split.take_first(df, columns, k, few=3)
            assert [str(tuple(r)) for r in got.select(*columns).orderBy(*columns).collect()] == [str(w) for w in want[:k]]
    assert split.take_first(df, [F.col("id")], 0).count() == 0 and split.take_first(df.where("id < 0"), [F.col("id")], 3).count() == 0


def test_half_of_the_table_meets_in_no_task(spark, table):
    got = split.first_k(table, 350, few=16)
    assert ids(got) == set(sorted(IDS)[:350])
    shape = split.take_first(table, [F.col("id")], 350, few=16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shape.split("InMemoryTableScan")[0] and "TakeOrdered" not in shape and "GlobalLimit" not in shape
    same = spark.range(1000).selectExpr("7L AS id", "id AS n")
    assert split.first_k(same, 400, few=16).count() == 400 and split.lowest_k(same, 999, F.lit(1.0), few=16).count() == 999


def test_draws_nest_and_follow(spark, table, tmp_path):
    plan = [
        split.Draw("train", 300), split.Draw("val", 100, beyond=("train",)), split.Draw("some", 50, seed=7, of="train"),
        split.Draw("inner", 20, seed=9, of="some"), split.Draw("first", 40, seed=None, of="train"), split.Draw("all", 10**6), split.Draw("none", 0),
    ]
    for path in (None, str(tmp_path / "keys")):
        rows = split.draws(table, plan, path=path, few=8)
        found = {d.name: {r.id for r in rows.collect() if d.name in r.draws} for d in plan}
        head = ordered(IDS)
        assert found["train"] == set(head[:300]) and found["val"] == set(head[300:400])
        some = [i for i in ordered(IDS, 7) if i in found["train"]][:50]
        assert found["some"] == set(some) and found["inner"] == {i for i in ordered(IDS, 9) if i in found["some"]} & set([i for i in ordered(IDS, 9) if i in found["some"]][:20])
        assert found["first"] == set(sorted(head[:300])[:40]) and found["all"] == set(IDS) and not found["none"]
        shape = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in shape.split("InMemoryTableScan")[0] and "Subquery" not in shape


def test_compile_subset_reads_the_table_once(spark):
    import os

    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        shape = entry_points.queries()["compile_subset"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert shape.count("FileScan") == 1
