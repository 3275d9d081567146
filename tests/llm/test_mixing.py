import random
from collections import Counter

import pytest
from pyspark.errors import SparkRuntimeException

from labelgauge.llm import mixing


def edf(shares, period):
    done, out = dict.fromkeys(shares, 0), []
    for t in range(period):
        ready = [
            (-(-(done[s] + 1) * period // n), s) for s, n in sorted(shares.items()) if done[s] < n and done[s] * period // n <= t
        ]
        due, s = min(ready)
        assert t < due
        done[s] += 1
        out.append(s)
    return out


def test_schedule_is_edf_within_one_block(spark):
    weights = {"a": 0.5, "b": 0.21, "c": 0.17, "d": 0.12}
    df = spark.createDataFrame([(k, v) for k, v in weights.items()], "source string, weight double")
    shares = mixing.period_shares(df, 100)
    sizes = {r.source: r.share for r in shares.collect()}
    assert sum(sizes.values()) == 100 and all(abs(sizes[s] - 100 * w) <= 1.6 for s, w in weights.items())
    slots = {r.slot: r.source for r in mixing.schedule(shares, 100).collect()}
    order = [slots[t] for t in range(100)]
    assert order == edf(sizes, 100)
    for t in range(101):
        for s, n in sizes.items():
            assert abs(order[:t].count(s) - t * n / 100) < 1


def test_rows_are_whole_and_follow_the_weights(spark):
    r = random.Random(1)
    rows = [(i, r.choice("aaaaaaaabbc"), f"t{i}") for i in range(3000)] + [(None, None, None), (5, "a", "t5"), (5, "a", "t5"), (9, "z", "no")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumnRenamed("text", "slot2")
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), (None, 0.5), ("none", 1.0), ("z", 0.0)], "source string, weight double")
    weights = weights.where("source IS NULL OR source <> 'none'")
    out = mixing.mix(docs, weights, order=("doc_id", "slot2"), block=4, period=90).collect()
    assert Counter((x.doc_id, x.source, x.slot2) for x in out) == Counter(rows)
    assert [x.slot for x in out if x.source == "z"] == [None]
    placed = sorted((x for x in out if x.slot is not None), key=lambda x: (x.slot, x.place))
    assert len({(x.slot, x.place) for x in placed}) == len(placed)
    assert all(x.place < 4 for x in placed) and len({(x.slot, x.source) for x in placed}) == len({x.slot for x in placed})
    inside = [x for x in placed if x.in_mix]
    last = max(x.slot for x in inside)
    assert sorted({x.slot for x in inside}) == list(range(last + 1))  # no slot before the gap is empty
    again = mixing.mix(docs.repartition(7), weights, order=("doc_id", "slot2"), block=4, period=90).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def exact(parts, slots):
    """Earliest deadline first over all slots from 0, with whole parts as weights."""
    whole, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(slots):
        _, s = min((-(-(done[s] + 1) * whole // n), s) for s, n in parts.items() if done[s] * whole // n <= t)
        done[s] += 1
        out.append(s)
    return out


def test_weights_hold_over_many_periods(spark):
    r = random.Random(3)
    hot = {"hot": 93091**0.5} | {f"s{i:02}": 8600**0.5 for i in range(19)}
    many = {f"s{i:02}": r.random() ** 2 + 0.02 for i in range(30)} | {"tiny": 0.003}
    # the last has more sources than slots in a period
    for weights, period, slots in ((hot, 1000, 4500), (many, 10, 700), ({"a": 1.0, "b": 1e-4}, 1000, 15000), (many, 7, 300)):
        df = spark.createDataFrame(list(weights.items()), "source string, weight double")
        shares = mixing.exact_shares(df)
        parts = {x.source: x.share for x in shares.collect()}
        whole = sum(weights.values())
        assert all(abs(n / sum(parts.values()) - weights[s] / whole) < 1e-11 for s, n in parts.items())
        found = mixing._slots(shares.selectExpr("*", "1000000 AS blocks"), mixing.F.lit(slots), period).collect()
        found = sorted((x.slot, x.source, x.kth) for x in found)
        order = [s for _, s, _ in found]
        assert [t for t, _, _ in found] == list(range(slots)) and order == exact(parts, slots)
        had = dict.fromkeys(weights, 0)
        for t, s, k in found:
            assert k == had[s]
            had[s] += 1
            assert all(abs(had[x] - (t + 1) * w / whole) < 1 for x, w in weights.items())


def test_rows_of_a_mix_keep_the_weights(spark):
    sizes = {"hot": 9000} | {f"s{i:02}": 830 for i in range(19)} | {"rare": 3}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    out = mixing.mix(docs, mixing.root_weights(docs), order=("doc_id",)).collect()
    assert Counter((x.doc_id, x.source) for x in out) == Counter((i, s) for s, n in sizes.items() for i in range(n))
    assert all(x.slot is not None for x in out) and len({(x.slot, x.place) for x in out}) == len(out)
    had, whole = Counter(), sum(n**0.5 for n in sizes.values())
    last = max(x.slot for x in out if x.in_mix)
    taken = {x.slot: x.source for x in out if x.in_mix}
    assert sorted(taken) == list(range(last + 1)) and last > 500
    for t in range(last + 1):
        had[taken[t]] += 1
        assert all(abs(had[s] - (t + 1) * n**0.5 / whole) < 1 for s, n in sizes.items())


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    weights = mixing.root_weights(docs)
    assert mixing.mix(docs, weights, order=("doc_id",)).first().slot == 0
    assert mixing.mix(docs.limit(0), weights, order=("doc_id",)).collect() == []
    assert mixing.mix(docs, weights.limit(0), order=("doc_id",)).first().slot is None
    many = spark.range(20).selectExpr("string(id) AS source", "1.0D AS weight")
    with pytest.raises(SparkRuntimeException, match="more sources"):
        mixing.mix(docs, many, order=("doc_id",), period=10).collect()


def test_tiny_weights_cost_no_more_than_the_blocks(spark):
    import time

    for weights in ({"a": 1.0, "b": 1e-9}, {"a": 1.0, "b": 1e-12, "c": 0.5}):
        docs = spark.createDataFrame([(i, "abc"[i % len(weights)]) for i in range(400)], "doc_id long, source string")
        df = spark.createDataFrame(list(weights.items()), "source string, weight double")
        start = time.time()
        out = mixing.mix(docs, df, order=("doc_id",)).collect()
        assert time.time() - start < 30 and len({x.doc_id for x in out}) == 400
        slots = sorted({(x.slot, x.source) for x in out})
        assert [t for t, _ in slots] == list(range(len(slots)))  # one source a slot, no slot empty
        whole, had = sum(weights.values()), Counter()
        for t, s in slots:
            had[s] += 1
            if any(x.in_mix for x in out if x.slot == t):
                assert all(abs(had[x] - (t + 1) * w / whole) < 1 for x, w in weights.items())


def test_what_is_left_follows_by_deadline(spark):
    from fractions import Fraction

    sizes, weights = {"a": 160, "b": 8, "c": 400, None: 90}, {"a": 3.0, "b": 2.0, "c": 2.0, None: 1.0}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    for c in ("slot_", "own", "end", "share", "block_", "nth", "o", "rank_", "bucket"):
        docs = docs.withColumn(c, mixing.F.lit(c))
    out = mixing.mix(docs, spark.createDataFrame(list(weights.items()), "source string, weight double"), order=("doc_id",)).collect()
    assert all(x.own == "own" and x.end == "end" and x.bucket == "bucket" for x in out) and len(out) == sum(sizes.values())
    by_slot = sorted({(x.slot, x.source or "", x.in_mix) for x in out})
    assert [t for t, _, _ in by_slot] == list(range(len(by_slot)))
    had, late = Counter(), []
    for _, s, in_mix in by_slot:
        had[s] += 1
        if not in_mix:
            late.append((Fraction(had[s]) / Fraction(weights[s or None]), {"a": 1, "b": 2, "c": 3, "": 4}[s]))
    assert late == sorted(late) and len(late) > 20


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 7, "p", "x") for i in range(40)], "doc_id long, source string, slot int, place string, in_mix string")
    out = mixing.mix(docs, mixing.root_weights(docs), order=("doc_id",))
    assert out.columns == ["doc_id", "source", "slot", "place", "in_mix"] and {x.place for x in out.collect()} == set(range(8))
