import random
from collections import Counter

import numpy as np
import pytest

from labelgauge.llm import near_dedup as n
from labelgauge.llm.textbytes import U64, mix


def runs(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])


def similarity(a, b):
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 0.0


def brute(texts):
    sets, group = [runs(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    out = [" ".join(word() for _ in range(r.randint(1, 120))) for _ in range(40)]
    for size, edits in ((30, 1), (20, 6), (8, 2)):
        base = [word() for _ in range(r.randint(60, 150))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [out[0]] * 4 + ["", None, "  \n", "one two", "one  two", "one two three", "a b c d e " * 50, "a b c d e " * 49]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_TEXTS", 10)  # so that components are verified block by block
    rows = texts(seed)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.id_: (r.class_id, r.n_texts) for r in n.near_classes(df).collect()}
    want = brute(rows)
    assert [got[i][0] for i in range(len(rows))] == want
    sizes = Counter(want)
    assert [got[i][1] for i in range(len(rows))] == [sizes[g] for g in want]
    assert max(sizes.values()) >= 20


def test_one_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    rows = [(5, text, 1), (5, text, 2), (None, near, 3), (7, text, 4), (8, None, 5), (None, None, 6), (9, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash_ int").withColumnRenamed("hash_", "o")
    got = n.first_of_classes(df).collect()
    assert {r.doc_id for r in got if r.o < 5} == {None} and len(got) == 4
    assert n.first_of_classes(df.limit(0)).collect() == [] and n.first_of_classes(df).columns == df.columns


def test_signature_agrees_as_often_as_sets_do(spark):
    r = np.random.default_rng(3)
    hits = []
    for size in (3, 40, 400, 9000):
        a = mix(r.integers(1, 1 << 62, size, dtype=np.int64).astype(U64))
        b = np.concatenate([a[: size * 3 // 4], mix(r.integers(1, 1 << 62, size - size * 3 // 4, dtype=np.int64).astype(U64))])
        with np.errstate(over="ignore"):
            same = n.signature(n.strips(a)) == n.signature(n.strips(b))
        both = len(np.intersect1d(a, b))
        hits.append(abs(same.mean() - both / (2 * size - both)))
    assert max(hits) < 0.2 and sum(hits) / 4 < 0.12


def test_weights_count(spark):
    one = mix(np.arange(1, 30, dtype=U64))
    with np.errstate(over="ignore"):
        thrice = n.strips(np.concatenate([one, one, one]))
        assert len(set(thrice.tolist())) == 87
        share = (n.signature(thrice) == n.signature(n.strips(one))).mean()
    assert 0.15 < share < 0.52  # a third


def test_many_near_copies_take_one_pass(spark, monkeypatch):
    """A group of near copies is verified against its centre; only what stays apart meets the rest."""
    seen = []
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(3000)]
    # half like the group: they share some buckets with it, and are no links
    rows += [(10_000 + i, " ".join(base[:60] + [f"y{i}"] + base[62:70] + [f"z{i}", f"q{i}"])) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = n._apart

    def apart(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(n, "_apart", apart)
    got = {r.id_: r.class_id for r in n.near_classes(df).collect()}
    assert {got[i] for i in range(3000)} == {0}
    assert all(g >= 10_000 or similarity(runs(rows[0][1]), runs(t)) >= 0.7 for (i, t), g in zip(rows, got.values()) if i >= 10_000 for g in [got[i]])
    assert seen[0] < 20 * 3 * 3000


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 90_000}" for i in range(1_500_000))
    df = spark.createDataFrame([(1, long), (2, long + " more words at the end"), (3, long[: len(long) // 2]), (4, "a b")], "doc_id long, text string")
    got = {r.id_: r.class_id for r in n.near_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
