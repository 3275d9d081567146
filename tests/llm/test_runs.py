"""Periodic runs against a plain search over all periods."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgauge.llm import runs


def plain(words):
    """Every run, by trying every period at every start."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found)


def made(rng):
    """Words with runs of many periods, runs in runs, and near misses."""
    words = []
    for _ in range(rng.randint(1, 6)):
        kind, few = rng.random(), [str(rng.randint(0, rng.choice([1, 3, 50]))) for _ in range(rng.choice([1, 2, 5, 17, 33, 70, 130]))]
        words += few * rng.randint(1, 7) if kind < 0.7 else few
        words += few[: rng.randint(0, len(few))]
    if rng.random() < 0.3:
        words[rng.randrange(len(words))] = "x"
    return words


def test_finds_what_a_plain_search_finds():
    rng, hits = random.Random(5), 0
    for _ in range(400):
        words = made(rng)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        want = plain(words)
        assert runs.find_runs(np.array([number[w] for w in words], np.int64)) == want
        hits += sum(q >= runs.SHORT for _, _, q in want)
    assert hits > 100


def test_regular_words_of_two_kinds():
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]  # no stretch occurs three times in a row
    assert runs.find_runs(np.array(bits)) == []
    fib = "a"
    before = "b"
    while len(fib) < 5000:
        fib, before = fib + before, fib
    assert runs.find_runs(np.array([ord(c) for c in fib[:2000]])) == plain(fib[:2000])


def test_rows_of_every_kind(spark):
    long = " ".join(f"w{i % 250_000}" for i in range(1_100_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a b"), (4, "a a a a a a b"), (5, "ü ü ü " * 8), (6, "one two three"), (7, long)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("runs", F.lit("x")).withColumn("o", F.lit(1)).withColumn("t", F.lit(2))
    got = sorted((r.id, [tuple(x) for x in r.runs], r.collapsed, r.n_words, r.o, r.t) for r in runs.with_runs(docs).collect())
    assert [(i, r) for i, r, *_ in got] == [
        (1, []), (2, []), (3, []), (4, [(0, 6, 1)]), (4, [(0, 6, 1)]), (5, [(0, 16, 2)]), (6, []), (7, [(0, 1_100_000, 250_000)]),
    ]
    assert [c for _, _, c, *_ in got[:7]] == ["", "", "", "a b", "a b", "ü ü ü", "one two three"]
    assert got[7][2] == " ".join(f"w{i}" for i in range(250_000)) and all(r[4:] == (1, 2) for r in got)
    assert runs.with_runs(docs.where("id > 100")).count() == 0


def test_texts_laid_end_to_end_do_not_meet(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(made(rng))) for i in range(300)] + [(1000 + i, "same " * 3) for i in range(5)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    for r in runs.with_runs(docs).collect():
        words = r.text.split()
        want = plain(words)
        assert [tuple(x) for x in r.runs] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_against_plain(spark):
    """The query's columns on the smallest tables, the changed words included."""
    import hashlib
    import os
    import zlib

    from labelgauge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in QUERIES["op13_periodic_runs"](spark, sf).collect():
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        if len(words) > 700:
            continue
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = plain(words)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        gone = {i for s, k, q in want for i in range(s + q, s + k)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in want))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        seen += bool(want)
    assert seen > 5
