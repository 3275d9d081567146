import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelgauge.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def texts():
    r = random.Random(1)
    out = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x " * 500, "a b c d " * 40, "\x0b\x0cé z", "#*$%&|<>"]
    out += ["a b c a b c a b c", "q a b c z a b c", "same\nsame\n\n \nother\nsame"]
    for _ in range(40):
        words = r.choices(["a", "b", "c", "dé", "#e", "$"], k=r.randint(1, 150))
        out.append("".join(w + r.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in words))
    out.append(" ".join(r.choices(["a", "b", "cc"], k=30_000)))
    return out


def test_counts_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(rows)], "doc_id long, text string, kept string")
    marked = df.withColumn("target", F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in q.judge(df, q.ratios(marked)).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(rows):
        assert tuple(got[i][n] for n in names) == brute(t), repr((t or "")[:80])
        assert got[i].kept == (not got[i].base_failed and got[i].score >= q.THRESHOLD)


def test_scores_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = df.withColumn("target", F.when(F.col("doc_id") != 3, F.col("doc_id") % 3 == 0))
    # the buckets as Spark hashes them, everything else by hand
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    names = sorted({w for _, t in rows for w in split(t)})
    hashed = spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("h"))
    one = {r.w: r.h for r in hashed.collect()}
    pairs = [(a, b) for a in one.values() for b in one.values()]
    both = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(q.BUCKETS)).alias("p"))
    two = {(r.a, r.b): r.p for r in both.collect()}

    def grams(t):
        h = [one[w] for w in split(t)]
        return [x % q.BUCKETS for x in h] + [two[p] for p in zip(h, h[1:], strict=False)]

    raw, hit = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i != 3 and i % 3 == 0:
            hit.update(grams(t))
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + q.BUCKETS)
    got = {r.doc_id: r.score for r in q.judge(df, q.ratios(marked)).collect()}
    for i, t in rows:
        g = grams(t)
        want = sum(math.log(share(hit, b)) - math.log(share(raw, b)) for b in g) / max(len(g), 1)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, target boolean")
    found = q.ratios(df)
    assert q.judge(df, found).collect() == []
    some = spark.createDataFrame([(1, "a " * 60)], "doc_id long, text string")
    row = q.judge(some, found).first()
    assert row.score == 0 and row.base_failed and not row.kept
