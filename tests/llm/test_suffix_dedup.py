import random

import pytest

from labelgauge.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiné" if r.random() < 0.3 else "stro") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(80), prose(45)
    rows = [prose(r.randint(0, 200)) for _ in range(30)]
    rows += [f"{prose(r.randint(0, 9))} {passage} {prose(20)}" for _ in range(12)]
    rows += [passage[r.randint(0, 150) :] + other[: r.randint(150, 260)] for _ in range(25)]
    near = prose(150).split()
    for _ in range(25):
        w = list(near)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [rows[3]] * 3 + [f"{other} {other} {other}", "a" * 700, "ab" * 400, "", None, "é" * 150, "x"]
    rows += [rows[0] * 2, rows[1][:199], rows[1][:200], rows[1][7:260]]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df).collect()}
    want = brute([(t or "").encode() for t in rows], 200)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(w[1] for w in want) > 1000


@pytest.mark.parametrize("length", [96, 119, 130, 500, 1100])
def test_other_lengths_take_fewer_or_more_doublings(spark, length):
    rows = texts(4)
    r = random.Random(length)
    long = " ".join(str(r.random()) for _ in range(200))
    for _ in range(20):  # copies that differ in a byte here and there
        cut = bytearray(long.encode())
        for _ in range(r.randint(0, 3)):
            cut[r.randrange(len(cut))] = 64
        rows.append(cut.decode())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length=length).collect()}
    assert [got[i] for i in range(len(rows))] == brute([(t or "").encode() for t in rows], length)


def test_pieces_of_long_texts(spark, monkeypatch):
    from labelgauge.llm import suffix_dedup

    data = ("".join(random.Random(5).choices("abc de", k=3000)) * 2).encode()
    import numpy as np

    whole = suffix_dedup._stretches(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 200, *map(suffix_dedup.Hasher, (1, 2)))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1024)
    import pyarrow as pa

    starts, parts = set(), suffix_dedup._pieces(pa.array([data.decode()]), 200)
    for _, shift, part, offsets in parts:
        found = suffix_dedup._stretches(part, offsets, 200, *map(suffix_dedup.Hasher, (1, 2)))
        if found:
            starts |= {(s + shift, a + shift) for lo, hi, a in zip(*found[1:4], strict=True) for s in range(lo, hi + 1)}
    assert starts == {(s, a) for lo, hi, a in zip(*whole[1:4], strict=True) for s in range(lo, hi + 1)}


def test_each_start_is_in_one_piece(monkeypatch):
    import pyarrow as pa

    from labelgauge.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE", 1024)
    for size in (1025, 1223, 1224, 1849, 1850, 5000):
        starts = []
        for _, shift, part, offsets in suffix_dedup._pieces(pa.array([random.Random(size).randbytes(size).hex()[:size]]), 200):
            found = suffix_dedup._stretches(part, offsets, 200, *map(suffix_dedup.Hasher, (1, 2)))
            starts += [s + shift for lo, hi in zip(*found[1:3], strict=True) for s in range(lo, hi + 1)]
        assert sorted(starts) == list(range(size - 199))


def test_unique_and_repeated_strings_of_very_long_texts(spark):
    from labelgauge.llm.suffix_dedup import PIECE

    hexes = lambda seed, n: random.Random(seed).randbytes(n).hex()[:n]
    unique = hexes(1, PIECE + 5000)
    passage, parts = hexes(2, 500), [hexes(i, n) for i, n in ((3, 1000), (4, PIECE - 1800), (5, 900))]
    twice = f"{parts[0]}g{passage}h{parts[1]}i{passage}j{parts[2]}"  # the second copy lies over the border of two pieces
    df = spark.createDataFrame([(1, unique), (2, twice)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df).collect()}
    # what stands twice by a set of all strings of 200 bytes
    seen, again = set(), set()
    for t in (unique, twice):
        for i in range(len(t) - 199):
            h = hash(t[i : i + 200])
            (again if h in seen else seen).add(h)
    assert len(again) == 301
    assert got[1] == (len(unique), 0, 0, unique.encode())
    assert got[2] == (len(twice), 1000, 2, f"{parts[0]}gh{parts[1]}ij{parts[2]}".encode())


def test_odd_tables(spark):
    schema = "doc_id long, text string, id_ string, lo int, spans int, t string, kept_ int"
    empty = spark.createDataFrame([], schema)
    assert remove_repeats(empty).collect() == []
    long = " ".join(map(str, range(100)))
    rows = [(None, long, "a", 1, 2, "t", 3), (None, long, "b", 1, 2, "t", 3), (1, None, "c", 1, 2, "t", 3), (1, long, None, 0, 0, "", 0)]
    got = remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, str(r.id_), r.n_removed) for r in got) == [(-1, "a", 289), (-1, "b", 289), (1, "None", 289), (1, "c", 0)]
