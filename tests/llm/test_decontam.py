import random

import numpy as np

from labelgauge.llm import decontam as d


def edits(pattern, text):
    """Least edits of the pattern at any place of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def prose(r, n):
    return " ".join("".join(r.choices("aeinrst", k=r.randint(1, 7))) for _ in range(n))


def change(r, text, n):
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], ["z"], [out[i], "z"]])
    return "".join(out)


def test_equals_brute_force():
    r = random.Random(4)
    items = [(i, prose(r, r.randint(9, 40))) for i in range(12)]
    docs = [prose(r, 40) for _ in range(10)]
    for _, text in items:
        for n in (0, 3, 6, 9, 14, 30):
            docs.append(f"{prose(r, r.randint(0, 12))} {change(r, text, n)} {prose(r, 5)}")
    docs += ["", items[0][1], items[1][1].upper(), items[2][1].replace(" ", "\n"), items[3][1][:70] * 2]
    segments = d.Segments(items)
    data = [x.encode() for x in docs]
    offsets = np.cumsum([0, *map(len, data)])
    row, segment, cost, start, end = d.matches(segments, np.frombuffer(b"".join(data), np.uint8), offsets)
    got = {}
    for a, b, c in zip(row, segment, cost, strict=True):
        got[a, b] = min(c, got.get((a, b), 99))
    want = {}
    for i, text in enumerate(data):
        folded = d.folded(np.frombuffer(text, np.uint8)).tobytes()
        for k, pattern in enumerate(segments.texts):
            e = edits(pattern.tobytes(), folded)
            if e <= segments.edits[k]:
                want[i, k] = e
    assert got == want and len(want) > 60
    for a, b, s, e in zip(row, segment, start, end, strict=True):
        if want[a, b] == 0 and got[a, b] == 0:
            assert 0 <= s < e <= len(data[a])


def test_spans_and_odd_rows(spark):
    r = random.Random(5)
    item = prose(r, 30)
    rows = [(1, f"before {item} after", "x"), (1, f"before {item} after", "y"), (None, item, "z"), (2, None, "a"), (3, "", "b"), (4, prose(r, 50), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, o string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short"), (None, prose(r, 20))], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in d.leaks(docs, bench).collect()}
    assert set(found) == {(1, 7), (None, 7)}
    hit = found[1, 7]
    assert (hit.start_byte, hit.end_byte, hit.edits) == (7, 7 + len(item), 0)
    assert sorted(x.o for x in d.without_leaks(docs, bench).collect()) == ["a", "b", "c"]
    assert d.without_leaks(docs, bench).columns == docs.columns
    none = bench.limit(0)
    assert d.leaks(docs, none).collect() == [] and d.without_leaks(docs, none).count() == 6
    assert d.leaks(docs.limit(0), bench).collect() == []


def test_runs_of_white_space(spark):
    r = random.Random(8)
    words = prose(r, 60).split()
    lines = [" ".join(words[i : i + 4]) for i in range(0, 60, 4)]
    code = "\n        ".join(lines)  # an indented item
    doubled = "  ".join(prose(r, 40).split())
    wide = prose(r, 40)
    docs = {
        1: f"é {code} after",
        2: f"before  \t {doubled}\n\nafter",
        3: f"x {' '.join(words)} y",
        4: "\r\n\t\t".join(lines),
        5: wide.replace(" ", " \u00a0\u2003 "),
        6: "\n" * 200 + prose(r, 30) + " " * 200,
        7: " " * 500,
        8: "",
        9: wide.upper().replace(" ", "\u3000"),
    }
    bench = spark.createDataFrame([(1, code), (2, doubled), (3, wide), (4, " " * 400)], "item_id long, text string")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    found = {(x.doc_id, x.item_id): x for x in d.leaks(df, bench).collect()}
    assert set(found) == {(1, 1), (3, 1), (4, 1), (2, 2), (5, 3), (9, 3)}
    for (doc, _), x in found.items():
        assert x.edits == 0, doc
    for doc, item, text in ((1, 1, code), (2, 2, doubled), (3, 1, " ".join(words)), (4, 1, docs[4]), (5, 3, docs[5]), (9, 3, docs[9])):
        at = docs[doc].encode().index(text.encode())
        assert (found[doc, item].start_byte, found[doc, item].end_byte) == (at, at + len(text.encode())), doc
    assert {x.doc_id for x in d.without_leaks(df, bench).collect()} == {6, 7, 8}


def test_blocks_of_the_benchmark(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, prose(r, 20)) for i in range(9)]
    docs = spark.createDataFrame([(i, f"{t} {prose(r, 9)}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.leaks(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK", 200)
    assert len(list(d._blocks(bench, "text", "item_id"))) > 3
    assert sorted(map(tuple, d.leaks(docs, bench).collect())) == whole and len(whole) == 9
    assert d.without_leaks(docs, bench).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    question = "What is the capital of Peru?"
    docs = {
        1: f"quiz: {question} Lima.", 2: question.upper(), 3: "what  is\nthe capital\tof Peru?", 4: "what is the capital of Peru",
        5: f"x{question}", 6: f"xWhat is the capital of Peru? and (what is the capital of peru?)", 7: "somewhat is the capital of Peru?",
        8: "What is the capital of Perú?", 9: "2 + 2 = 4", 10: "12 + 2 = 4", 11: "2 + 2 = 43", 12: "", 13: None,
    }
    bench = spark.createDataFrame([(1, question), (2, "2 + 2 = 4"), (3, "Lima"), (4, prose(random.Random(1), 30))], "item_id long, text string")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    found = {(x.doc_id, x.item_id): (x.start_byte, x.end_byte, x.edits) for x in d.leaks(df, bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 1), (6, 1), (9, 2)}
    assert found[1, 1] == (6, 34, 0) and found[6, 1] == (35, 63, 0)
    assert {x.doc_id for x in d.without_leaks(df, bench).collect()} == {4, 5, 7, 8, 10, 11, 12, 13}


def test_a_very_long_text(spark):
    r = random.Random(9)
    item, filler = prose(r, 30), prose(r, 5000)
    long = " ".join([filler] * 250 + [item] + [filler] * 250)
    df = spark.createDataFrame([(1, long), (2, filler)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (hit,) = d.leaks(df, bench).collect()
    assert hit.doc_id == 1 and hit.start_byte == long.index(item) and hit.edits == 0 and len(long) > 8_000_000
