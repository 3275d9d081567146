"""Licence scans against brute force, whole texts, headers in comments, and inheritance."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from labelgauge.llm import licenses as li


def terms(text):
    parts = regex.split(r"[^\p{L}\p{N}.]+|\.+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.+", text.lower())
    return Counter(t for t in parts if t and t not in li.STOPS)


FULL = {name: text for name, text in li.TEMPLATES if "\n\n" in text}


def commented(text, mark="# ", width=60):
    """A text wrapped anew, every line a comment."""
    out = []
    for paragraph in text.split("\n\n"):
        line = ""
        for word in paragraph.split():
            if len(line) + len(word) > width:
                out.append(line)
                line = ""
            line += word + " "
        out += [line, ""]
    return "\n".join(mark + line.rstrip() for line in out[:-1])


FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3.\n"),
    ("a/b/c/x.py", "code\n# Licensed under the Apache License, Version 2.0.\nmore words here"),
    ("a/b/c/y.py", "nothing to see\nwork of the version"),
    ("a/z.py", None),
    ("a/b.py", "MIT"),
    ("q/r/s.py", "SPDX-License-Identifier: MIT"),
    ("q/r/t.py", "all of the words and many others under no license at all, to be sure"),
    ("top.py", ""),
    ("long.txt", "words " * 40_000 + "\nLicensed under CC BY-NC 4.0."),
    ("l/license.md", "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0."),
    ("h/gpl.py", "#!/usr/bin/python\n" + commented(FULL["GPL-3.0"]) + "\nimport os\n"),
    ("h/bsd.c", "/*\n * Copyright (c) 2020, Some One. All rights reserved.\n *\n" + commented(FULL["BSD-3-Clause"], " * ") + "\n */\nint x;"),
    ("h/own.c", "// Copyright 2020. All rights reserved.\nint x;"),
    (None, "Released under the MIT License."),
]


def brute(files):
    texts = [(p, t or "") for p, t in files if p is not None]
    units = []
    for path, text in texts:
        lead = (regex.match(li.COMMENT, text) or [""])[0]
        parts = list(enumerate(regex.split(r"\r?\n", text)))
        paragraphs = regex.split(li.BLANK, lead) + regex.split(li.BLANK, text[len(lead) :])
        parts += [(li.FIRST_PARAGRAPH - i, x) for i, x in enumerate(paragraphs) if "\n" in x.strip(" \r\n")]
        parts += [(li.LEADING, lead)] + [(li.WHOLE, text)] * bool(regex.search(li.LICENSE_FILE, path))
        units += [(path, line, part) for line, part in parts if regex.search(li.ANCHOR, part)]
    vectors = {part: terms(part) for _, _, part in units}
    df = Counter(t for v in vectors.values() for t in v)
    weigh = lambda c: {t: n * (math.log((len(vectors) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    models = []
    for i, (name, text) in enumerate(li.TEMPLATES):
        first, _, rest = text.partition("\n\n")
        models += [(2 * i, name, False, weigh(terms(first)))] + [(2 * i + 1, name, True, weigh(terms(text)))] * bool(rest)
    out = {}
    for path, line, part in units:
        x, large = weigh(vectors[part]), line in (li.WHOLE, li.LEADING)
        for i, name, whole, m in models:
            dot = sum(x.get(t, 0) * w for t, w in m.items())
            score = round(min(dot / (length(x) * length(m)), 1), 6) if dot else 0
            if score >= li.LEAST and (large or not whole):
                rank = (name != "Proprietary", whole and large, score, -i, line if large else -abs(line), name, line)
                out[path] = max(out.get(path, ()), rank)
    return {p: (r[5], r[2]) for p, r in out.items()}


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame(FILES, "path string, text string")
    got = {r.path: (r.license, pytest.approx(r.score, abs=2e-6)) for r in li.scan(df).collect()}
    assert got == brute(FILES) and len(got) >= 9
    assert got["h/gpl.py"][0] == "GPL-3.0" and got["h/bsd.c"][0] == "BSD-3-Clause" and got["h/own.c"][0] == "Proprietary"


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_headers_and_texts_of_each_licence(spark, mark):
    rows = []
    for i, (name, text) in enumerate(li.TEMPLATES[:-1]):
        text = text if "\n" not in text else commented(text, mark, 40 + 7 * (i % 5))
        text = "/*\n" + text + "\n */" if mark == " * " and "\n" in text else text
        rows += [(f"{i}/{name}/x.c", text + "\nint main() { return 0; }\n"), (f"{i}/{name}/LICENSE", "Copyright 2019 A. Person\n\n" + text)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.license for r in li.scan(df).collect()}
    # without a comment the clauses of the two BSD texts are told apart in a licence file only
    wrong = {p: got.get(p) for p, _ in rows if got.get(p) != p.split("/")[1]}
    assert all(not mark and p.endswith("BSD-2-Clause/x.c") for p in wrong), wrong


def test_long_licences_by_title(spark):
    body = "\n\n".join(f"{i}. Section of the License. The licensee may do thing {i} with copies of covered work {i * 7}." for i in range(90))
    titles = {
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007",
        "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991",
        "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007",
        "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007",
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/",
        "MPL-2.0": "Mozilla Public License Version 2.0\n==================================",
    }
    rows = [(f"{name}/COPYING", f"{title}\n\n{body}\n") for name, title in titles.items()]
    df = spark.createDataFrame(rows, "path string, text string")
    assert {r.path.split("/")[0]: r.license for r in li.scan(df).collect()} == {n: n for n in titles}


def test_inheritance(spark):
    df = spark.createDataFrame(FILES + FILES[:1], "path string, text string")
    got = {r.path: (r.license, r.how, r.source_directory) for r in li.licensed(df).collect()}
    assert len(got) == 14
    assert got["a/b/c/x.py"] == ("Apache-2.0", "own", None)
    assert got["a/b/c/y.py"] == ("GPL-3.0", "inherited", "a/b")
    assert got["a/z.py"] == ("MIT", "inherited", "a") and got["a/b.py"][:2] == ("MIT", "inherited")
    assert got["q/r/s.py"][:2] == ("MIT", "own") and got["q/r/t.py"] == (None, "none", None)
    assert got["top.py"] == (None, "none", None) and got["long.txt"][0] == "CC-BY-NC-4.0"


def test_the_nearest_licence_file_counts_even_if_unknown(spark):
    apache = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE"
    rows = [
        ("LICENSE", "Released under the MIT License."), ("x", "a"), ("d/e/f", "b"), ("k/LICENSE", "Our own words on a licence, to be read."),
        ("k/m/x", "c"), ("n/COPYING", None), ("n/x", "d"), ("d/LICENSE", apache),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit(1) for c in ("license", "line", "same", "lead")})
    got = {r.path: (r.license, r.how, r.source_directory) for r in li.licensed(df).collect()}
    assert got["x"] == ("MIT", "inherited", "") and got["d/e/f"] == ("Apache-2.0", "inherited", "d")
    assert got["k/m/x"] == (None, "unknown", "k") and got["k/LICENSE"] == (None, "unknown", "k") and got["n/x"] == (None, "unknown", "n")
    assert li.licensed(df.limit(0)).collect() == []
