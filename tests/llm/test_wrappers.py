"""Wrapper induction: tree matching against a plain recursion, and pages of several kinds."""

import itertools
import random

from pyspark.sql import functions as F

from labelgauge.llm import wrappers


def plain_matching(a, b):
    """The greatest common tree by trying all ordered choices of children."""
    if a.label != b.label:
        return 0
    best, k = 0, min(len(a.children), len(b.children))
    for size in range(k + 1):
        for left in itertools.combinations(a.children, size):
            for right in itertools.combinations(b.children, size):
                scores = [plain_matching(x, y) for x, y in zip(left, right)]
                best = max(best, sum(scores))
    return 1 + best


def some_tree(rng, depth=3):
    return wrappers.Node(rng.choice("ab") if depth < 3 else "r", [some_tree(rng, depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)])


def test_matching_and_merging():
    rng = random.Random(2)
    for _ in range(150):
        a, b = some_tree(rng), some_tree(rng)
        common = wrappers.matching(a, b, {})
        assert common == plain_matching(a, b)
        sizes = [len(wrappers.nodes_of(t)) for t in (a, b)]
        text = wrappers.text_of(b)
        before, frame = wrappers.text_of(a), wrappers.nodes_of(b)
        wrappers.merge(a, b)
        assert len(wrappers.nodes_of(a)) == sum(sizes) - common
        assert all(n.end().label == n.label for n in frame)
        assert wrappers.text_of(wrappers.tree_of(text)) == text
        whole = wrappers.text_of(a)
        # what was merged finds itself whole in the wrapper
        for part in (before, text):
            assert len(set(wrappers.slots(part, whole))) == len(wrappers.nodes_of(wrappers.tree_of(part)))


def page(i, host="a.example", body=None, extra=""):
    text = body or f"<p>first {i} text</p>{extra}<p>more of {i}</p><p>Read our terms.</p>"
    return (i, f"https://{host}/{i}", f"<html><head><title>T {i}</title></head><body><div><a href=/>Home</a> <a href=/x{i}>x{i}</a></div><div><h1>T {i}</h1>{text}</div><div>About us, since 1999</div></body></html>")


def texts(spark, rows, **more):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.main_text(docs, **more).collect()}


def test_constants_and_menus_go_without_any_names(spark):
    rows = [page(i, extra="<div><p>banner</p></div>" * (i % 3 == 0)) for i in range(9)]
    found = texts(spark, rows)
    for i in range(9):
        assert found[i] == f"T {i}\nfirst {i} text\n" + "banner\n" * (i % 3 == 0) + f"more of {i}"
    assert texts(spark, rows, broadcast=-1) == found


def test_copies_are_no_template(spark):
    rows = [(i, "http://b.example/", f"<article><h1>One</h1><p>the same article</p></article><p>{i}</p>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {"One\nthe same article"}


def test_labels(spark):
    html = """<html><body class="page with-sidebar"><header>top</header><nav><ul><li><a>m</a></ul></nav>
    <div class="cookie-notice">We use <b>cookies</b></div><div class="content has-ads"><main><article class=post><header><h1>Head&amp;line</h1></header>
    <p>One<br>two &lt;three&gt; f&uuml;nf<p>Un<b>clos</b>ed <i>inline</i><div class='ad-slot'>Buy!</div><form>Name <input> <button>Go</button></form>
    <ul><li>item a<li>item b</ul><table><tr><td>c1<td>c2</table><script>if (a < b) "</p>"</script><style>p{}</style>
    <section id="comments"><article class="comment"><p>nice!</p></article></section></article></main></div>
    <aside>side</aside><div class="sidebar">s</div><footer>&copy; f</footer></body></html>"""
    want = "Head&line\nOne two <three> fünf\nUnclosed inline\nitem a\nitem b\nc1\nc2"
    odd = "<p title='a>b' data-x=\"</p>\">kept<!-- <p>gone</p> --> a < b & c &nbsp; d</p><p>it's <b"
    rows = [(1, "http://c.example/", html), (2, None, html), (3, "not an address", html), (4, "http://d.example", None), (5, "http://d.example", ""), (6, "http://e.example", odd), (6, "http://e.example", odd)]
    found = texts(spark, rows)
    assert found[1] == found[2] == found[3] == want
    assert found[4] == found[5] == "" and found[6] == "kept a < b & c d\nit's"


def test_long_deep_and_wide_pages(spark):
    words = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, "http://a/", f"<article><p>{words}</article>"), (2, "http://a/", "<div>" * 30_000 + "deep"), (3, "http://a/", "".join(f"<p>p{i}</p><h2>h{i}</h2>" for i in range(20_000)))]
    found = texts(spark, rows)
    assert found[1] == words and found[2] == "deep" and found[3].count("\n") == 39_999


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, "http://a/", "<p>x</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    docs = docs.withColumns({c: F.lit(c) for c in ("o", "h", "m", "t", "page", "host", "salt", "frame", "text")})
    out = wrappers.main_text(docs, broadcast=-1)
    assert sorted(out.columns) == sorted(docs.columns) and out.first().text == "x" and out.first().salt == "salt"
    assert wrappers.main_text(docs.where("page_id > 1")).count() == 0


def test_many_frames_of_one_host(spark):
    kinds = [f"<section class=k{'abcdefghij'[i % 10]}{'abcdefghijkl'[i // 10]}><p>v{i}</p></section>" for i in range(120)]
    rows = [page(i, body=kind + "<p>Read our terms.</p>") for i, kind in enumerate(kinds)]
    found = texts(spark, rows)
    assert all(found[i] == f"T {i}\nv{i}" for i in range(120))
