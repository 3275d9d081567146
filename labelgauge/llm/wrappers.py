"""Main text of web pages, by wrappers induced from the pages of each host.

1. Every page becomes a *frame*: its tree of block elements (label: name of the element and its first
   class or id), in which siblings that repeat are one node. The distinct frames of a host, few beside its
   pages, are aligned by simple tree matching and merged, some at a time, until each host has one wrapper.
2. Each frame is aligned with the wrapper of its host, so that every text block of every page has a *slot*
   there. A text that stands in its slot on most of a host's pages (counted by distinct headings, so that
   copies of a page count once) is constant: template. What varies is content.
3. Of what varies, slots in menus, headers, footers, sidebars, notices, adverts, forms and reader comments
   go by the wrapper's labels, and slots outside the article that hold mostly links go as menus. Where a
   page has an ``article`` or ``main``, only slots within count.

Block elements part blocks; inline elements and ``br`` do not. Character references are decoded, white
space is one space, blocks are joined by line breaks in page order. Nothing else is dropped or cut.

A null page or one without text gives an empty text; broken or unclosed markup is read as far as it goes.
Pages without a host are not aligned and go by labels alone. Repeated pages come out alike, equal ids do
no harm (pages are never joined by id), an empty table gives an empty one. Models per host are broadcast
only if all of them together are under ``BROADCAST`` bytes; beyond that pages meet them by (host, salt).
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelgauge.llm.textbytes import Hasher
from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

#: A text is constant if it stands under this share of a host's headings, and under so many at least.
SHARE, LEAST = 0.8, 4
#: A slot outside the article is a menu if this share of its characters is in links.
LINKS = 0.6
#: Frames merged at a time; salts of a host where models are not broadcast; bytes of broadcast models.
MERGED, SALTS, BROADCAST = 32, 64, 8 << 20
#: Beyond this depth elements count as children of the last one; beyond this many children a node folds all alike ones.
DEEP, WIDE = 100, 64

# Elements without an end tag, with raw text, inside of a block, never content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript iframe template svg math object embed canvas audio video map nav footer aside form "
    "button select option datalist textarea input fieldset legend dialog menu noembed noframes".split()
)
#: An open element of the first kind ends where one of the second begins.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPE = frozenset("ul ol dl table article section div main body html aside nav select".split())
REPEATED = frozenset("p li tr td th dt dd option blockquote figure h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that name what is not content.
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer contentinfo sidebar aside "
    "complementary widget notice notices alert cookie cookies consent gdpr ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion popup modal dialog overlay newsletter subscribe signup login search form "
    "share sharing social related recommended pagination pager toolbar".split()
)
COMMENTS = frozenset("comment comments respond reply replies discussion disqus".split())
MAIN = frozenset({"article", "main"})

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


class Node:
    """An element of a frame or wrapper; ``into`` is the node that it was merged into."""

    __slots__ = ("label", "children", "into", "number")

    def __init__(self, label, children=()):
        self.label, self.children, self.into, self.number = label, list(children), None, -1

    def end(self):
        node = self
        while node.into is not None:
            node = node.into
        return node


def label_of(tag, attributes):
    """An element as ``kind|tag.name``: the kind is ``m`` (main), ``h`` (header), ``x`` (not content), ``c`` (comments) or none."""
    kind, first = "", ""
    if attributes:
        words = []
        for name, value in NAMED.findall(attributes):
            value = value.strip("\"' \t\n\r\f").lower()
            if name.lower() == "role" and value == "main":
                kind = "m"
            for one in value.split():
                first = first or one
                if not one.startswith(("has-", "with-", "no-", "without-", "is-")):
                    words += re.split(r"[-_\d]+", one)
        if tag not in ("html", "body"):
            if not COMMENTS.isdisjoint(words):
                kind = "c"
            elif not kind and not NAMES.isdisjoint(words):
                kind = "x"
    if tag in NEVER:
        kind = "x"
    elif tag in MAIN and kind != "c":
        kind = "m"
    elif tag == "header" and not kind:
        kind = "h"
    first, tag = re.sub(r"[^a-z:-]+", "9", first.replace("_", "-")), re.sub(r"[^a-z0-9:-]", "-", tag)
    return f"{kind}|{tag}.{first}" if first else f"{kind}|{tag}"


def parse(page):
    """(root, blocks, title): the element tree, and (node, text, characters in links) of each text block."""
    root = Node("|")
    stack, path = [("", root)], []
    blocks, held, links, in_link = [], [], 0, 0
    title, at, n = "", 0, len(page)

    def flush():
        nonlocal held, links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                blocks.append((stack[-1][1], text, min(links, len(text))))
        held, links = [], 0

    while at < n:
        found = TOKEN.search(page, at)
        start = found.start() if found else n
        if start > at:
            held.append(page[at:start])
            if in_link:
                links += start - at
        if not found:
            break
        at, tag = found.end(), found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if found.group(1) else 1
            elif tag == "br":
                held.append(" ")
            continue
        flush()
        in_link = 0
        if found.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in ("p", "li") and stack[i][0] in SCOPE:
                    break
            continue
        # an open paragraph ends at any block; items and cells end at their like
        while len(stack) > 1 and stack[-1][0] == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if tag in CLOSES.get(stack[i][0], ()) or (tag == "tr" and stack[i][0] in ("td", "th")):
                if tag != "tr" or stack[i][0] == "tr":
                    del stack[i:]
                    break
            elif stack[i][0] in SCOPE:
                break
        if tag == "body":
            stack = [s for s in stack if s[0] in ("", "html")]
        parent = stack[-1][1]
        if tag in ("html", "body"):
            again = [c for c in parent.children if c.label.split("|")[1].split(".")[0] == tag]
            node = again[0] if again else Node(label_of(tag, found.group(3)))
            if not again:
                parent.children.append(node)
        elif tag in VOID:
            continue
        else:
            node = Node(label_of(tag, found.group(3)))
            parent.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "title" and not title:
                title = " ".join(entities.unescape(page[at : close.start() if close else n]).split())
            at = close.end() if close else n
        elif len(stack) < DEEP:
            stack.append((tag, node))
        else:
            stack.append((tag, stack[-1][1]))
    flush()
    return root, blocks, title


def matching(a, b, known):
    """Simple tree matching: the number of nodes in the greatest common tree of two trees, from the roots down."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + _table(a.children, b.children, known)[-1][-1]
    return known[key]


def _table(left, right, known):
    rows = [[0] * (len(right) + 1)]
    for x in left:
        last, row = rows[-1], [0]
        for j, y in enumerate(right):
            best = last[j + 1] if last[j + 1] > row[j] else row[j]
            if x.label == y.label:
                both = last[j] + matching(x, y, known)
                if both > best:
                    best = both
            row.append(best)
        rows.append(row)
    return rows


def merge(a, b, known=None):
    """Tree b merged into tree a (equal labels): matched nodes become one, the others are put in between."""
    known = {} if known is None else known
    b.into = a
    if not b.children:
        return a
    if len(a.children) == 1 == len(b.children) and a.children[0].label == b.children[0].label:
        merge(a.children[0], b.children[0], known)
        return a
    rows = _table(a.children, b.children, known)
    i, j, out = len(a.children), len(b.children), []
    while i or j:
        if i and rows[i][j] == rows[i - 1][j]:
            i -= 1
            out.append((a.children[i], None))
        elif j and rows[i][j] == rows[i][j - 1]:
            j -= 1
            out.append((b.children[j], None))
        else:
            i, j = i - 1, j - 1
            out.append((a.children[i], b.children[j]))
    a.children = [x for x, _ in reversed(out)]
    for x, y in reversed(out):
        if y is not None:
            merge(x, y, known)
    return a


def fold(node):
    """Siblings that repeat as one node, from the leaves up.

    Paragraphs, items and the like, and elements with a name, fold wherever they stand among their siblings,
    so that what is put between them changes no slot; other elements fold with a like neighbour only.
    """
    out, by_label, wide = [], {}, len(node.children) > WIDE
    for child in node.children:
        fold(child)
        like, tag = by_label.get(child.label), child.label.split("|")[1]
        if like is not None and not (wide or tag in REPEATED or "." in tag):
            like = out[-1] if out[-1].label == child.label and text_of(out[-1]) == text_of(child) else None
        if like is not None:
            merge(like, child)
        else:
            out.append(child)
            by_label.setdefault(child.label, child)
    node.children = out
    return node


def text_of(node):
    """A frame or wrapper as text; ``tree_of`` reads it back."""
    return f"{node.label}({','.join(map(text_of, node.children))})" if node.children else node.label


def tree_of(text):
    root = Node("")
    stack, node = [root], root
    for label, mark in re.findall(r"([^(),]*)([(),]|$)", text):
        if label:
            node = Node(label)
            stack[-1].children.append(node)
        if mark == "(":
            stack.append(node)
        elif mark == ")":
            stack.pop()
    return root.children[0]


def nodes_of(tree):
    """The nodes of a tree in the order of its text, numbered."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo += reversed(node.children)
    return out


def framed(page):
    """(frame text, blocks as (node number, text, characters in links), heading) of a page."""
    root, blocks, title = parse(page or "")
    fold(root)
    nodes_of(root)
    head = next((t for node, t, _ in blocks if node.label.startswith("|h1")), "")
    return text_of(root), [(node.end().number, t, n) for node, t, n in blocks], title + "\n" + head


def slots(frame, wrapper):
    """Per node of the frame: its slot (node number) in the wrapper that took it in."""
    wrapper, frame = tree_of(wrapper), tree_of(frame)
    nodes = nodes_of(frame)
    merge(wrapper, frame)
    place = {id(node): i for i, node in enumerate(nodes_of(wrapper))}
    return [place[id(node.end())] for node in nodes]


def excluded(frame):
    """Per node of a frame: True where its label or an ancestor's says that it is no content.

    Names exclude an element only if no article is within; with an article or main outside of what is
    excluded, all that is not within one is excluded, too. Also gives whether nodes are in an article.
    """
    tree = tree_of(frame)
    nodes = nodes_of(tree)
    holds = [False] * len(nodes)
    for node in reversed(nodes):
        holds[node.number] = node.label[0] == "m" or any(holds[c.number] for c in node.children)
    out, inside = [False] * len(nodes), [False] * len(nodes)
    for node in nodes:
        kind, tag = node.label.split("|", 1)
        i = node.number
        inside[i] = inside[i] or (kind == "m" and not out[i])
        named = kind == "x" and tag.split(".")[0] not in NEVER
        if kind == "c" or (kind == "x" and not (named and holds[i])) or (kind == "h" and not inside[i] and not holds[i]):
            out[i] = True
        for c in node.children:
            out[c.number], inside[c.number] = out[i], inside[i] and not out[i]
    if any(inside):
        out = [o or not a for o, a in zip(out, inside)]
    return out, inside


HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url):
    """The host of an address in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


_hasher = Hasher(12)


def _hash(texts):
    """63-bit names of texts."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *map(len, data)])
    whole = np.frombuffer(b"".join(data), np.uint8)
    return (_hasher.load(whole).of(ends[:-1], ends[1:]) >> np.uint64(1)).astype(np.int64)


FRAME = "frame string, heading bigint, node array<int>, hash array<bigint>, chars array<int>, linked array<int>"


def frames(pages, url="url", html="html"):
    """Per page with a host: its frame, and its blocks as narrow arrays (node, text name, characters, those in links)."""

    def run(batches):
        for batch in batches:
            out = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                frame, blocks, heading = framed(page)
                names = _hash([t for _, t, _ in blocks] + [heading]).tolist()
                out.append((host, frame, names[-1], [b[0] for b in blocks], names[:-1], [len(b[1]) for b in blocks], [b[2] for b in blocks]))
            kinds = [pa.string(), pa.string(), pa.int64(), *map(pa.list_, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
            names = ["host", "frame", "heading", "node", "hash", "chars", "linked"]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    narrow = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("page")).where("host is not null")
    return narrow.mapInArrow(run, f"host string, {FRAME}")


def _merged(table):
    trees = sorted(table.column("frame").to_pylist())
    wrapper = tree_of(trees[0])
    for frame in trees[1:]:
        merge(wrapper, tree_of(frame))
    return pa.table({"host": table.column("host").slice(0, 1), "frame": [text_of(wrapper)]})


def wrappers(found, spark):
    """(host, wrapper): the distinct frames of each host merged, MERGED or so at a time, until one is left."""
    table = stored(found.select("host", "frame").distinct(), shared_dir(spark, "frames"))
    while True:
        sizes = table.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return table.withColumnRenamed("frame", "wrapper")
        buckets = table.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("frame"), F.ceil(F.col("n") / MERGED)))
        merged = buckets.select("host", "frame", "bucket").groupBy("host", "bucket").applyInArrow(_merged, "host string, frame string")
        table = stored(merged.distinct(), shared_dir(spark, "wrappers"))


def _slotted(batches):
    """(host, frame, slot of each node) for rows (host, frame, wrapper)."""
    for batch in batches:
        rows = zip(batch.column("frame").to_pylist(), batch.column("wrapper").to_pylist())
        slot = pa.array([slots(frame, wrapper) for frame, wrapper in rows], pa.list_(pa.int32()))
        inside = [excluded(frame)[1] for frame in batch.column("frame").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("frame"), slot, pa.array(inside, pa.list_(pa.bool_()))], ["host", "frame", "slot", "inside"]
        )


def models(pages, url="url", html="html"):
    """One row per host: its wrapper, its constant texts as "slot:name", and its slots that are menus."""
    spark = pages.sparkSession
    found = stored(frames(pages, url, html), shared_dir(spark, "page-frames"))
    wrapped = wrappers(found, spark)
    mapped = found.select("host", "frame").distinct().join(wrapped, "host")
    mapped = mapped.mapInArrow(_slotted, "host string, frame string, slot array<int>, inside array<boolean>")
    mapped = stored(mapped, shared_dir(spark, "slots"))
    nodes = mapped.select("host", "frame", F.posexplode("slot").alias("node", "slot"), "inside")
    nodes = nodes.select("host", "frame", "node", "slot", F.element_at("inside", F.col("node") + 1).alias("inside"))

    # constants: only texts under LEAST headings of a host at least are looked at further
    block = F.explode(F.arrays_zip("node", "hash"))
    each = found.select("host", "frame", "heading", block.alias("b")).select("host", "frame", "heading", F.col("b.node").alias("node"), F.col("b.hash").alias("hash"))
    seen = each.distinct()
    often = seen.select("host", "hash", "heading").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    headings = found.select("host", "heading").distinct().groupBy("host").agg(F.count("*").alias("of"))
    often = often.join(headings, "host").where(F.col("n") >= SHARE * F.col("of")).select("host", "hash", "of")
    often = stored(often, shared_dir(spark, "often"))
    placed = seen.join(often.hint("broadcast") if _bytes(often, F.lit(64)) <= BROADCAST else often.hint("merge"), ["host", "hash"])
    placed = placed.select("host", "of", "frame", "node", "hash", "heading").distinct().join(nodes, ["host", "frame", "node"])
    counted = placed.select("host", "of", "slot", "hash", "heading").distinct().groupBy("host", "of", "slot", "hash").agg(F.count("*").alias("n"))
    constant = counted.where((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("of")))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_set(F.concat_ws(":", "slot", "hash"))).alias("constants"))

    # menus: characters and linked characters per slot, summed per frame first
    block = F.explode(F.arrays_zip("node", "chars", "linked"))
    sums = found.select("host", "frame", block.alias("b")).groupBy("host", "frame", F.col("b.node").alias("node"))
    sums = sums.agg(F.sum("b.chars").alias("chars"), F.sum("b.linked").alias("linked")).join(nodes, ["host", "frame", "node"])
    sums = sums.where("NOT inside").groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    menu = sums.where(F.col("linked") > LINKS * F.col("chars")).groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("menus"))
    out = wrapped.join(constant, "host", "left").join(menu, "host", "left")
    return stored(out, shared_dir(spark, "models"))


def _bytes(table, each):
    return table.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


class _Reader:
    """Extraction for pages of many hosts, with what was worked out for a (model, frame) kept a while."""

    def __init__(self, most=4096):
        self.most, self.plans = most, {}

    def plan(self, frame, model):
        key = (frame, model and model["host"])
        if key not in self.plans:
            if len(self.plans) >= self.most:
                self.plans.clear()
            out, inside = excluded(frame)
            if model is None:
                self.plans[key] = out, None, frozenset()
            else:
                slot, menus = slots(frame, model["wrapper"]), set(model["menus"] or ())
                out = [o or (s in menus and not a) for o, s, a in zip(out, slot, inside)]
                self.plans[key] = out, slot, frozenset(model["constants"] or ())
        return self.plans[key]

    def text(self, page, model):
        frame, blocks, _ = framed(page)
        out, slot, constants = self.plan(frame, model)
        kept = [b for b in blocks if not out[b[0]]]
        if constants and kept:
            names = _hash([t for _, t, _ in kept]).tolist()
            kept = [b for b, name in zip(kept, names) if f"{slot[b[0]]}:{name}" not in constants]
        return "\n".join(t for _, t, _ in kept)


def main_text(pages, url="url", html="html", out="text", broadcast=BROADCAST):
    """``pages`` with the main text of each page; a column named like ``out`` is replaced, others are kept."""
    spark = pages.sparkSession
    per_host = models(pages, url, html)
    model = F.struct("host", "wrapper", "constants", "menus")
    others = [c for c in pages.columns if c != out]
    held = F.struct(*[F.col(f"`{c}`") for c in others])
    whole = pages.select(held.alias("o"), F.col(f"`{html}`").alias("page"), host_of(F.col(f"`{url}`")).alias("h"))
    weight = F.length("wrapper") + 32 * F.size(F.coalesce("constants", F.array())) + 8 * F.size(F.coalesce("menus", F.array())) + 64
    if _bytes(per_host, weight) <= broadcast:
        met = whole.join(F.broadcast(per_host.select(F.col("host").alias("h"), model.alias("m"))), "h", "left")
    else:
        salted = per_host.select(F.col("host").alias("h"), model.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        spread = whole.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
        met = spread.join(salted.hint("merge"), ["h", "salt"], "left")

    def run(batches):
        reader = _Reader()
        for batch in batches:
            rows = zip(batch.column("page").to_pylist(), batch.column("m").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array([reader.text(p, m) for p, m in rows], pa.string())], ["o", "t"])

    kind = whole.schema["o"].dataType.simpleString()
    done = met.select("o", "page", "m").mapInArrow(run, f"o {kind}, t string")
    return done.select(*[F.col(f"o.`{c}`") for c in others], F.col("t").alias(out))
