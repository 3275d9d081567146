"""Benchmark leaks: q-gram lemma filtering over diagonal bands, verified by banded alignment.

Benchmark texts are cut into segments of 64 to 127 bytes (a shorter text is one segment), each with an
edit budget of a tenth of its length. A segment of m bytes that occurs with at most e edits shares at
least ``m - Q + 1 - Q * e`` of its q-grams with the text, and all of them on diagonals (place in the
text less place in the segment) that lie within 2e of each other. Shared q-grams are counted in bands
of diagonals that overlap by half, so that every such set lies in one band as a whole; bands that
reach the bound are aligned with the segment, within the band only, and stay if the edits fit.

Letters are compared in lower case and each run of white space as one blank, in items and texts alike;
places are bytes of the given text.
The benchmark is the query set: it goes to the tasks in blocks of at most ``BLOCK`` bytes (a longer
item alone), each against all rows. Items of ``Q`` to ``LEAST`` - 1 bytes are looked for without edits and
between word borders; shorter ones (a word, mostly) cannot tell a leak from common words and are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelgauge.llm.textbytes import SPACE, chunks

Q = 8
SEGMENT = 64
LEAST = 32
BUDGET = 0.1
BAND = 32
BLOCK = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[SPACE] = 32
LOWER[28:32] = 32
#: Bytes of words: letters and digits, and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BITS = 22
SPREAD = np.uint64(0x9E3779B97F4A7C15)
FAR = 1 << 20


def wide_space(data):
    """Marks the bytes of the white space of Unicode that takes more than one byte."""
    marks = np.zeros(len(data), bool)
    if len(data) > 1:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        marks[:-1] |= two
        marks[1:] |= two
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        three = (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        marks[:-2] |= three
        marks[1:-1] |= three
        marks[2:] |= three
    return marks


def fold(data, offsets):
    """(bytes, offsets, places) of a slice as it is compared: bytes in lower case (ASCII and the letters of
    Latin-1), one blank for each run of white space of a row; places are those of the bytes kept."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:] += capital.astype(np.uint8) * np.uint8(32)
    out[wide_space(data)] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[offsets[offsets < len(out)]] = True  # a run ends with its row
    places = np.flatnonzero(keep)
    return out[places], np.append(0, np.cumsum(keep))[offsets], places


def folded(data):
    """The bytes of one text as they are compared."""
    return fold(data, np.array([0, len(data)]))[0]


def grams(data):
    """The q-grams of some bytes, as numbers."""
    n = max(len(data) - Q + 1, 0)
    return np.ndarray((n,), np.uint64, np.ascontiguousarray(data), strides=(1,)) if n else np.zeros(0, np.uint64)


class Segments:
    """The segments of a block of benchmark items, with an index of their q-grams."""

    def __init__(self, items):
        self.texts, self.items, exact = [], [], []
        for item, text in items:
            data = folded(np.frombuffer((text or "").encode(), np.uint8))
            data = np.frombuffer(data.tobytes().strip(b" "), np.uint8)
            if len(data) >= LEAST:
                cuts = np.linspace(0, len(data), max(1, len(data) // SEGMENT) + 1).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    self.texts.append(data[a:b])
                    self.items.append(item)
                    exact.append(False)
            elif len(data) >= Q:
                self.texts.append(data)
                self.items.append(item)
                exact.append(True)
        self.exact = np.array(exact, bool)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((self.sizes * BUDGET).astype(np.int64), (self.sizes - Q) // Q)
        self.least = self.sizes - Q + 1 - Q * self.edits
        self.items = np.array(self.items, np.int64)
        if self.texts:
            names = np.concatenate([grams(t) for t in self.texts])
            lengths = self.sizes - Q + 1
            order = np.argsort(names, kind="stable")
            self.names = names[order]
            self.segment = np.repeat(np.arange(len(lengths)), lengths)[order]
            self.place = (np.arange(len(names)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
            self.seen = np.zeros(1 << BITS, bool)
            self.seen[(self.names * SPREAD) >> np.uint64(64 - BITS)] = True


def align(segments, ids, text, starts, ends, lows, limit=256):
    """Least edits of each segment within its band of a text, with the start and end of the best place.

    ``lows``: the first diagonal of the band, ``starts`` and ``ends`` the reach of its document. Cells of
    a row of the table are diagonals; a cell holds edits times ``FAR`` plus its distance from ``lows``
    when it began, so that the least value also tells where the match starts.
    """
    out = []
    for a in range(0, len(ids), limit):
        part = slice(a, a + limit)
        own, low = ids[part], lows[part]
        size = segments.sizes[own]
        slack = int(segments.edits[own].max())
        width = 2 * BAND + 2 * slack
        low = low - slack
        k = np.arange(width)
        cells = np.broadcast_to(k, (len(own), width)).astype(np.int64)  # a match may begin anywhere
        outside = 1 << 40
        begin = low[:, None] + k
        cells = np.where((begin < starts[part, None]) | (begin > ends[part, None]), outside, cells)
        done = np.empty((len(own), 3), np.int64)
        longest = int(size.max())
        pattern = np.zeros((len(own), longest), np.uint8)
        for i, s in enumerate(own):
            pattern[i, : size[i]] = segments.texts[s]
        for row in range(longest):
            at = low[:, None] + k + row
            inside = (at >= starts[part, None]) & (at < ends[part, None])
            byte = text[np.clip(at, 0, len(text) - 1)]
            across = np.where(inside, cells + (byte != pattern[:, row, None]) * FAR, outside)
            skipped = np.full_like(cells, outside)  # a byte of the segment that the text lacks
            skipped[:, :-1] = cells[:, 1:] + FAR
            cells = np.minimum(across, skipped)
            # bytes of the text that the segment lacks
            cells = np.minimum.accumulate(cells - k * FAR, axis=1) + k * FAR
            for i in np.flatnonzero(size == row + 1):
                best = int(cells[i].argmin())
                value = int(cells[i, best])
                first = low[i] + value % FAR
                done[i] = value // FAR, first, min(low[i] + best + row + 1, ends[part][i])
        out.append(done)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def matches(segments, data, offsets):
    """(row, segment, edits, start, end) of the segments found in a slice of texts."""
    none = (np.zeros(0, np.int64),) * 5
    if not segments.texts or len(data) < Q:
        return none
    given = offsets
    data, offsets, places = fold(data, offsets)
    if len(data) < Q:
        return none
    names = grams(data)
    at = np.flatnonzero(segments.seen[(names * SPREAD) >> np.uint64(64 - BITS)])
    lo = np.searchsorted(segments.names, names[at], "left")
    count = np.searchsorted(segments.names, names[at], "right") - lo
    row = np.searchsorted(offsets, at, "right") - 1
    count[at + Q > offsets[row + 1]] = 0
    some = count > 0
    at, lo, count = at[some], lo[some], count[some]
    if not len(at):
        return none
    hit = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
    segment = segments.segment[hit]
    short = segments.exact[segment]
    if short.any():
        start = short & (segments.place[hit] == 0)
        exact = whole_words(segments, segment[start], np.repeat(at, count)[start], data, offsets)
        at, count, hit, segment = np.repeat(at, count)[~short], np.ones((~short).sum(), int), hit[~short], segment[~short]
    else:
        exact = none[:3]
    # within a slice a segment spans less than FAR diagonals below zero
    band = (np.repeat(at, count) - segments.place[hit] + FAR) // BAND
    key = np.concatenate([segment * (1 << 36) + band, segment * (1 << 36) + band - 1])
    key, shared = np.unique(key, return_counts=True)
    segment, band = key >> 36, key & ((1 << 36) - 1)
    good = shared >= segments.least[segment]
    # a band can lie over the border of two texts: it is aligned with each of them
    segment, low = segment[good], band[good] * BAND - FAR
    row = np.searchsorted(offsets, np.maximum(low, 0), "right") - 1
    last = np.searchsorted(offsets, np.minimum(low + 2 * BAND + segments.sizes[segment], offsets[-1] - 1), "right") - 1
    spread = np.maximum(last - row, 0) + 1
    pick = np.repeat(np.arange(len(row)), spread)
    row = row[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(spread) - spread, spread)
    segment, low = segment[pick], low[pick]
    found = align(segments, segment, data, offsets[row], offsets[row + 1], low)
    good = found[:, 0] <= segments.edits[segment]
    row, segment = np.append(row[good], exact[0]), np.append(segment[good], exact[1])
    found = found[good]
    first, last = np.append(found[:, 1], exact[2]), np.append(found[:, 2], exact[2] + segments.sizes[exact[1]])
    edits = np.append(found[:, 0], np.zeros(len(exact[0]), np.int64))
    begin, end = places[first], places[last - 1] + 1
    return row, segment, edits, begin - given[row], end - given[row]


def whole_words(segments, segment, at, data, offsets):
    """(row, segment, place) of the short segments that stand at some places as whole words, byte for byte."""
    row = np.searchsorted(offsets, at, "right") - 1
    end = at + segments.sizes[segment]
    good = end <= offsets[row + 1]
    row, segment, at, end = row[good], segment[good], at[good], end[good]
    good = ((at == offsets[row]) | ~WORD[data[at - 1]]) & ((end == offsets[row + 1]) | ~WORD[data[np.minimum(end, len(data) - 1)]])
    for k in np.unique(segment):
        own = np.flatnonzero(segment == k)
        pattern = segments.texts[k]
        good[own] &= (data[at[own, None] + np.arange(len(pattern))] == pattern).all(1)
    return row[good], segment[good], at[good]


def _blocks(benchmark, text, id_column):
    """Benchmark items in blocks of bounded size, one block after the other."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_column).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    for r in rows.where("t IS NOT NULL").toLocalIterator():
        if block and size + len(r.t) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r.i if r.i is not None else -1, r.t))
        size += len(r.t)
    if block:
        yield block


def _found(items):
    def run(batches):
        segments = Segments(items)
        for batch in batches:
            for start, _, data, offsets in chunks(batch.column("t")):
                row, segment, edits, begin, end = matches(segments, data, offsets)
                if len(row):
                    columns = [batch.column("o").take(pa.array(row + start)), pa.array(segments.items[segment])]
                    columns += [pa.array(c) for c in (segment, edits, begin, end)]
                    yield pa.RecordBatch.from_arrays(columns, ["o", "item_id", "segment", "edits", "start_byte", "end_byte"])

    return run


def leaks(docs, benchmark, text="text", id_column="doc_id", item_text="text", item_column="item_id"):
    """One row per document and benchmark item found in it: what, where, and with how many edits.

    n_segments counts the segments of the item found in the text, edits is the least number of edits of
    one, start_byte and end_byte span them. Null and empty texts and items match nothing; rows with equal
    ids and texts give one row; items with equal ids count as one item.
    """
    key = F.col(id_column)
    rows = docs.select(F.struct(key.alias("id"), F.xxhash64(text).alias("h")).alias("o"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["o"].dataType.simpleString()
    schema = f"o {kind}, item_id long, segment long, edits long, start_byte long, end_byte long"
    found = [rows.mapInArrow(_found(b), schema) for b in _blocks(benchmark, item_text, item_column)]
    if not found:
        found = [rows.limit(0).mapInArrow(_found([]), schema)]
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    whole = whole.groupBy("o", "item_id").agg(
        F.countDistinct("segment").alias("n_segments"), F.min("edits").alias("edits"),
        F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"),
    )
    return whole.select(F.col("o.id").alias(id_column), "item_id", "n_segments", "edits", "start_byte", "end_byte")


def _clean(items):
    def run(batches):
        segments = Segments(items)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for start, _, data, offsets in chunks(batch.column("t")):
                keep[start + matches(segments, data, offsets)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def without_leaks(docs, benchmark, text="text", item_text="text", item_column="item_id"):
    """The rows of ``docs`` in whose text no segment of the benchmark is found; null texts stay."""
    for block in _blocks(benchmark, item_text, item_column):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("o")
        rows = docs.select(whole, F.col(text).cast("string").alias("t"))
        docs = rows.mapInArrow(_clean(block), rows.schema).select("o.*")
    return docs
