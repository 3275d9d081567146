"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends keeping that period. Words are what stands between white space
(``[\\x20\\x09-\\x0D]``); texts are whole, and each stays in its row: nothing is shuffled.

Periods below ``SHORT`` are found by comparing the words with those one lag further, lag by lag. For
each scale w (``SHORT`` and its doublings) the grams of 2 w words are named, and the least name of every
window of w grams is kept. A run with period q in [w, 2 w) holds a whole window and the same window q
words later, as w + 2 w - 1 + q < 4 q; so both minima are kept. A gram at least as long as the period
cannot recur sooner inside the run, so the *next* kept gram of that name is exactly q words on. Such
pairs are the seeds; each is extended word by word in both directions, and a pair inside a run already
extended with its period is passed over. Minima thin out with w, so all scales together cost the words
times the number of scales. Names only choose seeds: a run's words are compared themselves.

Texts are taken many at a time, laid end to end with a word of their own between them. Null texts and
texts without a word have no run and an empty collapsed text. Repeated rows come out alike, an empty
table gives an empty one; a text is one row, so the longest text is the bound of a task's memory
(about 150 bytes a word).
"""

from collections import defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelgauge.llm.textbytes import U64, mix

#: A run has at least this many words, and this many periods.
WORDS, PERIODS = 6, 4
#: Periods below this are looked for lag by lag; also the window of the first scale.
SHORT = 16
#: Words laid end to end in one go; a longer text is taken alone.
SLICE = 1 << 17


def _least(q):
    return max(WORDS, PERIODS * q)


def _equal_ahead(ids, a, b):
    """How many words from a on equal those from b on (a < b)."""
    n, size, top = 0, 64, len(ids) - b
    while n < top:
        differ = np.flatnonzero(ids[a + n : a + min(n + size, top)] != ids[b + n : b + min(n + size, top)])
        if len(differ):
            return n + int(differ[0])
        n, size = min(n + size, top), size * 2
    return n


def _equal_behind(ids, a, b):
    """How many words before a equal those before b (a < b)."""
    n, size = 0, 64
    while n < a:
        m = min(size, a - n)
        differ = np.flatnonzero(ids[a - n - m : a - n] != ids[b - n - m : b - n])
        if len(differ):
            return n + m - 1 - int(differ[-1])
        n, size = n + m, size * 2
    return n


def _smallest(ids, start, q):
    """Whether q is the smallest period of a stretch of 4 q words or more that has period q."""
    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            if np.array_equal(ids[start : start + q], ids[start + q // r : start + q + q // r]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def _by_lags(ids):
    """(start, length, lag) of stretches that repeat at a lag below SHORT."""
    for q in range(1, min(SHORT, len(ids))):
        m = _least(q) - q
        at = np.flatnonzero(ids[q:] == ids[:-q])
        if len(at) < m:
            continue
        if not (at[m - 1 :] - at[: len(at) - m + 1] == m - 1).any():
            continue
        cut = np.flatnonzero(np.diff(at) != 1)
        first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
        for s, e in zip(first.tolist(), last.tolist()):
            if e - s + 1 >= m:
                yield s, e - s + 1 + q, q


def _slide(x, w, op, fill):
    """``op`` (minimum or maximum) over every w entries in a row."""
    m = len(x) - w + 1
    rows = np.append(x, np.full(-len(x) % w, fill, x.dtype)).reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:m], ahead[w - 1 : w - 1 + m])


def _minimizers(names, w):
    """The places whose name is the least of some window of w names (all of them on ties)."""
    least = _slide(names, w, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), w, np.maximum, 0) == names)


def _by_scales(ids, longest):
    """(start, length, distance) of stretches that repeat at a distance of SHORT or more."""
    with np.errstate(over="ignore"):
        names, size, w = mix(ids.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), 1, SHORT
        while PERIODS * w <= longest:
            while size < 2 * w:  # the name of twice as many words, from two names
                names = mix(names[:-size] * U64(0xD6E8FEB86659FD93) + mix(names[size:] + U64(size)))
                size *= 2
            at = _minimizers(names, w)
            order = at[np.argsort(names[at], kind="stable")]
            apart = np.diff(order)
            seeds = (names[order[1:]] == names[order[:-1]]) & (apart >= w) & (apart < 2 * w)
            x, d = order[:-1][seeds], apart[seeds]
            by_distance = np.lexsort((x, d))
            before, end = 0, 0
            for a, q in zip(x[by_distance].tolist(), d[by_distance].tolist()):
                if q == before and a + q < end:
                    continue
                start = a - _equal_behind(ids, a, a + q)
                before, end = q, a + q + _equal_ahead(ids, a, a + q)
                yield start, end - start, q
            w *= 2


def find_runs(ids, longest=None):
    """(start, length, period) of every run of a word-number array, by start, then period.

    ``longest`` bounds the length of a run where it is known (texts laid end to end).
    """
    longest = len(ids) if longest is None else longest
    found = [*_by_lags(ids), *_by_scales(ids, longest)]
    return sorted((s, n, q) for s, n, q in found if n >= _least(q) and _smallest(ids, s, q))


def _slices(texts):
    """Lists of word lists with at most SLICE words, or one longer text."""
    held, size = [], 0
    for text in texts:
        words = text.split() if text else []  # bytes split at just the six white-space bytes
        if held and size + len(words) > SLICE:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words) + 1
    if held:
        yield held


def _slice_runs(texts):
    """Per text of a slice: its runs, and its words without what repeats."""
    number = defaultdict()
    number.default_factory = number.__len__
    starts = np.cumsum([0, *(len(words) + 1 for words in texts)])
    ids = np.empty(starts[-1], np.int64)
    for i, words in enumerate(texts):
        ids[starts[i] : starts[i + 1] - 1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids[starts[i + 1] - 1] = -1 - i
    found = [[] for _ in texts]
    again = np.zeros(len(ids) + 1, np.int64)
    for s, n, q in find_runs(ids, max(map(len, texts))):
        i = int(np.searchsorted(starts, s, "right")) - 1
        found[i].append({"start": s - int(starts[i]), "length": n, "period": q})
        again[s + q] += 1
        again[s + n] -= 1
    kept = np.cumsum(again) == 0
    for i, words in enumerate(texts):
        if found[i]:
            words = compress(words, kept[starts[i] : starts[i + 1] - 1].tolist())
        yield found[i], b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = "runs_ array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_ string, words_ bigint"


def with_runs(docs, text="text", runs="runs", collapsed="collapsed", words="n_words"):
    """``docs`` with its runs (by start, then period), the text without repeats, and the word count.

    The collapsed text holds the words that no run contains beyond its first period, joined by one
    space. Columns named like the three new ones are replaced; all others are kept as they are.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("t").cast(pa.large_binary()).to_pylist()
            found, rest, count = [], [], []
            for held in _slices(texts):
                count += [len(words) for words in held]
                for a, b in _slice_runs(held):
                    found.append(a)
                    rest.append(b)
            columns = [batch.column("o"), pa.array(found, pa.list_(RUN)), pa.array(rest, pa.binary()).cast(pa.string())]
            names = ["o", "runs_", "collapsed_", "words_"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64())], names)

    others = [c for c in docs.columns if c not in (runs, collapsed, words)]
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(1).alias("one"))
    whole = docs.select(held.alias("o"), F.col(f"`{text}`").alias("t"))
    done = whole.mapInArrow(run, f"o {whole.schema['o'].dataType.simpleString()}, {ADDED}")
    return done.select(
        *[F.col(f"o.`{c}`") for c in others], F.col("runs_").alias(runs), F.col("collapsed_").alias(collapsed), F.col("words_").alias(words)
    )


def longest_run(runs):
    """The run with the greatest length, ties by least start, then period; null where there is none."""
    ranked = F.array_sort(runs, lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).otherwise(0))
    return F.try_element_at(ranked, F.lit(1))
