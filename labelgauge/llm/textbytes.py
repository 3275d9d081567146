"""Vectorised helpers over the bytes of many texts at once (numpy and Arrow, inside tasks).

``chunks`` cuts an Arrow batch into slices of a few hundred kilobytes of text (a longer text is a
slice of its own), so that the memory of a task follows the slice and not the batch. ``Hasher``
names any byte range of a slice in constant time by a polynomial over the bytes, modulo 2**64.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space that separates words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x):
    """A well-spread 64-bit value for each 64-bit value (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts_of(column):
    """A string or binary column of one batch as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column, most=1 << 19, rows=1024):
    """(first row, last row + 1, bytes, offsets into them) for slices of a batch's texts.

    The batch is laid out as bytes ``rows`` texts at a time, so that a large batch is never held twice.
    """
    for at in range(0, len(column), rows):
        data, offsets = texts_of(column.slice(at, rows))
        start, end = 0, len(offsets) - 1
        while start < end:
            stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), end)
            yield at + start, at + stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def tidy(run):
    """``run`` for ``mapInArrow``; what its task kept is given back at the end, as workers outlive their tasks."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def release():
    """Gives back what long texts left in the tables of powers, and what Arrow holds without use."""
    Hasher.powers.clear()
    pa.default_memory_pool().release_unused()


class Hasher:
    """Names byte ranges of a slice: ``Hasher(seed).load(data)``, then ``of(starts, ends)``."""

    powers = {}

    def __init__(self, seed=1):
        with np.errstate(over="ignore"):
            self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = (0x5851F42D4C957F2D * (2 * seed + 1)) | 1
        self.base %= 1 << 64

    def _powers(self, n):
        have = Hasher.powers.get(self.base)
        if have is None or len(have[0]) < n:
            size = max(1 << 20, n)
            inverse = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, self.base, U64)]))
                down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, inverse, U64)]))
            have = Hasher.powers[self.base] = (up, down)
        return have

    def load(self, data):
        n = len(data)
        up, self.down = self._powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(self.table[data] * up[:n], out=self.sums[1:])
        return self

    def of(self, starts, ends):
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, k):
        """The name of each k bytes in a row, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def words_of(data, offsets):
    """Starts and ends of the words of a slice, and the row each word stands in."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    if len(data):
        edge[0], edge[-1] = solid[0], solid[-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text also ends a word
    inner = first[:-1] & solid
    inner[1:] &= solid[:-1]
    inner[:1] = False
    begins = edge[:-1] & solid | inner
    starts = np.flatnonzero(begins)
    after = np.zeros(len(data) + 1, bool)
    after[1:] = solid & (~np.append(solid[1:], False) | first[1:])
    ends = np.flatnonzero(after)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
