"""The first k rows of any order, exactly, for any k, without a sort.

``cut`` finds row k of an order by range histograms: one pass counts the rows of the range by ``BUCKETS``
equal parts of it, and the part that holds row k is the next range, until it holds one value or few rows.
The columns of the order are settled one after the other, each among the rows that equal the values found
so far. Every pass reads the order's columns only, shuffles one row per part and task, and sends at most
``BUCKETS`` rows to the driver. What comes out is a comparison with constant values, which the
scan can use; rows are neither sorted nor gathered. Rows that equal the last one in all columns are
numbered in two levels where only some of them belong to the first k.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a range counted in one pass; rows of a range that are ranked as they are.
BUCKETS, FEW = 4096, 65_536
#: Groups that equal rows are dealt to when they are numbered.
SALTS = 64


def numbered(df, key, name):
    """``df`` with a number from 1 among the rows of equal ``key`` (a column of it), which must not be null.

    Equal rows are dealt to ``SALTS`` groups and counted per (key, group); a running total of the counts
    starts each group's numbers. Only keys that occur more than once are numbered, as narrow rows that then
    meet the table by their place in it, so no task holds all rows of one key and no other column is in a
    window. The places are those of the scan: store a table first that comes out in another order each time.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    narrow = placed.select(F.col(key).alias("_k"), "_place", F.pmod("_place", F.lit(SALTS)).alias("_salt"))
    group = Window.partitionBy("_k")
    before = group.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.groupBy("_k", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    starts = starts.select("_k", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"), F.sum("_c").over(group).alias("_n"))
    within = Window.partitionBy("_k", "_salt").orderBy("_place")
    repeated = narrow.join(starts.where("_n > 1"), ["_k", "_salt"])
    repeated = repeated.select("_place", (F.col("_first") + F.row_number().over(within)).alias("_nth"))
    out = placed.join(repeated, "_place", "left")
    return out.withColumn(name, F.coalesce("_nth", F.lit(1)).cast("long")).drop("_place", "_nth")


def _whole(column, kind):
    """A column of whole numbers, dates or truth values as exact numbers in the same order."""
    column = F.unix_date(column) if isinstance(kind, T.DateType) else column.cast("long")
    return column.cast("decimal(38,0)")


def _whole_value(value, kind):
    """A value of such a column as the number that ``_whole`` makes of it."""
    return value.toordinal() - 719_163 if isinstance(kind, T.DateType) else int(value)


def _part(column, kind, low, high):
    """The part of the range from low to high that a value lies in: a number or text in the same order."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        x = column.cast("double")
        a, b = float(low), float(high)
        finite = [v for v in (a, b) if math.isfinite(v)]
        a, b = (finite[0], finite[-1]) if len(finite) == 2 else (-1.7e308, 1.7e308)
        share = (x / 2 - a / 2) / (b / 2 - a / 2) * BUCKETS if b > a else F.lit(0.0)
        inner = F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(BUCKETS - 1))
        odd = F.when(F.isnan(x), BUCKETS + 1).when(x == float("inf"), BUCKETS).when(x == float("-inf"), -1)
        return odd.otherwise(inner).cast("long")
    if isinstance(kind, T.StringType):
        # two bytes beyond what the least and the greatest value share
        a, b = (v.encode().hex().upper() for v in (low, high))
        same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        return F.substring(F.hex(column), 1, same // 2 * 2 + 4)
    a, b = _whole_value(low, kind), _whole_value(high, kind)
    width = max(1, -(-(b - a + 1) // BUCKETS))
    return F.floor((_whole(column, kind) - F.lit(a).cast("decimal(38,0)")) / F.lit(width)).cast("long")


def _equals(column, value):
    if value is None:
        return column.isNull()
    return F.isnan(column) if value != value else column == F.lit(value)


def _at_most(column, value):
    return column.isNotNull() if value != value else column <= F.lit(value)


def _value(rows, name, kind, k, few):
    """(value of row k, rows before it, rows that have it) of a column, nulls first."""
    c = F.col(name)
    if isinstance(kind, T.TimestampType):  # as a number, so that no time zone meddles
        rows, kind = rows.withColumn(name, F.unix_micros(c)), T.LongType()
    seen = rows.agg(F.count(F.lit(1)), F.count(c), F.min(c), F.max(c)).first()
    n, known, low, high = seen
    if k <= n - known:
        return None, 0, n - known
    below, count = n - known, known
    while True:
        if low == high or (low != low and high != high):
            return low, below, count
        within = rows.where((c >= F.lit(low)) & _at_most(c, high))
        part = None if count <= few else _part(c, kind, low, high)
        if part is None:
            counts = within.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("c"))
            running = F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("v"))
            found = counts.withColumn("upto", running).where(F.col("upto") >= k - below).orderBy("upto").limit(1).first()
            return found["v"], below + found["upto"] - found["c"], found["c"]
        parts = within.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min(c).alias("a"), F.max(c).alias("b")).orderBy("p").collect()
        if len(parts) == 1:
            few = count  # values that no part tells apart
        for p in parts:
            if below + p["c"] >= k:
                low, high, count = p["a"], p["b"], p["c"]
                break
            below += p["c"]


class Cut:
    """The place of row k in an order: ``values`` of its columns; ``first`` tells rows before or at it."""

    def __init__(self, columns, values, taken, ties):
        self.columns, self.values, self.taken, self.ties = columns, values, taken, ties

    @property
    def whole(self):
        """Whether all rows with the values of row k are among the first k."""
        return self.taken == self.ties

    def _from(self, i):
        c, v = self.columns[i], self.values[i]
        last = i == len(self.values) - 1
        rest = F.lit(self.whole) if last else self._from(i + 1)
        if v is None:
            return c.isNull() & rest
        if last and self.whole:
            return c.isNull() | _at_most(c, v)
        return c.isNull() | (_at_most(c, v) & (~_equals(c, v) | rest))

    def first(self):
        """True for the rows before row k, and for those that equal it if all of them are taken."""
        return F.coalesce(self._from(0), F.lit(False)) if self.values else F.lit(self.whole)

    def at(self):
        """True for the rows that equal row k in the whole order."""
        out = F.lit(True)
        for c, v in zip(self.columns, self.values):
            out = out & F.coalesce(_equals(c, v), F.lit(False))
        return out


def cut(df, order, k, few=FEW):
    """The place of row k (from 1) in the ascending ``order``, a list of columns, nulls first; None beyond the end."""
    plain = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows, kinds, values, need = plain, [f.dataType for f in plain.schema], [], k
    equal = None
    columns = [F.unix_micros(c) if isinstance(t, T.TimestampType) else c for c, t in zip(order, kinds)]
    if k < 1 or rows.count() < k:
        return None
    for i, kind in enumerate(kinds):
        value, below, equal = _value(rows, f"k{i}", kind, need, few)
        values.append(value)
        need -= below
        if need == equal:
            break
        here = F.unix_micros(f"k{i}") if isinstance(kind, T.TimestampType) else F.col(f"k{i}")
        rows = rows.where(_equals(here, value))
    return Cut(columns, values, need, equal)


def take_first(df, order, k, few=FEW):
    """The first k rows of the ascending ``order`` (a list of columns), nulls first; all rows when there are no more.

    Exactly k rows come out. Which of the rows that are equal in the whole order stay is open.
    """
    if k < 1:
        return df.where(F.lit(False))
    found = cut(df, order, k, few)
    if found is None:
        return df
    kept = df.where(found.first())
    if found.whole:
        return kept
    tied = numbered(df.where(found.at()).withColumn("_tie", F.lit(0)), "_tie", "_number")
    return kept.unionByName(tied.where(F.col("_number") <= found.taken).drop("_tie", "_number"))
