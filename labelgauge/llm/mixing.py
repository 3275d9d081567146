"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

The rows of a source, in a seeded order, form blocks of equal size. With the target weight w, block i
of a source (from 1) is released at slot floor((i - 1) / w) and due at slot ceil(i / w); of the released
blocks, the one with the earliest deadline takes the slot (ties by name). So every source has, at
every slot, less than one block more or less than its weight asks for.

That choice is worked out period by period, all periods at the same time. A block that is open at a slot
was released at most 1 / w slots, rounded up, and one before; blocks released earlier are done by then.
So a period is a row of its own, which folds over its slots and the ``reach`` slots before (``reach``: that
number for the smallest weight). The blocks released before these slots and not done yet are known by
number; they take the first of these slots, whichever they are. Then the same blocks are open at the start
of the period as in one run from slot 0: those that are due are done, and of the others, the earliest
deadlines that their releases let in, as many as slots are left.

The mix ends at the first slot whose block its source does not have. Up to there every slot holds a block
of the data, so the slots worked out are no more than the blocks (and one per source), however small a
weight is. The blocks that are left follow by their exact deadlines i / w without gaps; the slot of each is
a count of the earlier deadlines of all sources, in closed form from its own number, with no schedule.
No row is dropped or repeated.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

PERIOD = 1000
#: Weights are whole parts of about so many.
PARTS = 1 << 40
#: Hash buckets of a source within which rows are numbered; the bucket's start comes from the counts.
BUCKETS = 4096


def period_shares(weights, period=PERIOD):
    """(source, share, place): whole slots of a period for each source, by largest remainders.

    ``weights``: columns source and weight. Sources with a weight above 0 have one slot at least; null,
    negative and repeated weights count as 0 or are added up. At most ``period`` sources fit.
    """
    some = weights.groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"))
    some = some.where("w > 0")
    sums = some.agg(F.sum("w").alias("whole"), F.count("*").alias("n"))
    free = F.lit(period) - sums.select("n").scalar()
    fits = F.assert_true(sums.select("n").scalar() <= period, F.lit(f"more sources than the {period} slots of a period"))
    part = some.select("source", (F.col("w") / sums.select("whole").scalar() * free).alias("x"), fits.alias("fits"))
    part = part.where("fits IS NULL").select("source", "x", F.floor("x").alias("f"))
    left = F.lit(period) - part.agg(F.sum(F.col("f") + 1)).scalar()
    order = Window.orderBy((F.col("x") - F.col("f")).desc(), "source")
    shares = part.withColumn("extra", (F.row_number().over(order) <= left).cast("long"))
    shares = shares.select("source", (F.col("f") + 1 + F.col("extra")).alias("share"))
    return shares.withColumn("place", F.row_number().over(Window.orderBy("source")) - 1)


def exact_shares(weights):
    """(source, share, place): the weights as whole parts of their sum, which is ``PARTS`` but for rounding.

    ``weights`` as in ``period_shares``; any number of sources. A source has one part at least.
    """
    some = weights.groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"))
    some = some.where("w > 0")
    part = F.round(F.col("w") / some.agg(F.sum("w")).scalar() * PARTS).cast("long")
    shares = some.select("source", F.greatest(part, F.lit(1).cast("long")).alias("share"))
    return shares.withColumn("place", F.row_number().over(Window.orderBy("source")) - 1)


def schedule(shares, period=PERIOD):
    """(source, share, kth, slot): which slot of a period the k-th block of each source takes.

    For shares that are whole slots of the period, so that the schedule repeats after it.
    """
    return _slots(shares.withColumn("blocks", F.col("share") - 1), F.lit(period), period)


def _slots(shares, until, period=PERIOD):
    """(source, share, kth, slot): the slots of blocks 0 to ``blocks`` of each source, before slot ``until``.

    ``shares``: source, share, place and blocks (null counts as 0); the weight is the share of their sum.
    ``until``: a column over ``shares`` as a whole.
    """
    spark = shares.sparkSession
    names = F.sort_array(F.collect_list(F.struct("place", "source", "share", F.coalesce("blocks", F.lit(0)).alias("blocks"))))
    row = shares.agg(F.coalesce(names, F.array()).alias("s"), F.sum("share").alias("whole"), until.cast("long").alias("until"))
    row = row.where("whole > 0").withColumn("reach", F.expr("(whole + array_min(s.share) - 1) DIV array_min(s.share) + 1"))
    row = row.withColumn("size", F.greatest("reach", F.lit(period).cast("long")))
    rows = row.withColumn("k", F.explode(F.expr("sequence(0, greatest((until + size - 1) DIV size, 1) - 1)")))
    # a fixed number of partitions: the rows are few and small, the work is in the fold
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    rows = rows.withColumn("start", F.expr("greatest(k * size - reach, 0L)"))
    # the first block released at start or later, and by how many parts of a slot it is released after it
    late = "CAST(pmod(-CAST(start AS DECIMAL(19,0)) * x.share, CAST(whole AS DECIMAL(19,0))) AS BIGINT)"
    had = "CAST((CAST(start AS DECIMAL(19,0)) * x.share + late) DIV whole AS BIGINT)"
    rows = rows.withColumn("own", F.expr(f"""transform(s, x -> aggregate(array({late}), named_struct('share', x.share, 'late', 0L, 'had', 0L),
      (st, late) -> named_struct('share', x.share, 'late', late, 'had', {had})))"""))
    rows = rows.withColumn("idle", F.expr("aggregate(own, -start, (n, x) -> n + x.had)"))
    rows = rows.withColumn("last", F.expr("least((k + 1) * size, until) - start"))
    found = f"""transform(filter({_fold()}, t -> start + t.slot >= k * size AND own[t.i].had + t.kth <= s[t.i].blocks),
        t -> named_struct('source', s[t.i].source, 'share', s[t.i].share, 'kth', own[t.i].had + t.kth, 'slot', start + t.slot))"""
    return rows.select(F.expr(f"inline({found})"))


def _fold():
    """The fold over slots 0 to ``last`` (from ``start``): who took each, as (slot, i, kth), both from the start.

    Block k (from 0) of ``own[i]`` is released (late + k * whole) / share slots after the start, rounded
    down, and due (late + (k + 1) * whole) / share slots after it, rounded up. The first ``idle`` slots go to
    blocks released before the start. Slots are taken in stretches of a hundred, so that what is added to
    stays short.
    """
    pick = """array_min(transform(
      filter(sequence(0, size(own) - 1),
        i -> t >= idle AND (own[i].late + st.done[i] * whole) DIV own[i].share <= t),
      i -> named_struct('due', (own[i].late + (st.done[i] + 1) * whole + own[i].share - 1) DIV own[i].share,
        'i', i, 'kth', st.done[i])))"""
    step = f"""aggregate(array({pick}), st, (old, p) -> IF(p IS NULL, old, named_struct(
        'done', transform(old.done, (d, i) -> IF(i = p.i, d + 1, d)),
        'taken', concat(old.taken, array(named_struct('slot', t, 'i', p.i, 'kth', p.kth))))))"""
    none = "CAST(array() AS ARRAY<STRUCT<slot: BIGINT, i: INT, kth: BIGINT>>)"
    stretch = f"""aggregate(sequence(b * 100L, least(b * 100L + 100, last) - 1),
        named_struct('done', whole_.done, 'taken', {none}), (st, t) -> {step})"""
    return f"""flatten(aggregate(IF(last < 1, CAST(array() AS ARRAY<BIGINT>), sequence(0L, (last - 1) DIV 100)),
      named_struct('done', transform(own, x -> 0L), 'all', CAST(array() AS ARRAY<ARRAY<STRUCT<slot: BIGINT, i: INT, kth: BIGINT>>>)),
      (whole_, b) -> aggregate(array({stretch}), whole_, (old, p) -> named_struct(
        'done', p.done, 'all', concat(old.all, array(p.taken))))).all)"""


def mix(docs, weights, source="source", order=("doc_id", "text"), block=8, period=None, seed=0):
    """``docs`` with ``slot`` (long, of its block), ``place`` (long, in the block) and ``in_mix``.

    Sorted by slot and place, every start of the result within ``in_mix`` holds the sources by weight, to less
    than one block; ``in_mix`` marks the rows before the first slot that a source could not fill. After it
    the rows that are left follow by deadline. Rows of sources without a weight above 0 have no slot (null)
    and are not in the mix; a null source is a source like any other. Within a source, rows follow the
    md5 of the seed and the ``order`` columns (equal rows in any order, as they are equal). No row is dropped.
    Columns named like a result are replaced; all others are kept whatever their names. With a ``period``,
    the weights are first rounded to whole slots of it, and what is said here holds for the rounded weights.
    """
    results = ("slot", "place", "in_mix")
    name = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), *[name(c) for c in order]))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    rows = docs.select(F.struct(*others).alias("o"), name(source).alias("source"), rank.alias("rank_"))
    rows = rows.withColumn("bucket", F.conv(F.substring("rank_", 1, 3), 16, 10).cast("int"))
    named = weights.select(name("source").alias("source"), F.col("weight").cast("double").alias("weight"))
    narrow = docs.select(name(source).alias("source"), rank.alias("rank_"))
    counts = narrow.groupBy("source", F.conv(F.substring("rank_", 1, 3), 16, 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket")
    counts = counts.withColumn("before", F.sum("n").over(ahead) - F.col("n"))
    shares = period_shares(named, period) if period else exact_shares(named)
    sizes = counts.groupBy("source").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    shares = shares.join(sizes, "source", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    # up to the slot by which a source lacks a block
    whole = F.sum("share").cast("decimal(19,0)")
    due = F.ceil((F.col("blocks") + 1).cast("decimal(19,0)") * shares.agg(whole).scalar() / F.col("share"))
    slots = _slots(shares, F.min(due), period or PERIOD)
    slots = stored(slots.join(sizes, "source", "left"), shared_dir(docs.sparkSession, "mix"))
    end = slots.where("kth = coalesce(blocks, 0)").agg(F.min("slot").alias("end")).scalar()
    slots = slots.where(F.col("slot") < end)
    done = slots.groupBy("source").agg(F.count("*").alias("done"))
    each = shares.join(done, "source", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    each = each.agg(F.collect_list(F.struct("source", "place", "share", "blocks", "done"))).scalar()
    inside = Window.partitionBy("source", "bucket").orderBy("rank_")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1).join(
        counts.select("source", "bucket", "before"), ["source", "bucket"]
    )
    numbered = numbered.withColumn("nth", F.col("nth") + F.col("before"))
    numbered = numbered.withColumn("block_", F.floor(F.col("nth") / block))
    slots = slots.select("source", F.col("kth").alias("block_"), "slot")
    placed = numbered.join(slots.hint("merge"), ["source", "block_"], "left")
    placed = placed.withColumns({"end": end, "each": each})
    own = F.get(F.filter("each", lambda x: x["source"] == F.col("source")), F.lit(0))
    placed = placed.withColumn("own", F.when(F.col("slot").isNull(), own))
    later = F.when(F.col("own").isNotNull(), F.col("end") + F.aggregate("each", F.lit(0).cast("long"), _earlier))
    placed = placed.select("o", F.coalesce("slot", later).alias("slot"), (F.col("nth") % block).cast("long").alias("place"), "end")
    placed = placed.withColumn("in_mix", F.coalesce(F.col("slot") < F.col("end"), F.lit(False)))
    return placed.select("o.*", "slot", F.when(F.col("slot").isNotNull(), F.col("place")).alias("place"), "in_mix")


def _earlier(count, x):
    """``count`` and the blocks of source x that are left and due before block ``block_`` of the source ``own``.

    Block i of x comes before when i / x.share is less than (block_ + 1) / own.share, on ties by place.
    """
    own = F.col("own")
    at = (F.col("block_") + 1).cast("decimal(19,0)") * x["share"]
    all_ = at > (x["blocks"] + 1).cast("decimal(19,0)") * own["share"]
    tie = F.when(x["place"] < own["place"], 0).otherwise(1)
    some = F.call_function("div", at - tie, own["share"].cast("decimal(19,0)")).cast("long")
    return count + F.greatest(F.when(all_, x["blocks"]).otherwise(F.least(x["blocks"], some)) - x["done"], F.lit(0))


def root_weights(docs, source="source"):
    """(source, weight): the square root of the rows of each source, which lifts small sources."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sqrt(F.count("*").cast(T.DoubleType())).alias("weight"))
