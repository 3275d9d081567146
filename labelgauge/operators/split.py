"""Seeded shuffle, samples and splits that need no global sort.

The shuffled order is the order of ``md5("seed:id")``, then the id. Where the first k rows of
that order are wanted, a *cutoff* is found instead of sorting: the rows are counted by the first
hex digits of their hash (a fixed number of buckets, evenly filled whatever the ids are), the
running total names the bucket in which row k falls, and only that bucket is ranked. The rows
are then kept or labelled by one comparison each. Only the id column is read to find a cutoff,
the other columns are never shuffled, and k may be anything up to all rows.
"""

from typing import NamedTuple

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.operators.select import FEW, Cut, cut, take_first
from labelgauge.sources.writers import stored

# 16 ** 4 buckets: a running total over 65,536 rows, and one bucket in 65,536 to rank.
BUCKET_DIGITS = 4


def shuffle_key(id_col, seed=42):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def shuffled(df, id_col="id", seed=42):
    """The whole table in seeded order, from the first row of the first partition on.

    The hash is evenly spread, so its leading digits name the partition. A sort would read the
    table once more to find partition bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", shuffle_key(id_col, seed))
    share = F.expr(f"int(shiftright(bigint(conv(left(_key, 8), 16, 10)) * {n}, 32))")
    keyed = keyed.repartitionById(n, share)
    return keyed.sortWithinPartitions("_key", id_col).drop("_key")


def _position(id_col, seed):
    return F.struct(shuffle_key(id_col, seed).alias("h"), F.col(id_col).alias("i"))


def _edges(keys, targets, by=()):
    """The position of row k per target, as rows ``*by, mark, at``.

    ``keys`` has the columns ``*by, at``. ``targets`` gives ``{mark: f(n, least)}``, f taking the
    number of rows (of the group) and that of the smallest group and giving a count column. A
    count of zero has no position, one beyond n has that of the last row.
    """
    # Never null, so that the join below needs no null check that would hash every id again.
    bucket = F.coalesce(F.substring("at.h", 1, BUCKET_DIGITS), F.lit(""))
    keys = keys.withColumn("bucket", bucket)
    counts = keys.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*by)
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(
        "*", F.sum("c").over(running).alias("high"), F.sum("c").over(group).alias("n")
    ).withColumn("least", F.min("n").over(Window.partitionBy()))
    n = F.col("n")
    marks = F.array(
        *[
            F.struct(
                F.lit(mark).alias("mark"),
                F.least(n, f(n, F.col("least"))).cast("long").alias("k"),
            )
            for mark, f in targets.items()
        ]
    )
    marks = (
        counts.select(*by, "bucket", "c", "high", F.inline(marks))
        .where((F.col("k") <= F.col("high")) & (F.col("k") > F.col("high") - F.col("c")))
        .select(*by, "bucket", "mark", (F.col("k") - F.col("high") + F.col("c")).alias("nth"))
    )
    # One row per target and group at most, so the broadcast does not grow with the data.
    within = Window.partitionBy(*by, "mark", "bucket").orderBy("at")
    return (
        keys.join(F.broadcast(marks), [*by, "bucket"])
        .withColumn("rank", F.row_number().over(within))
        .where("rank = nth")
        .select(*by, "mark", "at")
    )


def _cutoffs(df, id_col, seed, targets):
    """A scalar struct with the position of row k per target."""
    edges = _edges(df.select(_position(id_col, seed).alias("at")), targets)
    at = [F.max(F.when(F.col("mark") == m, F.col("at"))).alias(m) for m in targets]
    return edges.agg(F.struct(*at)).scalar()


def sample_n(df, n, id_col="id", seed=42):
    """A seeded sample of n rows, the whole table when it has no more."""
    cut = _cutoffs(df, id_col, seed, {"end": lambda total, _: F.lit(n)})
    return df.where(_position(id_col, seed) <= cut["end"])


def train_val_split(df, train, val, id_col="id", seed=42, fallback=False):
    """The first ``train`` rows of the shuffled order, then the next ``val``; column ``split``.

    With ``fallback``, a table with fewer rows than asked for is split 70 % / rest instead.
    """

    def short(total):
        return (total < train + val) if fallback else F.lit(False)

    cut = _cutoffs(
        df,
        id_col,
        seed,
        {
            "train": lambda total, _: F.when(
                short(total), F.floor(total * F.lit(0.7))
            ).otherwise(train),
            "val": lambda total, _: F.when(short(total), total).otherwise(train + val),
        },
    )
    at = _position(id_col, seed)
    split = F.when(at <= cut["train"], "train").when(at <= cut["val"], "val")
    return df.withColumn("split", split).where("split is not null")


def holdout_split(df, test_size, id_col="id", seed=42):
    """``test_size`` seeded rows as 'test', all others as 'train'."""
    cut = _cutoffs(df, id_col, seed, {"test": lambda total, _: F.lit(test_size)})
    is_test = F.coalesce(_position(id_col, seed) <= cut["test"], F.lit(False))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def balanced(df, label_col="label", id_col="id", classes=None, seed=42):
    """Every class cut down to the size of the smallest, by seeded choice.

    The classes are the label's values, or those of them in ``classes``; rows without a class are left
    out. Each class has its cutoff at hand as an entry of one constant map. There is no join on the
    label, so a class holding most rows stays spread over all tasks.
    """
    label = F.col(label_col)
    wanted = label.isNotNull() if classes is None else label.isin(*classes)
    keys = df.where(wanted).select(label.alias("class"), _position(id_col, seed).alias("at"))
    edges = _edges(keys, {"end": lambda _, least: least}, by=["class"])
    cut = edges.agg(F.map_from_entries(F.collect_list(F.struct("class", "at")))).scalar()
    return df.where(wanted).where(_position(id_col, seed) <= F.try_element_at(cut, label))


def _limited(df, order, k, few):
    """The first k rows: by the cutoff of the k least keys while k is small, by range histograms beyond."""
    if k > few:
        return take_first(df, order, k, few).orderBy(*order)
    at = F.struct(*order)
    last = df.select(at.alias("at")).orderBy("at").limit(k).agg(F.max("at")).scalar()
    return df.where(at <= last).orderBy(*order).limit(k)


def first_k(df, k, id_col="id", then=(), few=FEW):
    """The k rows with the lowest ids, equal ids by the columns ``then``; null ids come first.

    Up to ``few`` rows the cutoff id comes from the k least keys, and is pushed to the scan; rows beyond k
    that share it are cut off last. Beyond, it is found by range histograms, and nothing meets in one task.
    """
    order = [F.col(id_col), *map(F.col, then)]
    if k > few:
        return take_first(df, order, k, few).orderBy(*order)
    last = df.select(id_col, *then).orderBy(id_col, *then).limit(k).agg(F.max(id_col)).scalar()
    return df.where((F.col(id_col) <= last) | F.col(id_col).isNull()).orderBy(id_col, *then).limit(k)


def lowest_k(df, k, score, id_col="id", few=FEW):
    """The k rows with the lowest score, equal scores by id; texts are not carried to the choice.

    Null scores and null ids come first. Any k, as in ``first_k``.
    """
    return _limited(df, [score, F.col(id_col)], k, few)


def demonstrations(df, k, score, threshold, id_col="id", few=FEW):
    """Up to k rows whose score reaches the threshold, in id order."""
    return first_k(df.where(score >= threshold), k, id_col, few=few)


class Draw(NamedTuple):
    """A named draw of ``size`` rows in the order of a seeded hash (of the id where ``seed`` is None).

    ``of`` names the draw it is taken from (all rows if None), ``beyond`` names draws whose rows are passed over.
    """

    name: str
    size: int
    seed: int | None = 42
    of: str | None = None
    beyond: tuple = ()


def draws(df, plan, id_col="id", path=None, few=FEW):
    """``df`` with ``draws``: the names of the draws of ``plan`` that a row is in, in the order of the plan.

    Draws may be nested and follow each other to any depth. All are settled on one narrow table of the ids
    and their hash per seed (stored at ``path`` if given), each by the place of its last row; a row is
    then told by comparing its own hashes with those constant places. So ``df`` is read once, whatever
    the number of draws, and nothing of it is shuffled. Ids must be unique; where there are fewer rows than
    asked for, a draw holds what there is.
    """
    seeds = sorted({d.seed for d in plan if d.seed is not None})
    place = {s: (F.conv(F.left(shuffle_key(id_col, s), F.lit(15)), 16, 10).cast("long"), shuffle_key(id_col, s)) for s in seeds}
    hashes = [c.alias(f"{n}{s}") for s in seeds for n, c in zip("hm", place[s])]
    keys = stored(df.select(F.col(id_col).alias("i"), *hashes), path)
    holds, known = {}, {}
    for d in plan:
        orders = [[F.col(f"h{d.seed}"), F.col(f"m{d.seed}"), F.col("i")], [*place.get(d.seed, ()), F.col(id_col)]]
        narrow, own = (o[-1:] if d.seed is None else o for o in orders)
        found = cut(keys.where(_inside(known, d)), narrow, d.size, few)
        if found is None:  # no rows are wanted, or all there are
            first = wide = F.lit(d.size > 0)
        else:
            first, wide = found.first(), Cut(own, found.values, found.taken, found.ties).first()
        known[d.name], holds[d.name] = _inside(known, d) & first, _inside(holds, d) & wide
    names = [F.when(holds[d.name], d.name) for d in plan]
    return df.withColumn("draws", F.array_compact(F.array(*names)))


def _inside(known, draw):
    """The condition for the rows that a draw is taken from."""
    out = F.lit(True) if draw.of is None else known[draw.of]
    for name in draw.beyond:
        out = out & ~known[name]
    return out
