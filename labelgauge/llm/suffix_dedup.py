"""Removal of byte strings that occur more than once, by distributed prefix doubling.

Positions are ranked by ever longer prefixes: the rank of a position by its first 2 h bytes is the pair of
its rank by h bytes and that of the position h bytes on. Positions whose rank occurs once leave before the
next doubling, until the prefixes reach ``length``. Not every byte is a position from the start:

1. *Chosen positions.* Of the ``length - SEED + 1`` seeds inside each string of ``length`` bytes,
   the one with the smallest hash is chosen. Equal strings choose alike, so strings can only be
   equal where their chosen positions carry equal ranks, and only about one position in 75 bytes
   has to be ranked at first, by ``SEED`` bytes. Positions whose rank occurs once leave. All strings
   that chose a position form a *stretch* of neighbouring starts.
2. *Settled stretches.* Stretches that are equal as a whole are repeated throughout and are settled,
   copy by copy, however many copies there are. Of those that share a rank but differ (the edges of
   repeated passages), one of each kind goes on.
3. *Doubling.* The kinds left are ranked at every ``STEP``-th position, counted from the chosen one, and
   compared among those of equal chosen rank and equal place. Ranks of ``SEED`` bytes pair within the
   row that holds the stretch; after that Spark drops the ranks that occur once and lays the positions of a
   stretch side by side, and what finds a partner one offset on is ranked by the pair. Offsets double up to
   what all strings that start within a step share; blocks of starts that are equal as a whole are settled.
4. *Starts.* The starts of the blocks left, one by one, pair the rank of their block with the few bytes
   around it, which makes the full ``length``.

Every string of every text takes part; no group is collected: equal ranks meet in aggregates with
partial sums and in joins whose large partitions adaptive execution can split. Ranks are 64-bit names of
their pairs; a settled string is equal in its rank and in a second name of all its bytes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored
from labelgauge.llm.textbytes import U64, Hasher, chunks, texts_of

SEED = 48
#: Bytes ranked at once; a longer text is taken in pieces that overlap by one byte less than a string.
PIECE = 1 << 22
LOW = (1 << 24) - 1

POSITIONS = "id_ long, hash_ long, lo int, hi int, at int, rank_ long, whole long"
#: Bytes between the positions that are ranked by doubling; it divides ``SEED``.
STEP = 24


def _least(keys, width):
    """The least of each ``width`` keys in a row."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(U64).max, U64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _stretches(data, offsets, length, one, two):
    """(row, first start, last start, chosen position, rank, name) of the stretches of a slice."""
    one.load(data)
    seeds = one.every(SEED)
    width = length - SEED + 1
    if len(seeds) < width:
        return None
    two.load(data)
    place = np.arange(len(seeds), dtype=U64)
    chosen = _least(seeds & ~U64(LOW) | U64(LOW) - place, width)
    chosen = (U64(LOW) - (chosen & U64(LOW))).astype(np.int64)
    change = np.zeros(len(data) + 2, np.int32)
    long_ = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(change, offsets[long_], 1)
    np.add.at(change, offsets[long_ + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[: len(chosen)]))
    if not len(starts):
        return None
    at = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo, at = starts[new], at[new]
    hi = starts[np.append(new[1:], True)]
    row = np.searchsorted(offsets, lo, "right") - 1
    return row, lo, hi, at, seeds[at], two.of(lo, hi + length)


def _pieces(column, length):
    """Slices of texts; a text beyond ``PIECE`` in overlapping pieces: (rows, shift, bytes, offsets)."""
    for start, stop, data, offsets in chunks(column):
        rows = np.arange(start, stop)
        if len(data) <= PIECE:
            yield rows, 0, data, offsets
        else:
            # a piece holds PIECE - length + 1 starts; each start lies in one piece
            for a in range(0, len(data) - length + 1, PIECE - length + 1):
                part = data[a : a + PIECE]
                yield rows, a, part, np.array([0, len(part)])


def _batch(names, columns):
    columns = [c.view(np.int64) if c.dtype == U64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _rank_positions(length):
    names = ["id_", "hash_", "lo", "hi", "at", "rank_", "whole"]

    def run(batches):
        one, two = Hasher(1), Hasher(2)
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, shift, data, offsets in _pieces(batch.column(2), length):
                found = _stretches(data, offsets, length, one, two)
                if found is None:
                    continue
                row, *places, rank, whole = found
                places = [(p + shift - offsets[row]).astype(np.int32) for p in places]
                yield _batch(names, [ids[rows[row]], hashes[rows[row]], *places, rank, whole])

    return run


def row_key(docs, text="text", id_column="doc_id"):
    """The two columns that name a row of ``docs``: its id and a hash of its text.

    Rows that agree in both have the same text, so they share every decision.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    return key.alias("id_"), F.xxhash64(F.col(text)).alias("hash_")


def _rerank(rows, shared):
    """(rows that are settled, one row of each kind that is not) of the rows whose rank recurs.

    ``shared``: a function that stores a table and reads it back.
    """
    ranks = rows.groupBy("rank_").agg(
        F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")
    )
    # stored, so that the join can be split where one rank has many rows
    ranks = shared(ranks.where("n > 1").select("rank_", (F.col("least") != F.col("most")).alias("mixed")))
    again = shared(rows.join(ranks, "rank_"))
    mixed = again.where("mixed").drop("mixed")
    one = F.struct(*[c for c in mixed.columns if c not in ("rank_", "whole")])
    kinds = mixed.groupBy("rank_", "whole").agg(F.count("*").alias("n"), F.min(one).alias("one"))
    kinds = shared(kinds)
    several = mixed.join(kinds.where("n > 1").select("rank_", "whole"), ["rank_", "whole"])
    settled = again.where("NOT mixed").drop("mixed").unionByName(several)
    return settled.select("id_", "hash_", "lo", "hi"), kinds.select("rank_", "one.*")


def _reach(length):
    """Bytes that all strings starting within a step share, from their last start on, in whole steps."""
    return (length - STEP + 1) // STEP * STEP


def _cut(start, size):
    """``size`` bytes of a stretch from a byte of its text on."""
    return f"substring(t, {start} - first + 1, {size})"


def _doubled(stretches, length, shared):
    """The blocks of starts of ``stretches`` whose shared bytes recur: lo, hi, rank_, and a name of the whole.

    Block b holds the starts from ``at - STEP * b - STEP + 1`` to ``at - STEP * b``; its position is the last.
    """
    reach, key = _reach(length), ["id_", "hash_", "first"]
    offset = min(SEED, reach - SEED)
    have = SEED + offset
    ahead = (reach - have) // STEP  # positions after the last block, for pairs with it
    first, last = f"CAST((at - hi) DIV {STEP} AS INT)", f"CAST((at - lo) DIV {STEP} AS INT)"
    rows = stretches.withColumn("b", F.explode(F.expr(f"sequence({first} - {ahead}, {last})")))
    place = f"at - {STEP} * b"
    halves = ", ".join(f"xxhash64({_cut(f'{place} + {o}', SEED)})" for o in (0, offset))
    low, top = f"greatest(lo, {place} - {STEP - 1})", f"least(hi, {place})"
    whole = _cut(low, f"{top} - {low} + {length}")
    ranks = rows.select(
        *key, "hi", "at", "b", F.expr(f"xxhash64(rank_, b, {halves})").alias("r"),
        F.expr(f"CASE WHEN b >= {first} THEN xxhash64(1, {whole}) END").alias("whole"),
    )
    while have < reach:
        offset = min(have, reach - have)
        again = shared(ranks.groupBy("r").count().where("count > 1").select("r"))
        behind = -(offset // STEP)
        beside = Window.partitionBy(*key).orderBy("b").rangeBetween(behind, behind)
        pairs = ranks.join(again, "r").withColumn("other", F.first("r").over(beside)).where("other IS NOT NULL")
        ranks = pairs.withColumn("r", F.xxhash64("r", "other")).drop("other")
        have += offset
        ranks = shared(ranks) if have < reach else ranks
    low, top = low.replace("lo,", "first,"), F.expr(top)
    return ranks.where(f"b >= {first}").select(
        *key, F.expr(low).alias("lo"), top.alias("hi"), "at", F.col("r").alias("rank_"), "whole"
    )


def _by_start(blocks, length):
    """Each start of ``blocks``: the rank of its block with the bytes before and after what that covers."""
    reach = _reach(length)
    rows = blocks.withColumn("s", F.explode(F.sequence("lo", "hi")))
    rows = rows.withColumn("place", F.expr(f"at - {STEP} * CAST((at - s) DIV {STEP} AS INT)"))
    before, after = _cut("s", "place - s"), _cut(f"place + {reach}", f"s + {length} - place - {reach}")
    return rows.select(
        "id_", "hash_", "first", F.col("s").alias("lo"), F.col("s").alias("hi"), "at",
        F.expr(f"xxhash64(rank_, place - s, concat({before}, {after}))").alias("rank_"),
        F.expr(f"xxhash64(1, {_cut('s', length)})").alias("whole"),
    )


def repeated_spans(docs, text="text", id_column="doc_id", length=200):
    """(id_, hash_, spans) of the texts that hold a string of ``length`` bytes found elsewhere.

    ``spans`` are the (start, end) byte ranges, apart from each other and in order, that such strings
    cover. Null and short texts have none. Rows that repeat a row repeat its text.
    """
    if length < 2 * SEED:
        raise ValueError(f"length must be at least {2 * SEED}")

    def shared(df):
        return stored(df, shared_dir(docs.sparkSession, "repeats"))

    narrow = docs.select(*row_key(docs, text, id_column), F.col(text).cast("string").alias("t"))
    positions = narrow.where(F.octet_length("t") >= length).mapInArrow(_rank_positions(length), POSITIONS)
    settled, kinds = _rerank(positions, shared)

    wanted = kinds.groupBy("id_", "hash_").agg(F.collect_list(F.struct("lo", "hi", "at", "rank_")).alias("wanted"))
    texts = narrow.dropDuplicates(["id_", "hash_"]).join(wanted, ["id_", "hash_"])
    cut = F.expr(f"substring(CAST(t AS BINARY), w.lo + 1, w.hi - w.lo + {length})")
    texts = texts.select("id_", "hash_", "t", F.explode("wanted").alias("w"))
    texts = shared(texts.select(
        "id_", "hash_", F.col("w.lo").alias("first"), "w.lo", "w.hi", "w.at", "w.rank_", cut.alias("t")
    ))
    more, kinds = _rerank(_doubled(texts, length, shared), shared)
    starts = kinds.join(texts.select("id_", "hash_", "first", "t"), ["id_", "hash_", "first"])
    last, _ = _rerank(_by_start(starts, length), shared)

    found = settled.unionByName(more).unionByName(last).select("id_", "hash_", "lo", F.col("hi") + length)
    spans = found.toDF("id_", "hash_", "lo", "hi").distinct().groupBy("id_", "hash_")
    return spans.agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


RESULTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}


def _keep(batches):
    # some rows at a time, so that a large batch is never held twice
    for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        data, offsets = texts_of(batch.column("t"))
        spans = batch.column("spans")
        ends = (spans.offsets.to_numpy() - spans.offsets[0].as_py()) if len(spans) else np.zeros(1, np.int32)
        lows, highs = (spans.flatten().field(i).to_pylist() for i in (0, 1))
        columns = [[], [], [], []]
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            kept, end, runs = [], 0, 0
            for j in range(ends[i], ends[i + 1]):
                if lows[j] > end or not runs:
                    kept.append(text[end : lows[j]])
                    runs += 1
                end = max(end, highs[j])
            kept = b"".join([*kept, text[end:]])
            for column, value in zip(columns, (len(text), len(text) - len(kept), runs, kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        new = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("o"), *new], ["o", *RESULTS])


def remove_repeats(docs, text="text", id_column="doc_id", length=200):
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) in place of the text.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the same text
    or another, is removed; all strings are judged on the input, so no occurrence stays. Null texts
    count as empty; rows with equal ids are told apart by their texts, rows that repeat a row repeat
    its text, an empty table gives an empty one. Other columns pass, whatever their names, but for
    those named like a result.
    """
    spans = repeated_spans(docs, text, id_column, length)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text and c not in RESULTS])
    rows = docs.select(others.alias("o"), *row_key(docs, text, id_column), F.col(text).cast("string").alias("t"))
    none = F.expr("array()").cast("array<struct<lo:int,hi:int>>")
    rows = rows.join(spans, ["id_", "hash_"], "left")
    rows = rows.select("o", "t", F.coalesce("spans", none).alias("spans"))
    kind = rows.schema["o"].dataType.simpleString()
    results = ", ".join(f"{c} {t}" for c, t in RESULTS.items())
    return rows.mapInArrow(_keep, f"o {kind}, {results}").select("o.*", *RESULTS)
