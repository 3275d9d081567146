"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

A text is the weighted set of its runs of five words, each weighted by how often it occurs. Darts
are thrown at the plane of weight and rank: hashing alone decides which darts fall into the region
of a run (as wide as its weight, up to a rank bound that depends on the total weight only), and the
dart of the lowest rank at each of ``COORDINATES`` coordinates makes up the signature. Two texts
agree at a coordinate with the probability of their weighted Jaccard similarity, and the work grows
with the length of the text plus the darts, not with their product.

Texts of equal words are one class from the start. Classes that agree in one of ``BANDS`` bands (five
coordinates each; a pair at 0.8 is missed once in 2,700) are candidates, verified by exact similarity:

1. Each text goes to the least member of all its buckets, its centre. The texts of a centre meet in blocks
   of bounded size, each with the centre, so a bucket of many copies costs its size and not its square.
2. What these links join is one class already. Only buckets that still hold texts of several classes, and
   whose texts have not all met in one block, go on: every text outside the largest class of its bucket
   meets all others of the bucket, block by block. Buckets of the same texts are taken once.

The classes are the components of the links found. No link between candidates of different classes is lost
to a cap, and the work beyond the first step grows with the texts that stay apart from their bucket.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelgauge.llm.components import components
from labelgauge.llm.suffix_dedup import row_key
from labelgauge.llm.textbytes import U64, Hasher, chunks, mix, release, tidy, words_of
from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

WORDS = 5
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS
#: Verified together: so many texts, or so many bytes of them.
BLOCK_TEXTS, BLOCK_BYTES = 400, 4 << 20
STEP = U64(0x9E3779B97F4A7C15)
#: Rank cells: narrow ones first, then of height one.
CELLS = [(0.0, 0.125), (0.125, 0.125), (0.25, 0.25), (0.5, 0.5)]


def _poisson(height):
    """Cumulated probabilities of 0, 1, 2 ... darts in a cell of this height."""
    steps = np.concatenate([[1.0], height / np.arange(1, 24)])
    return np.cumsum(np.exp(-height) * np.cumprod(steps))


CUTS = {h: _poisson(h) for h in (0.125, 0.25, 0.5, 1.0)}


def strips(runs):
    """The unit strips of a weighted set: the n-th copy of an element is a strip of its own."""
    runs = np.sort(runs)
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    copy = np.arange(len(runs)) - first
    return np.where(copy > 0, mix(runs + copy.astype(U64) * STEP), runs)


def signature(strip, coordinates=COORDINATES):
    """The DartMinHash signature of a set of strips, which must not be empty."""
    need = coordinates * (np.log(coordinates) + 2) / len(strip)
    values = np.zeros(coordinates, U64)
    best = np.full(coordinates, np.inf)
    cell, top = 0, 0.0
    while cell == 0 or not np.isfinite(best).all():
        while True:
            low, height = CELLS[cell] if cell < len(CELLS) else (float(cell - len(CELLS) + 1), 1.0)
            seed = mix(strip + U64(cell + 1) * U64(0xD1342543DE82EF95))
            count = np.searchsorted(CUTS[height], (seed >> U64(11)) * 2.0**-53, "right")
            dart = np.repeat(seed, count)
            nth = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(dart + (nth.astype(U64) + U64(1)) * STEP)
            rank = low + height * ((dart >> U64(11)) * 2.0**-53)
            at = (mix(dart) % U64(coordinates)).astype(np.int64)
            order = np.argsort(-rank, kind="stable")
            first = np.full(coordinates, np.inf)
            first[at[order]] = rank[order]
            name = np.zeros(coordinates, U64)
            name[at[order]] = dart[order]
            earlier = first < best
            best[earlier], values[earlier] = first[earlier], name[earlier]
            cell, top = cell + 1, low + height
            if top >= need:
                break
    return values


def bands_of(values):
    """One name for each band of a signature."""
    rows = values.reshape(BANDS, ROWS)
    name = np.arange(1, BANDS + 1, dtype=U64)
    for i in range(ROWS):
        name = mix(name * STEP + rows[:, i])
    return name


def runs_of(names, first):
    """Names of the runs of words of one text, from the names of its words; a short text is one run."""
    width = min(WORDS, len(names))
    n = len(names) - width + 1
    run = np.full(n, U64(width))
    for i in range(width):
        run = mix(run * STEP + names[i : i + n])
    return run


def _texts(column, one, two):
    """(row, names of its words, name of the whole by two hashes) of each text of a batch."""
    for start, stop, data, offsets in chunks(column):
        begins, ends, rows = words_of(data, offsets)
        one.load(data)
        two.load(data)
        names, others = one.of(begins, ends), two.of(begins, ends)
        cuts = np.searchsorted(rows, np.arange(stop - start + 1))
        place = np.arange(len(names), dtype=U64)
        own = (place - cuts[rows].astype(U64)) if len(rows) else place
        spread = np.concatenate([[U64(0)], np.cumsum(mix(names + own * STEP))])
        also = np.concatenate([[U64(0)], np.cumsum(mix(others + own * U64(0xD1342543DE82EF95)))])
        for i in range(stop - start):
            a, b = cuts[i], cuts[i + 1]
            yield start + i, names[a:b], spread[b] - spread[a], also[b] - also[a]


SIGNED = "id_ long, hash_ long, w1 long, w2 long, n_bytes long, bands array<long>"


def _sign(batches):
    one, two = Hasher(5), Hasher(6)
    known = {}
    for batch in batches:
        ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sizes = batch.column(3).to_numpy(zero_copy_only=False)
        w1, w2, bands = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [None] * len(ids)
        with np.errstate(over="ignore"):
            for row, names, a, b in _texts(batch.column(2), one, two):
                if not len(names):  # nothing to compare: a class of its own
                    w1[row], w2[row], bands[row] = ids[row], hashes[row], []
                    continue
                w1[row], w2[row] = np.array([a, b], U64).view(np.int64)
                key = (int(a), int(b))
                if key not in known:
                    if len(known) >= 4096:  # copies of a text often stand close together
                        known.clear()
                    few = len(names) < WORDS
                    known[key] = [] if few else bands_of(signature(strips(runs_of(names, 0)))).view(np.int64)
                bands[row] = known[key]
        columns = [ids, hashes, w1, w2, sizes]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(bands, pa.list_(pa.int64()))],
            ["id_", "hash_", "w1", "w2", "n_bytes", "bands"],
        )


def links(sets, least, probe=None):
    """A spanning forest (x, y) of the pairs of sets with a Jaccard similarity of ``least``.

    With ``probe`` (truth values), only pairs with such a set are looked at.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    posting, ends = owner[order], np.cumsum(counts)
    begins = ends - counts
    parent = np.arange(len(sets))
    cuts = np.cumsum(sizes) - sizes
    out = []
    for x in range(len(sets)) if probe is None else np.flatnonzero(probe):
        items = inverse[cuts[x] : cuts[x] + sizes[x]]
        items = items[counts[items] > 1]
        length = counts[items]
        at = np.arange(length.sum()) + np.repeat(begins[items] - (np.cumsum(length) - length), length)
        common = np.bincount(posting[at], minlength=len(sets))
        near = np.flatnonzero(common >= least * (sizes + sizes[x] - common) - 1e-9)
        for y in near[near > x] if probe is None else near:
            a, b = parent[x], parent[y]
            if a != b:
                parent[parent == b] = a
                out.append((x, y))
    return out


def _verify(least):
    """The links within a block of texts (columns node, t, probe); blocks without any probe compare all pairs."""

    def run(table):
        one, two = Hasher(5), Hasher(6)
        table = table.combine_chunks()
        sets = [None] * table.num_rows
        with np.errstate(over="ignore"):
            for row, names, _, _ in _texts(table.column("t"), one, two):
                sets[row] = strips(runs_of(names, 0))
        probe = np.array(table.column("probe").to_pylist(), bool)
        pairs = np.array(links(sets, least, probe if probe.any() else None), np.int64).reshape(-1, 2)
        node = table.column("node").combine_chunks()
        if len(one.sums) > 1 << 20:  # tables for texts of such a length are not worth keeping
            release()
        return pa.table({"a": node.take(pairs[:, 0]), "b": node.take(pairs[:, 1])})

    return run


def _blocks(rows, *group):
    """(group, blocks): how many blocks of bounded size the rows (with their bytes in n) of a group make."""
    return rows.groupBy(*group).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_BYTES)).alias("blocks")
    )


def _star_blocks(stars, kinds, shared):
    """(a, c, k): each text with its centre c and its block k of the centre's texts, and c itself in every block."""
    own = stars.groupBy("a").agg(F.min("b").alias("c")).where("a <> c").join(kinds.select(F.col("node").alias("a"), "n"), "a")
    own = shared(own)
    # stored, so that the join that follows can be split where one centre has many texts
    sizes = shared(_blocks(own, "c"))
    blocks = own.join(sizes, "c").select("a", "c", F.pmod(F.xxhash64("a"), "blocks").alias("k"))
    centres = sizes.select(F.col("c").alias("a"), "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    return shared(blocks), centres


def _apart(stars, blocks, roots, kinds, shared):
    """(node, band, i, j, probe): the texts of buckets that hold several classes, in the pairs of blocks to compare.

    ``stars``: (a, b, band) of all buckets; ``blocks``: where each text has met its centre; ``roots``: (a,
    root), the class of each text that has one.
    """
    met = stars.join(blocks.select("a", F.struct("c", "k").alias("g")), "a", "left").join(roots, "a", "left")
    met = shared(met.select("a", "b", "band", "g", F.coalesce("root", "a").alias("root")))
    other = F.col("a") != F.col("b")
    state = met.groupBy("band").agg(
        F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.when(other, F.col("g"))).alias("g1"),
        F.max(F.when(other, F.col("g"))).alias("g2"), F.count_if(other & F.col("g").isNull()).alias("loose"),
        F.max(F.when(~other, F.col("b"))).alias("b"), F.max(F.when(~other, F.col("g"))).alias("gb"),
        F.count("*").alias("n"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("sum"),
    )
    # a bucket whose texts have all met in one block has nothing left to compare
    one = (F.col("loose") == 0) & (F.col("g1") == F.col("g2")) & ((F.col("g1.c") == F.col("b")) | F.col("gb").eqNullSafe(F.col("g1")))
    mixed = state.where((F.col("r1") != F.col("r2")) & ~F.coalesce(one, F.lit(False)))
    mixed = shared(mixed.groupBy("n", "sum").agg(F.min("band").alias("band")).select("band"))
    rows = met.select("a", "band", "root").join(mixed, "band").join(kinds.select(F.col("node").alias("a"), "n"), "a")
    rows = shared(rows)
    large = rows.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("l"))
    large = shared(large.select("band", F.col("l.root").alias("large")))
    rows = shared(rows.join(large, "band").withColumn("probe", F.expr("root <> large")))
    sizes = _blocks(rows, "band", "probe").groupBy("band").agg(
        F.coalesce(F.max(F.when(F.col("probe"), F.col("blocks"))), F.lit(0)).alias("few"),
        F.coalesce(F.max(F.when(~F.col("probe"), F.col("blocks"))), F.lit(0)).alias("many"),
    )
    rows = rows.join(shared(sizes), "band")
    at = F.pmod(F.xxhash64("a", F.lit(1)), F.when(F.col("probe"), F.col("few")).otherwise(F.col("many")))
    rows = rows.withColumn("own", at).withColumn("zero", F.lit(0).cast("long"))
    # blocks of the largest class come after those of the others
    pairs = F.expr("""IF(probe,
        transform(sequence(zero, few + many - 1), o -> named_struct('i', least(o, own), 'j', greatest(o, own))),
        transform(sequence(zero, few - 1), o -> named_struct('i', o, 'j', few + own)))""")
    return rows.select(F.col("a").alias("node"), "band", F.explode(pairs).alias("p"), "probe")


def near_classes(docs, text="text", id_column="doc_id", least=0.8):
    """(id_, hash_, class_id, class_hash, n_texts) of each row of ``docs``; see ``row_key`` for the keys.

    A class are the texts joined by chains of pairs with a similarity of ``least`` or more; class_id and
    class_hash name its first row, n_texts counts its rows. Texts of equal words are always one class;
    texts of fewer than five words only with such. Null texts and texts without a word are classes of
    their own. Rows that repeat a row share its keys and its class.
    """
    spark = docs.sparkSession

    def shared(df):
        return stored(df, shared_dir(spark, "near"))

    a, b = row_key(docs, text, id_column)
    narrow = docs.select(a, b, F.col(text).cast("string").alias("t"), F.octet_length(text).cast("long").alias("n"))
    narrow = narrow.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    signed = shared(narrow.mapInArrow(tidy(_sign), SIGNED)).withColumn("node", F.struct("w1", "w2"))
    kinds = signed.groupBy("node").agg(
        F.min(F.struct("id_", "hash_")).alias("first"), F.first("bands").alias("bands"), F.min("n_bytes").alias("n")
    )
    kinds = shared(kinds)
    banded = kinds.select("node", F.explode("bands").alias("band"))
    buckets = shared(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("b")).where("n > 1"))
    stars = shared(banded.join(buckets.drop("n"), "band").select(F.col("node").alias("a"), "b", "band"))
    first = narrow.select("id_", "hash_", "t").dropDuplicates(["id_", "hash_"])
    kept = kinds.select("node", "first.*")

    def verified(rows, *group):
        texts = rows.join(kept, "node").join(first, ["id_", "hash_"]).select("node", "t", "probe", *group)
        node = "struct<w1:long,w2:long>"
        return shared(texts.groupBy(*group).applyInArrow(_verify(least), f"a {node}, b {node}"))

    blocks, centres = _star_blocks(stars, kinds, shared)
    rows = blocks.unionByName(centres).select(F.col("a").alias("node"), "c", "k", F.lit(False).alias("probe"))
    found = verified(rows, "c", "k")
    near = components(found, shared)
    roots = near.select("a", F.col("b").alias("root"))
    more = verified(_apart(stars, blocks, roots, kinds, shared), "band", "p")
    classes = components(near.unionByName(more), shared)
    whole = signed.select("id_", "hash_", "node").join(
        classes.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left"
    )
    whole = shared(whole.select("id_", "hash_", F.coalesce("root", "node").alias("root")))
    heads = shared(whole.groupBy("root").agg(F.min(F.struct("id_", "hash_")).alias("head"), F.count("*").alias("n_texts")))
    return whole.join(heads, "root").select(
        "id_", "hash_", F.col("head.id_").alias("class_id"), F.col("head.hash_").alias("class_hash"), "n_texts"
    )


def first_of_classes(docs, text="text", id_column="doc_id", least=0.8):
    """The rows of ``docs`` that come first in their class; of rows that agree in id and text, one."""
    classes = near_classes(docs, text, id_column, least)
    heads = classes.where("id_ = class_id AND hash_ = class_hash").select("id_", "hash_").distinct()
    a, b = row_key(docs, text, id_column)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("o"), a, b)
    return rows.join(heads, ["id_", "hash_"]).groupBy("id_", "hash_").agg(F.first("o").alias("o")).select("o.*")
