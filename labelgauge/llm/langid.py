"""Language by the nearest of several centroids per language, over hashed byte n-grams.

A text is a vector of the counts of its byte n-grams (n = 1 to 4, lower case, white space as one blank, other
ASCII than letters as blanks; n-grams with two blanks in a row are left out), hashed into ``FEATURES``
features, damped by a logarithm, weighted by inverse document frequency and scaled to length one. Each
language has up to ``CENTROIDS`` centroids, clustered by cosine (spherical k-means, seeded by the sampled
texts that lie farthest apart); a text has the language of the most similar centroid and is rejected
where it is less similar to it than all but ``REJECT`` of the centroid's own texts.

Document frequencies count all rows learned from. The clustering sees a sample of about ``SAMPLE`` rows
of each language, picked by the hash of a key; that bounds what it holds, not what is classified.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelgauge.llm.decontam import fold
from labelgauge.llm.textbytes import chunks
from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

FEATURES = 1 << 13
GRAMS = (1, 2, 3, 4)
CENTROIDS = 4
SAMPLE = 1500
ROUNDS = 3
REJECT = 0.005
SEEDS = 24
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def counts(column):
    """(first row, last row + 1, matrix of n-gram counts) for slices of a batch."""
    for start, stop, data, offsets in chunks(column, 1 << 18):
        data, offsets, _ = fold(data, offsets)  # shorter, as runs of white space become one blank
        data = LETTERS[data]
        twice = np.zeros(len(data) + 1, np.int32)  # blanks after blanks, up to a place
        np.cumsum((data[1:] == 32) & (data[:-1] == 32), out=twice[1 : len(data)])
        twice[len(data) :] = twice[len(data) - 1] if len(data) else 0
        for a in range(0, stop - start, 32):
            b = min(a + 32, stop - start)
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            blanks = twice[offsets[a] : offsets[b] + 1]
            size = np.diff(own)
            owner = np.repeat(np.arange(b - a) * FEATURES, size)
            last = np.repeat(own[1:], size)
            place = np.arange(len(part))
            gram, grid = np.zeros(len(part), np.uint32), np.zeros((b - a) * FEATURES)
            for n in GRAMS:
                gram = gram[: len(part) - n + 1] << np.uint32(8) | part[n - 1 :]
                if not len(gram):
                    break
                h = (gram * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x3C6EF372)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                at = owner[: len(gram)] + (h >> np.uint32(19)).astype(np.int64)
                inside = place[: len(gram)] + n <= last[: len(gram)]
                inside &= blanks[n - 1 : n - 1 + len(gram)] == blanks[: len(gram)]
                grid += np.bincount(at[inside], minlength=len(grid))
            yield start + a, start + b, grid.reshape(b - a, FEATURES)


def vectors(grid, weights):
    x = np.log1p(grid).astype(np.float32) * weights
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _sums(key, value):
    """A task's sums as one row for each key and feature that is not zero."""
    at = np.flatnonzero(value)
    return [pa.array(np.full(len(at), key, np.int32)), pa.array(at.astype(np.int32)), pa.array(value[at].astype(np.float64))]


def _frequencies(batches):
    seen = np.zeros(FEATURES)
    for batch in batches:
        for _, _, grid in counts(batch.column("t")):
            seen += (grid > 0).sum(0)
    yield pa.RecordBatch.from_arrays(_sums(0, seen), ["key", "feature", "value"])


def _assign(model):
    """Sums of the vectors nearest to each centroid of their own language, and a histogram of cosines."""
    weights, centroids, owner, _, names = model
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        sums = np.zeros((len(centroids), FEATURES))
        cosines = np.zeros((len(centroids), 1000))
        for batch in batches:
            langs = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for a, b, grid in counts(batch.column("t")):
                x = vectors(grid, weights)
                near = x @ centroids.T
                near[owner[None, :] != langs[a:b, None]] = -1
                best = near.argmax(1)
                np.add.at(sums, best, x)
                np.add.at(cosines, (best, np.clip(near.max(1) * 1000, 0, 999).astype(int)), 1)
        for i in range(len(centroids)):
            yield pa.RecordBatch.from_arrays(_sums(i, sums[i]), ["key", "feature", "value"])
            yield pa.RecordBatch.from_arrays(_sums(-1 - i, cosines[i]), ["key", "feature", "value"])

    return run


def _sparse(weights):
    """The vectors of texts as lists of their entries."""

    def run(batches):
        for batch in batches:
            for a, b, grid in counts(batch.column("t")):
                x = vectors(grid, weights)
                features = [np.flatnonzero(row) for row in x]
                part = batch.slice(a, b - a)
                columns = [
                    part.column("lang"), part.column("place"), pa.array(features, pa.list_(pa.int32())),
                    pa.array([row[f] for row, f in zip(x, features)], pa.list_(pa.float32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "feature", "value"])

    return run


def _farthest(x, k):
    """Rows of ``x`` far from each other: the first, then always the one least similar to those taken."""
    taken = [0]
    while len(taken) < min(k, len(x)):
        near = (x @ x[taken].T).max(1)
        if near.min() > 0.999:
            break
        taken.append(int(near.argmin()))
    return x[taken]


SUMS = "key int, feature int, value double"


def fit(rows, text="text", lang="lang", key=None, sample=SAMPLE, centroids=CENTROIDS):
    """A model from rows with a language; rows without one, or without text, are left out. None without rows."""
    rows = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(key or text).cast("string"), F.lit("sample")), F.lit(1 << 30)).alias("h"),
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    names = sorted(sizes, key=lambda x: (-sizes[x], x))  # equal similarity: the more common language
    seen = np.zeros(FEATURES)
    for r in rows.select("t").mapInArrow(_frequencies, SUMS).groupBy("feature").agg(F.sum("value")).collect():
        seen[r[0]] = r[1]
    weights = (np.log((sum(sizes.values()) + 1) / (seen + 1)) + 1).astype(np.float32)
    bound = F.lit(0)
    for name, n in sizes.items():
        bound = F.when(F.col("lang") == name, F.lit(int(min(1.0, sample / n) * (1 << 30)))).otherwise(bound)
    some = stored(rows.where(F.col("h") < bound), shared_dir(rows.sparkSession, "langid"))
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= SEEDS)
    # the texts stay in the tasks: SEEDS sparse vectors of at most FEATURES entries come back per language
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("t", "h")))
    sparse = "lang string, place int, feature array<int>, value array<float>"
    seeds = {}
    for r in first.select("lang", "place", "t").mapInArrow(_sparse(weights), sparse).collect():
        x = np.zeros(FEATURES, np.float32)
        x[r.feature] = r.value
        seeds.setdefault(r.lang, []).append((r.place, x))
    groups = []
    for name in names:
        x = [x for _, x in sorted(seeds.get(name, []), key=lambda seed: seed[0])]
        groups.append(_farthest(np.stack(x or [np.zeros(FEATURES, np.float32)]), centroids))
    owner = np.repeat(np.arange(len(names)), [len(g) for g in groups])
    model = (weights, np.concatenate(groups), owner, np.zeros(len(owner)), names)
    for _ in range(ROUNDS):
        new, cosines = np.zeros((len(owner), FEATURES)), np.zeros((len(owner), 1000))
        sums = some.mapInArrow(_assign(model), SUMS).groupBy("key", "feature").agg(F.sum("value"))
        for k, feature, value in sums.toLocalIterator():
            (new if k >= 0 else cosines)[k if k >= 0 else -1 - k, feature] = value
        length = np.sqrt((new * new).sum(1, keepdims=True))
        new = np.where(length > 0, new / np.maximum(length, 1e-12), model[1]).astype(np.float32)
        share = np.cumsum(cosines, 1) / np.maximum(cosines.sum(1, keepdims=True), 1)
        model = (weights, new, owner, (share > REJECT).argmax(1) / 1000, names)
    return model


def _classify(model):
    weights, centroids, owner, least, names = model

    def run(batches):
        for batch in batches:
            best, near = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            for a, b, grid in counts(batch.column("t")):
                cosine = vectors(grid, weights) @ centroids.T
                best[a:b] = cosine.argmax(1)
                near[a:b] = np.clip(cosine.max(1), 0, 1)
            lang = pa.array([names[owner[i]] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), lang, pa.array(near), pa.array(near < least[best])], ["o", "lang_pred", "score", "rejected"]
            )

    return run


def classify(docs, model, text="text", unknown="und"):
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected, by the text alone.

    A null text, or one without a letter, is ``unknown`` with score 0 and rejected; without a model all
    rows are. Other columns pass whatever their names, but for those named like a result.
    """
    results = ["lang_pred", "score", "rejected"]
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    rows = docs.select(others.alias("o"), F.col(text).cast("string").alias("t"))
    letters = F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False))
    kind = rows.schema["o"].dataType.simpleString()
    rows = rows.select(F.struct("o", letters.alias("letters")).alias("o"), "t")
    if model is None:
        rows = rows.select("o", F.lit(unknown).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    else:
        rows = rows.mapInArrow(
            _classify(model), f"o struct<o:{kind},letters:boolean>, lang_pred string, score double, rejected boolean"
        )
    known = F.col("o.letters")
    return rows.select(
        "o.o.*", F.when(known, F.col("lang_pred")).otherwise(unknown).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"), (~known | F.col("rejected")).alias("rejected"),
    )
