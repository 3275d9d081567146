"""Quality classifier: naive Bayes support vectors over hashed n-grams.

Every byte n-gram (n = 1 to 4) and every word of a text sets one of ``FEATURES`` indicators. The
indicators are scaled by the log-count ratios of the two classes, counted over all labelled rows,
and scaled to unit length; a linear hinge-loss model is then fitted by dual coordinate descent on a
bounded sample of labelled rows, drawn alike from both classes, and its margins are turned into
probabilities by a logistic curve fitted on the part of the sample that the model has not seen.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelgauge.llm.textbytes import U64, Hasher, chunks, mix, words_of
from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

FEATURES = 1 << 15
GRAMS = (1, 2, 3, 4)


def indicators(column):
    """(first row, last row + 1, rows, features) of slices of a batch: the indicators that are set."""
    names = Hasher(7)
    for start, stop, data, offsets in chunks(column, 1 << 18):
        for a in range(0, stop - start, 32):
            b = min(a + 32, stop - start)
            lo, hi = offsets[a], offsets[b]
            part, own = data[lo:hi], offsets[a : b + 1] - lo
            grid = np.zeros((b - a) * FEATURES, bool)
            owner = np.repeat(np.arange(b - a), np.diff(own)) * FEATURES
            last = np.repeat(own[1:], np.diff(own))
            place = np.arange(len(part))
            gram = np.zeros(len(part), np.uint32)
            for n in GRAMS:
                gram = gram[: len(part) - n + 1] << np.uint32(8) | part[n - 1 :]
                if not len(gram):
                    break
                inside = place[: len(gram)] + n <= last[: len(gram)]
                h = (gram * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x3C6EF372)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                feature = (h >> np.uint32(17)).astype(np.int64)
                grid[(owner[: len(gram)] + feature)[inside]] = True
            begins, ends, rows = words_of(part, own)
            word = mix(names.load(part).of(begins, ends)) >> U64(49)
            grid[rows * FEATURES + word.astype(np.int64)] = True
            at = np.flatnonzero(grid)
            yield start + a, start + b, at // FEATURES, at % FEATURES


def _learn(batches):
    """Feature counts by class as one row for each feature and task; sampled rows as they come."""
    counts = np.zeros((2, FEATURES), np.int64)
    schema = pa.schema([("feature", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("y", pa.int32()), ("set", pa.list_(pa.int32()))])
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        sampled = batch.column(2).to_numpy(zero_copy_only=False)
        for start, stop, rows, features in indicators(batch.column(0)):
            y = label[start:stop]
            for c in (0, 1):
                counts[c] += np.bincount(features[y[rows] == c], minlength=FEATURES)
            ends = np.searchsorted(rows, np.arange(stop - start + 1))
            for i in np.flatnonzero(sampled[start:stop]):
                own = features[ends[i] : ends[i + 1]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], t) for t in (pa.int32(), pa.int64(), pa.int64())]
                    + [pa.array([y[i]], pa.int32()), pa.array([own], pa.list_(pa.int32()))], schema=schema
                )
    some = np.flatnonzero(counts.sum(0)).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])]
        + [pa.nulls(len(some), t) for t in (pa.int32(), pa.list_(pa.int32()))], schema=schema
    )


def dual_descent(sets, y, ratios, cost=1.0, epochs=12, seed=1):
    """Weights and bias of the hinge-loss model over the scaled, normed indicators."""
    values = []
    for s in sets:
        v = ratios[s]
        values.append(v / max(np.sqrt(v @ v), 1e-12))
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(sets))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(sets)):
            gradient = y[i] * (weights[sets[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost)  # unit length, and the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[sets[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weights, bias


def logistic(margins, y, share):
    """Slope and shift of P(1 | margin), each class weighing as much as its ``share`` of all rows."""
    slope, shift = 1.0, 0.0
    n1 = max(y.sum(), 1)
    weight = np.where(y == 1, share / n1, (1 - share) / max(len(y) - n1, 1))
    # targets away from 0 and 1 keep the slope finite where the classes lie apart
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        g = np.array([(weight * (p - target) * margins).sum(), (weight * (p - target)).sum()])
        q = weight * p * (1 - p)
        h = np.array([[(q * margins**2).sum(), (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        slope, shift = slope - step[0], shift - step[1]
    return max(slope, 1e-3), shift


def _fit(ratios, share):
    def run(table):
        sets = [np.array(s, np.int64) for s in table.column("set").to_pylist()]
        y = table.column("y").to_numpy()
        order = np.lexsort([[int(s.sum()) for s in sets], [len(s) for s in sets]])
        sets, y = [sets[i] for i in order], y[order]
        unseen = np.arange(len(sets)) % 5 == 0
        if len(sets) < 50 or len(set(y[unseen])) < 2:
            unseen[:] = False
        weights, bias = dual_descent([s for s, u in zip(sets, unseen, strict=True) if not u], np.where(y[~unseen] == 1, 1.0, -1.0), ratios)
        scaled = weights * ratios
        margins = np.array([scaled[s].sum() / max(np.sqrt((ratios[s] ** 2).sum()), 1e-12) + bias for s in sets])
        held = unseen if unseen.any() else np.ones(len(sets), bool)
        slope, shift = logistic(margins[held], y[held], share)
        return pa.table({"weights": [scaled.tolist()], "bias": [float(bias)], "slope": [float(slope)], "shift": [float(shift)]})

    return run


def fit(rows, text="text", label="y", key=None, sample_rows=4000):
    """A model from labelled rows (``label`` 0 or 1; other rows are left out), or None without both classes.

    ``sample_rows`` bounds the rows (about as many of each class, picked by the hash of ``key``, by default
    the text) that the hinge-loss model sees; the log-count ratios count all rows.
    """
    rows = rows.where(F.col(label).isin(0, 1)).select(
        F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y"),
        F.xxhash64(F.col(key or text).cast("string"), F.lit("sample")).alias("h"),
    )
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    part = F.when(F.col("y") == 1, F.lit(min(1.0, sample_rows / 2 / n[1]))).otherwise(F.lit(min(1.0, sample_rows / 2 / n[0])))
    rows = rows.select("t", "y", (F.pmod("h", F.lit(1 << 30)) < part * (1 << 30)).alias("sampled"))
    learned = rows.mapInArrow(_learn, "feature int, n0 long, n1 long, y int, set array<int>")
    learned = stored(learned, shared_dir(rows.sparkSession, "quality"))
    counts = np.zeros((2, FEATURES))
    for r in learned.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("n0"), F.sum("n1")).collect():
        counts[:, r[0]] = r[1:]
    p, q = counts[1] + 1, counts[0] + 1
    ratios = np.log((p / (n[1] + 2)) / (q / (n[0] + 2)))
    share = n[1] / (n[0] + n[1])
    sample = learned.where("feature IS NULL").select("y", "set").withColumn("one", F.lit(1))
    model = sample.groupBy("one").applyInArrow(
        _fit(ratios, share), "weights array<double>, bias double, slope double, shift double"
    ).first()
    return np.array(model.weights), ratios**2, model.bias, model.slope, model.shift


def _score(model):
    weights, squares, bias, slope, shift = model

    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start, stop, rows, features in indicators(batch.column("t")):
                size = stop - start
                top = np.bincount(rows, weights[features], size)
                length = np.sqrt(np.bincount(rows, squares[features], size))
                scores[start:stop] = top / np.maximum(length, 1e-12) + bias
            scores = 1 / (1 + np.exp(-np.clip(slope * scores + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array(scores)], ["o", "score"])

    return run


def score(docs, model, text="text"):
    """``docs`` with ``score`` in 0 to 1 for every row, by its text alone.

    Null counts as empty; an empty text has the score of the bias. Without a model (no labels of both
    classes) every score is 0.5. A column named score is replaced, all others pass whatever their names.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    rows = docs.select(F.struct(*keep).alias("o"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["o"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"o {kind}, score double").select("o.*", "score")


def labelled(docs, labels, label="quality", id_column="doc_id", text="text"):
    """(doc_id, text, y) of the documents with a label; of several labels of one id, the larger half wins."""
    y = labels.where(F.col(label).isin(0, 1)).groupBy(id_column).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    return docs.select(id_column, text).join(y.hint("merge"), id_column)  # labels grow with the documents: never broadcast
