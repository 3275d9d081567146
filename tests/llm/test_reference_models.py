"""The two classifiers against plain versions of their methods, text by text and number by number."""

import math
import random
import re

import numpy as np

from labelgauge.llm import langid, quality_nb

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def gram_hash(gram, shift):
    """The place of a byte n-gram among the features."""
    h = (int.from_bytes(gram, "big") * 0x9E3779B1 & M32) ^ (len(gram) * 0x3C6EF372 & M32)
    return ((h ^ (h >> 15)) * 0x85EBCA6B & M32) >> shift


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n))


# language ID


def gram_counts(text):
    """Counts by feature of the n-grams that hold no two blanks in a row."""
    text = re.sub(r"\s+", " ", text).lower()
    data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.encode())
    own = {}
    for n in (1, 2, 3, 4):
        for i in range(len(data) - n + 1):
            if b"  " not in data[i : i + n]:
                f = gram_hash(data[i : i + n], 19)
                own[f] = own.get(f, 0) + 1
    return own


def tf_idf(texts):
    """(vectors of unit length, weights) of texts."""
    counts = [gram_counts(text) for text in texts]
    seen = np.zeros(langid.FEATURES)
    for own in counts:
        for f in own:
            seen[f] += 1
    weights = np.log((len(texts) + 1) / (seen + 1)) + 1
    x = np.zeros((len(texts), langid.FEATURES))
    for row, own in zip(x, counts, strict=True):
        for f, c in own.items():
            row[f] = math.log(1 + c) * weights[f]
    return x / np.linalg.norm(x, axis=1, keepdims=True), weights


def spherical_means(x, k, rounds):
    """Centroids of unit length from seeds far apart, and the cosines of the last assignment."""
    taken = [0]
    while len(taken) < min(k, len(x)):
        near = (x @ x[taken].T).max(1)
        taken.append(int(near.argmin()))
    centroids = x[taken]
    for _ in range(rounds):
        cosines = x @ centroids.T
        best = cosines.argmax(1)
        sums = np.array([x[best == i].sum(0) for i in range(len(centroids))])
        least = [min([math.floor(c * 1000) / 1000 for c in cosines[best == i, i]], default=0) for i in range(len(centroids))]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)
    return centroids, least


def test_counts_of_a_text_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    r = random.Random(4)
    texts = [" \n ".join(words(r, "abcÉÄß", 2).replace(" ", r.choice(["  ", "\t\n", " 7 ", "\u00a0 "])) for _ in range(r.randint(0, 30))) for _ in range(90)]
    texts = [t if i % 9 else r.choice([None, "", " ", "  \n"]) for i, t in enumerate(texts)]
    row = lambda grid: {int(f): int(grid[f]) for f in np.flatnonzero(grid)}
    together = {a + i: row(own) for a, _, grid in langid.counts(pa.array(texts)) for i, own in enumerate(grid)}
    assert together == {i: gram_counts(t or "") for i, t in enumerate(texts)}


def test_language_model_equals_a_plain_one(spark):
    r = random.Random(11)
    letters = {"aa": "abcdefé", "bb": "efghijk", "cc": "klmnßop"}
    rows = [(words(r, letters[lang], r.randint(4, 60)) + r.choice(["", "  12, -- x", "\n\n"]), lang) for lang in letters for _ in range(20 + ord(lang[0]) % 3)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    sizes = {lang: sum(own == lang for _, own in rows) for lang in letters}
    x, weights = tf_idf([t for t, _ in rows])
    assert np.allclose(model[0], weights, atol=1e-5)
    names, centroids, least, owner = sorted(sizes, key=lambda n: (-sizes[n], n)), [], [], []
    for name in names:  # seeds in the order of the texts
        own = sorted((t.encode(), i) for i, (t, lang) in enumerate(rows) if lang == name)
        means, low = spherical_means(x[[i for _, i in own]], langid.CENTROIDS, langid.ROUNDS)
        centroids += list(means)
        least += low
        owner += [name] * len(means)
    assert model[4] == names and [names[i] for i in model[2]] == owner
    assert np.allclose(model[1], centroids, atol=1e-4)
    assert np.allclose(model[3], least, atol=0.0011)

    asked = [words(r, r.choice([*letters.values(), "abnop", "xyzwvu"]), r.randint(1, 40)) for _ in range(60)]
    got = {g.text: g for g in langid.classify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()}
    alone = np.zeros((len(asked), langid.FEATURES))
    for row, text in zip(alone, asked, strict=True):
        for f, c in gram_counts(text).items():
            row[f] = math.log(1 + c) * weights[f]
        row /= np.linalg.norm(row)
    cosines = alone @ np.array(centroids).T
    for text, row in zip(asked, cosines, strict=True):
        best = int(row.argmax())
        assert abs(got[text].score - row[best]) < 1e-4
        if np.sort(row)[-1] - max([c for c, o in zip(row, owner, strict=True) if o != owner[best]]) > 1e-4:
            assert got[text].lang_pred == owner[best]
        if abs(row[best] - least[best]) > 2e-3:
            assert got[text].rejected == (row[best] < least[best])
    assert {g.lang_pred for g in got.values()} == set(letters) and any(g.rejected for g in got.values())


# quality


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def word_name(word, seed=7):
    base = (0x5851F42D4C957F2D * (2 * seed + 1) | 1) & M64
    return mixed(sum(mixed(((b + 1) * 0x9E3779B97F4A7C15 + seed) & M64) * pow(base, i, 1 << 64) for i, b in enumerate(word)) & M64)


def indicators(text):
    data = (text or "").encode()
    grams = {gram_hash(data[i : i + n], 17) for n in (1, 2, 3, 4) for i in range(len(data) - n + 1)}
    return sorted(grams | {mixed(word_name(w)) >> 49 for w in data.split()})


def rows_of_two_kinds(n):
    r = random.Random(5)
    good = lambda: words(r, "abcdeé ", r.randint(1, 25))
    bad = lambda: words(r, "defg$#!", r.randint(1, 25))
    return [(i, None if i == 7 else good() if i % 3 else bad(), int(i % 3 > 0) if i % 17 else 1 - int(i % 3 > 0)) for i in range(n)]


def test_quality_ratios_and_scores_equal_plain_ones(spark):
    rows = rows_of_two_kinds(150)
    table = spark.createDataFrame(rows, "doc_id long, text string, y int")
    weights, squares, bias, slope, shift = quality_nb.fit(table, key="doc_id")
    counts, n = np.zeros((2, quality_nb.FEATURES)), [0, 0]
    for _, text, y in rows:
        n[y] += 1
        counts[y, indicators(text)] += 1
    ratios = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    assert np.allclose(squares, ratios**2)
    asked = [*rows[:40], (900, "", 0), (901, "never seen: Ωж", 0), (902, "abc  de\tf\n" * 300, 0)]
    asked = spark.createDataFrame(asked, "doc_id long, text string, y int")
    for got in quality_nb.score(asked, (weights, squares, bias, slope, shift)).collect():
        own = indicators(got.text)
        length = math.sqrt(sum(ratios[f] ** 2 for f in own))
        margin = sum(weights[f] for f in own) / max(length, 1e-12) + bias
        assert abs(got.score - 1 / (1 + math.exp(-(slope * margin + shift)))) < 1e-9


def test_dual_descent_reaches_the_least_hinge_loss():
    rows = rows_of_two_kinds(90)
    sets = [np.array(indicators(t)) for _, t, _ in rows if t]
    y = np.array([1.0 if label else -1.0 for _, t, label in rows if t])
    ratios = np.random.default_rng(2).normal(size=quality_nb.FEATURES)
    weights, bias = quality_nb.dual_descent(sets, y, ratios, epochs=200)
    x = np.zeros((len(sets), quality_nb.FEATURES + 1))
    for row, s in zip(x, sets, strict=True):
        row[s] = ratios[s] / np.linalg.norm(ratios[s])
    x[:, -1] = 1
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    # projected gradient ascent on the dual: its value bounds the least loss from below
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, 1)
    bound = alpha.sum() - alpha @ q @ alpha / 2
    found = loss(np.append(weights, bias))
    assert bound - 1e-6 <= found <= bound * 1.001 < loss(np.zeros(x.shape[1]))


def test_log_loss_of_the_logistic_curve_is_least():
    r = np.random.default_rng(3)
    y = (r.random(300) < 0.3).astype(int)
    margins = r.normal(size=300) + y
    slope, shift = quality_nb.logistic(margins, y, 0.3)
    n1 = y.sum()
    weight = np.where(y == 1, 0.3 / n1, 0.7 / (300 - n1))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (300 - n1 + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    least = loss(slope, shift)
    assert all(least <= loss(slope + a, shift + b) + 1e-12 for a in (-0.05, 0, 0.05) for b in (-0.05, 0, 0.05))
