"""Quality rules: text counts and a hashed n-gram likelihood ratio, in DataFrame and SQL functions only.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials over the
buckets, of a trusted target (rows that the caller marks) and of the raw corpus (all rows), give each
bucket a log-likelihood ratio; the score of a text is the mean ratio of its n-grams. Counts cover every
row and word; the table of ratios has ``BUCKETS`` entries whatever the input.
"""

from pyspark.sql import functions as F

from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

BUCKETS = 1 << 14
#: Words are runs of other characters.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Mean log-likelihood ratio (nats per n-gram) below which a text is not kept.
THRESHOLD = -0.15


def words(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def base_counts(docs, text="text"):
    """``docs`` with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words and ``hashes_`` of the words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({
        "hashes_": F.transform(words(t), lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.regexp_replace(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    n = F.size("hashes_")
    tail = lambda i: F.slice("hashes_", F.lit(i), F.greatest(n - 2, F.lit(0)))
    triples = F.zip_with(F.zip_with(tail(1), tail(2), lambda a, b: F.xxhash64(a, b)), tail(3), lambda p, c: F.xxhash64(p, c))
    rows = rows.withColumn("n_words", n.cast("long")).withColumn("triples_", triples)
    # equal triples side by side, each with its place; those with an equal neighbour repeat
    some = F.size("triples_") > F.size(F.array_distinct("triples_"))
    pairs = F.sort_array(F.transform("triples_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs_", F.when(some, pairs)).drop("triples_")
    hash_at = lambda k: F.try_element_at("pairs_", k)["h"]
    again = F.filter("pairs_", lambda p, k: (hash_at(k + 2) == p["h"]) | F.when(k > 0, hash_at(F.greatest(k, F.lit(1))) == p["h"]).otherwise(False))
    rows = rows.withColumn("at_", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("pairs_")
    # the words that windows of three cover: three each, less what the next window covers too
    steps = F.zip_with("at_", F.slice("at_", 2, F.greatest(F.size("at_"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at_")


def grams(hashes="hashes_", buckets=BUCKETS):
    """The buckets of the words and of the pairs of neighbouring words."""
    h = F.col(hashes)
    many = F.greatest(F.size(h) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(h, F.lit(1), many), F.slice(h, F.lit(2), many), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), pairs)


def ratios(marked, text="text", target="target", buckets=BUCKETS):
    """(bucket, ratio): log of the smoothed target share over the raw share, for every bucket seen."""
    rows = marked.select(F.coalesce(F.col(target), F.lit(False)).cast("long").alias("y"), F.transform(words(F.col(text).cast("string")), lambda w: F.xxhash64(w)).alias("hashes_"))
    counts = rows.select("y", F.explode(grams(buckets=buckets)).alias("bucket")).groupBy("bucket")
    counts = stored(counts.agg(F.count("*").alias("raw"), F.sum("y").alias("hit")), shared_dir(marked.sparkSession, "grams"))
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("hit").alias("hit"))
    share = lambda c: (F.col(c) + 1) / (sums.select(c).scalar() + buckets)
    return counts.select("bucket", (F.log(share("hit")) - F.log(share("raw"))).alias("ratio"))


def judge(docs, ratio_table, text="text", threshold=THRESHOLD, buckets=BUCKETS):
    """``docs`` with the counts of ``base_counts``, ``score``, ``base_failed`` and ``kept``.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three. kept:
    not base_failed and a mean ratio of at least ``threshold``; buckets not in the table count 0, and so
    does a text without words. Null counts as empty. Columns named like a result are replaced.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in results]).alias("o_")
    rows = base_counts(docs.select(others, F.col(text).cast("string").alias("t_")), "t_")
    dense = ratio_table.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("r"))
    # one number for each bucket, as a constant of the plan: lambdas take no subqueries
    numbers = dense.select(F.concat_ws(",", _dense("r", buckets).cast("array<string>"))).first()[0]
    table = F.split(F.lit(numbers), ",").cast("array<double>")
    total = F.aggregate(grams(buckets=buckets), F.lit(0.0), lambda s, b: s + F.get(table, b.cast("int")))
    n = F.greatest(F.col("n_words") * 2 - 1, F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("score", total / n).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (F.col("score") >= threshold)).select("o_.*", *results)


def _dense(pairs, buckets):
    """An array with the ratio of each bucket, 0 where the sorted pairs have none."""
    gaps = F.expr(f"""flatten(transform(sequence(0, size({pairs})), i -> concat(
      array_repeat(0.0D, CAST(coalesce(get({pairs}, i).bucket, {buckets}L) - coalesce(get({pairs}, i - 1).bucket, -1L) - 1 AS INT)),
      IF(i < size({pairs}), array(get({pairs}, i).ratio), CAST(array() AS ARRAY<DOUBLE>)))))""")
    return gaps
