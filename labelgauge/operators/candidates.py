"""Candidates (alternative instruction texts): gates, requests, scores, choice, comparison.

A candidate table has ``candidate_id`` (its place in the list), ``component`` and ``body``.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.functions.text import token_count
from labelgauge.schema import LABELS

# Fixed values of the two gates.
MIN_CHARS = 100
MIN_TOKENS = 150
TITLE = "HARMFUL SPEECH CLASSIFIER"
RARE_CHARACTER = r"[\x{2711}-\x{10FFFF}]"
MAX_RARE_SHARE = 0.05

#: Candidates that meet a row together: how many, and the characters beyond which a block ends.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20


def is_valid(body, labels=LABELS):
    """Long enough, asks for JSON and names a label."""
    named = reduce(or_, [body.contains(name) for name in labels])
    return F.coalesce((F.length(body) >= MIN_CHARS) & body.contains("JSON") & named, F.lit(False))


def is_valid_strict(body):
    """Enough words, shows a JSON object, keeps its title and few characters beyond U+2710."""
    rare = F.regexp_count(body, F.lit(RARE_CHARACTER))
    return F.coalesce(
        body.contains("{")
        & body.contains(TITLE)
        & (F.try_divide(rare, F.length(body)) <= MAX_RARE_SHARE)
        & (token_count(body) >= MIN_TOKENS),
        F.lit(False),
    )


def passing_or_all(candidates, ok):
    """The candidates for which ``ok`` holds; all of them when it holds for none."""
    any_ok = candidates.agg(F.coalesce(F.bool_or(ok), F.lit(False))).scalar()
    return candidates.where(ok | ~any_ok)


def candidate_blocks(candidates, size=BLOCK_ROWS, chars=BLOCK_CHARS):
    """The candidates in blocks of bounded size: ``block``, and ``members``, an array of whole candidates.

    A block holds at most ``size`` candidates, and no more than ``chars`` characters of text beyond its last
    one. Candidates are dealt to buckets by their id and numbered within, so no task sees them all.
    """
    texts = [F.coalesce(F.length(f"`{n}`"), F.lit(0)) for n, kind in candidates.dtypes if kind == "string"]
    width = sum(texts, F.lit(0)).cast("long")
    buckets = candidates.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1))).scalar()
    whole = F.struct(*[F.col(f"`{c}`") for c in candidates.columns])
    dealt = candidates.select(whole.alias("m"), width.alias("w"), F.pmod(F.xxhash64("candidate_id"), buckets).alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("m.candidate_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor((F.row_number().over(order) - 1) / size) + F.floor(F.coalesce(F.sum("w").over(before), F.lit(0)) / chars)
    dealt = dealt.withColumn("block", F.struct("bucket", part.alias("part")))
    return dealt.groupBy("block").agg(F.collect_list("m").alias("members"))


def candidate_requests(rows, candidates, id_col="id", size=BLOCK_ROWS, chars=BLOCK_CHARS):
    """Every candidate on every row, whatever the ids of the candidates are.

    The output is that large by meaning, but what is shuffled is not: candidates go in blocks of bounded
    size, a row is sent once per block, not once per candidate, and the product of a row and the members of
    a block is formed where they meet. Each block meets all rows, so its rows are spread by row id and the
    block is copied once for each part.
    """
    blocks = candidate_blocks(candidates, size, chars)
    names = blocks.agg(F.collect_set("block").alias("names")).scalar()
    sent = rows.withColumn("_names", names).withColumn("_block", F.explode("_names")).drop("_names")
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = sent.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    copies = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = salted.join(copies.withColumnRenamed("block", "_block"), ["_block", "_salt"]).drop("_block", "_salt")
    columns = [c for c in met.columns if c != "members"]
    return met.select(*[F.col(f"`{c}`") for c in columns], F.inline("members"))


def first_nonzero_score(*columns):
    """The first score that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0))


def best_by_score(candidates, score):
    """The candidate with the highest score, the first in the list on ties."""
    scored = candidates.withColumn("_score", score)
    return scored.orderBy(F.desc("_score"), F.asc("candidate_id")).limit(1).drop("_score")


def best_by_length(candidates, body="body"):
    """The candidate with the longest text, the first in the list on ties."""
    sized = candidates.withColumn("_size", F.length(body))
    return sized.orderBy(F.desc("_size"), F.asc("candidate_id")).limit(1).drop("_size")


def best_score(scores, score="score"):
    """The best score, 0.0 when there is none."""
    return scores.agg(F.coalesce(F.max(score), F.lit(0.0)).alias("best_score"))


def compare(approaches, baseline, name="approach", score="macro_f1"):
    """Each approach's gain over the baseline approach in percent, 0 when the baseline has 0."""
    base = approaches.where(F.col(name) == baseline).select(F.col(score)).scalar()
    gain = (F.col(score) - F.col("baseline_score")) * 100 / F.col("baseline_score")
    return approaches.withColumn("baseline_score", base).withColumn(
        "gain_pct", F.when(F.col("baseline_score") > 0, gain).otherwise(0.0)
    )
