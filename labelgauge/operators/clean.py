"""Cleaning: class subsets, label filters, exact de-duplication, label consistency."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.functions.labels import class_label, label_sum
from labelgauge.functions.text import text_column
from labelgauge.schema import LABELS

# Label rules as (name, label at 1, label that must then be 0).
RULES = (("dehumanization excludes stereotype", "dehumanization", "stereotype"),)


def drop_empty_text(df, text_col="text"):
    return df.dropna(subset=[text_col])


def unified(df):
    return df.select("text", "label", "source")


def union_all(first, *others):
    for other in others:
        first = first.unionByName(other)
    return first


def first_of_each_text(df, order_by, text_col="text"):
    """One row per distinct text, the first in ``order_by``.

    Ranking to 1 is cut down before the shuffle as well, so a text that makes up much of the
    table sends one row per task. The hash leads the key to keep comparisons of long texts rare;
    the text itself decides.
    """
    w = Window.partitionBy(F.xxhash64(text_col), F.col(text_col)).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def class_subset(df, label_col="label", keep=None):
    """Rows of the two named classes with the label as 1 or 0; ``keep`` selects one of them."""
    df = df.withColumn(label_col, class_label(F.col(label_col)))
    return df.where(F.col(label_col).isNotNull() if keep is None else F.col(label_col) == keep)


def with_any_label(df, labels=LABELS):
    """Rows with at least one label set."""
    return df.where(label_sum(labels) > 0)


def any_label_counts(df, labels=LABELS):
    """How many rows the zero-label filter keeps and removes."""
    kept = F.count_if(label_sum(labels) > 0)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        kept.alias("kept"),
        (F.count(F.lit(1)) - kept).alias("removed"),
    )


def examples(df, labels=LABELS, as_type="string"):
    """Text and labels as one record each, labels as strings or integers."""
    return df.select(
        *[c for c in ("id",) if c in df.columns],
        text_column(df.columns).alias("text"),
        *[F.col(c).cast(as_type).alias(c) for c in labels],
    )


def _broken(rule, name):
    return (F.col(name.format(rule[1])) == 1) & (F.col(name.format(rule[2])) == 1)


def rule_violations(df, rules=RULES, name="{}"):
    """The rows that break a rule, one row per rule broken."""
    broken = F.array_compact(
        F.array(*[F.when(_broken(r, name), F.lit(r[0])) for r in rules])
    )
    return df.withColumn("rule", F.explode(broken))


def rule_counts(df, rules=RULES, name="{}"):
    """Violations per rule in one pass, rules without any included."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_broken(r, name)).alias(f"r{i}") for i, r in enumerate(rules)],
    )
    rows = [
        F.struct(F.lit(r[0]).alias("rule"), F.col(f"r{i}").alias("violations"), F.col("n").alias("rows"))
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))
