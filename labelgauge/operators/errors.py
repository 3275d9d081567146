"""Error mining: which rows, labels and label pairs go wrong."""

from itertools import combinations

from pyspark.sql import functions as F

from labelgauge.functions.scores import row_accuracy
from labelgauge.operators.batch import evaluation
from labelgauge.operators.metrics import WIDE, as_arrays, tallies, wrong_pairs
from labelgauge.operators.split import first_k, lowest_k
from labelgauge.schema import LABELS

# Error names, the wording of lines, and the section a label is described in.
MISSED, FALSE_ALARM, ALL_CORRECT = "MISSED", "FALSE ALARM", "(all correct)"
UNDERSPECIFIED_LINE = "Section 5: %s (FP=%d, FN=%d)"
EXPAND_LINE = "Section %s (%s): expand definition + markers — %d errors"
PAIR_LINE = "Section 9: add rule distinguishing %s vs %s"
EXAMPLES_LINE = "Section 11: add examples for labels with errors"
SIGNAL_START, SIGNAL_ENTRY = "Most confused: ", "(('%s', '%s'), %d)"
SECTIONS = {
    "stereotype": "5a",
    "vilification": "5b",
    "dehumanization": "5c",
    "extreme_language": "5d",
    "lack_of_empathy": "5e",
    "invalidation": "5f",
}


def trajectories(df, labels=LABELS, truth="", pred="pred_"):
    """The trace of every row: input, reply, prediction, truth, score."""
    return evaluation(df, labels, truth, pred, traces=True)


def error_list(labels=LABELS, truth="", pred="pred_"):
    """The labels a row got wrong, each as missed or false alarm, as an array of strings."""
    wrong = ", ".join(
        f"""CASE WHEN `{truth}{name}` = `{pred}{name}` THEN NULL
            WHEN `{truth}{name}` = 1 THEN '{name}: {MISSED}' ELSE '{name}: {FALSE_ALARM}' END"""
        for name in labels
    )
    joined = F.expr(f"nullif(concat_ws('\n', {wrong}), '')")
    return F.split(F.coalesce(joined, F.lit(ALL_CORRECT)), "\n")


def error_pairs(df, id_col="id", labels=LABELS, truth="", pred="pred_"):
    """Every pair of labels wrong in the same row, one row per pair; pairs never leave their row."""
    if len(labels) > WIDE:
        k, names = len(labels), f"array({', '.join(repr(n) for n in sorted(labels))})"
        found = as_arrays(df, [id_col], labels, truth, pred).selectExpr(id_col, f"explode({wrong_pairs(labels)}) AS e")
        return found.selectExpr(id_col, f"get({names}, e div {k}) AS label_a", f"get({names}, e % {k}) AS label_b")
    wrong = {name: f"`{truth}{name}` <> `{pred}{name}`" for name in labels}
    pairs = ", ".join(
        f"""CASE WHEN {wrong[a]} AND {wrong[b]}
            THEN named_struct('label_a', '{a}', 'label_b', '{b}') END"""
        for a, b in combinations(sorted(labels), 2)
    )
    return df.selectExpr(id_col, f"inline(array_compact(array({pairs})))")


def pair_counts(counted):
    """How often two labels were wrong together, pairs that never were left out."""
    return counted.select(F.inline("joint")).where("n_both > 0").drop("ord")


# Wrong predictions by label and kind, the most frequent first. Equal counts keep label order,
# misses before false alarms.
ERROR_ENTRIES = """array_sort(filter(flatten(transform(cells, c -> array(
    named_struct('minus', -c.fn, 'ord', c.ord, 'kind_ord', 0, 'label', c.label, 'kind', 'FN', 'n_errors', c.fn),
    named_struct('minus', -c.fp, 'ord', c.ord, 'kind_ord', 1, 'label', c.label, 'kind', 'FP', 'n_errors', c.fp)
))), e -> e.n_errors > 0))"""


def error_counts(counted):
    """Wrong predictions by label and kind (FN or FP), without zeros."""
    return counted.selectExpr(f"inline({ERROR_ENTRIES})").select("label", "kind", "n_errors")


def most_frequent_errors(counted, k):
    df = counted.selectExpr(f"posexplode(slice({ERROR_ENTRIES}, 1, {k})) AS (pos, e)")
    return df.select((F.col("pos") + 1).alias("rank"), "e.label", "e.kind", "e.n_errors")


# A line per label with errors, in label order.
UNDERSPECIFIED = f"""transform(filter(cells, c -> c.fp + c.fn > 0),
    c -> format_string('{UNDERSPECIFIED_LINE}', c.label, c.fp, c.fn))"""


def underspecified(counted):
    return counted.selectExpr(f"posexplode({UNDERSPECIFIED}) AS (ord, line)")


def expansion_lines(k=4):
    """SQL on tallies: what to expand, as an array of lines.

    The k most frequent errors, then the worst pair, then a call for more examples.
    """
    sections = ", ".join(f"'{label}', '{section}'" for label, section in SECTIONS.items())
    entries = f"slice({ERROR_ENTRIES}, 1, {k})"
    worst_pair = """slice(array_sort(transform(filter(joint, p -> p.n_both > 0),
        p -> named_struct('minus', -p.n_both, 'ord', p.ord, 'a', p.label_a, 'b', p.label_b))), 1, 1)"""
    return f"""concat(
        transform({entries}, e -> format_string(
            '{EXPAND_LINE}', map({sections})[e.label], e.label, e.n_errors)),
        transform({worst_pair}, p -> format_string('{PAIR_LINE}', p.a, p.b)),
        transform(slice({ERROR_ENTRIES}, 1, 1), e -> '{EXAMPLES_LINE}'))"""


def expansion_plan(counted, k=4):
    """The lines of ``expansion_lines`` as rows."""
    return counted.selectExpr(f"posexplode({expansion_lines(k)}) AS (ord, line)")


def confusion_signal(k=2):
    """SQL on tallies: the k most frequent errors as one line."""
    shown = f"""transform(slice({ERROR_ENTRIES}, 1, {k}),
        e -> format_string("{SIGNAL_ENTRY}", e.label, e.kind, e.n_errors))"""
    return f"concat('{SIGNAL_START}[', array_join({shown}, ', '), ']')"


def reflective_records(
    df, candidate, components, k=10, labels=LABELS, truth="", pred="pred_",
    traces=True, worst=False, extra=None,
):
    """Per component the first (or worst) k rows with their errors and the batch's summary.

    ``candidate`` maps component to text; ``extra`` holds further constant fields of the caller.
    Without traces there is nothing to reflect on and the table is empty.
    """
    summary = (
        tallies(df, labels, truth, pred)
        .selectExpr(
            f"""named_struct('confusion_signal', {confusion_signal()},
                'underspecified_sections', {UNDERSPECIFIED}, 'expansion_sections', {expansion_lines()})"""
        )
        .scalar()
    )
    pairs = [(truth + name, pred + name) for name in labels]
    score = row_accuracy(pairs)
    picked = lowest_k(df, k, score) if worst else first_k(df, k)
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("component_name"),
                F.lit(candidate.get(name, "")).alias("current_text"),
            )
            for name in components
        ]
    )
    records = picked.select(
        F.inline(parts),
        "id",
        score.alias("score"),
        F.col("text").alias("input"),
        F.col("raw_response").alias("output"),
        error_list(labels, truth, pred).alias("per_label_errors"),
        summary.alias("summary"),
    )
    records = records.select("*", "summary.*").drop("summary")
    records = records.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})
    return records if traces else records.where(F.lit(False))


def error_type(label_col="label", pred_col="predicted"):
    label, pred = F.col(label_col), F.col(pred_col)
    return F.when((label == 0) & (pred == 1), "False Positive").when(
        (label == 1) & (pred == 0), "False Negative"
    )


def false_positives(df, label_col="label", pred_col="predicted"):
    return df.where((F.col(label_col) == 0) & (F.col(pred_col) == 1))


def false_negatives(df, label_col="label", pred_col="predicted"):
    return df.where((F.col(label_col) == 1) & (F.col(pred_col) == 0))


def missed_rows(df, pred_col="predicted"):
    """The rows of an all-positive set that were not found."""
    return df.where(F.col(pred_col) == 0)


def tagged_errors(df, label_col="label", pred_col="predicted"):
    """False positives and false negatives in one pass, named in ``error_type``."""
    tagged = df.withColumn("error_type", error_type(label_col, pred_col))
    return tagged.where("error_type is not null")
