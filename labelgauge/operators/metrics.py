"""Multi-label quality metrics.

``tallies`` reads the table once: every count behind every metric is a conditional count of one
aggregate, so rows are neither multiplied per label nor shuffled. All else is arithmetic on the
one row (or the one row per group) it gives; counts nobody asks for are pruned from the plan.
"""

from itertools import combinations

from pyspark.sql import functions as F

from labelgauge.functions.scores import cell_metrics, ratio, round4
from labelgauge.schema import LABELS

#: Label lists longer than this are counted by arrays instead of an expression per label and pair.
WIDE = 40

CELLS = ("tp", "fp", "tn", "fn")
AVERAGED = ("precision", "recall", "f1", "accuracy")
_CELL = {
    "tp": "`{t}` = 1 AND `{p}` = 1",
    "fp": "`{t}` = 0 AND `{p}` = 1",
    "tn": "`{t}` = 0 AND `{p}` = 0",
    "fn": "`{t}` = 1 AND `{p}` = 0",
}


def tallies(df, labels=LABELS, truth="", pred="pred_", by=()):
    """Row count, exact matches, confusion cells per label and joint errors per label pair.

    ``truth`` and ``pred`` are the column prefixes. A null prediction counts in no cell. Pairs that were
    never wrong together have a count of 0, or none where there are more than ``WIDE`` labels.
    """
    if len(labels) > WIDE:
        return _wide_tallies(df, labels, truth, pred, by)
    couples = list(combinations(sorted(labels), 2))
    right = {name: f"`{truth}{name}` = `{pred}{name}`" for name in labels}
    counts = {"n": "true", "exact": " AND ".join(right.values())}
    for i, name in enumerate(labels):
        for cell, condition in _CELL.items():
            counts[f"{cell}{i}"] = condition.format(t=truth + name, p=pred + name)
    for j, (a, b) in enumerate(couples):
        counts[f"both{j}"] = f"NOT ({right[a]}) AND NOT ({right[b]})"
    cells = ", ".join(
        f"named_struct('ord', {i}, 'label', '{name}', "
        + ", ".join(f"'{cell}', {cell}{i}" for cell in CELLS)
        + ")"
        for i, name in enumerate(labels)
    )
    joint = ", ".join(
        f"named_struct('ord', {j}, 'label_a', '{a}', 'label_b', '{b}', 'n_both', both{j})"
        for j, (a, b) in enumerate(couples)
    )
    counts = [f"count_if({condition}) AS {c}" for c, condition in counts.items()]
    counted = df.groupBy(*by).agg(*map(F.expr, counts)) if by else df.selectExpr(*counts)
    return counted.selectExpr(
        *by, "n", "exact", f"array({cells}) AS cells", f"array({joint}) AS joint"
    )


def as_arrays(df, keys, labels, truth="", pred="pred_"):
    """The columns ``keys``, and the labels of a row as the arrays ``_t`` and ``_p``."""
    arrays = [f"array({', '.join(f'`{at}{name}`' for name in labels)}) AS {c}" for at, c in ((truth, "_t"), (pred, "_p"))]
    return df.selectExpr(*keys, *arrays)


def wrong_pairs(labels):
    """SQL on ``as_arrays``: the pairs of wrong labels of a row, as a * k + b for places a < b among the k sorted labels."""
    place = {name: i for i, name in enumerate(sorted(labels))}
    places = f"array({', '.join(str(place[name]) for name in labels)})"
    wrong = f"array_sort(array_compact(transform(_t, (x, i) -> if(x <> get(_p, i), get({places}, i), NULL))))"
    pairs = f"flatten(transform(w, (a, i) -> transform(slice(w, i + 2, size(w)), b -> a * {len(labels)} + b)))"
    return f"get(transform(array({wrong}), w -> {pairs}), 0)"


def _wide_tallies(df, labels, truth, pred, by):
    """``tallies`` for long lists of labels, without an expression per label or per pair.

    Each row gives what counts in it as numbers: itself, an exact match, its labels but for true negatives,
    its pairs of wrong labels. These are counted within the tasks first, so a task passes on one row per
    number; true negatives are what is left of the rows.
    """
    k = len(labels)
    cells = """array_compact(transform(_t, (x, i) -> CASE WHEN x = 1 AND get(_p, i) = 1 THEN 4 * i
        WHEN x = 0 AND get(_p, i) = 1 THEN 4 * i + 1 WHEN x = 0 AND get(_p, i) = 0 THEN NULL
        WHEN x = 1 AND get(_p, i) = 0 THEN 4 * i + 3 ELSE 4 * i + 2 END))"""
    exact = "size(filter(_t, (x, i) -> coalesce(x <> get(_p, i), true))) = 0"
    pairs = f"transform({wrong_pairs(labels)}, x -> x + {4 * k})"
    keys = ", ".join(f"'{c}', `{c}`" for c in by)
    rows = as_arrays(df, [f"named_struct('_', 0{', ' + keys if keys else ''}) AS g"], labels, truth, pred)
    rows = rows.selectExpr("g", f"explode(concat(array(-1), if({exact}, array(-2), array()), {cells}, {pairs})) AS e")
    counts = rows.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c"))
    counted = counts.groupBy(*([F.col("g")] if by else [])).agg(
        F.expr("coalesce(max(c) FILTER (WHERE e = -1), 0) AS n"),
        F.expr("coalesce(max(c) FILTER (WHERE e = -2), 0) AS exact"),
        F.expr(f"map_from_entries(collect_list(struct(e, c)) FILTER (WHERE e BETWEEN 0 AND {4 * k - 1})) AS m"),
        F.expr(f"array_sort(collect_list(struct(e - {4 * k} AS e, c)) FILTER (WHERE e >= {4 * k})) AS pairs"),
    )
    names, ordered = (f"array({', '.join(repr(n) for n in some)})" for some in (labels, sorted(labels)))
    at = {cell: f"coalesce(try_element_at(m, 4 * i + {x}), 0L)" for cell, x in (("tp", 0), ("fp", 1), ("none", 2), ("fn", 3))}
    tn = f"n - {at['tp']} - {at['fp']} - {at['none']} - {at['fn']}"
    cell = f"named_struct('ord', i, 'label', name, 'tp', {at['tp']}, 'fp', {at['fp']}, 'tn', {tn}, 'fn', {at['fn']})"
    a, b = f"(e.e div {k})", f"(e.e % {k})"
    ord_ = f"int({a} * {k} - {a} * ({a} + 1) div 2 + {b} - {a} - 1)"
    joint = f"named_struct('ord', {ord_}, 'label_a', get({ordered}, int({a})), 'label_b', get({ordered}, int({b})), 'n_both', e.c)"
    return counted.selectExpr(
        *[f"g.`{c}`" for c in by], "n", "exact", f"transform({names}, (name, i) -> {cell}) AS cells", f"transform(pairs, e -> {joint}) AS joint"
    )


def confusion(counted, by=()):
    """The cells as rows: ``ord, label, tp, fp, tn, fn``."""
    return counted.select(*by, F.inline("cells"))


def label_metrics(counted, by=(), rounded=False):
    """Metrics per label, with support and predicted positives."""
    final = round4 if rounded else str
    metrics = [f"{final(v)} AS {m}" for m, v in cell_metrics().items()]
    sizes = ["tp + fn AS support", "tp + fp AS predicted"]
    return confusion(counted, by).selectExpr("*", *metrics, *sizes)


def macro_sql(round_first=False):
    """SQL per metric for the unweighted mean over the labels of a tallies row."""
    final = round4 if round_first else str
    return {
        m: f"aggregate(cells, 0D, (a, c) -> a + {final(v)}) / size(cells)"
        for m, v in cell_metrics("c.").items()
    }


def pooled(counted):
    """Tallies with the cells of all labels added up, as the columns tp, fp, tn, fn."""
    return counted.selectExpr(
        "*", *[f"aggregate(cells, 0L, (a, c) -> a + c.{cell}) AS {cell}" for cell in CELLS]
    )


SUBSET_ACCURACY = ratio("exact", "n")


def macro(counted, by=(), round_first=False):
    return counted.selectExpr(*by, *[f"{v} AS {m}" for m, v in macro_sql(round_first).items()])


def micro(counted, by=()):
    """Metrics over all cells of all labels."""
    metrics = [f"{v} AS {m}" for m, v in cell_metrics().items()]
    return pooled(counted).selectExpr(*by, *CELLS, *metrics)


def subset_accuracy(counted, by=()):
    """The share of rows with every label right."""
    return counted.selectExpr(*by, "n", "exact", f"{SUBSET_ACCURACY} AS subset_accuracy")


def metrics_long(counted, by=()):
    """Every metric as ``scope, label, metric, value``."""

    def rows(scope, label, values):
        return [
            f"named_struct('scope', '{scope}', 'label', {label}, 'metric', '{m}', 'value', double({v}))"
            for m, v in values.items()
        ]

    per_label = {m: cell_metrics("c.")[m] for m in AVERAGED} | {"support": "c.tp + c.fn"}
    overall = rows("macro", "''", {m: macro_sql()[m] for m in AVERAGED})
    overall += rows("micro", "''", {m: cell_metrics()[m] for m in AVERAGED})
    overall += rows("overall", "''", {"subset_accuracy": SUBSET_ACCURACY})
    return pooled(counted).selectExpr(
        *by,
        f"""inline(concat(
            flatten(transform(cells, c -> array({", ".join(rows("label", "c.label", per_label))}))),
            array({", ".join(overall)})))""",
    )


def evaluator_report(counted):
    """Per label accuracy, F1 and error counts, and an 'overall' row.

    Overall accuracy is taken over all cells, overall F1 is the macro F1.
    """

    def row(ord, label, accuracy, f1, at):
        return f"""named_struct('ord', {ord}, 'label', {label}, 'accuracy', {accuracy}, 'f1', {f1},
            'false_positives', {at}fp, 'false_negatives', {at}fn)"""

    each = cell_metrics("c.")
    per_label = row("c.ord", "c.label", each["accuracy"], each["f1"], "c.")
    overall = row("size(cells)", "'overall'", cell_metrics()["accuracy"], macro_sql()["f1"], "")
    return pooled(counted).selectExpr(
        f"inline(concat(transform(cells, c -> {per_label}), array({overall})))"
    )


def label_totals(df, labels=LABELS):
    """Positives per label and their share of the rows in percent, in label order."""
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"count_if(`{c}` = 1)").alias(f"t{i}") for i, c in enumerate(labels)],
    )
    rows = ", ".join(
        f"named_struct('ord', {i}, 'label', '{c}', 'positives', t{i}, 'percent', {ratio(f't{i} * 100', 'n')})"
        for i, c in enumerate(labels)
    )
    return totals.selectExpr(f"inline(array({rows}))")


def class_counts(df, label_col="label", ordered=True):
    """Rows per class, largest first; rows without a class are left out."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(label_col)) if ordered else counts


def detection_rate(df, pred_col="predicted"):
    """How many rows of an all-positive set were found."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(pred_col) == 1).alias("detected"),
        F.count_if(F.col(pred_col) == 0).alias("missed"),
    )
    return counted.selectExpr(
        "*",
        f"{ratio('detected * 100', 'total')} AS detected_pct",
        f"{ratio('missed * 100', 'total')} AS missed_pct",
        f"{round4(ratio('detected', 'total'))} AS detection_rate",
    )


def category_counts(df, category="trigger", pred_col="predicted", ordered=True):
    """Detected rows per category, the raw texts as they are, largest first."""
    return class_counts(df.where(F.col(pred_col) == 1), category, ordered)


def accuracy_scores(counted, by=(), keep=("n",)):
    """The mean share of equal labels per row, from tallies: equal cells over all cells, without a second pass."""
    hits = "aggregate(cells, 0L, (a, c) -> a + c.tp + c.tn)"
    return counted.selectExpr(*by, *keep, f"{hits} / (n * size(cells)) AS mean_score")


def mean_score(df, score="score", by=()):
    """Mean score; a failed row (null) counts as 0."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(F.coalesce(F.col(score), F.lit(0.0))), F.lit(0.0)).alias("mean_score"),
    )


def answered_accuracy(counted):
    """Accuracy per label over the rows that have a prediction, 0 when none has."""
    return confusion(counted).selectExpr(
        "ord",
        "label",
        "tp + tn AS correct",
        "tp + fp + tn + fn AS total",
        f"{cell_metrics()['accuracy']} AS accuracy",
    )


def binary_report(counted):
    """Metrics, cells and the per-class report of one label (tallies with a single label)."""
    names = ("precision", "recall", "f1")
    one = cell_metrics()
    zero = {m: f"{m}0" for m in names}
    both = confusion(counted).selectExpr(
        *CELLS,
        "tp + fn AS n1",
        "tn + fp AS n0",
        *[f"{one[m]} AS {m}1" for m in ("accuracy", *names)],
        # The negative class swaps the roles of the cells.
        f"{ratio('tn', 'tn + fn')} AS precision0",
        f"{ratio('tn', 'tn + fp')} AS recall0",
        f"{ratio('2 * tn', '2 * tn + fn + fp')} AS f10",
    )

    def row(i, name, values, support):
        shown = ", ".join(f"'{m}', {values[m]}" for m in names)
        cells = ", ".join(f"'{cell}', {cell}" for cell in CELLS)
        return f"""named_struct('ord', {i}, 'class', '{name}', {shown}, 'accuracy', accuracy1,
            'support', {support}, {cells})"""

    mean = {m: f"({m}0 + {m}1) / 2" for m in names}
    weighted = {m: ratio(f"{m}0 * n0 + {m}1 * n1", "n0 + n1") for m in names}
    rows = [
        row(0, "0", zero, "n0"),
        row(1, "1", {m: f"{m}1" for m in names}, "n1"),
        row(2, "macro avg", mean, "n0 + n1"),
        row(3, "weighted avg", weighted, "n0 + n1"),
    ]
    return both.selectExpr(f"inline(array({', '.join(rows)}))")
