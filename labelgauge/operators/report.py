"""Reports: the nested run summary and the text report of a probe."""

from pyspark.sql import functions as F

from labelgauge.functions.scores import cell_metrics, ratio, round4
from labelgauge.functions.text import preview, text_stats
from labelgauge.operators.metrics import AVERAGED, SUBSET_ACCURACY, macro_sql, pooled
from labelgauge.schema import LABELS

# The wording of the probe report.
BAR, THIN_BAR = "=" * 65, "-" * 65
TITLE = "STEREOTYPE DETECTION RESULTS"
TOTAL_LINE = "Total samples      : %d"
DETECTED_LINE = "Correctly detected : %d  (%.1f%%)"
MISSED_LINE = "Missed stereotypes : %d  (%.1f%%)"
RATE_LINE = "Detection Rate     : %.4f"
CATEGORY_TITLE = "\nTrigger distribution for detected examples:"
CATEGORY_LINE = "  Trigger %s: %d"
MISSED_TITLE = "MISSED STEREOTYPES — %d examples"
TEXT_LINE = "\n[%d] TEXT: %s"
FIELD_LINES = {
    "group": "     Model's Group   : ",
    "trigger": "     Model's Trigger  : ",
    "reasoning": "     Model's Reasoning: ",
}
VERDICT_LINE = "     → TRUE LABEL: 1 (Stereotype)  |  PREDICTED: 0 (Missed)"


def run_summary(counted, config, labels=LABELS, by=()):
    """The run's constants and a nested ``metrics`` struct, one row (per approach in ``by``)."""
    means = macro_sql()
    per_label = ", ".join(
        f"'{name}', named_struct("
        + ", ".join(f"'{m}', {v}" for m, v in cell_metrics(f"cells[{i}].").items() if m in AVERAGED)
        + f", 'support', cells[{i}].tp + cells[{i}].fn)"
        for i, name in enumerate(labels)
    )
    metrics = f"""named_struct(
        'macro_f1', {means["f1"]}, 'macro_precision', {means["precision"]},
        'macro_recall', {means["recall"]}, 'micro_f1', {cell_metrics()["f1"]},
        'subset_accuracy', {SUBSET_ACCURACY}, 'per_label', named_struct({per_label}))"""
    constants = [F.lit(v).alias(k) for k, v in config.items()]
    return pooled(counted).select(*by, *constants, F.expr(metrics).alias("metrics"))


def candidate_summary(best, scores, seed, config):
    """One row on a choice of candidates: constants, the best text against its seed, the scores.

    ``best`` is the chosen candidate's row, ``scores`` the table of mean scores, ``seed`` the text
    the candidates grew from.
    """
    counted = scores.agg(
        F.count(F.lit(1)).alias("num_candidates"),
        F.coalesce(F.max("mean_score"), F.lit(0.0)).alias("best_score"),
    )
    scored = counted.select(F.struct("*")).scalar()
    stats = text_stats(F.col("body"), F.lit(seed))
    df = best.select("body", scored.alias("scored"))
    return df.select(
        *[F.lit(v).alias(k) for k, v in config.items()],
        F.lit(len(seed)).alias("seed_prompt_length"),
        stats["n_chars"].alias("optimized_prompt_length"),
        stats["expansion_ratio"].alias("expansion_ratio"),
        stats["markers_removed"].alias("expand_markers_removed"),
        "scored.*",
    )


def _line(section, line, ord=None, tie=None, part=0):
    return F.struct(
        F.lit(section).alias("section"),
        (F.lit(0) if ord is None else ord).cast("long").alias("ord"),
        (F.lit("") if tie is None else tie).alias("tie"),
        F.lit(part).alias("part"),
        line.alias("line"),
    )


def probe_report(results, notes="", id_col="id"):
    """The report as rows ``section, ord, tie, part, line``; in that order they are the text.

    Every missed row has its block, so the report is a table as large as there are misses.
    ``notes`` is the caller's explanation, put before the blocks. The input is read once: totals, categories
    and blocks are the grouping sets of one aggregate, in which only missed rows carry a text.
    """
    hit, miss = F.col("predicted") == 1, F.col("predicted") == 0
    shown = F.struct(F.col(id_col).alias("id"), preview("text", 200).alias("text"), *FIELD_LINES)
    rows = results.select(
        "predicted", F.when(hit, F.struct(F.col("trigger").alias("name"))).alias("category"), F.when(miss, shown).alias("block"),
        F.lit(1).alias("real"),
    )
    # a row that counts for nothing, so that an empty table has its totals too
    rows = rows.unionByName(results.sparkSession.range(1).select(), allowMissingColumns=True)
    counted = rows.groupingSets([[], ["category"], ["block"]], "category", "block").agg(
        F.count("real").alias("n"), F.count_if(hit).alias("detected"), F.count_if(miss).alias("missed"),
        F.grouping_id().alias("kind"),
    )
    kind, total = F.col("kind"), F.col("n")
    percent = {c: F.coalesce(F.try_divide(F.col(c) * 100.0, total), F.lit(0.0)) for c in ("detected", "missed")}
    rate = F.expr(round4(ratio("detected", "n")))
    any_missed = F.col("missed") > 0
    head = [
        _line(0, F.lit(BAR), part=0),
        _line(0, F.lit(TITLE), part=1),
        _line(0, F.lit(BAR), part=2),
        _line(0, F.format_string(TOTAL_LINE, total), part=3),
        _line(0, F.format_string(DETECTED_LINE, "detected", percent["detected"]), part=4),
        _line(0, F.format_string(MISSED_LINE, "missed", percent["missed"]), part=5),
        _line(0, F.format_string(RATE_LINE, rate), part=6),
        _line(1, F.lit(CATEGORY_TITLE), part=0),
        _line(3, F.when(any_missed, f"\n{BAR}"), part=0),
        _line(3, F.when(any_missed, F.format_string(MISSED_TITLE, "missed")), part=1),
        _line(3, F.when(any_missed, BAR), part=2),
        _line(3, F.when(any_missed, F.lit(notes)), part=3),
        _line(3, F.when(any_missed, THIN_BAR), part=4),
    ]
    name = F.coalesce("category.name", F.lit(""))
    known = F.col("category.name").isNotNull()
    categories = [_line(2, F.when(known, F.format_string(CATEGORY_LINE, name, total)), ord=-total, tie=name)]
    first = F.format_string(TEXT_LINE, (F.col("block.id") + 1).cast("long"), "block.text")
    fields = [F.when(F.col(f"block.{f}") != "", F.concat(F.lit(start), F.col(f"block.{f}"))) for f, start in FIELD_LINES.items()]
    block = [_line(4, x, ord=F.col("block.id"), part=i) for i, x in enumerate([first, *fields, F.lit(VERDICT_LINE)])]
    # rows that are equal in all that is shown have a block each
    copies = F.flatten(F.array_repeat(F.array(*block), total.cast("int")))
    # the bits of the kind tell which columns a row is a total over: category, then block
    lines = (
        F.when(kind == 3, F.array(*head))
        .when((kind == 1) & F.col("category").isNotNull(), F.array(*categories))
        .when((kind == 2) & F.col("block").isNotNull(), copies)
    )
    return counted.select(F.inline(lines)).where("line is not null")


REPORT_ORDER = ("section", "ord", "tie", "part")
