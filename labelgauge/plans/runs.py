"""The three whole runs: multi-label evaluation, all-positive probe, candidate choice.

Each takes tables and gives tables; nothing is computed before a result is asked for. Decoding
feeds several results: with a ``store`` path in the shared folder the decoded rows are written
there once, without one they are decoded anew for each result.
"""

from pyspark.sql import functions as F

from labelgauge.functions.decode import (
    decode_fenced_json,
    decode_probe,
    decode_six_lines,
    kept_reply,
    with_defaults,
)
from labelgauge.functions.scores import row_accuracy
from labelgauge.operators.align import score_stored_replies
from labelgauge.operators.candidates import best_by_score, is_valid, passing_or_all
from labelgauge.operators.clean import drop_empty_text, first_of_each_text
from labelgauge.operators.errors import missed_rows
from labelgauge.operators.metrics import (
    accuracy_scores,
    category_counts,
    detection_rate,
    label_metrics,
    macro,
    metrics_long,
    tallies,
)
from labelgauge.schema import LABELS
from labelgauge.sources.writers import stored

PREDICTED = [f"pred_{name}" for name in LABELS]


def multilabel_run(rows, replies, store=None):
    """Stored six-line replies against multi-label truth."""
    decoded = score_stored_replies(rows, replies, decode_six_lines)
    predictions = with_defaults(decoded, PREDICTED).withColumn(
        "raw_model_output", kept_reply(F.col("raw_response"))
    )
    predictions = stored(predictions.drop("raw_response"), store)
    counted = tallies(predictions)
    return {
        "predictions": predictions,
        "failures": predictions.agg(F.sum("failed_cells").alias("parse_failures")),
        "metrics": label_metrics(counted, rounded=True),
        "macro": macro(counted, round_first=True),
    }


def probe_run(positives, replies, store=None):
    """Stored yes/no replies on a set in which every row is positive."""
    positives = first_of_each_text(drop_empty_text(positives), ["id"])
    decoded = score_stored_replies(positives, replies, decode_probe)
    results = with_defaults(decoded, ["predicted"]).withColumn(
        "raw_output", kept_reply(F.col("raw_response"), "ERROR")
    )
    results = stored(results.drop("raw_response"), store)
    return {
        "results": results,
        "rate": detection_rate(results),
        "triggers": category_counts(results),
        "missed": missed_rows(results),
    }


def candidate_run(rows, candidates, replies, store=None):
    """Stored fenced-JSON replies of several candidates; scores, the choice and its metrics.

    ``replies`` has ``candidate_id, id, raw_response``: the product of candidates and rows is
    already in it, so scoring is an equi-join by row id.
    """
    decoded = decode_fenced_json(replies, "raw_response").join(rows, "id")
    pairs = [(name, f"pred_{name}") for name in LABELS]
    scored = stored(decoded.withColumn("score", row_accuracy(pairs)), store)
    counted = tallies(scored, by=["candidate_id"])
    scores = accuracy_scores(counted, ["candidate_id"])
    valid = passing_or_all(candidates, is_valid(F.col("body")))
    best = best_by_score(
        valid.join(scores, "candidate_id", "left"), F.coalesce(F.col("mean_score"), F.lit(0.0))
    )
    # scores, choice and metrics all come from one table with a row per candidate
    order = F.struct(F.coalesce("mean_score", F.lit(0.0)).alias("s"), (-F.col("candidate_id")).alias("i"))
    figures = ["n", "exact", "cells", "joint"]
    ranked = valid.select("candidate_id").join(accuracy_scores(counted, ["candidate_id"], figures), "candidate_id", "left")
    chosen = ranked.agg(F.max_by(F.struct(*figures), order).alias("c")).select("c.*").where("n > 0")
    return {
        "scored": scored,
        "scores": scores,
        "best": best,
        "metrics": metrics_long(chosen),
    }
