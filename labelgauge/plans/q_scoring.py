"""Queries: reply decoding, batch scoring, row scores, metrics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.functions import decode, scores
from labelgauge.functions.labels import answer_string, yes_value
from labelgauge.functions.text import user_prompt
from labelgauge.operators import align as alignment
from labelgauge.operators import batch, metrics
from labelgauge.operators.candidates import is_valid, passing_or_all
from labelgauge.operators.split import train_val_split
from labelgauge.plans import tables
from labelgauge.plans.registry import (
    BINARY,
    LABELLED,
    METRICS,
    PROBE,
    SIX,
    bits,
    query,
    rounded,
)
from labelgauge.plans.runs import PREDICTED
from labelgauge.schema import LABELS
from labelgauge.session import shared_dir



def pairs():
    return [(c, f"pred_{c}") for c in LABELS]


# --- reply decoding: the oracle states the bits the replies were made from ---------------------


@query(f"""WITH {SIX} SELECT id,
  p_stereotype AS pred_stereotype,
  p_vilification AS pred_vilification, p_dehumanization AS pred_dehumanization,
  CASE WHEN id % 6 < 5 THEN p_extreme_language END AS pred_extreme_language,
  CASE WHEN id % 6 < 5 THEN p_lack_of_empathy END AS pred_lack_of_empathy,
  CASE WHEN id % 6 < 5 THEN p_invalidation END AS pred_invalidation
FROM six""")
def six_line_decoder(spark, sf):
    df = decode.decode_six_lines(tables.six_line_replies(spark, sf), "raw_response")
    return df.select("id", *PREDICTED)


@query(f"""WITH {SIX} SELECT id, id % 6 < 4 AS parse_ok, {bits("id % 6 < 4")} FROM six""")
def fenced_json_decoder(spark, sf):
    df = decode.decode_fenced_json(tables.fenced_replies(spark, sf), "raw_response")
    return df.select("id", "parse_ok", *PREDICTED)


@query(f"""WITH {SIX} SELECT id, id % 6 < 5 AS parse_ok, {bits("id % 6 < 5")} FROM six""")
def braced_json_decoder(spark, sf):
    df = decode.decode_braced_json(tables.braced_replies(spark, sf), "raw_response")
    return df.select("id", "parse_ok", *PREDICTED)


@query(f"""WITH {LABELLED} SELECT id, CASE WHEN id % 13 = 0 THEN NULL
  ELSE (ARRAY[1, 1, 0, 1, NULL])[n_chars % 5 + 1]::INTEGER END AS predicted FROM labelled""")
def yes_no_decoder(spark, sf):
    df = tables.probe_replies(spark, sf)
    return df.select("id", decode.yes_no(F.col("raw_response")).alias("predicted"))


@query(f"""WITH {LABELLED} SELECT id, CASE WHEN id % 13 = 0 THEN '' ELSE source END AS "group",
  CASE WHEN id % 13 = 0 THEN '' WHEN id % 7 = 0 THEN 'Reasoning: ' || trim(split_part(text, chr(10), 1))
    ELSE lang END AS trigger,
  CASE WHEN id % 13 = 0 THEN '' ELSE trim(split_part(text, chr(10), 1)) END AS reasoning
FROM labelled""")
def field_extraction(spark, sf):
    df = decode.decode_probe(tables.probe_replies(spark, sf), "raw_response")
    return df.select("id", "group", "trigger", "reasoning")


@query("""SELECT doc_id AS id,
  (ARRAY[1, 0, NULL, NULL, 1])[doc_id % 5 + 1]::INTEGER AS predicted FROM documents""")
def first_word_decoder(spark, sf):
    word = tables._pick(F.col("id") % 5, ("  YES\n", "no ", "Yes, ", "", "\tyes\t"))
    reply = F.when(F.col("id") % 5 == 3, F.lit(" \n")).otherwise(F.concat(word, F.col("text")))
    reply = F.when(F.col("id") % 5 == 2, F.concat(F.lit("Yes, "), "text")).otherwise(reply)
    df = tables.documents(spark, sf)
    return df.select("id", decode.first_word_yes_no(reply).alias("predicted"))


@query("""SELECT doc_id AS id, (ARRAY[1, 1, 1, 1, 0, 0, 0])[doc_id % 7 + 1]::INTEGER AS trimmed,
  (ARRAY[1, 1, 1, 0, 0, 0, 0])[doc_id % 7 + 1]::INTEGER AS untrimmed FROM documents""")
def yes_value_normaliser(spark, sf):
    raw = tables._pick(F.col("id") % 7, ("1", "True", "true", " 1\n", "TRUE", "1.0", None))
    df = tables.documents(spark, sf)
    return df.select(
        "id", yes_value(raw).alias("trimmed"), yes_value(raw, trim=False).alias("untrimmed")
    )


@query(f"""WITH {SIX} SELECT id, p_stereotype AS pred_stereotype,
  p_vilification AS pred_vilification, p_dehumanization AS pred_dehumanization,
  CASE WHEN id % 6 < 5 THEN p_extreme_language ELSE 0 END AS pred_extreme_language,
  CASE WHEN id % 6 < 5 THEN p_lack_of_empathy ELSE 0 END AS pred_lack_of_empathy,
  CASE WHEN id % 6 < 5 THEN p_invalidation ELSE 0 END AS pred_invalidation,
  CASE WHEN id % 6 = 5 THEN 3 ELSE 0 END AS failed_cells
FROM six""")
def defaulted_predictions(spark, sf):
    df = decode.decode_six_lines(tables.six_line_replies(spark, sf), "raw_response")
    return decode.with_defaults(df, PREDICTED).select("id", *PREDICTED, "failed_cells")


@query(f"""WITH {LABELLED}, {SIX}, probe AS (SELECT count(*) FILTER (id % 13 = 0 OR n_chars % 5 = 4)
  AS row_failures, count(*) FILTER (id % 13 = 0) AS sentinels FROM labelled)
SELECT row_failures, sentinels,
  (SELECT sum(CASE WHEN id % 6 = 5 THEN 3 ELSE 0 END)::BIGINT FROM six) AS cell_failures FROM probe""")
def failure_counts(spark, sf):
    lines = decode.decode_six_lines(tables.six_line_replies(spark, sf), "raw_response")
    cells = decode.with_defaults(lines, PREDICTED).agg(F.sum("failed_cells")).scalar()
    probe = decode.decode_probe(tables.probe_replies(spark, sf), "raw_response")
    probe = decode.with_defaults(probe, ["predicted"])
    kept = decode.kept_reply(F.col("raw_response"), "ERROR")
    counts = probe.agg(
        F.sum("failed_cells").alias("row_failures"),
        F.count_if(kept == "ERROR").alias("sentinels"),
    )
    return counts.withColumn("cell_failures", cells)


# --- batch scoring ------------------------------------------------------------------------------


def length_model(labels):
    """A stand-in model: labels by the length of the text, and no answer for some lengths."""
    start = len("Classify:\n")

    def model(prompt):
        n = len(prompt) - start
        if n % 10 == 0:
            raise ValueError("no answer")
        values = (n % 4 == 0, n % 7 < 2, n % 3 == 1, n % 6 == 0, n % 5 < 2, n % 2 == 0)
        shown = ", ".join(f'"{c}": {int(v)}' for c, v in zip(labels, values))
        return "```json\n{" + shown + "}\n```"

    return model


@query(f"""WITH {LABELLED} SELECT id, n_chars % 10 = 0 AS failed,
  CASE WHEN n_chars % 10 = 0 THEN '<ERROR: no answer>' END AS error,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 4 = 0 THEN 1 ELSE 0 END AS pred_stereotype,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 7 < 2 THEN 1 ELSE 0 END AS pred_vilification,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 3 = 1 THEN 1 ELSE 0 END AS pred_dehumanization,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 6 = 0 THEN 1 ELSE 0 END AS pred_extreme_language,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 5 < 2 THEN 1 ELSE 0 END AS pred_lack_of_empathy,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 2 = 0 THEN 1 ELSE 0 END AS pred_invalidation
FROM labelled""")
def model_batch(spark, sf):
    rows = tables.labelled(spark, sf).select("id", user_prompt(F.col("text")).alias("prompt"))
    answered = batch.score_batch(rows, length_model(LABELS))
    df = decode.decode_fenced_json(answered, "raw_response")
    error = F.when(F.col("failed"), F.col("raw_response")).alias("error")
    return df.select("id", "failed", error, *PREDICTED)


def source_candidates(spark, sf):
    """A candidate per source of the documents, numbered by name, with texts of several lengths."""
    named = tables.documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy("source")) - 1  # a row per source
    body = F.concat(
        F.lit("Return JSON for texts of "), "source", F.lit(" with stereotype and all other labels."),
        F.repeat(F.lit(" Be exact."), place % 7), F.lit(" Give every label the value 0 or 1 and nothing else."),
    )
    return named.select(place.cast("int").alias("candidate_id"), body.alias("body"))


GRID_HITS = " + ".join(
    f"CASE WHEN {c} = (CASE WHEN n % 10 > 0 AND {p} THEN 1 ELSE 0 END) THEN 1 ELSE 0 END"
    for c, p in zip(LABELS, ("n % 4 = 0", "n % 7 < 2", "n % 3 = 1", "n % 6 = 0", "n % 5 < 2", "n % 2 = 0"))
)


@query(f"""WITH {SIX}, c AS (SELECT (row_number() OVER (ORDER BY source) - 1)::INTEGER AS candidate_id, source
  FROM (SELECT DISTINCT source FROM documents)),
b AS (SELECT candidate_id, 'Return JSON for texts of ' || source || ' with stereotype and all other labels.' ||
  repeat(' Be exact.', candidate_id % 7) || ' Give every label the value 0 or 1 and nothing else.' AS body FROM c),
g AS (SELECT candidate_id, body, {", ".join(f"t_{c} AS {c}" for c in LABELS)},
  length(body) + 2 + length(text) AS n FROM six, b),
s AS (SELECT candidate_id, body, count(*) AS n, avg(({GRID_HITS}) / 6.0) AS mean_score FROM g GROUP BY candidate_id, body),
v AS (SELECT *, length(body) >= 100 AS ok, bool_or(length(body) >= 100) OVER () AS any_ok FROM s)
SELECT candidate_id, n, round(mean_score, 6) AS mean_score,
  candidate_id = first_value(candidate_id) OVER (ORDER BY ok OR NOT any_ok DESC, round(mean_score, 9) DESC, candidate_id) AS chosen
FROM v""")
def candidate_batch(spark, sf):
    """Many candidates on all rows, from requests to the choice: prompts, replies, decoding, scores, best."""
    rows, bodies = tables.truth_only(spark, sf), source_candidates(spark, sf)
    done = batch.evaluate_candidates(rows, bodies, length_model(LABELS), decode.decode_fenced_json)
    scored = metrics.mean_score(done, by=["candidate_id"])
    valid = passing_or_all(bodies.select("candidate_id", "body"), is_valid(F.col("body")))
    ranked = valid.select("candidate_id").join(scored, "candidate_id")
    best = F.max_by("candidate_id", F.struct(F.round("mean_score", 9).alias("s"), (-F.col("candidate_id")).alias("i")))
    chosen = ranked.agg(best.alias("best")).scalar()
    return rounded(scored.withColumn("chosen", F.col("candidate_id") == chosen), "mean_score")


@query(f"""WITH {LABELLED} SELECT id, 1::BIGINT AS n_answers, n_chars % 10 = 0 AS failed,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 4 = 0 THEN 1 ELSE 0 END AS pred_stereotype,
  CASE WHEN n_chars % 10 > 0 AND n_chars % 2 = 0 THEN 1 ELSE 0 END AS pred_invalidation FROM labelled""")
def resumed_scoring(spark, sf):
    """Half of the rows scored, then all of them: the second run asks for what the first has not stored."""
    rows = tables.labelled(spark, sf).select("id", user_prompt(F.col("text")).alias("prompt"))
    path, model = shared_dir(spark, "replies"), length_model(LABELS)
    batch.score_resumable(rows.where("id % 2 = 0"), model, path, batches=3)
    answered = batch.score_resumable(rows, model, path, batches=3)
    df = decode.decode_fenced_json(answered, "raw_response")
    return df.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_answers"), F.bool_or("failed").alias("failed"),
        *[F.max(c).alias(c) for c in ("pred_stereotype", "pred_invalidation")],
    )


@query(f"""WITH {SIX} SELECT id, {bits("id % 6 < 4")},
  {", ".join(f"t_{c} AS {c}" for c in LABELS)} FROM six""")
def stored_reply_scoring(spark, sf):
    df = alignment.score_stored_replies(
        tables.truth_only(spark, sf),
        tables.fenced_replies(spark, sf),
        decode.decode_fenced_json,
    )
    return df.select("id", *LABELS, *PREDICTED)


# --- alignment and row scores -------------------------------------------------------------------


def some_predictions(spark, sf):
    """Predictions for all labelled documents but every eighth."""
    return tables.six(spark, sf).where("id % 8 > 0").select("id", *PREDICTED)


@query(f"WITH {SIX} SELECT id, {bits('id % 8 > 0')} FROM six")
def aligned_with_default(spark, sf):
    df = alignment.align(tables.truth_only(spark, sf), some_predictions(spark, sf))
    return df.select("id", *PREDICTED)


@query(f"WITH {SIX} SELECT id, {bits()} FROM six WHERE id % 8 > 0")
def aligned_with_skip(spark, sf):
    truth, predicted = tables.truth_only(spark, sf), some_predictions(spark, sf)
    return alignment.align(truth, predicted, missing="skip").select("id", *PREDICTED)


MATCHES = " + ".join(f"CASE WHEN t_{c} = p_{c} THEN 1 ELSE 0 END" for c in LABELS)
HITS = " + ".join(f"t_{c} * p_{c}" for c in LABELS)


@query(f"WITH {SIX} SELECT id, round(({MATCHES})::DOUBLE / 6, 6) AS accuracy FROM six")
def instance_accuracy(spark, sf):
    df = tables.six(spark, sf).select("id", scores.row_accuracy(pairs()).alias("accuracy"))
    return rounded(df, "accuracy")


@query(f"WITH {SIX} SELECT id, round(({HITS})::DOUBLE / 6, 6) AS macro_f1 FROM six")
def instance_macro_f1(spark, sf):
    df = tables.six(spark, sf).select("id", scores.row_macro_f1(pairs()).alias("macro_f1"))
    return rounded(df, "macro_f1")


@query(f"""WITH {SIX} SELECT id, round(0.4::DOUBLE * ({MATCHES}) / 6
  + 0.6::DOUBLE * least(sqrt(length(text)::DOUBLE / 8000), 1), 6) AS score FROM six""")
def composite_score(spark, sf):
    score = scores.composite(scores.row_accuracy(pairs()), F.length("text"))
    return rounded(tables.six(spark, sf).select("id", score.alias("score")), "score")


GOLD = " || ', ' || ".join(f"'{c}=' || t_{c}" for c in LABELS)
GIVEN = " || ', ' || ".join(f"'{c}=' || p_{c}" for c in LABELS)


@query(f"""WITH {SIX}, said AS (SELECT id, {GOLD} AS answer,
  'So: ' || {GIVEN} || chr(10) || text AS reply FROM six)
SELECT id, CASE WHEN contains(reply, answer) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
  'Expected: ' || answer || chr(10) || 'Got: ' || reply AS feedback FROM said""")
def contained_answer_score(spark, sf):
    replies = tables.answer_replies(spark, sf).select("id", "raw_response")
    df = tables.truth_only(spark, sf).join(replies, "id")
    answer, reply = answer_string({c: c for c in LABELS}), F.col("raw_response")
    return df.select(
        "id",
        scores.answer_contained(answer, reply).alias("score"),
        scores.feedback(answer, reply).alias("feedback"),
    )


# --- metrics ------------------------------------------------------------------------------------


def counted(spark, sf):
    return metrics.tallies(tables.six(spark, sf))


@query(f"{METRICS} SELECT label, support::BIGINT AS positives FROM per_label")
def label_totals(spark, sf):
    return metrics.label_totals(tables.truth_only(spark, sf)).select("label", "positives")


@query(f"""{METRICS} SELECT label, support::BIGINT AS positives,
  round(100.0::DOUBLE * support / n, 6) AS percent FROM per_label""")
def label_distribution(spark, sf):
    df = metrics.label_totals(tables.truth_only(spark, sf))
    return rounded(df.select("label", "positives", "percent"), "percent")


@query("SELECT source AS label, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, label")
def class_counts(spark, sf):
    df = tables.documents(spark, sf).withColumnRenamed("source", "label")
    return metrics.class_counts(df)


@query(f"""{METRICS} SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn,
  fn::BIGINT AS fn FROM cells""")
def confusion_cells(spark, sf):
    return metrics.confusion(counted(spark, sf)).drop("ord")


RATIOS = ("accuracy", "precision", "recall", "f1")


@query(f"""{METRICS} SELECT label, {", ".join(f"round({m}, 6) AS {m}" for m in RATIOS)}
FROM per_label""")
def label_metrics(spark, sf):
    df = metrics.label_metrics(counted(spark, sf)).select("label", *RATIOS)
    return rounded(df, *RATIOS)


FOUR = {m: f"round_even({m} * 10000, 0) / 10000" for m in (*RATIOS, "weighted_f1")}


@query(f"""{METRICS} SELECT label, {", ".join(f"{x} AS {m}" for m, x in FOUR.items())} FROM per_label""")
def label_metrics_rounded(spark, sf):
    df = metrics.label_metrics(counted(spark, sf), rounded=True)
    return df.select("label", *FOUR)


@query(f"{METRICS} SELECT label, support::BIGINT AS support FROM per_label")
def label_support(spark, sf):
    return metrics.label_metrics(counted(spark, sf)).select("label", "support")


@query(f"{METRICS} SELECT label, round(weighted_f1, 6) AS weighted_f1 FROM per_label")
def weighted_f1(spark, sf):
    df = metrics.label_metrics(counted(spark, sf)).select("label", "weighted_f1")
    return rounded(df, "weighted_f1")


ALL_FIVE = (*RATIOS, "weighted_f1")


@query(f"{METRICS} SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in ALL_FIVE)} FROM per_label")
def macro_average(spark, sf):
    return rounded(metrics.macro(counted(spark, sf)).select(*ALL_FIVE), *ALL_FIVE)


@query(f"""{METRICS} SELECT {", ".join(f"round(avg({x}), 6) AS {m}" for m, x in FOUR.items())}
FROM per_label""")
def macro_average_of_rounded(spark, sf):
    df = metrics.macro(counted(spark, sf), round_first=True)
    return rounded(df.select(*ALL_FIVE), *ALL_FIVE)


@query(f"""{METRICS} SELECT tp, fp, tn, fn, {", ".join(f"round({m}, 6) AS {m}" for m in ALL_FIVE)}
FROM micro""")
def micro_average(spark, sf):
    df = metrics.micro(counted(spark, sf))
    return rounded(df.select("tp", "fp", "tn", "fn", *ALL_FIVE), *ALL_FIVE)


EXACT = " AND ".join(f"t_{c} = p_{c}" for c in LABELS)


@query(f"""WITH {SIX} SELECT count(*) AS n, count(*) FILTER ({EXACT}) AS exact,
  round(count(*) FILTER ({EXACT})::DOUBLE / count(*), 6) AS subset_accuracy FROM six""")
def subset_accuracy(spark, sf):
    df = metrics.subset_accuracy(counted(spark, sf))
    return rounded(df, "subset_accuracy")


@query(f"{METRICS} SELECT label, predicted::BIGINT AS predicted FROM per_label")
def predicted_positives(spark, sf):
    return metrics.label_metrics(counted(spark, sf)).select("label", "predicted")


@query(f"""{PROBE}, c AS (SELECT count(*) AS total, count(*) FILTER (predicted = 1) AS detected,
  count(*) FILTER (predicted = 0) AS missed FROM probe)
SELECT total, detected, missed, round(100.0::DOUBLE * detected / total, 6) AS detected_pct,
  round(100.0::DOUBLE * missed / total, 6) AS missed_pct,
  round_even(detected::DOUBLE / total * 10000, 0) / 10000 AS detection_rate FROM c""")
def detection_rate(spark, sf):
    df = metrics.detection_rate(tables.probe_results(spark, sf))
    return rounded(df, "detected_pct", "missed_pct")


@query(f"""{PROBE} SELECT trigger, count(*) AS n FROM probe WHERE predicted = 1
GROUP BY trigger ORDER BY n DESC, trigger""")
def category_distribution(spark, sf):
    return metrics.category_counts(tables.probe_results(spark, sf))


@query(f"""WITH {SIX} SELECT count(*) AS n, round(avg(CASE WHEN id % 6 < 4
  THEN ({MATCHES})::DOUBLE / 6 ELSE 0 END), 6) AS mean_score FROM six""")
def mean_score(spark, sf):
    score = F.when(F.col("id") % 6 < 4, scores.row_accuracy(pairs()))
    df = tables.six(spark, sf).select(score.alias("score"))
    return rounded(metrics.mean_score(df), "mean_score")


@query(f"""WITH {SIX}, ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS pos FROM six)
SELECT count(*) AS n, round(avg(({MATCHES})::DOUBLE / 6), 6) AS mean_score FROM ranked WHERE pos <= 3""")
def smoke_mean_score(spark, sf):
    df = train_val_split(tables.six(spark, sf), 3, 0)
    df = df.select(scores.row_accuracy(pairs()).alias("score"))
    return rounded(metrics.mean_score(df), "mean_score")


@query(f"""{METRICS}, answered AS (SELECT * FROM long WHERE id % 8 > 0)
SELECT label, count(*) FILTER (t = p) AS correct, count(*) AS total,
  round(count(*) FILTER (t = p)::DOUBLE / count(*), 6) AS accuracy FROM answered GROUP BY label""")
def answered_accuracy(spark, sf):
    df = alignment.align(
        tables.truth_only(spark, sf), some_predictions(spark, sf), missing="null"
    )
    result = metrics.answered_accuracy(metrics.tallies(df)).drop("ord")
    return rounded(result, "accuracy")


@query(f"""{BINARY}, c AS (
  SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp,
    count(*) FILTER (label = 0 AND predicted = 1) AS fp,
    count(*) FILTER (label = 0 AND predicted = 0) AS tn,
    count(*) FILTER (label = 1 AND predicted = 0) AS fn FROM results),
classes AS (
  SELECT '1' AS class, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
    2.0 * tp::DOUBLE / (2 * tp + fp + fn) AS f1, tp + fn AS support FROM c
  UNION ALL SELECT '0', tn::DOUBLE / (tn + fn), tn::DOUBLE / (tn + fp),
    2.0 * tn::DOUBLE / (2 * tn + fp + fn), tn + fp FROM c),
report AS (
  SELECT * FROM classes
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM classes
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT
    FROM classes)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, support, tp, fp, tn, fn
FROM report, c""")
def binary_report(spark, sf):
    renamed = tables.binary_results(spark, sf).withColumnRenamed("predicted", "pred_label")
    df = metrics.binary_report(metrics.tallies(renamed, ["label"])).drop("ord")
    return rounded(df, "precision", "recall", "f1", "accuracy")


@query(f"""{METRICS}
SELECT label, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, fp::BIGINT AS false_positives,
  fn::BIGINT AS false_negatives FROM per_label
UNION ALL SELECT 'overall', round(m.accuracy, 6), round((SELECT avg(f1) FROM per_label), 6), m.fp, m.fn
FROM micro m""")
def evaluator_report(spark, sf):
    df = metrics.evaluator_report(counted(spark, sf)).drop("ord")
    return rounded(df, "accuracy", "f1")


LONG_METRICS = " UNION ALL ".join(
    [f"SELECT 'label' AS scope, label, '{m}' AS metric, {m}::DOUBLE AS value FROM per_label"
     for m in (*RATIOS, "support")]
    + [f"SELECT 'macro', '', '{m}', avg({m}) FROM per_label" for m in RATIOS]
    + [f"SELECT 'micro', '', '{m}', {m} FROM micro" for m in RATIOS]
    + [f"SELECT 'overall', '', 'subset_accuracy', count(*) FILTER ({EXACT})::DOUBLE / count(*) FROM six"]
)


@query(f"{METRICS} SELECT scope, label, metric, round(value, 6) AS value FROM ({LONG_METRICS})")
def all_metrics(spark, sf):
    return rounded(metrics.metrics_long(counted(spark, sf)), "value")
