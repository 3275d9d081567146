"""Queries: error mining, top-k, candidates, comparison, whole runs."""

from pyspark.sql import functions as F

from labelgauge.functions.scores import row_accuracy
from labelgauge.functions.text import system_prompt
from labelgauge.operators import batch, errors, metrics
from labelgauge.operators import candidates as cand
from labelgauge.operators.report import candidate_summary as summary_of_candidates
from labelgauge.operators.report import run_summary
from labelgauge.operators.split import first_k, lowest_k
from labelgauge.plans import runs, tables
from labelgauge.plans.registry import (
    BINARY,
    CANDIDATES,
    LABELLED,
    METRICS,
    PROBE,
    SIX,
    query,
    rounded,
)
from labelgauge.schema import LABELS

MATCHES = " + ".join(f"CASE WHEN t_{c} = p_{c} THEN 1 ELSE 0 END" for c in LABELS)


def score():
    return row_accuracy([(c, f"pred_{c}") for c in LABELS])


def counted(spark, sf):
    return metrics.tallies(tables.six(spark, sf))


def answered(spark, sf):
    """The six-label view with a reply per row."""
    return tables.six(spark, sf).withColumn("raw_response", F.concat(F.lit("reply to "), "source"))


# --- trajectories and errors per row ------------------------------------------------------------

BIT_STRING = " || ".join(f"p_{c}" for c in LABELS)
TRUTH_STRING = " || ".join(f"t_{c}" for c in LABELS)


@query(f"""WITH {SIX} SELECT id, text AS input_text, 'reply to ' || source AS raw_response,
  {BIT_STRING} AS prediction, {TRUTH_STRING} AS ground_truth,
  round(({MATCHES})::DOUBLE / 6, 6) AS score FROM six""")
def trajectory_table(spark, sf):
    df = errors.trajectories(answered(spark, sf))
    flat = {
        side: F.concat(*[F.col(f"{side}.{c}").cast("string") for c in LABELS])
        for side in ("prediction", "ground_truth")
    }
    return rounded(df.withColumns(flat), "score")


@query(f"WITH {SIX} SELECT id, round(({MATCHES})::DOUBLE / 6, 6) AS score, {BIT_STRING} AS prediction FROM six")
def evaluation_without_traces(spark, sf):
    df = batch.evaluation(tables.six(spark, sf))
    flat = F.concat(*[F.col(f"prediction.{c}").cast("string") for c in LABELS])
    return rounded(df.withColumn("prediction", flat), "score")


WRONG_LIST = ", ".join(
    f"CASE WHEN t_{c} = p_{c} THEN NULL WHEN t_{c} = 1 THEN '{c}: MISSED' ELSE '{c}: FALSE ALARM' END"
    for c in LABELS
)
ERRORS_TEXT = f"coalesce(nullif(concat_ws('|', {WRONG_LIST}), ''), '(all correct)')"


@query(f"WITH {SIX} SELECT id, {ERRORS_TEXT} AS per_label_errors FROM six")
def label_error_lists(spark, sf):
    df = tables.six(spark, sf)
    return df.select("id", F.array_join(errors.error_list(), "|").alias("per_label_errors"))


@query(f"""{METRICS} SELECT a.id, a.label AS label_a, b.label AS label_b
FROM long a JOIN long b ON a.id = b.id AND a.label < b.label
WHERE a.t <> a.p AND b.t <> b.p""")
def error_pairs(spark, sf):
    return errors.error_pairs(tables.six(spark, sf))


@query(f"""{METRICS} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n_both
FROM long a JOIN long b ON a.id = b.id AND a.label < b.label
WHERE a.t <> a.p AND b.t <> b.p GROUP BY a.label, b.label""")
def error_pair_counts(spark, sf):
    return errors.pair_counts(counted(spark, sf))


KINDS = """kinds AS (
  SELECT ord, 0 AS kind_ord, label, 'FN' AS kind, fn::BIGINT AS n_errors FROM cells WHERE fn > 0
  UNION ALL SELECT ord, 1, label, 'FP', fp::BIGINT FROM cells WHERE fp > 0),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_errors DESC, ord, kind_ord) AS rank FROM kinds)"""


@query(f"{METRICS}, {KINDS} SELECT label, kind, n_errors FROM kinds")
def error_counts(spark, sf):
    return errors.error_counts(counted(spark, sf))


@query(f"{METRICS}, {KINDS} SELECT rank::INTEGER AS rank, label, kind, n_errors FROM ranked WHERE rank <= 4")
def most_frequent_errors(spark, sf):
    return errors.most_frequent_errors(counted(spark, sf), 4)


@query(f"""{METRICS} SELECT (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS ord,
  'Section 5: ' || label || ' (FP=' || fp || ', FN=' || fn || ')' AS line
FROM cells WHERE fp + fn > 0""")
def underspecified_labels(spark, sf):
    return errors.underspecified(counted(spark, sf))


PAIR_COUNTS = """pair_counts AS (
  SELECT a.label AS label_a, b.label AS label_b, count(*) AS n
  FROM long a JOIN long b ON a.id = b.id AND a.label < b.label
  WHERE a.t <> a.p AND b.t <> b.p GROUP BY a.label, b.label),
worst AS (SELECT * FROM pair_counts ORDER BY n DESC, label_a, label_b LIMIT 1)"""


PLAN_LINES = """lines AS (
  SELECT rank AS o, 'Section 5' || substring('abcdef', ord + 1, 1) || ' (' || label ||
    '): expand definition + markers — ' || n_errors || ' errors' AS line FROM ranked WHERE rank <= 4
  UNION ALL SELECT 5, 'Section 9: add rule distinguishing ' || label_a || ' vs ' || label_b FROM worst
  UNION ALL SELECT 6, 'Section 11: add examples for labels with errors'
    WHERE EXISTS (SELECT * FROM kinds))"""


@query(f"""{METRICS}, {KINDS}, {PAIR_COUNTS}, {PLAN_LINES}
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS ord, line FROM lines""")
def expansion_plan(spark, sf):
    return errors.expansion_plan(counted(spark, sf))


CANDIDATE = {"system_prompt": "Return six labels.", "style": "Be brief."}


def reflective_sql(order, k):
    return f"""{METRICS}, {KINDS}, {PAIR_COUNTS}, {PLAN_LINES},
plan AS (SELECT string_agg(line, '|' ORDER BY o) AS expansion_sections FROM lines),
signal AS (
  SELECT 'Most confused: [' || string_agg('((''' || label || ''', ''' || kind || '''), ' ||
    n_errors || ')', ', ' ORDER BY rank) || ']' AS confusion_signal FROM ranked WHERE rank <= 2),
under AS (
  SELECT string_agg('Section 5: ' || label || ' (FP=' || fp || ', FN=' || fn || ')', '|' ORDER BY ord)
    AS underspecified_sections FROM cells WHERE fp + fn > 0),
picked AS (SELECT *, ({MATCHES})::DOUBLE / 6 AS score FROM six ORDER BY {order} LIMIT {k}),
components AS (SELECT 'system_prompt' AS component_name, 'Return six labels.' AS current_text
  UNION ALL SELECT 'style', 'Be brief.')
SELECT component_name, current_text, id, round(score, 6) AS score, text AS input,
  'reply to ' || source AS output, {ERRORS_TEXT} AS per_label_errors, confusion_signal,
  underspecified_sections, expansion_sections
FROM picked, components, signal, under, plan"""


def shown(records):
    arrays = ("per_label_errors", "underspecified_sections", "expansion_sections")
    return rounded(records.withColumns({a: F.array_join(a, "|") for a in arrays}), "score")


@query(reflective_sql("id", 10))
def reflective_records(spark, sf):
    return shown(errors.reflective_records(answered(spark, sf), CANDIDATE, list(CANDIDATE)))


@query(reflective_sql("score, id", 5))
def worst_reflective_records(spark, sf):
    df = answered(spark, sf)
    return shown(errors.reflective_records(df, CANDIDATE, list(CANDIDATE), k=5, worst=True))


@query(f"""{PROBE} SELECT * FROM probe WHERE predicted = 0""")
def missed_table(spark, sf):
    return errors.missed_rows(tables.probe_results(spark, sf))


@query(f"""{BINARY} SELECT id, text, label, predicted,
  CASE WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type
FROM results WHERE label <> predicted""")
def tagged_errors(spark, sf):
    return errors.tagged_errors(tables.binary_results(spark, sf))


# --- first and worst rows ------------------------------------------------------------------------


@query(f"WITH {SIX} SELECT id, text FROM six ORDER BY id LIMIT 10")
def first_trajectories(spark, sf):
    return first_k(tables.six(spark, sf).select("id", "text"), 10)


@query(f"""WITH {SIX} SELECT id, text, round(({MATCHES})::DOUBLE / 6, 6) AS score FROM six
ORDER BY ({MATCHES}), id LIMIT 5""")
def worst_trajectories(spark, sf):
    df = lowest_k(tables.six(spark, sf), 5, score())
    return rounded(df.select("id", "text", score().alias("score")), "score")


# --- candidates ----------------------------------------------------------------------------------


@query(f"""{CANDIDATES} SELECT candidate_id, body FROM candidates
WHERE length(body) >= 100 AND contains(body, 'JSON') AND ({" OR ".join(f"contains(body, '{c}')" for c in LABELS)})""")
def candidate_gate(spark, sf):
    df = tables.candidates(spark, sf).select("candidate_id", "body")
    return df.where(cand.is_valid(F.col("body")))


@query(f"""{CANDIDATES} SELECT candidate_id, body FROM candidates
WHERE length(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')) >= 150
  AND contains(body, chr(123)) AND contains(body, 'HARMFUL SPEECH CLASSIFIER')
  AND length(regexp_replace(body, '[^\\x{{2711}}-\\x{{10FFFF}}]', '', 'g'))::DOUBLE / length(body) <= 0.05""")
def strict_candidate_gate(spark, sf):
    df = tables.candidates(spark, sf).select("candidate_id", "body")
    return df.where(cand.is_valid_strict(F.col("body")))


@query(f"""{CANDIDATES} SELECT candidate_id, 'some pass' AS part FROM candidates
WHERE length(body) >= 100 AND contains(body, 'JSON') AND contains(body, 'stereotype')
UNION ALL SELECT candidate_id, 'none passes' FROM candidates""")
def gate_fallback(spark, sf):
    df = tables.candidates(spark, sf)
    some = cand.passing_or_all(df, cand.is_valid(F.col("body")))
    none = cand.passing_or_all(df, F.length("body") < 0)
    return some.select("candidate_id", F.lit("some pass").alias("part")).unionByName(
        none.select("candidate_id", F.lit("none passes").alias("part"))
    )


@query(f"""WITH {LABELLED}, langs AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER
  AS candidate_id FROM (SELECT DISTINCT lang FROM documents))
SELECT c.candidate_id, d.id,
  'Return JSON with stereotype and the other labels for text in ' || c.lang ||
  '. Be exact; give every label the value 0 or 1 and nothing else.' || chr(10) || chr(10) ||
  'Text: ' || d.text AS prompt
FROM labelled d, langs c""")
def candidate_requests(spark, sf):
    rows = tables.labelled(spark, sf).select("id", "text")
    df = cand.candidate_requests(rows, tables.language_candidates(spark, sf))
    prompt = system_prompt(F.col("body"), F.col("text"))
    return df.select("candidate_id", "id", prompt.alias("prompt"))


@query("""WITH b AS (SELECT (item_id - 20) * 1000003 AS candidate_id, text AS body FROM benchmark WHERE item_id % 8 = 0)
SELECT candidate_id, doc_id AS id, body || ' ' || toxic AS prompt FROM labels, b""")
def sparse_candidate_requests(spark, sf):
    """Benchmark items as candidates whose ids are far apart and partly below 0."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id % 8 = 0")
    bodies = items.selectExpr("(item_id - 20) * 1000003 AS candidate_id", "text AS body")
    rows = tables.table(spark, sf, "labels").withColumnRenamed("doc_id", "id").select("id", "toxic")
    df = cand.candidate_requests(rows, bodies)
    return df.select("candidate_id", "id", F.concat_ws(" ", "body", "toxic").alias("prompt"))


CAND_BITS = " + ".join(
    f"CASE WHEN (id + {k}) % (candidate_id + 2) = 0 THEN 0 ELSE 1 END" for k in range(len(LABELS))
)
CAND_SCORES = f"""cand_scores AS (
  SELECT candidate_id, count(*) AS n, avg(({CAND_BITS})::DOUBLE / 6) AS mean_score
  FROM six, (SELECT unnest([0, 1, 2])::INTEGER AS candidate_id) GROUP BY candidate_id)"""
THREE = (
    "Return JSON with stereotype",
    "Return JSON with all six labels, stereotype to invalidation, each 0 or 1, and no other words at all.",
    "Return JSON with stereotype, vilification, dehumanization and the others as 0 or 1; nothing else please.",
)


def run_of_candidates(spark, sf):
    """The given replies come from three texts; the table of texts is drawn from the replies."""
    replies = tables.candidate_replies(spark, sf)
    body = F.get(F.array(*[F.lit(x) for x in THREE]), F.col("candidate_id"))
    listed = replies.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_replies"))
    texts = listed.select("candidate_id", body.alias("body"))
    return runs.candidate_run(tables.truth_only(spark, sf), texts, replies)


@query(f"WITH {SIX}, {CAND_SCORES} SELECT candidate_id, n, round(mean_score, 6) AS mean_score FROM cand_scores")
def candidate_scores(spark, sf):
    return rounded(run_of_candidates(spark, sf)["scores"], "mean_score")


@query(f"""WITH {SIX}, {CAND_SCORES} SELECT candidate_id, n, round(mean_score, 6) AS mean_score
FROM cand_scores WHERE candidate_id > 0 ORDER BY cand_scores.mean_score DESC, candidate_id LIMIT 1""")
def candidate_choice(spark, sf):
    best = run_of_candidates(spark, sf)["best"]
    return rounded(best.select("candidate_id", "n", "mean_score"), "mean_score")


SEED = "[EXPAND] Return JSON [EXPAND]"


@query(f"""WITH {SIX}, {CAND_SCORES}, best AS (SELECT candidate_id AS c, mean_score FROM cand_scores
  WHERE candidate_id > 0 ORDER BY mean_score DESC, candidate_id LIMIT 1),
body AS (SELECT length((ARRAY[{", ".join(f"'{x}'" for x in THREE)}])[c + 1])::BIGINT AS size FROM best)
SELECT 15 AS val_size, {len(SEED)} AS seed_prompt_length, size AS optimized_prompt_length,
  round(size::DOUBLE / {len(SEED)}, 6) AS expansion_ratio, 2::BIGINT AS expand_markers_removed,
  (SELECT count(*) FROM cand_scores) AS num_candidates,
  round((SELECT max(mean_score) FROM cand_scores), 6) AS best_score FROM body""")
def candidate_summary(spark, sf):
    run = run_of_candidates(spark, sf)
    df = summary_of_candidates(run["best"], run["scores"], SEED, {"val_size": 15})
    return rounded(df, "expansion_ratio", "best_score")


FIRST_NONZERO = """coalesce(nullif(aggregate_score, 0), nullif(score, 0), nullif(metrics_aggregate, 0), 0)"""


@query(f"""{CANDIDATES} SELECT candidate_id, round({FIRST_NONZERO}, 6) AS best FROM candidates
ORDER BY {FIRST_NONZERO} DESC, candidate_id LIMIT 1""")
def best_candidate_by_score(spark, sf):
    names = ("aggregate_score", "score", "metrics_aggregate")
    value = cand.first_nonzero_score(*[F.col(c) for c in names])
    df = cand.best_by_score(tables.candidates(spark, sf), value)
    return rounded(df.select("candidate_id", value.alias("best")), "best")


@query(f"{CANDIDATES} SELECT candidate_id, body FROM candidates ORDER BY length(body) DESC, candidate_id LIMIT 1")
def best_candidate_by_length(spark, sf):
    df = tables.candidates(spark, sf).select("candidate_id", "body")
    return cand.best_by_length(df)


@query(f"""{CANDIDATES} SELECT round(coalesce(max(score), 0), 6) AS best_score FROM candidates""")
def best_validation_score(spark, sf):
    return rounded(cand.best_score(tables.candidates(spark, sf)), "best_score")


LANG_METRICS = f"""WITH {SIX}, long AS ({" UNION ALL ".join(
    f"SELECT lang, '{c}' AS label, t_{c} AS t, p_{c} AS p FROM six" for c in LABELS)}),
f1s AS (SELECT lang, label, coalesce(2.0::DOUBLE * sum(t * p)
    / nullif(sum(t) + sum(p), 0), 0) AS f1 FROM long GROUP BY lang, label),
macro AS (SELECT lang AS approach, avg(f1) AS macro_f1 FROM f1s GROUP BY lang),
base AS (SELECT coalesce(max(macro_f1), 0) AS b FROM macro WHERE approach = 'en')"""


@query(f"""{LANG_METRICS} SELECT approach, round(macro_f1, 6) AS macro_f1, round(b, 6) AS baseline_score,
  round(CASE WHEN b > 0 THEN (macro_f1 - b) * 100 / b ELSE 0 END, 6) AS gain_pct FROM macro, base""")
def approach_comparison(spark, sf):
    groups = metrics.tallies(tables.six(spark, sf), by=["lang"])
    approaches = metrics.macro(groups, by=["lang"]).selectExpr("lang AS approach", "f1 AS macro_f1")
    df = cand.compare(approaches, "en")
    return rounded(df, "macro_f1", "baseline_score", "gain_pct")


@query(f"""{LANG_METRICS}, exact AS (SELECT lang, avg(CASE WHEN {MATCHES} = 6 THEN 1.0 ELSE 0.0 END)
  AS e FROM six GROUP BY lang)
SELECT approach, 30 AS val_size, round(macro_f1, 6) AS macro_f1, round(e, 6) AS subset_accuracy,
  round(f1, 6) AS stereotype_f1
FROM macro JOIN exact ON approach = exact.lang
  JOIN f1s ON approach = f1s.lang AND f1s.label = 'stereotype'""")
def approach_summaries(spark, sf):
    groups = metrics.tallies(tables.six(spark, sf), by=["lang"])
    df = run_summary(groups, {"val_size": 30}, by=["lang"]).select(
        F.col("lang").alias("approach"),
        "val_size",
        F.col("metrics.macro_f1").alias("macro_f1"),
        F.col("metrics.subset_accuracy").alias("subset_accuracy"),
        F.col("metrics.per_label.stereotype.f1").alias("stereotype_f1"),
    )
    return rounded(df, "macro_f1", "subset_accuracy", "stereotype_f1")


# --- whole runs ----------------------------------------------------------------------------------


@query(f"""{METRICS} SELECT 'made-up' AS model, 60 AS train_size,
  round((SELECT avg(f1) FROM per_label), 6) AS macro_f1,
  round((SELECT avg(precision) FROM per_label), 6) AS macro_precision,
  round((SELECT avg(recall) FROM per_label), 6) AS macro_recall,
  round((SELECT f1 FROM micro), 6) AS micro_f1,
  round((SELECT f1 FROM per_label WHERE label = 'invalidation'), 6) AS invalidation_f1,
  (SELECT support FROM per_label WHERE label = 'stereotype')::BIGINT AS stereotype_support""")
def run_summary_nested(spark, sf):
    df = run_summary(counted(spark, sf), {"model": "made-up", "train_size": 60})
    picked = {
        "macro_f1": "metrics.macro_f1",
        "macro_precision": "metrics.macro_precision",
        "macro_recall": "metrics.macro_recall",
        "micro_f1": "metrics.micro_f1",
        "invalidation_f1": "metrics.per_label.invalidation.f1",
    }
    support = F.col("metrics.per_label.stereotype.support").alias("stereotype_support")
    df = df.select("model", "train_size", support, *[F.col(v).alias(k) for k, v in picked.items()])
    return rounded(df, *picked)


DEFAULTED = f"""WITH {SIX.replace("six AS", "six0 AS")}, six AS (SELECT id, {", ".join(f"t_{c}" for c in LABELS)},
  p_stereotype, p_vilification, p_dehumanization,
  CASE WHEN id % 6 < 5 THEN p_extreme_language ELSE 0 END AS p_extreme_language,
  CASE WHEN id % 6 < 5 THEN p_lack_of_empathy ELSE 0 END AS p_lack_of_empathy,
  CASE WHEN id % 6 < 5 THEN p_invalidation ELSE 0 END AS p_invalidation FROM six0)"""
RUN_METRICS = METRICS.replace(f"WITH {SIX}", DEFAULTED)
FIVE = ("accuracy", "precision", "recall", "f1", "weighted_f1")


@query(f"""{RUN_METRICS} SELECT label,
  {", ".join(f"round_even({m} * 10000, 0) / 10000 AS {m}" for m in FIVE)},
  tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn FROM per_label""")
def multilabel_run_metrics(spark, sf):
    run = runs.multilabel_run(tables.truth_only(spark, sf), tables.six_line_replies(spark, sf))
    return run["metrics"].select("label", *FIVE, "tp", "fp", "tn", "fn")


@query(f"""WITH {LABELLED}, texts AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS rn FROM labelled WHERE toxic = 1)
SELECT CASE WHEN id % 13 = 0 THEN '' WHEN id % 7 = 0 THEN 'Reasoning: ' || trim(split_part(text, chr(10), 1))
    ELSE lang END AS trigger, count(*) AS n
FROM texts WHERE rn = 1 AND id % 13 > 0 AND n_chars % 5 IN (0, 1, 3) GROUP BY 1""")
def probe_run_triggers(spark, sf):
    positives = tables.labelled(spark, sf).where("toxic = 1").select("id", "text")
    return runs.probe_run(positives, tables.probe_replies(spark, sf))["triggers"]


CAND_P = ", ".join(
    f"CASE WHEN (id + {k}) % (c + 2) = 0 THEN 1 - t_{name} ELSE t_{name} END AS p_{name}"
    for k, name in enumerate(LABELS)
)
CHOSEN = f"""WITH {SIX.replace("six AS", "six0 AS")},
{CAND_SCORES.replace("FROM six,", "FROM six0,")},
chosen AS (SELECT candidate_id AS c FROM cand_scores WHERE candidate_id > 0
  ORDER BY mean_score DESC, candidate_id LIMIT 1),
six AS (SELECT id, {", ".join(f"t_{c}" for c in LABELS)}, {CAND_P} FROM six0, chosen)"""


@query(f"""{METRICS.replace(f"WITH {SIX}", CHOSEN)}
SELECT label, round(f1, 6) AS value FROM per_label""")
def chosen_candidate_f1(spark, sf):
    df = run_of_candidates(spark, sf)["metrics"]
    df = df.where("scope = 'label' and metric = 'f1'").select("label", "value")
    return rounded(df, "value")
