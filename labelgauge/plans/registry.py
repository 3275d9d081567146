"""Queries over the given tables, each with the SQL that states its result."""

from pyspark.sql import functions as F

from labelgauge.schema import LABELS

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- SQL shared by the oracles ---------------------------------------------------------------

LABELLED = """labelled AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SIX = """six AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars,
    l.toxic AS t_stereotype,
    1 - l.quality AS t_vilification,
    CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END AS t_dehumanization,
    CASE WHEN d.n_chars % 3 = 0 THEN 1 ELSE 0 END AS t_extreme_language,
    CASE WHEN d.n_chars % 5 = 1 THEN 1 ELSE 0 END AS t_lack_of_empathy,
    CASE WHEN d.doc_id % 6 = 2 THEN 1 ELSE 0 END AS t_invalidation,
    CASE WHEN d.n_chars % 4 = 0 THEN 1 ELSE 0 END AS p_stereotype,
    CASE WHEN d.n_chars % 7 < 2 THEN 1 ELSE 0 END AS p_vilification,
    CASE WHEN d.doc_id % 22 = 0 THEN 1 ELSE 0 END AS p_dehumanization,
    CASE WHEN d.n_chars % 6 = 0 THEN 1 ELSE 0 END AS p_extreme_language,
    CASE WHEN d.n_chars % 5 < 2 THEN 1 ELSE 0 END AS p_lack_of_empathy,
    CASE WHEN d.doc_id % 4 = 2 THEN 1 ELSE 0 END AS p_invalidation
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT id, {i} AS ord, '{c}' AS label, t_{c} AS t, p_{c} AS p FROM six"
    for i, c in enumerate(LABELS)
) + ")"

CELLS = """cells AS (
  SELECT ord, label, count(*) AS n,
    sum(CASE WHEN t = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN t = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN t = 0 AND p = 0 THEN 1 ELSE 0 END) AS tn,
    sum(CASE WHEN t = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn
  FROM long GROUP BY ord, label)"""

PER_LABEL = """per_label AS (
  SELECT *, tp + fn AS support, tp + fp AS predicted,
    (tp + tn)::DOUBLE / n AS accuracy,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    (coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)
     + coalesce(2.0 * tn::DOUBLE / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / n AS weighted_f1
  FROM cells)"""

POOLED = """pooled AS (
  SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn
  FROM cells)"""

MICRO = """micro AS (
  SELECT tp, fp, tn, fn, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy,
    tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
    2.0 * tp::DOUBLE / (2 * tp + fp + fn) AS f1,
    (2.0 * tp::DOUBLE / (2 * tp + fp + fn) * (tp + fn)
     + 2.0 * tn::DOUBLE / (2 * tn + fp + fn) * (tn + fp)) / (tp + fp + tn + fn) AS weighted_f1
  FROM pooled)"""

METRICS = f"WITH {SIX}, {LONG}, {CELLS}, {PER_LABEL}, {POOLED}, {MICRO}"

PROBE = f"""WITH {LABELLED}, probe AS (
  SELECT id, text, 1 AS label, CASE WHEN n_chars % 8 < 7 THEN 1 ELSE 0 END AS predicted,
    CASE WHEN id % 9 = 0 THEN '' ELSE source END AS "group",
    CASE WHEN id % 10 = 0 THEN '' ELSE lang || '/' || source END AS trigger,
    'seen in ' || source AS reasoning
  FROM labelled WHERE quality = 1)"""

BINARY = f"""WITH {LABELLED}, results AS (
  SELECT id, text, toxic AS label, CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 0 END AS predicted
  FROM labelled)"""

CANDIDATES = """WITH candidates AS (
  SELECT doc_id AS candidate_id,
    CASE doc_id % 4
      WHEN 0 THEN 'Return JSON with stereotype [EXPAND] ' || text
      WHEN 1 THEN 'JSON only. [EXPANDED] ' || text
      WHEN 2 THEN 'HARMFUL SPEECH CLASSIFIER {"a": 1} [EXPAND][EXPAND] ' || text
      ELSE 'HARMFUL SPEECH CLASSIFIER {"a": 1} ఞ❤❤❤❤❤❤❤❤ ' || text END AS body,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id % 97)::DOUBLE / 100 END AS aggregate_score,
    CASE WHEN doc_id % 2 = 0 THEN (doc_id % 89)::DOUBLE / 100 END AS score,
    (doc_id % 83)::DOUBLE / 100 AS metrics_aggregate
  FROM documents)"""


def bits(condition="true", prefix="pred_"):
    """The rendered bits where ``condition`` holds, else 0, as a select list."""
    return ", ".join(
        f"CASE WHEN {condition} THEN p_{c} ELSE 0 END AS {prefix}{c}" for c in LABELS
    )
