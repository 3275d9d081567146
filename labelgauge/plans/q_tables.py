"""Queries: readers, writers, cleaning, samples and splits."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgauge.functions.labels import (
    answer_string,
    coerce_label,
    label_sum,
    membership_label,
)
from labelgauge.functions.scores import row_accuracy
from labelgauge.functions.text import (
    preview,
    system_prompt,
    template_prompt,
    text_column,
    text_stats,
    token_count,
    user_prompt,
)
from labelgauge.operators import clean, split
from labelgauge.operators.errors import false_negatives, false_positives, missed_rows, tagged_errors
from labelgauge.operators.metrics import tallies
from labelgauge.operators.report import REPORT_ORDER, probe_report, run_summary
from labelgauge.plans import tables
from labelgauge.plans.registry import (
    BINARY,
    LABELLED,
    METRICS,
    PROBE,
    SIX,
    query,
    rounded,
)
from labelgauge.schema import LABELS
from labelgauge.session import shared_dir
from labelgauge.sources import readers, writers

# --- readers and writers: each writes the given table, reads it back, and shows the rows -------


@query(f"""WITH {LABELLED}
SELECT text, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS label, source
FROM labelled""")
def labelled_csv_scan(spark, sf):
    out = tables.labelled(spark, sf).select(
        F.col("text").alias("Sentences"),
        F.when(F.col("quality") == 1, "Positive").otherwise("Negative").alias("Label"),
        F.col("source").alias("file"),
    )
    return written_sentences(spark, out)


def written_sentences(spark, out):
    """The rows written as files with two orders of columns and read back by column name."""
    even = F.pmod(F.xxhash64("Sentences"), F.lit(2)) == 0
    other = out.where(~even).select("Label", F.lit("x").alias("note"), "Sentences", "file")
    paths = [
        writers.write_csv(df, shared_dir(spark, "sentences"), partition_by=["file"]) for df in (out.where(even), other)
    ]
    read = readers.read_labelled_csv(spark, [f"{path}/*/*.csv" for path in paths])
    return read.withColumn("source", F.regexp_extract("source", "file=([^/]+)/", 1))


@query(f"""WITH {LABELLED}, raw AS (
  SELECT text, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS label, source FROM labelled),
known AS (SELECT text, label, md5(text || chr(31) || label || chr(31) || source) || '-' ||
  row_number() OVER (PARTITION BY text, label, source) AS id FROM raw),
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS r FROM known) WHERE r = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS pos FROM single)
SELECT id, text, CASE label WHEN 'Positive' THEN 1 ELSE 0 END AS label,
  CASE WHEN pos <= 60 THEN 'test' ELSE 'train' END AS split FROM placed""")
def dataset_preparation(spark, sf):
    """Files to ids, one row per text, a holdout, and one file per class and part, read back."""
    out = tables.labelled(spark, sf).select(
        F.col("text").alias("Sentences"),
        F.when(F.col("quality") == 1, "Positive").otherwise("Negative").alias("Label"),
        F.col("source").alias("file"),
    )
    rows = readers.with_id(written_sentences(spark, out), ["text", "label", "source"])
    rows = split.holdout_split(clean.first_of_each_text(rows, ["id"]), 60).drop("source")
    parts = []
    for keep in (1, 0):
        part = clean.class_subset(rows, keep=keep)
        path = writers.write_csv(part, shared_dir(spark, f"class{keep}"), partition_by=["split"])
        # the folder's name carries the column that the files lack
        names = [f for f in part.schema.fields if f.name != "split"]
        files = readers._csv(spark, f"{path}/*/*.csv", T.StructType(names))
        parts.append(files.withColumn("split", F.regexp_extract("_metadata.file_path", "split=([^/]+)/", 1)))
    return clean.union_all(*parts).select("id", "text", "label", "split")


@query(f"""WITH {SIX}
SELECT text AS translated_te, {", ".join(f"t_{c}::BIGINT AS {c}" for c in LABELS)} FROM six
WHERE id % 10 > 0""")
def multilabel_csv_scan(spark, sf):
    df = tables.truth_only(spark, sf)
    text = F.when(F.col("id") % 10 > 0, F.col("text")).alias("translated_te")
    spelled = [
        F.when(F.col(c) == 1, F.get(F.array(*map(F.lit, ("1", "1.0", " 1", "True"))), (F.col("id") % 4).cast("int")))
        .otherwise(F.get(F.array(*map(F.lit, ("0", "no", "NaN", "False"))), (F.col("id") % 4).cast("int")))
        .alias(c)
        for c in LABELS
    ]
    path = writers.write_csv(df.select(text, *spelled), shared_dir(spark, "multilabel"))
    return readers.read_multilabel(spark, path)


@query("SELECT text, lang FROM documents WHERE doc_id % 9 > 0")
def first_column_scan(spark, sf):
    df = tables.documents(spark, sf)
    out = df.select(F.when(F.col("id") % 9 > 0, F.col("text")).alias("sentence"), "lang")
    path = writers.write_csv(out, shared_dir(spark, "first-column"))
    return readers.read_first_column(spark, [f"{path}-elsewhere", path])


@query("""SELECT text, CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END AS label, 'part.csv' AS source FROM documents""")
def configured_scan(spark, sf):
    out = tables.documents(spark, sf).select(F.col("text").alias("body"), "lang")
    path = writers.write_csv(out, shared_dir(spark, "configured"))
    config = {"path": path, "text_col": "body", "label_col": "lang", "positive_val": ["en", "fr"]}
    name = F.regexp_replace("source", r"^part-\d+-[-0-9a-f]+.*\.csv$", "part.csv")  # the rest is the writer's
    return readers.read_configured(spark, config).select("text", "label", name.alias("source"))


@query(f"WITH {LABELLED} SELECT text, toxic AS label FROM labelled")
def class_file_scan(spark, sf):
    df = tables.labelled(spark, sf)
    paths = [
        writers.write_csv(df.where(F.col("toxic") == c).select("text"), shared_dir(spark, f"class{c}"))
        for c in (1, 0)
    ]
    return readers.read_class_files(spark, *paths)


@query(f"""{PROBE}
SELECT id, text, label, predicted, nullif("group", '') AS "group", nullif(trigger, '') AS trigger,
  reasoning FROM probe""")
def csv_sink(spark, sf):
    df = tables.probe_results(spark, sf)
    path = writers.write_csv(df, shared_dir(spark, "results"))
    read = readers._csv(spark, path, df.schema)
    return readers.null_cells(read, ["group", "trigger"])


@query(f"""{METRICS}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(accuracy, 6) AS accuracy, support::BIGINT AS support,
  round((SELECT avg(f1) FROM per_label), 6) AS macro_f1,
  round((SELECT f1 FROM micro), 6) AS micro_f1, 60 AS train_size
FROM per_label""")
def metrics_json_sink(spark, sf):
    counted = tallies(tables.six(spark, sf))
    summary = run_summary(counted, {"train_size": 60, "val_size": 30})
    path = writers.write_json(summary, shared_dir(spark, "metrics"))
    read = spark.read.schema(summary.schema).json(path)
    per_label = F.array(
        *[F.struct(F.lit(c).alias("label"), f"metrics.per_label.{c}.*") for c in LABELS]
    )
    df = read.select(
        F.inline(per_label),
        F.col("metrics.macro_f1").alias("macro_f1"),
        F.col("metrics.micro_f1").alias("micro_f1"),
        "train_size",
    )
    return rounded(df, "precision", "recall", "f1", "accuracy", "macro_f1", "micro_f1")


REPORT_NOTES = "Read the misses by category."
REPORT_SQL = f"""{PROBE}, counted AS (
  SELECT count(*) AS total, count(*) FILTER (predicted = 1) AS detected,
    count(*) FILTER (predicted = 0) AS missed FROM probe),
categories AS (SELECT trigger, count(*) AS n FROM probe WHERE predicted = 1 GROUP BY trigger),
lines AS (
  SELECT 0 AS section, 0 AS ord, '' AS tie, 0 AS part, repeat('=', 65) AS line
  UNION ALL SELECT 0, 0, '', 1, 'STEREOTYPE DETECTION RESULTS'
  UNION ALL SELECT 0, 0, '', 2, repeat('=', 65)
  UNION ALL SELECT 0, 0, '', 3, 'Total samples      : ' || total FROM counted
  UNION ALL SELECT 0, 0, '', 4, 'Correctly detected : ' || detected || '  (' ||
    printf('%.1f', detected * 100.0 / total) || '%)' FROM counted
  UNION ALL SELECT 0, 0, '', 5, 'Missed stereotypes : ' || missed || '  (' ||
    printf('%.1f', missed * 100.0 / total) || '%)' FROM counted
  UNION ALL SELECT 0, 0, '', 6, 'Detection Rate     : ' ||
    printf('%.4f', detected * 1.0 / total) FROM counted
  UNION ALL SELECT 1, 0, '', 0, chr(10) || 'Trigger distribution for detected examples:'
  UNION ALL SELECT 2, -n, trigger, 0, '  Trigger ' || trigger || ': ' || n FROM categories
  UNION ALL SELECT 3, 0, '', 0, chr(10) || repeat('=', 65) FROM counted WHERE missed > 0
  UNION ALL SELECT 3, 0, '', 1, 'MISSED STEREOTYPES — ' || missed || ' examples' FROM counted
    WHERE missed > 0
  UNION ALL SELECT 3, 0, '', 2, repeat('=', 65) FROM counted WHERE missed > 0
  UNION ALL SELECT 3, 0, '', 3, '{REPORT_NOTES}' FROM counted WHERE missed > 0
  UNION ALL SELECT 3, 0, '', 4, repeat('-', 65) FROM counted WHERE missed > 0
  UNION ALL SELECT 4, id, '', 0, chr(10) || '[' || (id + 1) || '] TEXT: ' || substring(text, 1, 200)
    FROM probe WHERE predicted = 0
  UNION ALL SELECT 4, id, '', 1, '     Model''s Group   : ' || "group" FROM probe
    WHERE predicted = 0 AND "group" <> ''
  UNION ALL SELECT 4, id, '', 2, '     Model''s Trigger  : ' || trigger FROM probe
    WHERE predicted = 0 AND trigger <> ''
  UNION ALL SELECT 4, id, '', 3, '     Model''s Reasoning: ' || reasoning FROM probe
    WHERE predicted = 0 AND reasoning <> ''
  UNION ALL SELECT 4, id, '', 4, '     → TRUE LABEL: 1 (Stereotype)  |  PREDICTED: 0 (Missed)'
    FROM probe WHERE predicted = 0)"""


@query(f"""{REPORT_SQL}
SELECT section::INTEGER AS section, ord::BIGINT AS ord, tie, part::INTEGER AS part, line FROM lines""")
def report_lines(spark, sf):
    return probe_report(tables.probe_results(spark, sf), REPORT_NOTES)


@query(f"{REPORT_SQL} SELECT unnest(string_split(line, chr(10))) AS line FROM lines")
def report_text_sink(spark, sf):
    report = probe_report(tables.probe_results(spark, sf), REPORT_NOTES)
    path = writers.write_lines(report, shared_dir(spark, "report"), REPORT_ORDER)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- projections, filters, predicates ----------------------------------------------------------


@query(f"WITH {LABELLED} SELECT text, quality AS label, source FROM labelled")
def unified_columns(spark, sf):
    return clean.unified(tables.labelled(spark, sf).withColumnRenamed("quality", "label"))


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id % 17 <> 0")
def null_text_dropped(spark, sf):
    df = tables.documents(spark, sf)
    df = df.select("id", F.when(F.col("id") % 17 != 0, F.col("text")).alias("text"))
    return clean.drop_empty_text(df)


@query("""SELECT doc_id AS id, CASE doc_id % 12 WHEN 11 THEN n_chars ELSE
  (ARRAY[1, 1, 0, 0, 0, -1, 12, 0, 0, 1, 0])[doc_id % 12 + 1] + CASE doc_id % 12 WHEN 6 THEN 9007199254740993 - 12 ELSE 0 END
  END::BIGINT AS label FROM documents""")
def label_coercion(spark, sf):
    raw = F.get(
        F.array(
            *[F.lit(x) for x in ("1", "1.9", "x", "", "NaN", "-1", "9007199254740993", "1d", None, "True", "False")],
            F.col("n_chars").cast("string"),
        ),
        (F.col("id") % 12).cast("int"),
    )
    return tables.documents(spark, sf).select("id", coerce_label(raw).alias("label"))


@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0 END AS label
FROM documents WHERE doc_id % 3 < 2""")
def class_encoding(spark, sf):
    word = F.when(F.col("id") % 3 == 0, "Positive").when(F.col("id") % 3 == 1, "Negative")
    word = F.coalesce(word, F.lit("positive"))
    df = tables.documents(spark, sf).select("id", word.alias("label"))
    return clean.class_subset(df)


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' OR lang = 'de' THEN 1 ELSE 0 END AS label FROM documents")
def membership_labels(spark, sf):
    label = membership_label(F.col("lang"), ["en", "de"])
    return tables.documents(spark, sf).select("id", label.alias("label"))


ANY_LABEL = " + ".join(f"t_{c}" for c in LABELS)


@query(f"WITH {SIX} SELECT id, {ANY_LABEL} AS n_labels FROM six WHERE {ANY_LABEL} > 0")
def any_label_filter(spark, sf):
    df = clean.with_any_label(tables.truth_only(spark, sf))
    return df.select("id", label_sum(LABELS).alias("n_labels"))


@query(f"""WITH {SIX} SELECT count(*) AS total, count(*) FILTER ({ANY_LABEL} > 0) AS kept,
  count(*) FILTER ({ANY_LABEL} = 0) AS removed FROM six""")
def any_label_removed(spark, sf):
    return clean.any_label_counts(tables.truth_only(spark, sf))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN 'te ' || text END AS with_translation,
  text AS with_text, '' AS with_neither FROM documents""")
def text_choice(spark, sf):
    df = tables.documents(spark, sf)
    translated = df.withColumn("translated_te", F.when(F.col("id") % 5 > 0, F.concat(F.lit("te "), "text")))
    return translated.select(
        "id",
        text_column(translated.columns).alias("with_translation"),
        text_column(df.columns).alias("with_text"),
        text_column(["id"]).alias("with_neither"),
    )


EXAMPLES_TEMPLATE = "Example 1:\nText: All of them.\nStereotype: 1\n\nText:\n{text}\n\nClassify now."


@query("""SELECT doc_id AS id, 'For ' || lang || chr(10) || chr(10) || 'Text: ' || text AS system_form,
  'Classify:' || chr(10) || text AS user_form,
  'Example 1:' || chr(10) || 'Text: All of them.' || chr(10) || 'Stereotype: 1' || chr(10) || chr(10)
  || 'Text:' || chr(10) || text || chr(10) || chr(10) || 'Classify now.' AS example_form
FROM documents""")
def prompt_rendering(spark, sf):
    text = F.col("text")
    return tables.documents(spark, sf).select(
        "id",
        system_prompt(F.concat(F.lit("For "), "lang"), text).alias("system_form"),
        user_prompt(text).alias("user_form"),
        template_prompt(EXAMPLES_TEMPLATE, text).alias("example_form"),
    )


ANSWER = " || ', ' || ".join(f"'{c}=' || t_{c}" for c in LABELS)


@query(f"WITH {SIX} SELECT id, {ANSWER} AS answer FROM six")
def answer_strings(spark, sf):
    answer = answer_string({c: c for c in LABELS})
    return tables.truth_only(spark, sf).select("id", answer.alias("answer"))


@query("""SELECT doc_id AS id, substring(text, 1, 200) AS p200, substring(text, 1, 120) AS p120,
  substring(text, 1, 80) AS p80 FROM documents""")
def text_previews(spark, sf):
    text = F.col("text")
    sizes = {f"p{n}": preview(text, n) for n in (200, 120, 80)}
    return tables.documents(spark, sf).select("id", *[v.alias(k) for k, v in sizes.items()])


@query("""SELECT doc_id AS id, length('[EXPAND] ' || text || '[EXPANDED]')::BIGINT AS n_chars,
  2::BIGINT AS markers, 19::BIGINT AS growth, round(1900.0::DOUBLE / length(text), 6) AS growth_pct,
  round((length(text) + 19)::DOUBLE / length(text), 6) AS expansion_ratio, (-2)::BIGINT AS markers_removed
FROM documents""")
def text_statistics(spark, sf):
    text = F.concat(F.lit("[EXPAND] "), "text", F.lit("[EXPANDED]"))
    stats = text_stats(text, F.col("text"))
    df = tables.documents(spark, sf).select("id", *[v.alias(k) for k, v in stats.items()])
    return rounded(df, "growth_pct", "expansion_ratio")


@query("""SELECT doc_id AS id,
  length(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INTEGER AS tokens
FROM documents""")
def token_counts(spark, sf):
    return tables.documents(spark, sf).select("id", token_count(F.col("text")).alias("tokens"))


@query(f"""{BINARY} SELECT id, 'false positive' AS kind FROM results WHERE label = 0 AND predicted = 1
UNION ALL SELECT id, 'false negative' FROM results WHERE label = 1 AND predicted = 0
UNION ALL SELECT id, 'not found' FROM results WHERE predicted = 0""")
def error_filters(spark, sf):
    df = tables.binary_results(spark, sf)
    kinds = {
        "false positive": false_positives(df),
        "false negative": false_negatives(df),
        "not found": missed_rows(df),
    }
    return clean.union_all(*[d.select("id", F.lit(k).alias("kind")) for k, d in kinds.items()])


@query(f"""WITH {SIX} SELECT 'dehumanization excludes stereotype' AS rule,
  count(*) FILTER (t_dehumanization = 1 AND t_stereotype = 1) AS violations, count(*) AS rows FROM six""")
def label_rule_counts(spark, sf):
    return clean.rule_counts(tables.truth_only(spark, sf))


@query(f"""WITH {SIX} SELECT id, 'dehumanization excludes stereotype' AS rule FROM six
WHERE t_dehumanization = 1 AND t_stereotype = 1""")
def label_rule_violations(spark, sf):
    return clean.rule_violations(tables.truth_only(spark, sf)).select("id", "rule")


@query(f"""WITH {SIX} SELECT id, text, {", ".join(f"t_{c}::VARCHAR AS {c}" for c in LABELS)} FROM six""")
def example_records(spark, sf):
    return clean.examples(tables.truth_only(spark, sf))


# --- union, distinct, samples, splits ----------------------------------------------------------


@query("SELECT doc_id AS id, text, lang FROM documents")
def union_of_parts(spark, sf):
    df = tables.documents(spark, sf).select("id", "text", "lang")
    english = F.col("lang") == "en"
    return clean.union_all(df.where(english), df.where(~english).select("lang", "text", "id"))


@query("""SELECT id, source, text FROM (SELECT doc_id AS id, source, text,
  row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""")
def exact_dedup(spark, sf):
    df = tables.documents(spark, sf).select("id", "source", "text")
    return clean.first_of_each_text(df, ["source", "id"])


@query(f"""{BINARY}
SELECT id, CASE WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type
FROM results WHERE label <> predicted""")
def tagged_error_union(spark, sf):
    return tagged_errors(tables.binary_results(spark, sf)).select("id", "error_type")


SHUFFLED = """shuffled AS (
  SELECT doc_id AS id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos,
    count(*) OVER () AS n FROM documents)"""


@query("SELECT doc_id AS id, md5('42:' || doc_id) AS shuffle_key, text FROM documents ORDER BY 2, 1")
def seeded_shuffle(spark, sf):
    df = tables.documents(spark, sf).select(
        "id", split.shuffle_key("id").alias("shuffle_key"), "text"
    )
    return split.shuffled(df)


@query(f"""WITH {SHUFFLED} SELECT id, text, CASE WHEN pos <= 60 THEN 'train' ELSE 'val' END AS split
FROM shuffled WHERE pos <= 90""")
def head_split(spark, sf):
    return split.train_val_split(tables.documents(spark, sf).select("id", "text"), 60, 30)


@query(f"""WITH {SHUFFLED} SELECT id, text, CASE WHEN pos <= 50 THEN 'test' ELSE 'train' END AS split
FROM shuffled""")
def holdout(spark, sf):
    return split.holdout_split(tables.documents(spark, sf).select("id", "text"), 50)


@query(f"""WITH {SHUFFLED} SELECT id, text,
  CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM shuffled""")
def split_fallback(spark, sf):
    df = tables.documents(spark, sf).select("id", "text")
    return split.train_val_split(df, 10**12, 10**11, fallback=True)


@query(f"WITH {SHUFFLED} SELECT id, text FROM shuffled WHERE pos <= 100")
def seeded_sample(spark, sf):
    return split.sample_n(tables.documents(spark, sf).select("id", "text"), 100)


@query(f"""WITH {LABELLED}, ranked AS (
  SELECT id, text, quality AS label,
    row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || id), id) AS pos FROM labelled)
SELECT id, text, label FROM ranked
WHERE pos <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY quality))""")
def class_balance(spark, sf):
    df = tables.labelled(spark, sf).select("id", "text", F.col("quality").alias("label"))
    return split.balanced(df)


@query(f"""WITH {SHUFFLED}, train AS (SELECT id FROM shuffled WHERE pos <= 80),
drawn AS (SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) AS r FROM train),
first AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM train)
SELECT id, 'drawn' AS subset FROM drawn WHERE r <= 60
UNION ALL SELECT id, 'first' FROM first WHERE r <= 40""")
def compile_subset(spark, sf):
    plan = [split.Draw("train", 80), split.Draw("drawn", 60, seed=7, of="train"), split.Draw("first", 40, seed=None, of="train")]
    rows = split.draws(tables.documents(spark, sf).select("id"), plan, path=shared_dir(spark, "draws"))
    return rows.select("id", F.explode("draws").alias("subset")).where("subset <> 'train'")


@query("""WITH ranked AS (SELECT doc_id AS id, n_chars, text, count(*) OVER () AS n,
  row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents)
SELECT id, n_chars, text FROM ranked WHERE r <= n // 2""")
def shorter_half(spark, sf):
    """Half of all documents, the shortest ones: a k that grows with the table."""
    docs = tables.documents(spark, sf).select("id", "n_chars", "text")
    return split.lowest_k(docs, docs.count() // 2, F.col("n_chars"), few=64)


@query("""SELECT lang AS class, count(*) AS n, min(n) AS least FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pos,
    (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS n FROM documents)
WHERE pos <= n GROUP BY lang""")
def language_balance(spark, sf):
    """As many documents of each language as of the rarest, the languages being those there are."""
    docs = tables.documents(spark, sf)
    least = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    kept = split.balanced(docs.select("id", "lang"), "lang").groupBy(F.col("lang").alias("class"))
    return kept.agg(F.count(F.lit(1)).alias("n")).withColumn("least", least)


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 50")
def first_turns(spark, sf):
    """The first rows of a table whose ids repeat."""
    return split.first_k(spark.read.parquet(f"{sf}/conversations.parquet"), 50, "conv_id", then=("turn",))


MATCHES = " + ".join(f"CASE WHEN t_{c} = p_{c} THEN 1 ELSE 0 END" for c in LABELS)


@query(f"""WITH {SIX} SELECT id, round(({MATCHES})::DOUBLE / 6, 6) AS score, text FROM six
WHERE ({MATCHES}) >= 5 ORDER BY id LIMIT 8""")
def demonstration_choice(spark, sf):
    score = row_accuracy([(c, f"pred_{c}") for c in LABELS])
    df = split.demonstrations(tables.six(spark, sf), 8, score, 5 / 6 - 1e-9)
    return rounded(df.select("id", score.alias("score"), "text"), "score")
