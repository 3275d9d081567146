"""The given tables as the engine's inputs.

``documents`` is the labelled text, ``labels`` its truth. The six-label view and the replies are
computed from their columns; this is made-up label data to run the operators on.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.functions.labels import answer_string
from labelgauge.schema import DISPLAY_NAMES, LABELS

BITS = [f"p_{name}" for name in LABELS]
KEPT = ["id", "text", "lang", "source", "n_chars"]


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark, sf, name):
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "id")


def labelled(spark, sf):
    """Documents with their binary truth."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return documents(spark, sf).join(labels, "id")


def six(spark, sf, truth="", pred="pred_"):
    """Six truth and six prediction columns per labelled document."""
    truths = [
        "toxic",
        "1 - quality",
        "int(id % 11 = 0)",
        "int(n_chars % 3 = 0)",
        "int(n_chars % 5 = 1)",
        "int(id % 6 = 2)",
    ]
    preds = [
        "n_chars % 4 = 0",
        "n_chars % 7 < 2",
        "id % 22 = 0",
        "n_chars % 6 = 0",
        "n_chars % 5 < 2",
        "id % 4 = 2",
    ]
    return labelled(spark, sf).selectExpr(
        *KEPT,
        *[f"{t} AS {truth}{name}" for name, t in zip(LABELS, truths)],
        *[f"int({p}) AS {pred}{name}" for name, p in zip(LABELS, preds)],
    )


def truth_only(spark, sf):
    return six(spark, sf).drop(*[f"pred_{name}" for name in LABELS])


def bits_only(spark, sf):
    """The prediction bits under the names ``p_<label>``, as a separate table."""
    return six(spark, sf, pred="p_").select(*KEPT, *BITS)


def _pick(index, values):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _with_json(df, one_forms, zero_forms, note=None):
    """``body``: the bits as a JSON object, spelt differently from row to row; a text may follow."""
    style = F.col("n_chars") % len(one_forms)
    df = df.withColumns({"_one": _pick(style, one_forms), "_zero": _pick(style, zero_forms)})
    parts = F.expr(
        "concat_ws(', ', "
        + ", ".join(f"""concat('"{c}": ', if(p_{c} = 1, _one, _zero))""" for c in LABELS)
        + ")"
    )
    end = F.lit("}")
    if note is not None:
        # {"note": "..."} without its opening brace closes the object.
        end = F.concat(F.lit(", "), F.substr(F.to_json(F.struct(note.alias("note"))), F.lit(2)))
    return df.withColumn("body", F.concat(F.lit("{"), parts, end)).drop("_one", "_zero")


def fenced_replies(spark, sf):
    """Replies of the fenced-JSON kind; form by ``id % 6``, the last two of them unreadable."""
    df = _with_json(
        bits_only(spark, sf),
        ("1", '"1"', "true", '"true"', "1.0"),
        ("0", '"0"', "false", '"no"', '"1.0"'),
        F.col("text"),
    )
    body = F.col("body")
    form = F.col("id") % 6
    reply = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(form == 3, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(form == 4, F.concat(F.lit("No JSON: "), F.col("text")))
        .otherwise(F.concat(body, F.lit(" as asked")))
    )
    return df.withColumn("raw_response", reply).drop("body")


def braced_replies(spark, sf):
    """Replies with one object within prose; form by ``id % 6``, the last one unreadable."""
    df = _with_json(
        bits_only(spark, sf),
        ("1", '"0"', "true", "2", "[0]"),
        ("0", '""', "false", "null", "{}"),
        F.col("text"),
    )
    body = F.col("body")
    form = F.col("id") % 6
    reply = (
        F.when(form < 2, body)
        .when(form < 4, F.concat(F.lit("I think:\n"), body))
        .when(form == 4, F.concat(F.lit("Sure. "), body, F.lit("\nAnything else?")))
        .otherwise(F.concat(F.lit("none {"), F.col("text")))
    )
    return df.withColumn("raw_response", reply).drop("body")


def six_line_replies(spark, sf):
    """Replies of six lines; form by ``id % 6``: named thrice, bare lines, bare digits, partial."""
    def joined(between, parts):
        return F.expr(f"concat_ws('{between}', {', '.join(parts)})")

    def named(mark, names=LABELS, change="{}"):
        shown = {n: change.format(f"'{DISPLAY_NAMES[n]}'") for n in names}
        return joined("\\n", [f"concat({shown[n]}, '{mark}', p_{n})" for n in names])

    bits = [f"string({b})" for b in BITS]
    form = F.col("id") % 6
    after = F.concat(F.lit("\n\n"), F.col("text"))
    reply = (
        F.when(form == 0, F.concat(named(": "), after))
        .when(form == 1, F.concat(named(" = ", change="lower({})"), after))
        .when(form == 2, F.concat(named(" -\\n", change="upper({})"), after))
        .when(form == 3, F.concat(F.lit("Stereotype: 1\n"), joined(" \\n ", bits), after))
        .when(form == 4, F.concat(joined(", ", bits), after))
        .otherwise(named(": ", LABELS[:3]))
    )
    return bits_only(spark, sf).withColumn("raw_response", reply)


def answer_replies(spark, sf):
    """Replies that hold the answer string of the prediction bits."""
    reply = F.concat(F.lit("So: "), answer_string(dict(zip(LABELS, BITS))), F.lit("\n"), F.col("text"))
    return bits_only(spark, sf).withColumn("raw_response", reply)


def probe_replies(spark, sf):
    """Replies of the probe kind; answer by ``n_chars % 5``, some fields empty."""
    answer = _pick(F.col("n_chars") % 5, ("Yes", "yes", "No", "YES and Answer: no", "Maybe"))
    reply = F.concat(
        F.lit("Group: "),
        F.col("source"),
        F.lit("\nTRIGGER:  "),
        F.when(F.col("id") % 7 == 0, "").otherwise(F.col("lang")),
        F.lit("\nReasoning: "),
        F.col("text"),
        F.lit("\nAnswer: "),
        answer,
    )
    reply = F.when(F.col("id") % 13 != 0, reply)
    return labelled(spark, sf).withColumn("raw_response", reply)


def probe_results(spark, sf):
    """Every good-quality document taken as positive, with prediction and category."""
    df = labelled(spark, sf).where("quality = 1")
    return df.select(
        "id",
        "text",
        F.lit(1).alias("label"),
        F.when(F.col("n_chars") % 8 < 7, 1).otherwise(0).alias("predicted"),
        F.when(F.col("id") % 9 == 0, "").otherwise(F.col("source")).alias("group"),
        F.when(F.col("id") % 10 == 0, "")
        .otherwise(F.concat_ws("/", "lang", "source"))
        .alias("trigger"),
        F.concat(F.lit("seen in "), F.col("source")).alias("reasoning"),
    )


def binary_results(spark, sf):
    """One binary label: truth from ``labels``, prediction from the length."""
    return labelled(spark, sf).select(
        "id",
        "text",
        F.col("toxic").alias("label"),
        (F.col("n_chars") % 4 == 0).cast("int").alias("predicted"),
    )


def candidates(spark, sf):
    """Every document as a candidate instruction text, some with what the gates ask for."""
    text = F.col("text")
    body = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("Return JSON with stereotype [EXPAND] "), text))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("JSON only. [EXPANDED] "), text))
        .when(
            F.col("id") % 4 == 2,
            F.concat(F.lit('HARMFUL SPEECH CLASSIFIER {"a": 1} [EXPAND][EXPAND] '), text),
        )
        .otherwise(F.concat(F.lit('HARMFUL SPEECH CLASSIFIER {"a": 1} ఞ❤❤❤❤❤❤❤❤ '), text))
    )
    i = F.col("id")
    return documents(spark, sf).select(
        i.alias("candidate_id"),
        F.lit("system_prompt").alias("component"),
        body.alias("body"),
        F.when(i % 3 == 0, (i % 97) / 100.0).alias("aggregate_score"),
        F.when(i % 2 == 0, (i % 89) / 100.0).alias("score"),
        ((i % 83) / 100.0).alias("metrics_aggregate"),
    )


def language_candidates(spark, sf):
    """One short candidate per language of the documents, numbered from 0."""
    langs = documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"))
    place = F.row_number().over(Window.orderBy("lang")) - 1  # a row per language
    return langs.select(
        place.cast("int").alias("candidate_id"),
        F.concat(
            F.lit("Return JSON with stereotype and the other labels for text in "),
            F.col("lang"),
            F.lit(". Be exact; give every label the value 0 or 1 and nothing else."),
        ).alias("body"),
    )


def candidate_replies(spark, sf):
    """Three candidates' replies per labelled document, of growing agreement with the truth.

    The truth is laid under a bit pattern that flips it for some rows and labels.
    """
    df = truth_only(spark, sf).withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    flipped = {
        f"p_{c}": F.expr(f"if((id + {k}) % (candidate_id + 2) = 0, 1 - {c}, {c})")
        for k, c in enumerate(LABELS)
    }
    df = _with_json(df.withColumns(flipped), ("1",), ("0",))
    reply = F.concat(F.lit("```json\n"), "body", F.lit("\n```"))
    return df.select("candidate_id", "id", reply.alias("raw_response"))
