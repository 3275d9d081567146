"""Scoring rows with a pluggable model: the one place where Python workers run."""

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgauge.functions.scores import row_accuracy
from labelgauge.functions.text import user_prompt
from labelgauge.operators.candidates import candidate_requests
from labelgauge.schema import LABELS

#: The start of the names of the folders that hold the replies of a batch.
BATCH = "replies-"


def score_batch(df, predictor=None, prompt_col="prompt", raw_col="raw_response", setup=None, many=False):
    """Each row with the predictor's reply to its prompt, in Arrow batches within the partitions.

    ``predictor`` is any function from text to text that pickles: a closure travels with the job,
    a module's function needs its module on the executors. A model that is slow to load comes by
    ``setup`` instead, which each task calls once to get its predictor. With ``many``, the predictor
    takes a list of prompts and gives a list of replies; where it fails on a list, or gives another
    number of replies, each prompt of it is tried alone. An exception, or a reply that is neither
    text nor None, stays with its row: the reply is then ``<ERROR: ...>`` and ``failed`` is true.
    Only the prompts become Python values; all other columns pass as they are.
    """
    schema = T.StructType(df.schema.fields + [])
    schema = schema.add(raw_col, T.StringType()).add("failed", T.BooleanType())

    def checked(reply):
        if reply is None or isinstance(reply, str):
            return reply, False
        return f"<ERROR: a reply of type {type(reply).__name__}>", True

    def answer(one, prompt):
        try:
            return checked(one(prompt))
        except Exception as error:
            return f"<ERROR: {error}>", True

    def answers(model, prompts):
        if not many:
            return [answer(model, prompt) for prompt in prompts]
        try:
            replies = list(model(prompts))
            if len(replies) == len(prompts):
                return [checked(reply) for reply in replies]
        except Exception:  # noqa: S110 - tried again one by one
            pass
        return [answer(lambda prompt: model([prompt])[0], prompt) for prompt in prompts]

    def run(batches):
        model = setup() if setup else predictor
        for batch in batches:
            found = answers(model, batch.column(prompt_col).to_pylist())
            columns = [pa.array([a for a, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())]
            names = [*batch.schema.names, raw_col, "failed"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return df.mapInArrow(run, schema)


def score_resumable(requests, predictor=None, path=None, keys=("id",), batches=16, keep_failed=True, **how):
    """Replies to ``requests`` below ``path``, asking only for those not there yet; gives all replies.

    The requests are dealt to ``batches`` by their keys, and each batch is a job that appends its replies
    when it is whole; what a broken run has finished is not asked again, and no more than one batch is lost.
    A batch first leaves out the keys stored for it (an anti-join of narrow keys). Keys name a request, so
    they must be unique; null is a key like any other. Replies have the keys, ``raw_response`` and
    ``failed``; with ``keep_failed=False`` failed ones are not stored, so the next run asks for them again.
    """
    spark, keys = requests.sparkSession, list(keys)
    kinds = T.StructType([requests.schema[k] for k in keys])
    kinds = kinds.add("raw_response", T.StringType()).add("failed", T.BooleanType())
    dealt = requests.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
    for i in range(batches):
        todo, place = dealt.where(F.col("_batch") == i).drop("_batch"), f"{path}/{BATCH}{i:05d}"
        done = _stored_replies(spark, place, kinds)
        if done is not None:
            done = done.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            todo = todo.join(done, same, "left_anti")
        answered = score_batch(todo, predictor, **how).select(*keys, "raw_response", "failed")
        if not keep_failed:
            answered = answered.where("NOT failed")
        answered.write.mode("append").parquet(place)
    return spark.read.schema(kinds).parquet(f"{path}/{BATCH}*")


def _stored_replies(spark, path, schema):
    """What is stored at ``path``, None when nothing is."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise


def label_struct(prefix, labels=LABELS):
    return F.expr(f"struct({', '.join(f'`{prefix}{name}` AS `{name}`' for name in labels)})")


def evaluation(df, labels=LABELS, truth="", pred="pred_", traces=False):
    """Per row the prediction and its score; with ``traces`` also input, reply and truth."""
    pairs = [(truth + name, pred + name) for name in labels]
    columns = [label_struct(pred, labels).alias("prediction"), row_accuracy(pairs).alias("score")]
    if traces:
        columns += [
            F.col("text").alias("input_text"),
            F.col("raw_response"),
            label_struct(truth, labels).alias("ground_truth"),
        ]
    keys = [c for c in ("candidate_id", "id") if c in df.columns]
    return df.select(*keys, *columns)


def evaluate_candidates(rows, candidates, predictor, decode, labels=LABELS, many=False):
    """Every candidate on every row in one job: requests, prompts, replies, decoding, scores."""
    requests = candidate_requests(rows, candidates)
    prompt = F.concat(F.col("body"), F.lit("\n\n"), user_prompt(F.col("text")))
    answered = score_batch(requests.withColumn("prompt", prompt).drop("body", "text"), predictor, many=many)
    return evaluation(decode(answered.drop("prompt"), "raw_response"), labels)


def evaluate_candidate(rows, system, predictor, decode, labels=LABELS, traces=False):
    """Prompt, predict, decode and score: one candidate's system text on a batch of rows."""
    prompt = F.concat(F.lit(system + "\n\n"), user_prompt(F.col("text")))
    answered = score_batch(rows.withColumn("prompt", prompt), predictor).drop("prompt")
    return evaluation(decode(answered, "raw_response"), labels, traces=traces)
