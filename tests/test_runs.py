"""The whole runs on hand-made tables, and the folder for written tables."""

import os

import pytest

from labelgauge.plans.runs import candidate_run, multilabel_run, probe_run
from labelgauge.schema import LABELS, DISPLAY_NAMES
from labelgauge.session import shared_dir


def six_lines(bits):
    return "\n".join(f"{DISPLAY_NAMES[c]}: {b}" for c, b in zip(LABELS, bits))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, "a", "101000"), (1, "b", "010101"), (2, "c", "111111"), (3, "d", "000001")]
    return spark.createDataFrame(
        [(i, t, *map(int, bits)) for i, t, bits in data], ["id", "text", *LABELS]
    )


def test_multilabel_run(spark, rows, tmp_path):
    replies = [(0, six_lines("101000")), (1, "Stereotype: 1"), (2, "")]
    run = multilabel_run(rows, spark.createDataFrame(replies, "id long, raw_response string"))
    # Five labels missing in reply 1, all six in the empty reply and in the absent one.
    assert run["failures"].first().parse_failures == 17
    kept = {r.id: r.raw_model_output for r in run["predictions"].collect()}
    assert kept[2] == kept[3] == "API_ERROR" and kept[1] == "Stereotype: 1"
    found = {r.label: (r.tp, r.fp, r.tn, r.fn) for r in run["metrics"].collect()}
    assert found["stereotype"] == (1, 1, 1, 1)
    assert found["invalidation"] == (0, 0, 1, 3)
    again = multilabel_run(
        rows, spark.createDataFrame(replies, "id long, raw_response string"), str(tmp_path / "p")
    )
    for name in ("predictions", "metrics"):
        assert sorted(again[name].collect()) == sorted(run[name].collect())
    assert run["macro"].first().accuracy == pytest.approx((0.5 + 0.5 + 0.75 + 0.5 + 0.75 + 0.25) / 6)


def test_probe_run(spark):
    data = [(0, "same"), (1, "same"), (2, None), (3, "x"), (4, "y")]
    positives = spark.createDataFrame(data, "id long, text string")
    replies = [(0, "Trigger: 2\nAnswer: Yes"), (3, "Answer: No"), (4, None)]
    run = probe_run(positives, spark.createDataFrame(replies, "id long, raw_response string"))
    rate = run["rate"].first()
    assert (rate.total, rate.detected, rate.missed) == (3, 1, 2)
    assert [tuple(r) for r in run["triggers"].collect()] == [("2", 1)]
    assert {(r.id, r.raw_output) for r in run["missed"].collect()} == {(3, "Answer: No"), (4, "ERROR")}


def test_candidate_run(spark, rows):
    good = "Return JSON for stereotype " + "x" * 100
    candidates = spark.createDataFrame([(0, "bad"), (1, good), (2, good)], "candidate_id int, body string")
    truth = {r.id: [r[c] for c in LABELS] for r in rows.collect()}

    def reply(bits):
        return "```json\n{" + ", ".join(f'"{c}": {b}' for c, b in zip(LABELS, bits)) + "}\n```"

    replies = [(0, i, reply(bits)) for i, bits in truth.items()]
    replies += [(1, i, "no JSON") for i in truth]
    replies += [(2, i, reply(bits if i < 2 else [0] * 6)) for i, bits in truth.items()]
    table = spark.createDataFrame(replies, "candidate_id int, id long, raw_response string")
    run = candidate_run(rows, candidates, table)
    scores = {r.candidate_id: r.mean_score for r in run["scores"].collect()}
    assert scores[0] == 1 and scores[2] > scores[1]
    # The best score is the first candidate's, but its text does not pass the gate.
    assert run["best"].first().candidate_id == 2
    found = {(r.scope, r.label, r.metric): r.value for r in run["metrics"].collect()}
    assert found["overall", "", "subset_accuracy"] == 0.5
    assert found["label", "stereotype", "support"] == 2


def test_shared_dir_follows_the_setting(spark, tmp_path):
    class Session:
        conf = {"spark.checkpoint.dir": str(tmp_path)}

    first, second = shared_dir(Session, "t"), shared_dir(Session, "t")
    assert first != second and os.path.dirname(first) == str(tmp_path)
    # Unset in the test session: one folder stands in for it throughout.
    assert os.path.dirname(shared_dir(spark, "t")) == os.path.dirname(shared_dir(spark, "t"))


def test_replies_are_decoded_before_they_are_shuffled(spark, rows):
    """No exchange or join below the results carries the text of a reply."""
    import re

    from labelgauge.operators.align import score_stored_replies
    from labelgauge.functions.decode import decode_fenced_json

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        replies = spark.createDataFrame([(0, "x")], "id long, raw_response string")
        several = spark.createDataFrame([(0, 0, "x")], "candidate_id int, id long, raw_response string")
        texts = spark.createDataFrame([(0, "x")], "candidate_id int, body string")
        found = [
            score_stored_replies(rows, replies, decode_fenced_json).select("id", "pred_stereotype"),
            multilabel_run(rows, replies)["metrics"],
            candidate_run(rows, texts, several)["scores"],
            candidate_run(rows, texts, several)["metrics"],
        ]
        for df in found:
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
            assert shuffled and not any("raw_response" in columns for columns in shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_absent_replies_are_decoded_from_null(spark, rows):
    from labelgauge.operators.align import score_stored_replies
    from labelgauge.functions.decode import decode_fenced_json, decode_probe, decode_six_lines

    none = spark.createDataFrame([], "id long, raw_response string")
    nulls = rows.select("id").selectExpr("id", "CAST(NULL AS STRING) AS raw_response")
    for decode in (decode_fenced_json, decode_probe, decode_six_lines):
        got = sorted(map(tuple, score_stored_replies(rows.select("id"), none, decode).collect()), key=str)
        assert got == sorted(map(tuple, decode(nulls, "raw_response").collect()), key=str)


def test_candidate_batch(spark, rows):
    """Several candidates scored in one job by a model that takes lists and answers oddly at times."""
    from labelgauge.functions.decode import decode_fenced_json
    from labelgauge.operators.batch import evaluate_candidates, score_batch

    def model(prompts):
        if len(prompts) > 1:
            raise RuntimeError("one at a time")
        return [1 if "other" in prompts[0] else '{"stereotype": 1}']

    texts = spark.createDataFrame([(-1, "say so"), (9, "other")], "candidate_id int, body string")
    got = evaluate_candidates(rows, texts, model, decode_fenced_json, many=True).collect()
    assert len(got) == 8 and {r.prediction.stereotype for r in got if r.candidate_id == -1} == {1}
    assert {r.prediction.stereotype for r in got if r.candidate_id == 9} == {0}
    prompts = spark.createDataFrame([("a",), (None,), ("c",)], "prompt string")
    replies = {r.prompt: (r.raw_response, r.failed) for r in score_batch(prompts, lambda p: {"a": "yes", None: None}.get(p, 5)).collect()}
    assert replies["a"] == ("yes", False) and replies[None] == (None, False)
    assert replies["c"] == ("<ERROR: a reply of type int>", True)
