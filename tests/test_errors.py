import pytest
from pyspark.sql import functions as F

from labelgauge.functions.decode import decode_fenced_json
from labelgauge.functions.scores import answer_contained, composite, feedback, row_accuracy
from labelgauge.operators import batch, errors
from labelgauge.operators import candidates as cand
from labelgauge.operators.align import align
from labelgauge.operators.metrics import tallies
from labelgauge.schema import LABELS

NAMES = ["id", "text", "raw_response", *LABELS, *[f"pred_{c}" for c in LABELS]]


def rows(spark, *bits):
    """One row per (truth, prediction) pair of six-digit strings."""
    data = [(i, f"t{i}", f"r{i}", *map(int, t), *map(int, p)) for i, (t, p) in enumerate(bits)]
    return spark.createDataFrame(data, NAMES)


@pytest.fixture(scope="module")
def sample(spark):
    return rows(
        spark, ("100000", "010000"), ("111111", "111111"), ("100000", "010000"), ("000001", "000000"),
    )


def test_error_lists(sample):
    got = [r[0] for r in sample.orderBy("id").select(errors.error_list()).collect()]
    assert got[0] == ["stereotype: MISSED", "vilification: FALSE ALARM"]
    assert got[1] == ["(all correct)"]


def test_counts_pairs_and_plan(sample):
    counted = tallies(sample)
    assert [tuple(r) for r in errors.error_counts(counted).collect()] == [
        ("stereotype", "FN", 2), ("vilification", "FP", 2), ("invalidation", "FN", 1),
    ]
    assert [r.label for r in errors.most_frequent_errors(counted, 1).collect()] == ["stereotype"]
    assert [tuple(r) for r in errors.pair_counts(counted).collect()] == [("stereotype", "vilification", 2)]
    assert {tuple(r) for r in errors.error_pairs(sample).collect()} == {
        (0, "stereotype", "vilification"), (2, "stereotype", "vilification"),
    }
    assert [r.line for r in errors.underspecified(counted).collect()] == [
        "Section 5: stereotype (FP=0, FN=2)",
        "Section 5: vilification (FP=2, FN=0)",
        "Section 5: invalidation (FP=0, FN=1)",
    ]
    assert [r.line for r in errors.expansion_plan(counted, k=2).collect()] == [
        "Section 5a (stereotype): expand definition + markers — 2 errors",
        "Section 5b (vilification): expand definition + markers — 2 errors",
        "Section 9: add rule distinguishing stereotype vs vilification",
        "Section 11: add examples for labels with errors",
    ]


def test_nothing_wrong_gives_nothing(spark):
    counted = tallies(rows(spark, ("111111", "111111")))
    for step in (errors.error_counts, errors.pair_counts, errors.underspecified, errors.expansion_plan):
        assert step(counted).count() == 0


def test_reflective_records(sample):
    candidate = {"system_prompt": "P"}
    records = errors.reflective_records(
        sample, candidate, ["system_prompt", "other"], k=2, extra={"directive": "D"}
    ).collect()
    assert {(r.component_name, r.current_text, r.id) for r in records} == {
        (c, t, i) for c, t in (("system_prompt", "P"), ("other", "")) for i in (0, 1)
    }
    one = next(r for r in records if r.id == 0)
    assert one.confusion_signal == "Most confused: [(('stereotype', 'FN'), 2), (('vilification', 'FP'), 2)]"
    assert one.score == pytest.approx(4 / 6) and one.directive == "D" and one.output == "r0"
    assert len(one.underspecified_sections) == 3
    worst = errors.reflective_records(sample, candidate, ["system_prompt"], k=2, worst=True)
    assert {r.id for r in worst.collect()} == {0, 2}
    off = errors.reflective_records(sample, candidate, ["system_prompt"], traces=False)
    assert off.count() == 0


def test_tagged_errors(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (0, 0)], "label int, predicted int")
    got = [tuple(r) for r in errors.tagged_errors(df).collect()]
    assert got == [(0, 1, "False Positive"), (1, 0, "False Negative")]
    assert errors.missed_rows(df).count() == 2


def test_align_modes(spark):
    truth = spark.createDataFrame([(1,), (2,)], "id int")
    pred = spark.createDataFrame([(1, 1)], "id int, pred_a int")
    got = {m: {tuple(r) for r in align(truth, pred, missing=m, columns=["pred_a"]).collect()}
           for m in ("default", "null", "skip")}
    assert got == {"default": {(1, 1), (2, 0)}, "null": {(1, 1), (2, None)}, "skip": {(1, 1)}}


def test_row_scores(spark):
    df = spark.createDataFrame([("a=1", "so a=1, b", 1, 1, 2000)], "answer string, reply string, t int, p int, n int")
    row = df.select(
        answer_contained(F.col("answer"), F.col("reply")).alias("hit"),
        feedback(F.col("answer"), F.col("reply")).alias("words"),
        composite(row_accuracy([("t", "p")]), F.col("n")).alias("score"),
        composite(F.lit(0.5), F.lit(9000)).alias("full"),
    ).first()
    assert row.hit == 1.0 and row.words == "Expected: a=1\nGot: so a=1, b"
    assert row.score == pytest.approx(0.4 + 0.6 * 0.5)
    assert row.full == pytest.approx(0.8)


def test_evaluation_contract(sample):
    def fake_model(prompt):
        if "t1" in prompt:
            raise RuntimeError("down")
        return '{"stereotype": 1}'

    truth = sample.select("id", "text", *LABELS)
    plain = batch.evaluate_candidate(truth, "S", fake_model, decode_fenced_json)
    assert plain.columns == ["id", "prediction", "score"]
    traced = batch.evaluate_candidate(truth, "S", fake_model, decode_fenced_json, traces=True)
    got = {r.id: r for r in traced.collect()}
    assert len(got) == 4
    assert {"input_text", "raw_response", "prediction", "ground_truth", "score"} <= set(traced.columns)
    assert got[1].raw_response == "<ERROR: down>" and got[1].prediction.stereotype == 0
    assert got[1].score == 0 and got[0].score == 1 and got[0].ground_truth.stereotype == 1


def test_model_is_set_up_once_per_task(spark):
    def setup():
        calls = []

        def model(prompt):
            calls.append(prompt)
            return str(len(calls))

        return model

    df = spark.range(10).selectExpr("id", "string(id) AS prompt").coalesce(1)
    got = {r.raw_response for r in batch.score_batch(df, setup=setup).collect()}
    assert got == {str(i) for i in range(1, 11)}


BODY = "Return JSON with stereotype. " + "x" * 100


def test_gates(spark):
    bodies = [BODY, "short JSON stereotype", BODY.replace("JSON", "json"), "JSON " + "x" * 200, "", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "candidate_id int, body string")
    ok = cand.is_valid(F.col("body"))
    assert [r.candidate_id for r in cand.passing_or_all(df, ok).collect()] == [0]
    assert cand.passing_or_all(df.where("candidate_id > 0"), ok).count() == 5
    words = "HARMFUL SPEECH CLASSIFIER {" + " w" * 147
    strict = [words, words[:-2], words.replace("{", "["), words.lower(), words + "✑" * 40,
              words + "✑" * 15, words + "\U0001f600" * 40, words + "✐" * 400]
    want = [
        len(b.split()) >= 150 and "{" in b and "HARMFUL SPEECH CLASSIFIER" in b
        and sum(ord(c) > 10000 for c in b) / len(b) <= 0.05 for b in strict
    ]
    df = spark.createDataFrame(list(enumerate(strict)), "candidate_id int, body string")
    got = [r[0] for r in df.orderBy("candidate_id").select(cand.is_valid_strict(F.col("body"))).collect()]
    assert got == want and True in want and want.count(False) >= 4


def test_choice_of_candidates(spark):
    data = [
        (0, 0.0, None, 0.5, "aa"), (1, None, 0.7, 0.9, "bbb"), (2, 0.7, 0.1, None, "ccc"),
        (3, None, None, None, "d"),
    ]
    df = spark.createDataFrame(data, "candidate_id int, a double, b double, c double, body string")
    score = cand.first_nonzero_score(F.col("a"), F.col("b"), F.col("c"))
    assert [r[0] for r in df.select(score).collect()] == [0.5, 0.7, 0.7, 0.0]
    assert cand.best_by_score(df, score).first().candidate_id == 1
    assert cand.best_by_length(df).first().candidate_id == 1
    assert cand.best_score(df, "b").first().best_score == 0.7
    assert cand.best_score(df.where("b > 9"), "b").first().best_score == 0.0


def test_requests_and_comparison(spark):
    rows_ = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    bodies = spark.createDataFrame([(0, "A"), (2, "C")], "candidate_id int, body string")
    want = {(c, i) for c in ("A", "C") for i in (1, 2)}
    salted = cand.candidate_requests(rows_, bodies)
    assert "BroadcastExchange" not in salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.body, r.id) for r in salted.collect()} == want and salted.count() == 4
    assert cand.candidate_requests(rows_, bodies.where("candidate_id > 9")).count() == 0
    far = spark.createDataFrame([(-5, "A"), (7, "B"), (100_000, "C")], "candidate_id int, body string")
    assert {(r.body, r.id) for r in cand.candidate_requests(rows_, far).collect()} == {(c, i) for c in "ABC" for i in (1, 2)}
    small = cand.candidate_blocks(far.unionByName(bodies), size=2, chars=10**6).collect()
    assert max(len(r.members) for r in small) <= 2 and sum(len(r.members) for r in small) == 5
    long = spark.range(40).selectExpr("id AS candidate_id", "repeat('x', 100) AS body")
    assert max(len(r.members) for r in cand.candidate_blocks(long, 1000, 250).collect()) <= 4
    assert cand.candidate_requests(rows_, long, size=3, chars=150).count() == 80
    f1 = spark.createDataFrame([("base", 0.4), ("new", 0.5)], "approach string, macro_f1 double")
    got = {r.approach: r.gain_pct for r in cand.compare(f1, "base").collect()}
    assert got["base"] == 0 and got["new"] == pytest.approx(25)
    zero = f1.withColumn("macro_f1", F.when(F.col("approach") == "base", 0.0).otherwise(0.5))
    assert {r.gain_pct for r in cand.compare(zero, "base").collect()} == {0.0}


def test_scoring_resumes_where_it_stopped(spark, tmp_path):
    import os

    from labelgauge.operators.batch import score_resumable

    log = str(tmp_path / "asked")
    os.makedirs(log)

    def model(prompt):
        import uuid

        with open(f"{log}/{prompt}-{uuid.uuid4().hex}", "w"):
            pass
        if prompt == "p7" and len([f for f in os.listdir(log) if f.startswith("p7-")]) == 1:
            raise ValueError("busy")
        return f"re {prompt}"

    rows_ = spark.createDataFrame([(i if i else None, f"p{i}") for i in range(20)], "id int, prompt string")
    path = str(tmp_path / "replies")
    first = score_resumable(rows_.where("id < 9 OR id IS NULL"), model, path, batches=4, keep_failed=False)
    assert first.count() == 8  # p7 failed and is not kept
    every = score_resumable(rows_, model, path, batches=4, keep_failed=False).collect()
    assert sorted((r.id or 0, r.raw_response, r.failed) for r in every) == [(i, f"re p{i}", False) for i in range(20)]
    asked = [f.split("-")[0] for f in os.listdir(log)]
    assert sorted(asked) == sorted([f"p{i}" for i in range(20)] + ["p7"])
    again = score_resumable(rows_, model, path, batches=4).count()
    assert again == 20 and len(os.listdir(log)) == 21
