import pytest
from pyspark.sql import functions as F

from labelgauge.functions import text as text_fn
from labelgauge.functions.labels import answer_string, class_label, coerce_label, membership_label
from labelgauge.operators import clean
from labelgauge.schema import LABELS, require_columns


@pytest.mark.parametrize(
    "raw,want",
    [("1", 1), ("0", 0), ("1.0", 1), ("1.9", 1), ("-1.9", -1), (" 1 ", 1), ("1e0", 1), ("", 0), ("x", 0),
     ("NaN", 0), ("inf", 0), ("1d", 0), ("1f", 0), ("0x1", 0), ("True", 1), ("true", 1), ("False", 0), ("9007199254740993", 9007199254740993), ("1e30", 0), (".5", 0), ("1.", 1), (None, 0)],
)
def test_label_coercion(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(coerce_label(F.col("v"))).first()[0] == want


def test_numeric_columns_are_coerced(spark):
    df = spark.createDataFrame([(1.7, 1, True), (None, 0, False)], "a double, b int, c boolean")
    got = df.select(coerce_label(F.col("a")), coerce_label(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 0)]


def test_classes(spark):
    words = ["Positive", "Negative", "positive", "", None]
    df = spark.createDataFrame([(w,) for w in words], "label string")
    assert [r[0] for r in df.select(class_label(F.col("label"))).collect()] == [1, 0, None, None, None]
    assert clean.class_subset(df).count() == 2
    assert [r.label for r in clean.class_subset(df, keep=1).collect()] == [1]
    got = df.select(membership_label(F.col("label"), ["Positive", 1])).collect()
    assert [r[0] for r in got] == [1, 0, 0, 0, 0]


def test_first_occurrence_wins_even_in_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 30}", f"s{9 - i % 10}") for i in range(3000)]
    rows += [(5000, None, "s"), (4000, None, "s")]
    df = spark.createDataFrame(rows, "id int, text string, source string").repartition(7)
    got = {r.text: (r.source, r.id) for r in clean.first_of_each_text(df, ["source", "id"]).collect()}
    want = {}
    for i, text, source in rows:
        want[text] = min(want.get(text, (source, i)), (source, i))
    assert got == want


def test_label_filters_and_rules(spark):
    rows = [(0, 0, 0), (1, 0, 1), (0, 0, 1), (1, 0, 0)]
    df = spark.createDataFrame(rows, "stereotype int, vilification int, dehumanization int")
    some = ["stereotype", "vilification", "dehumanization"]
    assert clean.with_any_label(df, some).count() == 3
    counts = clean.any_label_counts(df, some).first()
    assert (counts.total, counts.kept, counts.removed) == (4, 3, 1)
    rule = clean.rule_counts(df).first()
    assert (rule.violations, rule.rows) == (1, 4)
    broken = clean.rule_violations(df).collect()
    assert len(broken) == 1 and broken[0].stereotype == 1


def test_text_choice_is_by_schema(spark):
    df = spark.createDataFrame([("a", None), ("b", "t")], "text string, translated_te string")
    got = [r[0] for r in df.select(text_fn.text_column(df.columns).alias("x")).collect()]
    assert got == [None, "t"]
    with pytest.raises(ValueError):
        require_columns(df, ["missing"])


def test_examples_and_answers(spark):
    df = spark.createDataFrame([("t", 1, 0, 0, 1, 0, 1)], ["text", *LABELS])
    assert clean.examples(df).first()["stereotype"] == "1"
    assert clean.examples(df, as_type="int").first()["vilification"] == 0
    answer = df.select(answer_string({c: c for c in LABELS})).first()[0]
    assert answer == (
        "stereotype=1, vilification=0, dehumanization=0, extreme_language=1, lack_of_empathy=0, "
        "invalidation=1"
    )


def test_text_helpers(spark):
    raw = " \n [EXPAND] one two [EXPANDED]x[EXPAND \t"
    df = spark.createDataFrame([(raw, "seed [EXPAND]")], "t string, s string")
    t = F.col("t")
    row = df.select(
        text_fn.strip(t).alias("strip"),
        text_fn.token_count(t).alias("tokens"),
        *[v.alias(k) for k, v in text_fn.text_stats(t, F.col("s")).items()],
        text_fn.template_prompt("a {text} b", t).alias("filled"),
    ).first()
    assert row.strip == raw.strip()
    assert row.tokens == len(raw.split())
    assert row.markers == raw.count("[EXPAND") == 3
    assert row.markers_removed == -2
    assert row.growth == len(raw) - 13
    assert row.expansion_ratio == pytest.approx(len(raw) / 13)
    assert row.filled == f"a {raw} b"
    with pytest.raises(ValueError):
        text_fn.template_prompt("no slot", t)


def test_token_count_on_odd_words(spark):
    words = ["", " ", "a", "é", "aé b", "éa b", "\x00a\x1cb", "x" * 50000 + " é" * 9, "తెలుగు పదం", "a　b c"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, t string")
    got = df.orderBy("i").select(text_fn.token_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(w.split()) for w in words]
