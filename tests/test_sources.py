import glob
import json

import pytest
from pyspark.errors import AnalysisException

from labelgauge.operators.clean import class_subset, first_of_each_text
from labelgauge.operators.metrics import tallies
from labelgauge.operators.report import REPORT_ORDER, probe_report, run_summary
from labelgauge.schema import LABELS
from labelgauge.sources import readers, writers

TEXTS = ['He said "no", twice', "two\nlines", " outer blanks ", "comma, comma", "back\\slash", "é"]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_labelled_files(spark, tmp_path):
    write(tmp_path / "df0.csv", 'Sentences,Label\n"a, b",Positive\n"c\nd",Negative\nNA,Negative\n')
    write(tmp_path / "df1.csv", 'Sentences,Label\n"a, b",Negative\n"say ""x""",Positive\n')
    df = readers.read_labelled_csv(spark, f"{tmp_path}/df*.csv")
    got = {(r.text, r.label, r.source.rsplit("/", 1)[1]) for r in df.collect()}
    assert got == {
        ("a, b", "Positive", "df0.csv"), ("c\nd", "Negative", "df0.csv"), (None, "Negative", "df0.csv"),
        ("a, b", "Negative", "df1.csv"), ('say "x"', "Positive", "df1.csv"),
    }
    first = first_of_each_text(df, ["source"])
    assert {(r.text, r.label) for r in class_subset(first).collect()} == {
        ("a, b", 1), ("c\nd", 0), (None, 0), ('say "x"', 1),
    }
    with pytest.raises(AnalysisException):
        readers.read_labelled_csv(spark, f"{tmp_path}/none*.csv")


def test_columns_go_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "Label,extra,Sentences\nPositive,x,one\n")
    got = readers.read_labelled_csv(spark, f"{tmp_path}/a.csv").first()
    assert (got.text, got.label) == ("one", "Positive")
    write(tmp_path / "b.csv", "Sentences,extra,Label\ntwo,x,Negative\n")
    got = readers.read_labelled_csv(spark, f"{tmp_path}/*.csv").collect()
    assert {(r.text, r.label, r.source[-5:]) for r in got} == {("one", "Positive", "a.csv"), ("two", "Negative", "b.csv")}
    write(tmp_path / "c.csv", "other,Label\ntwo,Negative\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_labelled_csv(spark, f"{tmp_path}/c.csv")


def test_multilabel_file(spark, tmp_path):
    head = "text,translated_te," + ",".join(LABELS)
    path = write(tmp_path / "m.csv", f"{head}\nen,te,1,0,1.0,x,,1\nen,,1,1,1,1,1,1\n")
    rows = readers.read_multilabel(spark, path).collect()
    assert [[r[c] for c in LABELS] for r in rows] == [[1, 0, 1, 0, 0, 1]]
    assert len(readers.read_multilabel(spark, path, text_col="text").collect()) == 2
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_multilabel(spark, path, text_col="other")


def test_first_column_and_configured(spark, tmp_path):
    path = write(tmp_path / "p.csv", "sentence,kind\nx,yes\n,no\ny,1\n")
    got = readers.read_first_column(spark, [str(tmp_path / "absent.csv"), path])
    assert got.columns == ["text", "kind"] and {r.text for r in got.collect()} == {"x", "y"}
    with pytest.raises(FileNotFoundError):
        readers.read_first_column(spark, [str(tmp_path / "absent.csv")])
    config = {"path": path, "text_col": "sentence", "label_col": "kind", "positive_val": ["yes", 1]}
    rows = readers.read_configured(spark, config).collect()
    assert {(r.text, r.label, r.source) for r in rows} == {("x", 1, "p.csv"), ("y", 1, "p.csv")}
    other = write(tmp_path / "n.csv", "sentence\nz\n")
    both = readers.read_class_files(spark, path, other).collect()
    assert {(r.text, r.label) for r in both} == {("x", 1), ("y", 1), ("z", 0)}


def test_csv_reads_back(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    path = writers.write_csv(df, str(tmp_path / "out"))
    got = readers._csv(spark, path, df.schema).collect()
    assert {(r.id, r.text) for r in got} == set(enumerate(TEXTS))


def test_metrics_json(spark, tmp_path):
    rows = [(i, *[i % 2] * 6, *[i % 3 % 2] * 6) for i in range(12)]
    df = spark.createDataFrame(rows, ["id", *LABELS, *[f"pred_{c}" for c in LABELS]])
    path = writers.write_json(run_summary(tallies(df), {"model": "m"}), str(tmp_path / "j"))
    (file,) = [f for f in glob.glob(f"{path}/*.json") if open(f).read()]
    found = json.loads(open(file).read())
    assert found["model"] == "m"
    assert list(found["metrics"]["per_label"]) == list(LABELS)
    assert found["metrics"]["subset_accuracy"] == pytest.approx(6 / 12)


def test_report_reads_as_one_text(spark, tmp_path):
    rows = [
        (0, "found", 1, "g", "B", "r"), (1, "x" * 300, 0, "g", "", ""), (2, "found", 1, "", "A", ""),
        (3, "found", 1, "", "A", ""),
    ]
    names = "id long, text string, predicted int, `group` string, trigger string, reasoning string"
    report = probe_report(spark.createDataFrame(rows, names), "Why they are missed.")
    path = writers.write_lines(report, str(tmp_path / "r"), REPORT_ORDER)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))
    bar = "=" * 65
    assert text.split("\n")[:7] == [
        bar, "STEREOTYPE DETECTION RESULTS", bar, "Total samples      : 4",
        "Correctly detected : 3  (75.0%)", "Missed stereotypes : 1  (25.0%)",
        "Detection Rate     : 0.7500",
    ]
    assert "  Trigger A: 2\n  Trigger B: 1\n\n" + bar in text
    assert "MISSED STEREOTYPES — 1 examples" in text and "Why they are missed." in text
    assert "[2] TEXT: " + "x" * 200 + "\n     Model's Group   : g\n     → TRUE LABEL" in text
    none = probe_report(spark.createDataFrame([r for r in rows if r[2]], names))
    assert none.where("section > 2").count() == 0
    empty = probe_report(spark.createDataFrame([], names)).orderBy(*REPORT_ORDER).collect()
    assert [r.section for r in empty] == [0] * 7 + [1] and empty[3].line == "Total samples      : 0"
    twice = probe_report(spark.createDataFrame([rows[1], rows[1]], names))
    assert twice.where("section = 4 AND part = 0").count() == 2


def test_ids_come_from_the_content(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), (None, "a"), ("b", "x")]
    df = spark.createDataFrame(rows, "text string, label string")
    ids = sorted((r.id, r.text or "", r.label or "") for r in readers.with_id(df).collect())
    assert len({i for i, _, _ in ids}) == 5
    assert ids == sorted((r.id, r.text or "", r.label or "") for r in readers.with_id(df.repartition(3)).collect())
    assert {i[-2:] for i, t, _ in ids if t == "a"} == {"-1", "-2"}


def test_a_row_that_makes_up_a_third_is_spread(spark):
    df = spark.range(0, 3000, 1, 5).selectExpr("if(id % 3 = 0, 'same', concat('t', id)) AS text", "if(id % 6 = 1, 'twice', 'x') AS label")
    df = df.unionByName(df.where("label = 'twice'"))
    got = [r.id for r in readers.with_id(df).collect()]
    assert len(set(got)) == len(got) == 3500
    key = max({i[:32] for i in got}, key=[i[:32] for i in got].count)
    assert sorted(int(i[33:]) for i in got if i.startswith(key)) == list(range(1, 1001))
    shape = readers.with_id(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in shape.split("\n") if "Window [" in line]
    assert windows and not any("text#" in line or "label#" in line for line in windows)


def test_headers_that_span_lines(spark, tmp_path):
    write(tmp_path / "a.csv", '"note\none",Label,Sentences\nx,Positive,"first\ntext"\n')
    write(tmp_path / "b.csv", '"note\ntwo",Sentences,Label\nx,second,Negative\n')
    got = {(r.text, r.label) for r in readers.read_labelled_csv(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {("first\ntext", "Positive"), ("second", "Negative")}


@pytest.mark.parametrize("multi_line", [True, False])
def test_headers_cost_the_same_whatever_the_size(spark, tmp_path, multi_line):
    def read_by(path):
        before = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead") or 0
        assert readers._files_by_header(spark, [path], multi_line) == [[f"file://{path}"]]
        return (spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead") or 0) - before

    line = "some text to read,Positive\n"
    large = write(tmp_path / "large.csv", "Sentences,Label\n" + line * 600_000)
    assert read_by(large) < 2_000_000
