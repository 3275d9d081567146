"""Every query against its SQL on the smallest data, and the shape of its plan."""

import os
import re

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from labelgauge.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_result(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    shape = plan(df)
    assert "CartesianProduct" not in shape and "BroadcastNestedLoopJoin" not in shape
    if name not in ("model_batch", "candidate_batch", "resumed_scoring"):
        assert not re.search("Python|MapInPandas|MapInArrow", shape)
    wrong, rows = difference(df, con, entry_points.oracle_sql()[name])
    assert wrong is None, wrong
    assert rows > 0 or name == "label_rule_violations"


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(entry_points.oracle_sql())


def test_metrics_take_one_aggregate(spark):
    shape = plan(entry_points.queries()["all_metrics"](spark, SF))
    assert shape.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in shape
    assert "text#" not in shape


def test_dedup_cuts_down_before_the_shuffle(spark):
    shape = plan(entry_points.queries()["exact_dedup"](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", shape) and shape.count("Exchange") == 1


def test_splits_do_not_shuffle_the_texts(spark):
    shape = plan(entry_points.queries()["holdout"](spark, SF)).split("Subquery")[0]
    assert "Exchange" not in shape


def test_first_rows_push_the_cutoff_to_the_scan(spark):
    from labelgauge.operators.split import first_k
    from labelgauge.plans.tables import documents

    shape = plan(first_k(documents(spark, SF), 5))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(doc_id", shape)


def test_rows_are_sent_once_per_block_of_candidates(spark):
    """The texts pass no Exchange above a Generate of candidates; the members are unfolded after the join."""
    from labelgauge.operators.candidates import candidate_requests

    rows = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    many = spark.range(1000).selectExpr("id AS candidate_id", "concat('body ', id) AS body")
    df = candidate_requests(rows, many)
    shape = plan(df)
    above_join = shape[: shape.index("Join")]
    assert "inline(members" in above_join and "Exchange" not in above_join.split("inline(members")[0]
    assert df.count() == 1000 * rows.count() and df.select("candidate_id", "id").distinct().count() == df.count()


def test_report_reads_its_input_once(spark):
    shape = plan(entry_points.queries()["report_lines"](spark, SF))
    assert shape.count("FileScan") == 2 and shape.count("Expand") == 1  # documents and labels
