"""What the physical plans may and may not hold."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
WRITING = {"ck_while_writing", "csv_roundtrip", "src_merchants", "src_transactions", "src_sla_events"}
RELATIONAL = sorted((set(entry.oracle_sql()) & set(entry.catalog())) - WRITING)
# reports and checks that read no percentile
PLAIN = (
    "mom_trends", "z_score_fraud", "interactions", "dq_leakage_guard", "data_exceptions", "dq_summary",
    "mart_portfolio_overview", "mart_risk_queue",
)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_products_and_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert banned not in plan


@pytest.mark.parametrize("name", PLAIN)
def test_no_percentile_where_none_is_read(spark, name):
    assert "band" not in _plan(entry.queries()[name](spark, FOLDER))


def test_percentile_is_banded_where_it_is_read(spark):
    assert "band" in _plan(entry.queries()["merchant_month_features"](spark, FOLDER))


def test_queue_sees_two_months(spark):
    """Day rows are copied to the last two month ends at most; older ones count into the first of them."""
    plan = _plan(entry.queries()["mart_risk_queue"](spark, FOLDER))
    assert "1995-01" not in plan and "2001-11-01" in plan


def test_percentile_reads_payments_once(spark):
    from tillwatch.plans import features
    from tillwatch.sources import stand_in as fx

    table = fx.StandIn(spark, FOLDER)
    df = features.approved_p95(table.transactions, fx.SPINE)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_feature_table_scans_each_event_table_once_for_windows(spark):
    plan = _plan(entry.Tables(spark, FOLDER).features())
    assert plan.count("orders.parquet") == 1
    assert plan.count("SortAggregate") == 0
    # one scan for the windows; the percentile's second use of its scan is replaced by the first at run time
    assert plan.count("lineitem.parquet") == 3


def test_hot_merchant_is_reduced_before_the_shuffle(spark, make):
    """A merchant with most of the payments leaves the rollup with one row per day."""
    from tillwatch.operators.rollup import daily_activity

    rows = [("hot", f"2024-01-{d:02d} 10:{m:02d}", "1.00", "APPROVED", 0, 0) for d in range(1, 11) for m in range(40)]
    daily = daily_activity(make.txns(*rows, ("cold", "2024-01-05 10:00", "1.00", "APPROVED", 0, 0)))
    assert daily.where("merchant_id = 'hot'").count() == 10
    assert "partial_sum" in _plan(daily)


def test_windows_are_one_aggregation(spark):
    """Deviations come from sums of squares: no window operator, and its sort, over the copied day rows."""
    plan = _plan(entry.queries()["txn_features_90d"](spark, FOLDER))
    assert "Window" not in plan and "Sort" not in plan.replace("SortAggregate", "")


def test_dataset_joins_no_second_aggregation(spark):
    """Features and label of the dataset come from one copy of the day rows to their months, percentile aside."""
    from tillwatch.plans import features
    from tillwatch.sources import stand_in as fx

    t = entry.Tables(spark, FOLDER)
    dataset = features.merchant_month_features(
        t.txns, t.sla, t.merchants, fx.SPINE, daily=t.daily(), percentile=False, label=fx.LABEL_RULE
    )
    assert _plan(dataset).count("Generate explode") == 1


def test_dataset_equals_the_join_of_its_tables(spark):
    from tillwatch.plans import marts

    t = entry.Tables(spark, FOLDER)
    joined = entry.six_decimals(marts.model_dataset(t.features(t.daily()), t.outcomes()))
    at_once = entry.queries()["model_dataset"](spark, FOLDER)
    assert at_once.columns == joined.columns
    assert at_once.exceptAll(joined).isEmpty() and joined.exceptAll(at_once).isEmpty()
