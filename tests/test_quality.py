"""Exceptions and constraint checks on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tillwatch.config import Spine
from tillwatch.operators.orphans import not_in
from tillwatch.operators.rollup import daily_activity
from tillwatch.operators.windows import month_members, past_months
from tillwatch.plans import features, quality
from tillwatch.sources import schemas

SPINE = Spine(date(2024, 1, 1), date(2024, 3, 1))


@pytest.mark.parametrize("parent", [["a"], ["a", None], [None], [], ["a", "a", "b"]])
@pytest.mark.parametrize("child", [["a", "b", "b", None], [None]])
def test_not_in_follows_sql(spark, parent, child):
    p = spark.createDataFrame([(x,) for x in parent], "k string")
    c = spark.createDataFrame([(x, i) for i, x in enumerate(child)], "k string, i int")
    p.createOrReplaceTempView("parent_keys")
    c.createOrReplaceTempView("child_keys")
    expected = spark.sql("SELECT * FROM child_keys WHERE k NOT IN (SELECT k FROM parent_keys)").collect()
    assert sorted(map(repr, not_in(c, p, "k").collect())) == sorted(map(repr, expected))


def test_exceptions(make, spark):
    txns = make.txns(
        ("a", "2024-01-10 10:00", "1.00", "APPROVED", 0, 0),
        ("a", "2024-02-10 10:00", "0.00", "APPROVED", 0, 0),
        ("a", "2024-03-31 23:59", "-5.00", "APPROVED", 0, 0),
        ("ghost", "2024-05-01 10:00", "5.00", "APPROVED", 0, 0),
        ("a", "2024-05-02 10:00", "5.00", "APPROVED", 0, 0),
    )
    txns = txns.unionByName(txns.where("txn_id = 't0'"))
    merchants, sla = make.merchants("a", "b"), make.sla(("a", "2024-01-10 10:00", 1))
    table = features.merchant_month_features(txns, sla, merchants, SPINE)
    found = quality.data_exceptions(txns, merchants, table, as_of="2024-05-01 10:00:00")
    rows = {(r.exception_type, r.reference_id): r.occurrences for r in found.collect()}
    assert rows == {
        ("ORPHAN_TXN", "t3"): 1,
        ("NEG_AMOUNT", "t1"): 1,
        ("NEG_AMOUNT", "t2"): 1,
        ("FUTURE_TS", "t4"): 1,
        ("DUP_TXN_ID", "t0"): 1,
        ("LEAKAGE_GUARD", "a_2024-01-31"): 3,
        ("LEAKAGE_GUARD", "a_2024-02-29"): 2,
        ("LEAKAGE_GUARD", "a_2024-03-31"): 1,
    }
    expanded = quality.expand_occurrences(found, chunk=2)
    assert expanded.columns == ["exception_type", "reference_id"]
    assert expanded.where("reference_id = 'a_2024-01-31'").count() == 3
    summary = {r.exception_type: r.exceptions for r in quality.exception_summary(found).collect()}
    assert summary["LEAKAGE_GUARD"] == 6 and expanded.count() == sum(summary.values())


def test_future_defaults_to_now(make):
    txns = make.txns(
        ("a", "2024-01-10 10:00", "1.00", "APPROVED", 0, 0), ("a", "2999-01-10 10:00", "1.00", "APPROVED", 0, 0)
    )
    assert [r.txn_id for r in quality.future_timestamps(txns).collect()] == ["t1"]


def test_windows_hold_nothing_later(make):
    txns = make.txns(*[("a", f"2024-01-{d:02d} 23:59", "1.00", "APPROVED", 0, 0) for d in range(1, 32)])
    found = quality.leakage_check(txns, make.sla(("a", "2024-02-29 23:00", 1)), make.merchants("a"), SPINE).collect()
    assert {(r.window_name, r.month_end.month): (r.first_day.day, r.last_day.day, r.violation) for r in found} == {
        ("txn_30", 1): (2, 31, 0), ("txn_60", 1): (1, 31, 0), ("txn_90", 1): (1, 31, 0),
        ("txn_30", 2): (31, 31, 0), ("txn_60", 2): (1, 31, 0), ("txn_90", 2): (1, 31, 0), ("txn_90", 3): (2, 31, 0),
        ("sla_60", 2): (29, 29, 0), ("sla_60", 3): (29, 29, 0), ("label_sla_60", 1): (29, 29, 0),
    }


@pytest.mark.parametrize("shift, back, caught", [(0, 0, False), (-1, 0, True), (-31, 0, True), (0, 1, True)])
def test_shifted_windows_are_caught(make, shift, back, caught):
    """Days picked by a distance that is off, or for another month, are days that the window may not hold."""
    txns = make.txns(*[("a", f"2024-0{m}-{d:02d} 12:00", "1.00", "APPROVED", 0, 0) for m in (1, 2, 3) for d in range(1, 29)])
    daily = daily_activity(txns, make.sla())
    members = month_members(daily, make.merchants("a"), past_months(F.col("day"), 90, SPINE), SPINE.past(90), SPINE)
    shifted = members.withColumns({"age": F.col("age") + shift, "month_end": F.last_day(F.add_months("month_end", -back))})
    found = quality.window_bounds(shifted, {"txn_30": ("n_txn", 0, 29), "txn_60": ("n_txn", 0, 59)})
    assert (found.where("violation = 1").count() > 0) == caught


def test_constraints(make, spark):
    txns = make.txns(
        ("a", "2024-01-10 10:00", "1.00", "APPROVED", 2, 0),
        (None, "2024-01-10 10:00", "0.00", "PENDING", None, 1),
        ("zz", "2024-01-10 10:00", "3.00", "DECLINED", 0, 0),
    )
    merchants = make.merchants("a", "a", "b")
    outcomes = spark.createDataFrame([("a", date(2024, 1, 31), 1)] * 2 + [("b", None, 0)] * 2, schemas.OUTCOMES)
    tables = {"merchants": merchants, "transactions": txns, "outcomes_monthly": outcomes}
    keys = {tuple(r) for r in quality.check_primary_keys(tables, schemas.PRIMARY_KEYS).collect()}
    assert keys == {("merchants", "a", 2), ("outcomes_monthly", "a_2024-01-31", 2)}
    foreign = {tuple(r) for r in quality.check_foreign_keys(tables, merchants, schemas.FOREIGN_KEYS).collect()}
    assert foreign == {("transactions", "t2")}
    nulls = {(r.table_name, r.column_name): r.null_rows for r in quality.check_not_null(tables, schemas.NOT_NULL).collect()}
    assert {k: n for k, n in nulls.items() if n} == {
        ("transactions", "merchant_id"): 1, ("transactions", "is_fraud"): 1, ("outcomes_monthly", "month_end"): 2,
    }
    domains = {(r.table_name, r.rule): r.violations for r in quality.check_domains(tables, schemas.DOMAINS).collect()}
    assert {k: n for k, n in domains.items() if n} == {
        ("transactions", "status in list"): 1, ("transactions", "is_fraud in list"): 1, ("transactions", "amount > 0"): 1,
    }


def test_label_sanity_order(make, spark):
    merchants = make.merchants("a", tier="HIGH").unionByName(make.merchants("b", tier="LOW"))
    outcomes = spark.createDataFrame(
        [("a", date(2024, 1, 31), 1), ("a", date(2024, 2, 29), 0), ("b", date(2024, 1, 31), 0)], schemas.OUTCOMES
    )
    assert [tuple(r) for r in quality.label_sanity(outcomes, merchants).collect()] == [
        ("HIGH", 2, 1, 0.5), ("LOW", 1, 0, 0.0),
    ]


def test_counts_taken_while_writing_equal_the_checks(make, spark, tmp_path):
    from tillwatch.sources import files

    txns = make.txns(
        ("a", "2024-01-20 10:00", "10.00", "APPROVED", None, 0),
        ("a", "2024-02-21 10:00", "-3.00", "ODD", 7, 0),
        (None, "2024-02-21 10:00", "30.00", None, 1, 0),
    )
    for i, frame in enumerate((txns, txns.limit(0))):
        watch = quality.Watch("transactions", schemas.NOT_NULL["transactions"], schemas.DOMAINS["transactions"])
        files.save_transactions(frame, str(tmp_path / str(i)), watch=watch.on)
        tables = {"transactions": frame}
        for found, expected in (
            (watch.null_rows(spark), quality.check_not_null(tables, schemas.NOT_NULL)),
            (watch.violations(spark), quality.check_domains(tables, schemas.DOMAINS)),
        ):
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_keys_are_counted_behind_a_shuffle(spark):
    """Nearly all keys are on one row: no scan task holds a count for each, no merged partition either, and a key on
    most rows is counted in several tasks."""
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    found = quality.spread_totals(rows, ["k"], "n", F.count(F.lit(1)))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 2 and all("REPARTITION_BY_NUM" in lines[i] for i in exchanges)
    assert not any("HashAggregate" in line for line in lines[exchanges[1]:]) and "apart_" in lines[exchanges[1]]
    assert found.where("n > 1").collect() == [("hot", 3000)] and found.count() == 1001
    assert quality.duplicate_ids(rows.select(F.nullif("k", F.lit("hot")).alias("k")), "k").collect() == [(None, 3000)]
