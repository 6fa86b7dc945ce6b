"""Readers, writers and views."""

import os
from datetime import date

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from tillwatch import session
from tillwatch.config import Spine
from tillwatch.operators import rollup
from tillwatch.operators.orphans import not_in
from tillwatch.operators.rollup import daily_activity
from tillwatch.operators.windows import month_members, past_months
from tillwatch.plans import labels, metrics, workflow
from tillwatch.sources import files, schemas
from tillwatch.sources.views import register_views

SPINE = Spine(date(2024, 1, 1), date(2024, 12, 1))


def test_typed_csv(spark, make, tmp_path):
    txns = make.txns(("a", "2024-01-10 10:07", "12.30", "APPROVED", 0, 1), ("b", "2024-01-11 00:00", "0.99", "DECLINED", 1, 0))
    files.write_scored(txns, str(tmp_path / "t"), "csv")
    back = files.load_transactions(spark, str(tmp_path / "t"))
    assert back.schema == schemas.TRANSACTIONS
    assert sorted(back.collect()) == sorted(txns.collect())


def test_plain_csv_text_with_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("merchant_id,industry,state,onboard_date,risk_tier_true\nx,Retail,CA,2024-07-05,LOW\n")
    assert files.load_merchants(spark, str(tmp_path / "m.csv")).first().onboard_date == date(2024, 7, 5)
    (tmp_path / "s.csv").write_text("event_id,merchant_id,event_ts,event_type,breached\ne,x,2024-07-05 13:00:00,DOC_REQUEST_MISSED,1\n")
    assert str(files.load_sla_events(spark, str(tmp_path / "s.csv")).first().event_ts) == "2024-07-05 13:00:00"


def test_wrong_values_stop_the_load(spark, tmp_path):
    (tmp_path / "s.csv").write_text("event_id,merchant_id,event_ts,event_type,breached\ne,x,yesterday,DOC_REQUEST_MISSED,1\n")
    with pytest.raises((PySparkException, Py4JError)):
        files.load_sla_events(spark, str(tmp_path / "s.csv")).collect()


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("risk_tier_true,state,note,industry,merchant_id,onboard_date\nLOW,CA,n,Retail,x,2024-07-05\n")
    row = files.load_merchants(spark, str(tmp_path / "m.csv")).first()
    assert (row.merchant_id, row.industry, row.state, row.risk_tier_true) == ("x", "Retail", "CA", "LOW")
    assert files.load_merchants(spark, str(tmp_path / "m.csv")).schema.names == schemas.MERCHANTS.names
    (tmp_path / "l.csv").write_text("merchant_id,industry,onboard_date,risk_tier_true\nx,Retail,2024-07-05,LOW\n")
    with pytest.raises(ValueError, match="state"):
        files.load_merchants(spark, str(tmp_path / "l.csv"))


def test_bad_values_stop_the_load_whatever_is_read_later(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "txn_id,merchant_id,txn_ts,amount,channel,status,is_fraud,is_chargeback\n"
        "t,x,2024-07-05 13:00:00,abc,CARD,APPROVED,0,0\n"
    )
    with pytest.raises((PySparkException, Py4JError)):
        files.load_transactions(spark, str(tmp_path / "t.csv"))
    assert files.load_transactions(spark, str(tmp_path / "t.csv"), validate=False).count() == 1


def test_nothing_runs_while_views_are_registered(spark, make):
    merchants, txns, sla = _year(make)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("views", "registering")
    register_views(merchants, txns, sla, SPINE, as_of="2025-01-01 00:00:00")
    not_in(txns, merchants, "merchant_id")
    metrics.precision_at(txns.withColumn("score", F.lit(0.5)), "score", label="is_fraud", key="merchant_id", month="txn_ts")
    assert list(tracker.getJobIdsForGroup("views")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_shared_folder_and_hand_offs(spark, tmp_path, monkeypatch):
    with session.HandOffs() as kept:
        frame = kept.write(spark.range(5), "five")
        path = frame.inputFiles()[0].removeprefix("file://")
        assert frame.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)

    class Cluster:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Unset:
        sparkContext = Cluster()
        conf = type("conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Unset())
    Cluster.getCheckpointDir = staticmethod(lambda: "hdfs://shared/folder")
    assert session.shared_folder(Unset()) == "hdfs://shared/folder"


def test_scored_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.1 + 0.2, ""), ("b", 1e-17, "High Vol")], "k string, s double, reason string")
    files.write_scored(frame, str(tmp_path / "csv"), "csv")
    back = {r.k: (r.s, r.reason) for r in files.read_scored(spark, str(tmp_path / "csv"), frame.schema, "csv").collect()}
    assert back == {"a": (0.1 + 0.2, None), "b": (1e-17, "High Vol")}
    files.write_scored(frame, str(tmp_path / "pq"))
    assert {r.reason for r in files.read_scored(spark, str(tmp_path / "pq"), frame.schema).collect()} == {"", "High Vol"}


def test_windows_prune_partitions_and_row_groups(spark, make, tmp_path):
    txns = make.txns(*[("a", f"20{y}-{m:02d}-10 10:00", "1.00", "APPROVED", 0, 0) for y in (22, 23, 24) for m in (1, 6)])
    files.save_transactions(txns, str(tmp_path / "t"))
    stored = files.load_transactions(spark, str(tmp_path / "t"), "parquet")
    assert stored.count() == 6
    rates = labels.forward_rates(stored, make.sla(("a", "2024-01-10 10:00", 1)), make.merchants("a"), SPINE)
    plan = rates._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "txn_ts" in line)
    assert "GreaterThanOrEqual(txn_ts,2024-02-01" in scan and "LessThan" in scan
    assert "txn_month" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "amount" not in scan and "channel" not in scan


def test_outcomes_table(spark, make, tmp_path):
    txns = make.txns(("a", "2024-02-10 10:00", "1.00", "APPROVED", 1, 0))
    rates = labels.forward_rates(txns, make.sla(("a", "2024-03-10 10:00", 1)), make.merchants("a", "b"), SPINE)
    labels.write_outcomes(labels.default_label(rates), str(tmp_path / "o"))
    back = files.load_outcomes(spark, str(tmp_path / "o"))
    assert back.schema == schemas.OUTCOMES and back.count() == 24
    assert {(r.merchant_id, r.month_end.month) for r in back.where("default_next_60d = 1").collect()} == {("a", 1)}


def _year(make):
    merchants = [f"m{i}" for i in range(6)]
    txns = make.txns(*[
        (m, f"2024-{month:02d}-{day:02d} 10:30", f"{10 + i}.00", "DECLINED" if (i + month) % 5 == 0 else "APPROVED",
         int((i + month + day) % 9 == 0), int((i * month + day) % 11 == 0))
        for i, m in enumerate(merchants) for month in range(1, 13) for day in (3, 12, 25)
    ])
    sla = make.sla(*[(m, f"2024-{month:02d}-15 09:00", int((i + month) % 4 == 0)) for i, m in enumerate(merchants) for month in range(1, 13)])
    return make.merchants(*merchants), txns, sla


def test_views(spark, make):
    merchants, txns, sla = _year(make)
    names = register_views(merchants, txns, sla, SPINE, as_of="2025-01-01 00:00:00")
    assert len(names) == 19
    assert spark.sql("SELECT count(*) FROM v_model_dataset").first()[0] == 72
    months = spark.sql("SELECT month_end, total_merchants FROM v_mart_portfolio_overview").collect()
    assert len(months) == 12 and {r.total_merchants for r in months} == {6}
    assert spark.sql("SELECT count(*) FROM v_mart_merchant_risk_queue").first()[0] == 6
    pairs = spark.sql(
        """SELECT count(*) FROM v_merchant_month_features f JOIN transactions t ON t.merchant_id = f.merchant_id
        WHERE date(t.txn_ts) > f.month_end"""
    ).first()[0]
    counted = "SELECT sum(occurrences) FROM v_data_exceptions WHERE exception_type = 'LEAKAGE_GUARD'"
    assert spark.sql(counted).first()[0] == pairs


def test_dataset_view_is_one_aggregation(spark, make):
    merchants, txns, sla = _year(make)
    register_views(merchants, txns, sla, SPINE)

    def joins(view):
        plan = spark.table(view)._jdf.queryExecution().optimizedPlan().toString()
        return sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines())

    assert joins("v_model_dataset") == joins("v_merchant_month_features")
    labels_of = lambda v: {(r.merchant_id, r.month_end): r.default_next_60d for r in spark.table(v).collect()}
    assert labels_of("v_model_dataset") == labels_of("outcomes_monthly")


def test_shuffles_have_more_partitions_over_more_files(spark, make, tmp_path, monkeypatch):
    merchants, txns, sla = _year(make)
    paths = {}
    for name, table in (("m", merchants), ("t", txns), ("s", sla)):
        paths[name] = str(tmp_path / f"{name} %")
        table.repartition(70).write.parquet(paths[name])
    merchants, txns, sla = (spark.read.parquet(p) for p in paths.values())
    size = {n: sum(f.stat().st_size for f in (tmp_path / f"{n} %").glob("*.parquet")) for n in paths}
    for name, table in (("m", merchants), ("t", txns), ("s", sla)):
        assert session.stored_bytes(table, looked_at=1000) == size[name]
        assert session.stored_bytes(table) == pytest.approx(size[name], rel=0.2)
    assert session.stored_bytes(spark.range(3)) == 0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = {tuple(r) for r in daily_activity(txns, sla).collect()}
    assert rollup.partitions(txns) == usual
    monkeypatch.setattr(rollup, "PART_BYTES", 5_000)
    events = session.stored_bytes(txns.select("txn_id").unionByName(sla.select(F.col("event_id").alias("txn_id"))))
    daily = daily_activity(txns, sla)
    assert daily.rdd.getNumPartitions() == -(-events // 5_000) > usual
    assert {tuple(r) for r in daily.collect()} == plain
    members = month_members(daily, merchants, past_months(F.col("day"), 30, SPINE), (None, None), SPINE)
    assert members.rdd.getNumPartitions() == -(-(events + 24 * session.stored_bytes(merchants)) // 5_000)


def test_runs_end_to_end(spark, make, tmp_path):
    merchants, txns, sla = _year(make)
    out = str(tmp_path)
    tables = workflow.build_warehouse(merchants, txns, sla, SPINE, out=out)
    assert tables.dataset.count() == 72 and tables.queue.count() == 6 and tables.overview.count() == 12
    run = workflow.run_training(merchants, txns, sla, SPINE, rounds=2, out=out)
    assert run.comparison.count() == 2
    portfolio = workflow.run_scoring(run.scored, out=out)
    assert sorted(x.name for x in (tmp_path / "outcomes_monthly").glob("month_end=*"))[0] == "month_end=2024-01-31"
    assert spark.read.parquet(f"{out}/merchant_month_features").where("month_end = '2024-12-31'").count() == 6
    assert files.load_transactions(spark, f"{out}/transactions", "parquet").count() == txns.count()
    assert files.read_scored(spark, f"{out}/final_scored_portfolio", portfolio.schema).count() == 18
    assert portfolio.count() == 18
    assert {"rule_score", "rule_reason", "final_risk_score", "alert_flag"} <= set(portfolio.columns)
