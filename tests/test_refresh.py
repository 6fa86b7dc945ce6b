"""Tables refreshed after late events against tables built anew."""

import os
from datetime import date

import pytest
from pyspark.errors import AnalysisException

from tillwatch.config import Spine
from tillwatch.plans import workflow

from test_sources import SPINE, _year


def rows(spark, out, name):
    found = spark.read.parquet(f"{out}/{name}")
    return sorted(map(tuple, found.select(*sorted(found.columns)).collect()), key=repr)


def written(folder):
    return {p.name: max(os.stat(f).st_mtime_ns for f in p.glob("part-*")) for p in folder.glob("month_end=*")}


def test_months_that_a_day_can_change():
    months = workflow.months_of_events(SPINE, date(2024, 5, 12), date(2024, 5, 12))
    assert months == (Spine(date(2024, 5, 1), SPINE.last), Spine(date(2024, 3, 1), date(2024, 4, 1)))
    assert workflow.months_of_events(SPINE, date(2025, 6, 1), date(2025, 6, 1)) == (None, None)
    ahead = workflow.months_of_events(SPINE, date(2025, 1, 15), date(2025, 1, 31))
    assert ahead == (None, Spine(date(2024, 11, 1), date(2024, 12, 1)))
    assert workflow.months_of_events(SPINE, date(2024, 2, 1), date(2024, 2, 1))[1] == Spine(date(2024, 1, 1), date(2024, 1, 1))


def test_late_day_equals_a_full_build(spark, make, tmp_path):
    merchants, txns, sla = _year(make)
    out, anew = tmp_path / "out", tmp_path / "anew"
    late = make.txns(*[(m, "2024-05-12 18:00", "77.00", "APPROVED", 1, 1) for m in ("m0", "m3")]).selectExpr(
        "concat('late-', txn_id) AS txn_id", *txns.columns[1:])
    workflow.build_warehouse(merchants, txns, sla, SPINE, out=str(out))
    before = {n: (written(out / n), rows(spark, out, n)) for n in ("merchant_month_features", "outcomes_monthly")}
    tables = workflow.refresh_warehouse(merchants, txns.union(late), sla, date(2024, 5, 12), date(2024, 5, 12), str(out), SPINE)
    assert tables.dataset.count() == 72 and tables.queue.count() == 6
    workflow.build_warehouse(merchants, txns.union(late), sla, SPINE, out=str(anew))
    for name, first, last in (("merchant_month_features", "2024-05-31", "2024-12-31"), ("outcomes_monthly", "2024-03-31", "2024-04-30")):
        assert rows(spark, out, name) == rows(spark, anew, name) != before[name][1]
        touched = {m for m, at in written(out / name).items() if at != before[name][0][m]}
        assert touched == {m for m in before[name][0] if first <= m.split("=")[1] <= last}
    # built again in place
    with pytest.raises(AnalysisException):
        workflow.build_warehouse(merchants, txns, sla, SPINE, out=str(out))
    workflow.build_warehouse(merchants, txns, sla, SPINE, out=str(out), mode="overwrite")
    assert rows(spark, out, "outcomes_monthly") == before["outcomes_monthly"][1]
