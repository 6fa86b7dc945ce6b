"""Closed forms against the product of joins they replace."""

import random
from datetime import date, timedelta

import pytest

from tillwatch.config import LabelRule, Spine
from tillwatch.operators.spine import month_spine
from tillwatch.plans import features, labels

SPINE = Spine(date(2024, 1, 1), date(2024, 3, 1))


def _sample(make, seed):
    rng = random.Random(seed)

    def stamp():
        day = date(2023, 10, 1) + timedelta(days=rng.randrange(230))
        return f"{day} {rng.choice(['00:00', '09:30', '23:59'])}"

    merchants = ("a", "b", "c", "quiet")
    txns = make.txns(*[
        (rng.choice(merchants[:3]), stamp(), rng.choice(["0.01", "19.99", "2500.00", f"{rng.randrange(1, 10**7) / 100:.2f}"]),
         rng.choice(["APPROVED", "APPROVED", "DECLINED"]), int(rng.random() < 0.2), int(rng.random() < 0.1))
        for _ in range(400)
    ])
    sla = make.sla(*[(rng.choice(merchants[1:3]), stamp(), int(rng.random() < 0.3)) for _ in range(60)])
    return make.merchants(*merchants), txns, sla


@pytest.mark.parametrize("seed", [1, 2])
def test_products_of_joins(spark, make, seed):
    merchants, txns, sla = _sample(make, seed)
    txns.createOrReplaceTempView("t_txns")
    sla.createOrReplaceTempView("t_sla")
    month_spine(merchants, SPINE).createOrReplaceTempView("t_months")
    literal = spark.sql(
        """SELECT m.merchant_id, m.month_end, coalesce(sum(t.is_fraud), 0) AS cumulative_fraud_90d,
        coalesce(stddev_samp(CASE WHEN t.status = 'APPROVED' THEN double(t.amount) END), 0) AS vol
        FROM t_months m LEFT JOIN t_txns t ON t.merchant_id = m.merchant_id
          AND date(t.txn_ts) > m.month_end - 90 AND date(t.txn_ts) <= m.month_end
        LEFT JOIN (SELECT DISTINCT merchant_id, date(txn_ts) AS d FROM t_txns) d ON d.merchant_id = m.merchant_id
          AND d.d > m.month_end - 90 AND d.d <= m.month_end GROUP BY ALL"""
    ).collect()
    found = {
        (r.merchant_id, r.month_end): r for r in features.txn_features_90d(txns, merchants, SPINE).collect()
    }
    assert len(found) == len(literal) == 12
    for row in literal:
        mine = found[row.merchant_id, row.month_end]
        assert mine.cumulative_fraud_90d == row.cumulative_fraud_90d
        assert mine.rolling_3m_volatility_90d == pytest.approx(row.vol, rel=1e-9, abs=1e-9)

    forward = spark.sql(
        """SELECT m.merchant_id, m.month_end, coalesce(sum(t.is_fraud), 0) AS f, count(t.txn_id) AS n,
        coalesce(avg(s.breached), 0) AS b, coalesce(avg(t.is_chargeback), 0) AS c
        FROM t_months m LEFT JOIN t_txns t ON t.merchant_id = m.merchant_id
          AND date(t.txn_ts) > m.month_end AND date(t.txn_ts) <= m.month_end + 60
        LEFT JOIN t_sla s ON s.merchant_id = m.merchant_id
          AND date(s.event_ts) > m.month_end AND date(s.event_ts) <= m.month_end + 60 GROUP BY ALL"""
    ).collect()
    rates = {(r.merchant_id, r.month_end): r for r in labels.forward_rates(txns, sla, merchants, SPINE).collect()}
    for row in forward:
        mine = rates[row.merchant_id, row.month_end]
        assert (mine.future_fraud_count, mine.future_txn_count) == (row.f, row.n)
        assert mine.future_sla_breach_rate == pytest.approx(row.b)
        assert mine.future_chargeback_rate == pytest.approx(row.c)


def test_one_approved_payment_has_no_deviation(make):
    txns = make.txns(
        ("a", "2024-01-20 10:00", "10.00", "APPROVED", 1, 0),
        ("a", "2024-01-21 10:00", "99.00", "DECLINED", 1, 0),
    )
    row = features.txn_features_90d(txns, make.merchants("a"), SPINE).where("month_end = '2024-01-31'").first()
    assert (row.rolling_3m_volatility_90d, row.cumulative_fraud_90d) == (0.0, 4)
    once = features.txn_features_90d(txns, make.merchants("a"), SPINE, as_written=False)
    assert once.where("month_end = '2024-01-31'").first().cumulative_fraud_90d == 2


def test_equal_amounts_have_exactly_no_deviation(make):
    rows = [("a", f"2024-01-{d:02d} 10:00", "1234567.89", "APPROVED", 0, 0) for d in range(5, 31)]
    row = features.txn_features_30d(make.txns(*rows), make.merchants("a"), SPINE).first()
    assert (row.amount_stddev_30d, row.p95_amount_30d) == (0.0, 1234567.89)


def test_deviation_is_stable_for_large_amounts(make):
    rows = [("a", f"2024-01-{d:02d} 10:00", f"9999999999.{d:02d}", "APPROVED", 0, 0) for d in range(5, 31)]
    row = features.txn_features_30d(make.txns(*rows), make.merchants("a"), SPINE).first()
    import statistics

    assert row.amount_stddev_30d == pytest.approx(statistics.stdev([d / 100 for d in range(5, 31)]), rel=1e-12)


@pytest.mark.parametrize(
    "rates, expected",
    [
        ((0.06, 0.0, 0.0, 0, 0, 0.0), 1),
        ((0.0599, 0.0599, 0.25, 9, 0, 0.2), 0),
        ((0.0, 0.06, 0.0, 0, 0, 0.0), 1),
        ((0.0, 0.0, 0.25, 10, 0, 0.0), 1),
        ((0.0, 0.0, 0.0, 0, 200, 0.2), 1),
        ((0.0, 0.0, 0.0, 0, 199, 0.9), 0),
    ],
)
def test_label_clauses(spark, rates, expected):
    columns = (
        "future_chargeback_rate double, future_fraud_rate double, future_decline_rate double, "
        "future_fraud_count long, future_txn_count long, future_sla_breach_rate double"
    )
    frame = spark.createDataFrame([rates], columns)
    assert labels.default_label(frame, LabelRule()).first().default_next_60d == expected
