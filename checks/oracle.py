"""Independent SQL for every relational query, written as literal joins over the raw tables (DuckDB dialect).

Windows are range joins here, the two products of joins are really built, and metrics use sorted windows: nothing is
shared with the Spark side except the definitions.
"""

from __future__ import annotations

import re

COEFFICIENTS = {
    "champ_score": (
        -3.0,
        {"fraud_rate_60d": 9.0, "chargeback_rate_60d": 7.0, "sla_breach_rate_60d": 2.0, "decline_rate_90d": 1.0},
    ),
    "challenger_score": (
        -2.5,
        {"fraud_rate_30d": 6.0, "chargeback_rate_30d": 5.0, "decline_rate_30d": 1.5, "z_score_fraud": 0.25,
         "txn_count_30d": 0.05},
    ),
}

REPORT = ("fraud_rate_30d", "chargeback_rate_30d", "decline_rate_30d", "sla_breach_rate_60d", "z_score_fraud",
          "risk_interaction")
MODEL = ("txn_count_30d", "gmv_30d", "decline_rate_30d", "fraud_rate_30d", "chargeback_rate_30d", "sla_events_60d",
         "sla_breach_rate_60d", "fraud_rate_60d", "chargeback_rate_60d", "cumulative_fraud_90d", "fraud_acceleration",
         "chargeback_acceleration", "amount_volatility_90d", "rolling_max_decline_spike", "z_score_fraud",
         "decline_rate_90d", "risk_interaction", "decline_x_fraud")


def _linear(name: str) -> str:
    intercept, weights = COEFFICIENTS[name]
    terms = f"CAST({intercept} AS DOUBLE)"
    for column, weight in weights.items():
        terms += f" + CAST({weight} AS DOUBLE) * CAST({column} AS DOUBLE)"
    return f"round(1e0 / (1e0 + exp(-({terms}))), 9)"


def _ago(days: int, ts: str = "p.txn_ts") -> str:
    """The event's date lies in the ``days`` days that end with the month."""
    return f"date_diff('day', CAST({ts} AS DATE), s.month_end) BETWEEN 0 AND {days - 1}"


def _next(days: int, ts: str = "p.txn_ts") -> str:
    return f"date_diff('day', s.month_end, CAST({ts} AS DATE)) BETWEEN 1 AND {days}"


def _instant_ago(days: int, ts: str = "p.txn_ts") -> str:
    return f"{ts} > s.month_end - INTERVAL {days} DAY AND {ts} <= CAST(s.month_end AS TIMESTAMP)"


def _instant_next(days: int, ts: str = "p.txn_ts") -> str:
    return f"{ts} > CAST(s.month_end AS TIMESTAMP) AND {ts} <= s.month_end + INTERVAL {days} DAY"


_DECLINED = "avg(CAST(p.status = 'DECLINED' AS INTEGER))"
_OK = "CAST(p.amount AS DOUBLE)) FILTER (p.status = 'APPROVED')"
_LABEL = """CASE WHEN future_chargeback_rate >= 0.15 THEN 1 WHEN future_fraud_rate >= 0.18 THEN 1
  WHEN future_decline_rate >= 0.25 AND future_fraud_count >= 10 THEN 1
  WHEN future_sla_breach_rate >= 0.40 AND future_txn_count >= 50 THEN 1 ELSE 0 END"""


def _labels(source: str) -> str:
    return f"SELECT *, {_LABEL} AS default_next_60d FROM {source}"


def _forward(txn_window: str, sla_window: str) -> str:
    """Payments and service events aggregated apart, so nothing is multiplied."""
    return f"""
SELECT s.merchant_id, s.month_end, coalesce(a.cb, 0) AS future_chargeback_rate, coalesce(a.fr, 0) AS future_fraud_rate,
  coalesce(a.de, 0) AS future_decline_rate, coalesce(a.fc, 0) AS future_fraud_count,
  coalesce(a.tc, 0) AS future_txn_count, coalesce(b.br, 0) AS future_sla_breach_rate
FROM months s
LEFT JOIN (SELECT s.merchant_id, s.month_end, avg(p.is_chargeback) AS cb, avg(p.is_fraud) AS fr, {_DECLINED} AS de,
    sum(p.is_fraud) AS fc, count(p.txn_id) AS tc
  FROM months s JOIN transactions p ON p.merchant_id = s.merchant_id AND {txn_window} GROUP BY ALL) a
  USING (merchant_id, month_end)
LEFT JOIN (SELECT s.merchant_id, s.month_end, avg(e.breached) AS br
  FROM months s JOIN sla_events e ON e.merchant_id = s.merchant_id AND {sla_window} GROUP BY ALL) b
  USING (merchant_id, month_end)"""


def _training(midnight: bool) -> str:
    only = "WHERE {0} = date_trunc('day', {0})" if midnight else ""
    return f"""
SELECT s.merchant_id, s.month_end, s.industry,
  coalesce(c.n, 0) AS txn_count_30d, coalesce(c.gmv, 0) AS gmv_30d, coalesce(c.de, 0) AS decline_rate_30d,
  coalesce(c.fr, 0) AS fraud_rate_30d, coalesce(c.cb, 0) AS chargeback_rate_30d,
  coalesce(e.n, 0) AS sla_events_60d, coalesce(e.br, 0) AS sla_breach_rate_60d, l.default_next_60d,
  coalesce(w.fraud_rate_60d, 0) AS fraud_rate_60d, coalesce(w.chargeback_rate_60d, 0) AS chargeback_rate_60d,
  coalesce(w.cumulative_fraud_90d, 0) AS cumulative_fraud_90d,
  coalesce(w.amount_volatility_90d, 0) AS amount_volatility_90d, coalesce(w.decline_rate_90d, 0) AS decline_rate_90d,
  coalesce(w.rolling_max_decline_spike, 0) AS rolling_max_decline_spike, w.historical_fraud_rate,
  w.historical_fraud_std, lag(coalesce(c.fr, 0), 1, 0) OVER m AS prev_fraud_rate,
  lag(coalesce(c.cb, 0), 1, 0) OVER m AS prev_cb_rate,
  coalesce(c.fr, 0) - lag(coalesce(c.fr, 0), 1, 0) OVER m AS fraud_acceleration,
  coalesce(c.cb, 0) - lag(coalesce(c.cb, 0), 1, 0) OVER m AS chargeback_acceleration,
  CASE WHEN w.historical_fraud_std > 0 THEN (coalesce(c.fr, 0) - w.historical_fraud_rate) / w.historical_fraud_std
    ELSE 0 END AS z_score_fraud,
  coalesce(c.fr, 0) * coalesce(c.cb, 0) AS risk_interaction, coalesce(c.de, 0) * coalesce(c.fr, 0) AS decline_x_fraud
FROM months s
LEFT JOIN (SELECT merchant_id, last_day(txn_ts) AS month_end, count(txn_id) AS n,
    coalesce(sum(amount) FILTER (status = 'APPROVED'), 0) AS gmv, avg(CAST(status = 'DECLINED' AS INTEGER)) AS de,
    avg(is_fraud) AS fr, avg(is_chargeback) AS cb FROM transactions {only.format('txn_ts')} GROUP BY ALL) c
  USING (merchant_id, month_end)
LEFT JOIN (SELECT merchant_id, last_day(event_ts) AS month_end, count(event_id) AS n, avg(breached) AS br
  FROM sla_events {only.format('event_ts')} GROUP BY ALL) e USING (merchant_id, month_end)
LEFT JOIN label_instant l USING (merchant_id, month_end)
LEFT JOIN window_instant w USING (merchant_id, month_end)
WINDOW m AS (PARTITION BY s.merchant_id ORDER BY s.month_end)"""


def _nested_sum(score: str, area: str) -> str:
    """Area under a curve over the distinct scores, by sorted windows."""
    return f"""
SELECT {area} FROM (
  SELECT *, lag(tp, 1, 0) OVER (ORDER BY cut DESC) AS tp0, lag(n, 1, 0) OVER (ORDER BY cut DESC) AS n0,
    max(tp) OVER () AS pos, max(n) OVER () AS tot FROM (
    SELECT cut, CAST(sum(hits) OVER (ORDER BY cut DESC) AS DOUBLE) AS tp,
      CAST(sum(cnt) OVER (ORDER BY cut DESC) AS DOUBLE) AS n FROM (
      SELECT {score} AS cut, sum(default_next_60d) AS hits, count(*) AS cnt FROM scored GROUP BY 1)))"""


_PR = "sum((tp - tp0) * (tp / n + CASE WHEN n0 = 0 THEN 1e0 ELSE tp0 / n0 END) / 2) / max(pos)"
_ROC = "sum(((n - tp) - (n0 - tp0)) * (tp + tp0) / 2) / (max(pos) * (max(tot) - max(pos)))"


def _points(model: str, score: str) -> str:
    return f"""
SELECT '{model}' AS model, cut AS threshold, tp / n AS precision, tp / max(tp) OVER () AS recall FROM (
  SELECT cut, CAST(sum(hits) OVER (ORDER BY cut DESC) AS DOUBLE) AS tp,
    CAST(sum(cnt) OVER (ORDER BY cut DESC) AS DOUBLE) AS n FROM (
    SELECT {score} AS cut, sum(default_next_60d) AS hits, count(*) AS cnt FROM scored GROUP BY 1))
UNION ALL SELECT '{model}', NULL, 1e0, 0e0"""


def _thinned(score: str, cells: int) -> str:
    """Of each cell of recall: the first, last, lowest and highest point of the curve."""
    def place(order):
        return f"row_number() OVER (PARTITION BY cell ORDER BY {order}) = 1"

    kept = " OR ".join(map(place, ("threshold DESC", "threshold", "precision, threshold DESC", "precision DESC, threshold DESC")))
    box = " * ".join(f"(max({c}) OVER (PARTITION BY cell) - min({c}) OVER (PARTITION BY cell))" for c in ("recall", "precision"))
    return f"""
SELECT cell, threshold, precision, recall, slack FROM (
  SELECT *, {kept} AS kept, {box} AS slack FROM (
    SELECT *, CAST(floor(recall * {cells}) AS INTEGER) AS cell FROM ({_points('', score)}) WHERE threshold IS NOT NULL)) WHERE kept
UNION ALL SELECT -1, NULL, 1e0, 0e0, 0e0"""


# Named sub-queries; a statement gets those it mentions, directly or through others.
PARTS = {
    "merchants": """
SELECT s_suppkey AS merchant_id,
  CASE s_nationkey % 5 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Travel' WHEN 2 THEN 'Subscription' WHEN 3 THEN 'Marketplace'
    ELSE 'DigitalGoods' END AS industry,
  lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state,
  DATE '1999-07-05' + CAST(s_suppkey % 210 AS INTEGER) AS onboard_date,
  CASE WHEN s_acctbal < 500 THEN 'HIGH' WHEN s_acctbal < 3000 THEN 'MED' ELSE 'LOW' END AS risk_tier_true
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "transactions": """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS txn_id, l_suppkey AS merchant_id,
  l_shipdate + to_minutes((l_orderkey * 7 + l_linenumber) % 1440) AS txn_ts,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
  CASE WHEN l_returnflag = 'A' THEN 'ACH' ELSE 'CARD' END AS channel,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'DECLINED' ELSE 'APPROVED' END AS status,
  CASE WHEN l_discount >= 0.085 AND l_tax >= 0.065 THEN 1 ELSE 0 END AS is_fraud,
  CASE WHEN l_discount <= 0.015 AND l_tax <= 0.015 AND NOT (l_returnflag = 'R' AND l_linestatus = 'O') THEN 1
    ELSE 0 END AS is_chargeback
FROM lineitem""",
    "sla_events": """
SELECT o_orderkey AS event_id, o_custkey // 15 AS merchant_id,
  o_orderdate + to_hours((o_orderkey * 13) % 24) AS event_ts,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'DISPUTE_RESPONSE_DELAY' WHEN '2-HIGH' THEN 'SETTLEMENT_DELAY'
    ELSE 'DOC_REQUEST_MISSED' END AS event_type,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS breached
FROM orders""",
    "months": """
SELECT merchant_id, industry, state, CAST(g AS DATE) AS month_start, last_day(g) AS month_end
FROM merchants, generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) AS t(g)""",
    "past30": f"""
SELECT s.merchant_id, s.month_end, count(*) AS txn_count_30d, coalesce(sum({_OK}, 0) AS gmv_30d,
  coalesce(avg({_OK}, 0) AS avg_amount_30d,
  coalesce(quantile_cont(CAST(p.amount AS DOUBLE), 0.95) FILTER (p.status = 'APPROVED'), 0) AS p95_amount_30d,
  coalesce(stddev_samp({_OK}, 0) AS amount_stddev_30d, coalesce({_DECLINED}, 0) AS decline_rate_30d,
  coalesce(avg(p.is_fraud), 0) AS fraud_rate_30d, coalesce(avg(p.is_chargeback), 0) AS chargeback_rate_30d,
  coalesce(avg(CAST(p.channel = 'ACH' AS INTEGER)), 0) AS ach_share_30d,
  count(DISTINCT CAST(p.txn_ts AS DATE)) AS active_days_30d
FROM months s LEFT JOIN transactions p ON p.merchant_id = s.merchant_id AND {_ago(30)} GROUP BY ALL""",
    "sla60": f"""
SELECT s.merchant_id, s.month_end, count(e.event_id) AS sla_events_60d, coalesce(sum(e.breached), 0) AS sla_breaches_60d,
  coalesce(avg(e.breached), 0) AS sla_breach_rate_60d
FROM months s LEFT JOIN sla_events e ON e.merchant_id = s.merchant_id AND {_ago(60, 'e.event_ts')} GROUP BY ALL""",
    "past60": f"""
SELECT s.merchant_id, s.month_end, coalesce(avg(p.is_fraud), 0) AS fraud_rate_60d,
  coalesce(avg(p.is_chargeback), 0) AS chargeback_rate_60d
FROM months s LEFT JOIN transactions p ON p.merchant_id = s.merchant_id AND {_ago(60)} GROUP BY ALL""",
    "declines": """
SELECT merchant_id, CAST(txn_ts AS DATE) AS txn_date, avg(CAST(status = 'DECLINED' AS INTEGER)) AS daily_dec,
  count(*) AS daily_txns FROM transactions GROUP BY ALL""",
    "past90": f"""
SELECT s.merchant_id, s.month_end, coalesce(sum(p.is_fraud), 0) AS cumulative_fraud_90d,
  coalesce(stddev_samp({_OK}, 0) AS rolling_3m_volatility_90d,
  coalesce(avg(CAST(p.status = 'DECLINED' AS INTEGER)), 0) AS decline_rate_90d,
  coalesce(max(d.daily_dec) FILTER (d.daily_txns >= 3), 0) AS rolling_max_decline_spike
FROM months s LEFT JOIN transactions p ON p.merchant_id = s.merchant_id AND {_ago(90)}
LEFT JOIN declines d ON d.merchant_id = s.merchant_id AND {_ago(90, 'd.txn_date')} GROUP BY ALL""",
    "past90_once": f"""
SELECT s.merchant_id, s.month_end, coalesce(max(a.fraud), 0) AS cumulative_fraud_90d,
  coalesce(max(a.vol), 0) AS rolling_3m_volatility_90d, coalesce(max(a.de), 0) AS decline_rate_90d,
  coalesce(max(d.daily_dec) FILTER (d.daily_txns >= 3), 0) AS rolling_max_decline_spike
FROM months s LEFT JOIN (SELECT s.merchant_id, s.month_end, sum(p.is_fraud) AS fraud, stddev_samp({_OK} AS vol,
    avg(CAST(p.status = 'DECLINED' AS INTEGER)) AS de
  FROM months s JOIN transactions p ON p.merchant_id = s.merchant_id AND {_ago(90)} GROUP BY ALL) a
  USING (merchant_id, month_end)
LEFT JOIN declines d ON d.merchant_id = s.merchant_id AND {_ago(90, 'd.txn_date')} GROUP BY ALL""",
    "history": """
SELECT s.merchant_id, s.month_end, coalesce(avg(p.is_fraud), 0) AS historical_fraud_rate,
  coalesce(stddev_samp(p.is_fraud), 0) AS historical_fraud_stddev
FROM months s LEFT JOIN transactions p ON p.merchant_id = s.merchant_id AND CAST(p.txn_ts AS DATE) <= s.month_end
GROUP BY ALL""",
    "trends": """
SELECT c.merchant_id, c.month_end, c.gmv_30d - coalesce(b.gmv_30d, 0) AS gmv_mom_change,
  c.fraud_rate_30d - coalesce(b.fraud_rate_30d, 0) AS fraud_rate_mom_change,
  c.chargeback_rate_30d - coalesce(b.chargeback_rate_30d, 0) AS chargeback_rate_mom_change,
  c.decline_rate_30d - coalesce(b.decline_rate_30d, 0) AS decline_rate_mom_change
FROM past30 c LEFT JOIN past30 b
  ON b.merchant_id = c.merchant_id AND b.month_end = CAST(c.month_end - INTERVAL 1 MONTH AS DATE)""",
    "features": """
SELECT s.merchant_id, s.month_end, s.industry, s.state, a.* EXCLUDE (merchant_id, month_end),
  t.* EXCLUDE (merchant_id, month_end), e.* EXCLUDE (merchant_id, month_end), b.* EXCLUDE (merchant_id, month_end),
  c.* EXCLUDE (merchant_id, month_end, rolling_3m_volatility_90d), c.rolling_3m_volatility_90d AS amount_volatility_90d,
  t.fraud_rate_mom_change AS fraud_acceleration, t.chargeback_rate_mom_change AS chargeback_acceleration,
  CASE WHEN h.historical_fraud_stddev > 0
    THEN (a.fraud_rate_30d - h.historical_fraud_rate) / h.historical_fraud_stddev ELSE 0 END AS z_score_fraud,
  a.fraud_rate_30d * a.chargeback_rate_30d AS risk_interaction, a.decline_rate_30d * a.fraud_rate_30d AS decline_x_fraud
FROM months s JOIN past30 a USING (merchant_id, month_end) JOIN trends t USING (merchant_id, month_end)
JOIN sla60 e USING (merchant_id, month_end) JOIN past60 b USING (merchant_id, month_end)
JOIN past90 c USING (merchant_id, month_end) JOIN history h USING (merchant_id, month_end)""",
    "forward": f"""
SELECT s.merchant_id, s.month_end, coalesce(avg(p.is_chargeback), 0) AS future_chargeback_rate,
  coalesce(avg(p.is_fraud), 0) AS future_fraud_rate,
  coalesce(avg(CAST(p.status = 'DECLINED' AS INTEGER)), 0) AS future_decline_rate,
  coalesce(sum(p.is_fraud), 0) AS future_fraud_count, count(p.txn_id) AS future_txn_count,
  coalesce(avg(e.breached), 0) AS future_sla_breach_rate
FROM months s LEFT JOIN transactions p ON p.merchant_id = s.merchant_id AND {_next(60)}
LEFT JOIN sla_events e ON e.merchant_id = s.merchant_id AND {_next(60, 'e.event_ts')} GROUP BY ALL""",
    "label": _labels("forward"),
    "forward_instant": _forward(_instant_next(60), _instant_next(60, "e.event_ts")),
    "label_instant": _labels("forward_instant"),
    "outcomes_monthly": "SELECT merchant_id, month_end, default_next_60d FROM label",
    "window_instant": f"""
SELECT s.merchant_id, s.month_end, a.fraud_rate_60d, a.chargeback_rate_60d, b.cumulative_fraud_90d,
  b.amount_volatility_90d, b.decline_rate_90d, d.spike AS rolling_max_decline_spike, h.historical_fraud_rate,
  h.historical_fraud_std
FROM months s
LEFT JOIN (SELECT s.merchant_id, s.month_end, avg(p.is_fraud) AS fraud_rate_60d, avg(p.is_chargeback) AS chargeback_rate_60d
  FROM months s JOIN transactions p ON p.merchant_id = s.merchant_id AND {_instant_ago(60)} GROUP BY ALL) a
  USING (merchant_id, month_end)
LEFT JOIN (SELECT s.merchant_id, s.month_end, sum(p.is_fraud) AS cumulative_fraud_90d,
    stddev_samp(CAST(p.amount AS DOUBLE)) AS amount_volatility_90d, avg(CAST(p.status = 'DECLINED' AS INTEGER)) AS decline_rate_90d
  FROM months s JOIN transactions p ON p.merchant_id = s.merchant_id AND {_instant_ago(90)} GROUP BY ALL) b
  USING (merchant_id, month_end)
LEFT JOIN (SELECT merchant_id, month_end, max(dec) AS spike FROM (
    SELECT s.merchant_id, s.month_end, CAST(p.txn_ts AS DATE) AS day, avg(CAST(p.status = 'DECLINED' AS INTEGER)) AS dec
    FROM months s JOIN transactions p ON p.merchant_id = s.merchant_id AND {_instant_ago(90)}
    GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL) d USING (merchant_id, month_end)
LEFT JOIN (SELECT s.merchant_id, s.month_end, avg(p.is_fraud) AS historical_fraud_rate, stddev_samp(p.is_fraud) AS historical_fraud_std
  FROM months s JOIN transactions p ON p.merchant_id = s.merchant_id AND p.txn_ts <= CAST(s.month_end AS TIMESTAMP)
  GROUP BY ALL) h USING (merchant_id, month_end)""",
    "training": _training(False),
    "training_as_written": _training(True),
    "scored": f"""
SELECT *, month(month_end) AS month, {_linear('champ_score')} AS champ_score,
  {_linear('challenger_score')} AS challenger_score FROM training WHERE month_end > DATE '2000-09-30'""",
    "ruled": """
SELECT *, least(0e0 + CASE WHEN chargeback_rate_30d > 0.01 AND gmv_30d > 1000 THEN 4e-1 ELSE 0e0 END
    + CASE WHEN sla_breach_rate_60d > 0.08 THEN 3e-1 ELSE 0e0 END + CASE WHEN fraud_rate_30d > 0.015 THEN 4e-1 ELSE 0e0 END
    + CASE WHEN txn_count_30d > 9 THEN 1e-1 ELSE 0e0 END, 1e0) AS rule_score,
  array_to_string(list_filter([CASE WHEN chargeback_rate_30d > 0.01 AND gmv_30d > 1000 THEN 'High CB & Vol' END,
    CASE WHEN sla_breach_rate_60d > 0.08 THEN 'SLA Breach' END, CASE WHEN fraud_rate_30d > 0.015 THEN 'High Fraud Rate' END,
    CASE WHEN txn_count_30d > 9 THEN 'High Vol' END], lambda r: r IS NOT NULL), ' | ') AS rule_reason FROM scored""",
    "hybrid": "SELECT *, greatest(challenger_score, rule_score) AS final_risk_score FROM ruled",
    "cuts": "SELECT CASE WHEN i = 99 THEN 1e0 ELSE i * (1e0 / 99e0) END AS threshold FROM range(100) AS r(i)",
    "sweep": """
SELECT threshold, count(*) FILTER (final_risk_score >= threshold AND default_next_60d = 1) AS tp,
  count(*) FILTER (final_risk_score >= threshold AND default_next_60d = 0) AS fp,
  count(*) FILTER (final_risk_score < threshold AND default_next_60d = 1) AS fn, 2 * tp - fp - 10 * fn AS profit
FROM cuts, hybrid GROUP BY threshold""",
    "best": "SELECT threshold, profit FROM sweep ORDER BY profit DESC, threshold LIMIT 1",
    "portfolio": "SELECT *, CAST(final_risk_score >= (SELECT threshold FROM best) AS INTEGER) AS alert_flag FROM hybrid",
    "exceptions": """
SELECT 'ORPHAN_TXN' AS exception_type, txn_id AS reference_id FROM transactions
  WHERE merchant_id NOT IN (SELECT merchant_id FROM merchants)
UNION ALL SELECT 'NEG_AMOUNT', txn_id FROM transactions WHERE amount <= 0
UNION ALL SELECT 'FUTURE_TS', txn_id FROM transactions WHERE txn_ts > TIMESTAMP '2001-06-01 00:00:00'
UNION ALL SELECT 'DUP_TXN_ID', txn_id FROM transactions GROUP BY txn_id HAVING count(*) > 1
UNION ALL SELECT 'LEAKAGE_GUARD', CAST(f.merchant_id AS VARCHAR) || '_' || CAST(f.month_end AS VARCHAR)
  FROM past30 f JOIN transactions p ON p.merchant_id = f.merchant_id AND CAST(p.txn_ts AS DATE) > f.month_end
  WHERE f.txn_count_30d > 0""",
}

def _needed(text: str, seen: dict[str, None]) -> dict[str, None]:
    for name, body in PARTS.items():
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(body, seen)
            seen[name] = None
    return seen


def _tree_parts(depth: int = 4) -> dict[str, str]:
    """The first boosted tree, level by level: every cut of every feature tried on every node by counting rows.

    Before the first tree all scores are 0.5, so sums of gradients and second derivatives follow from counts: ``n0`` and
    ``n1`` rows of either label.
    """
    values = ", ".join(f"{{'name': '{c}', 'place': {k}, 'v': CAST({c} AS FLOAT)}}" for k, c in enumerate(MODEL))
    long = f"""SELECT merchant_id, month_end, default_next_60d AS y, f.name AS feature, f.place AS place, f.v AS v
FROM (SELECT *, unnest([{values}]) AS f FROM training)"""
    parts = {
        "tree_rows": long,
        "tree_cuts": """SELECT DISTINCT feature, place, unnest(quantile_disc(v, list_transform(range(1, 256), lambda i: i / 256e0))) AS cut
FROM tree_rows WHERE month_end <= DATE '2000-09-30' GROUP BY feature, place""",
        "tree_weight": """SELECT count(*) FILTER (default_next_60d = 0) / CAST(count(*) FILTER (default_next_60d = 1) AS DOUBLE) AS w
FROM training WHERE month_end <= DATE '2000-09-30'""",
        "tree_at_0": "SELECT merchant_id, month_end, default_next_60d AS y, 1 AS node FROM training",
    }
    gradient, second = "(0.5e0 * {0} - 0.5e0 * w * {1})", "(0.25e0 * ({0} + w * {1}))"
    term = lambda a, b: f"{gradient.format(a, b)} * {gradient.format(a, b)} / ({second.format(a, b)} + 1)"
    for k in range(depth):
        parts[f"tree_sums_{k}"] = f"""SELECT node, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
FROM tree_at_{k} WHERE month_end <= DATE '2000-09-30' AND node >= {1 << k} GROUP BY node"""
        parts[f"tree_best_{k}"] = f"""SELECT node, feature, cut, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, place, cut) AS rank FROM (
    SELECT node, feature, place, cut, {term('l0', 'l1')} + {term('(n0 - l0)', '(n1 - l1)')} - {term('n0', 'n1')} AS gain,
      {second.format('l0', 'l1')} AS left_h, {second.format('(n0 - l0)', '(n1 - l1)')} AS right_h
    FROM (SELECT a.node, c.feature, c.place, c.cut, count(*) FILTER (a.y = 0) AS l0, count(*) FILTER (a.y = 1) AS l1
      FROM tree_at_{k} a JOIN tree_rows r USING (merchant_id, month_end) JOIN tree_cuts c ON r.feature = c.feature AND r.v < c.cut
      WHERE a.month_end <= DATE '2000-09-30' AND a.node >= {1 << k} GROUP BY ALL)
    JOIN tree_sums_{k} USING (node), tree_weight)
  WHERE left_h >= 1 AND right_h >= 1 AND gain > 1e-6) WHERE rank = 1"""
        parts[f"tree_at_{k + 1}"] = f"""SELECT a.merchant_id, a.month_end, a.y,
  CASE WHEN b.node IS NULL THEN a.node ELSE 2 * a.node + CAST(r.v >= b.cut AS INTEGER) END AS node
FROM tree_at_{k} a LEFT JOIN tree_best_{k} b ON a.node = b.node
LEFT JOIN tree_rows r ON a.merchant_id = r.merchant_id AND a.month_end = r.month_end AND b.feature = r.feature"""
    parts["tree_leaves"] = f"""SELECT node, -0.1e0 * {gradient.format('n0', 'n1')} / ({second.format('n0', 'n1')} + 1) AS value FROM (
  SELECT node, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM tree_at_{depth}
  WHERE month_end <= DATE '2000-09-30' GROUP BY node), tree_weight"""
    return parts


PARTS |= _tree_parts()


def statement(body: str) -> str:
    names = _needed(body, {})
    parts = ",\n".join(f"{n} AS ({PARTS[n].strip()})" for n in names)
    return f"WITH {parts}\n{body.strip()}" if names else body.strip()


def pick(source: str, keys: str = "", whole: str = "", small: str = "", real: str = "") -> str:
    """SELECT list with types fixed: ``whole`` BIGINT, ``small`` INTEGER, ``real`` DOUBLE at six decimals."""
    items = keys.split()
    items += [f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()]
    items += [f"CAST({c} AS INTEGER) AS {c}" for c in small.split()]
    items += [f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in real.split()]
    return f"SELECT {', '.join(items)} FROM {source}"


ON = "merchant_id month_end"
F30_WHOLE = "txn_count_30d active_days_30d"
F30_REAL = ("gmv_30d avg_amount_30d p95_amount_30d amount_stddev_30d decline_rate_30d fraud_rate_30d "
            "chargeback_rate_30d ach_share_30d")
MOM = "gmv_mom_change fraud_rate_mom_change chargeback_rate_mom_change decline_rate_mom_change"
SLA_WHOLE = "sla_events_60d sla_breaches_60d"
F90_REAL = "rolling_3m_volatility_90d decline_rate_90d rolling_max_decline_spike"
ADVANCED = ("fraud_rate_60d chargeback_rate_60d amount_volatility_90d rolling_max_decline_spike decline_rate_90d "
            "fraud_acceleration chargeback_acceleration z_score_fraud risk_interaction decline_x_fraud")
FEATURES = dict(
    keys=f"{ON} industry state",
    whole=f"{F30_WHOLE} {SLA_WHOLE} cumulative_fraud_90d",
    real=f"{F30_REAL} {MOM} sla_breach_rate_60d {ADVANCED}",
)
RATES_WHOLE = "future_fraud_count future_txn_count"
RATES_REAL = "future_chargeback_rate future_fraud_rate future_decline_rate future_sla_breach_rate"
CAL_REAL = "gmv_30d decline_rate_30d fraud_rate_30d chargeback_rate_30d"
WINDOW_REAL = ("fraud_rate_60d chargeback_rate_60d amount_volatility_90d decline_rate_90d rolling_max_decline_spike "
               "historical_fraud_rate historical_fraud_std")
TRAINING = dict(
    keys=f"{ON} industry",
    whole="txn_count_30d sla_events_60d cumulative_fraud_90d",
    small="default_next_60d",
    real=(f"{CAL_REAL} sla_breach_rate_60d {ADVANCED} historical_fraud_rate historical_fraud_std prev_fraud_rate "
          "prev_cb_rate"),
)
PORTFOLIO = dict(
    keys=f"{ON} rule_reason",
    small="default_next_60d alert_flag",
    real="champ_score challenger_score rule_score final_risk_score",
)


def _calendar(source: str, only: str = "") -> str:
    return f"""(SELECT merchant_id, last_day(txn_ts) AS month_end, count(txn_id) AS txn_count_30d,
  coalesce(sum(amount) FILTER (status = 'APPROVED'), 0) AS gmv_30d,
  avg(CAST(status = 'DECLINED' AS INTEGER)) AS decline_rate_30d, avg(is_fraud) AS fraud_rate_30d,
  avg(is_chargeback) AS chargeback_rate_30d FROM {source} {only} GROUP BY ALL)"""


def _calendar_sla(only: str = "") -> str:
    return f"""(SELECT merchant_id, last_day(event_ts) AS month_end, count(event_id) AS sla_events_60d,
  avg(breached) AS sla_breach_rate_60d FROM sla_events {only} GROUP BY ALL)"""


def _nulls(table: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows FROM {table}"
        for c in columns.split()
    )


def _outside(table: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{name}' AS rule, count(*) FILTER (NOT ({test})) AS violations FROM {table}"
        for name, test in tests.items()
    )


def _histogram(column: str) -> str:
    return f"""SELECT '{column}' AS feature, b.bin, lo + (hi - lo) / 40 * (b.bin - 1) AS bin_start,
  lo + (hi - lo) / 40 * b.bin AS bin_end, count(v) AS n
  FROM (SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi FROM scored) r
  CROSS JOIN (SELECT CAST(i AS INTEGER) AS bin FROM range(1, 41) AS x(i)) b
  LEFT JOIN (SELECT CAST({column} AS DOUBLE) AS v FROM scored) s
    ON least(40, 1 + CAST(floor((v - lo) / (hi - lo) * 40) AS INTEGER)) = b.bin GROUP BY ALL"""


def _grid() -> str:
    frauds = ", ".join(f"({x})" for x in (0.12, 0.15, 0.18, 0.20, 0.25))
    backs = ", ".join(f"({x})" for x in (0.10, 0.12, 0.15, 0.18, 0.20))
    return f"""(SELECT CAST(c AS DOUBLE) AS chargeback_threshold, CAST(f AS DOUBLE) AS fraud_threshold,
  avg(CAST(future_chargeback_rate >= c OR future_fraud_rate >= f
    OR (future_decline_rate >= 0.25 AND future_fraud_count >= 10) AS INTEGER)) AS default_rate
  FROM (VALUES {backs}) AS a(c), (VALUES {frauds}) AS b(f), forward_instant GROUP BY ALL
  HAVING default_rate BETWEEN 0.02 AND 0.04)"""


def _standardized() -> str:
    columns = ", ".join(
        f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) FILTER (month_end <= DATE '2000-09-30') OVER ())"
        f" / stddev_pop(CAST({c} AS DOUBLE)) FILTER (month_end <= DATE '2000-09-30') OVER () AS {c}"
        for c in MODEL
    )
    return f"(SELECT merchant_id, month_end, {columns} FROM training)"


def build() -> dict[str, str]:
    """Key -> statement."""
    midnight, midnight_sla = "WHERE txn_ts = date_trunc('day', txn_ts)", "WHERE event_ts = date_trunc('day', event_ts)"
    ids = "CAST(merchant_id AS VARCHAR) AS merchant_id"
    q = {
        "src_merchants": f"SELECT {ids}, industry, state, onboard_date, risk_tier_true FROM merchants",
        "src_transactions": f"""SELECT txn_id, {ids}, txn_ts, CAST(amount AS DOUBLE) AS amount, channel, status,
            is_fraud, is_chargeback FROM transactions""",
        "src_sla_events": f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {ids}, event_ts, event_type, breached
            FROM sla_events""",
        "csv_roundtrip": pick("(SELECT * REPLACE (nullif(rule_reason, '') AS rule_reason) FROM portfolio)", **PORTFOLIO),
        "sql_views": pick(
            """(SELECT industry, count(*) AS rows_n, avg(default_next_60d) AS default_rate, avg(fraud_rate_30d) AS fraud_rate
            FROM features JOIN outcomes_monthly USING (merchant_id, month_end) GROUP BY industry)""",
            keys="industry", whole="rows_n", real="default_rate fraud_rate"),
        "month_spine": "SELECT merchant_id, month_start, month_end FROM months",
        "month_spine_ends": "SELECT DISTINCT merchant_id, month_end FROM months",
        "txn_features_30d": pick("past30", ON, F30_WHOLE, real=F30_REAL),
        "sla_features_60d": pick("sla60", ON, SLA_WHOLE, real="sla_breach_rate_60d"),
        "txn_features_60d": pick("past60", ON, real="fraud_rate_60d chargeback_rate_60d"),
        "daily_declines": pick("declines", "merchant_id txn_date", "daily_txns", real="daily_dec"),
        "txn_features_90d": pick("past90", ON, "cumulative_fraud_90d", real=F90_REAL),
        "txn_features_90d_corrected": pick("past90_once", ON, "cumulative_fraud_90d", real=F90_REAL),
        "historical_fraud": pick("history", ON, real="historical_fraud_rate historical_fraud_stddev"),
        "mom_trends": pick("trends", ON, real=MOM),
        "mom_lag": pick("training", ON, real="prev_fraud_rate prev_cb_rate fraud_acceleration chargeback_acceleration"),
        "z_score_fraud": pick("features", ON, real="z_score_fraud"),
        "interactions": pick("features", ON, real="risk_interaction decline_x_fraud"),
        "merchant_month_features": pick("features", **FEATURES),
        "calendar_month_features": pick(_calendar("transactions"), ON, "txn_count_30d", real=CAL_REAL),
        "calendar_month_features_as_written": pick(
            _calendar("transactions", midnight), ON, "txn_count_30d", real=CAL_REAL),
        "calendar_month_sla": pick(_calendar_sla(), ON, "sla_events_60d", real="sla_breach_rate_60d"),
        "calendar_month_sla_as_written": pick(
            _calendar_sla(midnight_sla), ON, "sla_events_60d", real="sla_breach_rate_60d"),
        "ts_window_features": pick("window_instant", ON, "cumulative_fraud_90d", real=WINDOW_REAL),
        "impute_zero": pick(
            f"(SELECT merchant_id, month_end, {', '.join(f'coalesce({c}, 0) AS {c}' for c in WINDOW_REAL.split())}, "
            "coalesce(cumulative_fraud_90d, 0) AS cumulative_fraud_90d FROM window_instant)",
            ON, "cumulative_fraud_90d", real=WINDOW_REAL),
        "forward_rates_60d": pick("forward", ON, RATES_WHOLE, real=RATES_REAL),
        "default_label": pick("label", ON, small="default_next_60d"),
        "default_label_corrected": pick("label_instant", ON, RATES_WHOLE, "default_next_60d", RATES_REAL),
        "label_condition_rates": pick(
            """(SELECT avg(CAST(future_chargeback_rate >= 0.012 AS INTEGER)) AS chargeback_share,
            avg(CAST(future_fraud_rate >= 0.018 AS INTEGER)) AS fraud_share,
            avg(CAST(future_decline_rate >= 0.20 AND future_fraud_count >= 5 AS INTEGER)) AS decline_share,
            avg(CAST(future_sla_breach_rate >= 0.10 AND future_txn_count >= 200 AS INTEGER)) AS sla_share
            FROM forward_instant)""",
            real="chargeback_share fraud_share decline_share sla_share"),
        "threshold_grid": pick(_grid(), real="chargeback_threshold fraud_threshold default_rate"),
        "outcomes_monthly": pick("outcomes_monthly", ON, small="default_next_60d"),
        "model_dataset": pick(
            "(SELECT * FROM features JOIN outcomes_monthly USING (merchant_id, month_end))",
            small="default_next_60d", **FEATURES),
        "mart_portfolio_overview": pick(
            """(SELECT s.month_end, count(DISTINCT s.merchant_id) AS total_merchants, sum(f.gmv_30d) AS total_gmv,
            avg(f.fraud_rate_30d) AS portfolio_fraud_rate, avg(f.chargeback_rate_30d) AS portfolio_chargeback_rate,
            avg(f.sla_breach_rate_60d) AS portfolio_sla_breach_rate, avg(o.default_next_60d) AS portfolio_default_risk
            FROM months s LEFT JOIN features f USING (merchant_id, month_end)
            LEFT JOIN outcomes_monthly o USING (merchant_id, month_end) GROUP BY s.month_end)""",
            "month_end", "total_merchants",
            real="total_gmv portfolio_fraud_rate portfolio_chargeback_rate portfolio_sla_breach_rate portfolio_default_risk"),
        "mart_risk_queue": pick(
            """(SELECT * FROM features LEFT JOIN outcomes_monthly USING (merchant_id, month_end)
            WHERE month_end = (SELECT max(month_end) FROM months))""",
            f"{ON} industry state", small="default_next_60d",
            real="gmv_30d fraud_rate_30d chargeback_rate_30d decline_rate_30d sla_breach_rate_60d"),
        "python_master": pick("training", **TRAINING),
        "python_master_as_written": pick("training_as_written", **TRAINING),
        "oot_split": pick(
            """(SELECT *, month(month_end) AS month, CASE WHEN month_end <= DATE '2000-09-30' THEN 'train' ELSE 'test' END AS split
            FROM training)""",
            f"{ON} split", small="month default_next_60d"),
        "dq_orphan_txn": """SELECT txn_id, merchant_id FROM transactions
            WHERE merchant_id NOT IN (SELECT merchant_id FROM merchants)""",
        "dq_neg_amount": "SELECT txn_id, CAST(amount AS DOUBLE) AS amount FROM transactions WHERE amount <= 0",
        "dq_future_ts": "SELECT txn_id, txn_ts FROM transactions WHERE txn_ts > TIMESTAMP '2001-06-01 00:00:00'",
        "dq_dup_txn_id": "SELECT txn_id, count(*) AS copies FROM transactions GROUP BY txn_id HAVING count(*) > 1",
        "dq_leakage_guard": """SELECT reference_id, count(*) AS occurrences FROM exceptions
            WHERE exception_type = 'LEAKAGE_GUARD' GROUP BY reference_id""",
        "dq_leakage_corrected": " UNION ALL ".join(
            f"""SELECT '{name}' AS window_name, s.merchant_id, s.month_end, min(d) AS first_day, max(d) AS last_day,
            CAST(min(d) < s.month_end - {high} OR max(d) > s.month_end - ({low}) AS INTEGER) AS violation FROM months s
            JOIN (SELECT merchant_id, CAST({ts} AS DATE) AS d FROM {table}) e ON e.merchant_id = s.merchant_id
            AND d BETWEEN s.month_end - {high} AND s.month_end - ({low}) GROUP BY s.merchant_id, s.month_end"""
            for name, table, ts, low, high in (
                ("txn_30", "transactions", "txn_ts", 0, 29), ("txn_60", "transactions", "txn_ts", 0, 59),
                ("txn_90", "transactions", "txn_ts", 0, 89), ("sla_60", "sla_events", "event_ts", 0, 59),
                ("label_txn_60", "transactions", "txn_ts", -60, -1), ("label_sla_60", "sla_events", "event_ts", -60, -1))),
        "data_exceptions": """SELECT exception_type, reference_id, count(*) AS occurrences FROM exceptions
            GROUP BY ALL""",
        "dq_summary": "SELECT exception_type, count(*) AS exceptions FROM exceptions GROUP BY exception_type",
        "label_sanity": pick(
            """(SELECT risk_tier_true, count(*) AS total_months, sum(default_next_60d) AS default_count,
            avg(default_next_60d) AS default_rate FROM outcomes_monthly JOIN merchants USING (merchant_id)
            GROUP BY risk_tier_true)""",
            "risk_tier_true", "total_months default_count", real="default_rate"),
        "ck_primary_key": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS key_value, count(*) AS copies FROM {t} GROUP BY {k} HAVING count(*) > 1"
            for t, k in {"merchants": "merchant_id", "transactions": "txn_id", "sla_events": "event_id"}.items())
            + """ UNION ALL SELECT 'outcomes_monthly', CAST(merchant_id AS VARCHAR) || '_' || CAST(month_end AS VARCHAR),
            count(*) FROM outcomes_monthly GROUP BY merchant_id, month_end HAVING count(*) > 1""",
        "ck_foreign_key": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, {r} AS reference_id FROM {t} c WHERE NOT EXISTS "
            "(SELECT 1 FROM merchants m WHERE m.merchant_id = c.merchant_id)"
            for t, r in {
                "transactions": "txn_id",
                "sla_events": "CAST(event_id AS VARCHAR)",
                "outcomes_monthly": "CAST(merchant_id AS VARCHAR) || '_' || CAST(month_end AS VARCHAR)",
            }.items()),
        "ck_not_null": " UNION ALL ".join([
            _nulls("merchants", "merchant_id industry state onboard_date risk_tier_true"),
            _nulls("transactions", "txn_id merchant_id txn_ts amount channel status is_fraud is_chargeback"),
            _nulls("sla_events", "event_id merchant_id event_ts event_type breached"),
            _nulls("outcomes_monthly", "merchant_id month_end default_next_60d")]),
        # a sketch holds the few payments of a window here whole, so its ranks are exact
        "p95_sketched": f"""SELECT s.merchant_id, s.month_end,
            round(CAST(quantile_disc(p.amount, 0.95) AS DOUBLE), 6) + 0e0 AS amount FROM months s
            JOIN transactions p ON p.merchant_id = s.merchant_id AND {_ago(30)} WHERE p.status = 'APPROVED' GROUP BY ALL""",
        "ck_while_writing": f"""SELECT table_name, column_name AS rule, null_rows AS broken
            FROM ({_nulls("transactions", "txn_id merchant_id txn_ts amount channel status is_fraud is_chargeback")})
            UNION ALL SELECT table_name, rule, violations FROM ({_outside("transactions", {
                "channel in list": "channel IN ('ACH', 'CARD')", "status in list": "status IN ('DECLINED', 'APPROVED')",
                "is_fraud in list": "is_fraud IN (0, 1)", "is_chargeback in list": "is_chargeback IN (0, 1)",
                "amount > 0": "amount > 0"})})""",
        "ck_domain": " UNION ALL ".join([
            _outside("merchants", {"risk_tier_true in list": "risk_tier_true IN ('HIGH', 'MED', 'LOW')"}),
            _outside("transactions", {
                "channel in list": "channel IN ('ACH', 'CARD')", "status in list": "status IN ('DECLINED', 'APPROVED')",
                "is_fraud in list": "is_fraud IN (0, 1)", "is_chargeback in list": "is_chargeback IN (0, 1)",
                "amount > 0": "amount > 0"}),
            _outside("sla_events", {
                "event_type in list": "event_type IN ('DOC_REQUEST_MISSED', 'SETTLEMENT_DELAY', 'DISPUTE_RESPONSE_DELAY')",
                "breached in list": "breached IN (0, 1)"}),
            _outside("outcomes_monthly", {"default_next_60d in list": "default_next_60d IN (0, 1)"})]),
        "standardize": pick(_standardized(), ON, real=" ".join(MODEL)),
        "class_weights": pick(
            """(SELECT default_next_60d, count(*) AS n, sum(count(*)) OVER () / (2e0 * count(*)) AS balanced_weight,
            CASE WHEN default_next_60d = 1 THEN (sum(count(*)) OVER () - count(*)) / CAST(count(*) AS DOUBLE) ELSE 1 END AS pos_weight
            FROM training WHERE month_end <= DATE '2000-09-30' GROUP BY default_next_60d)""",
            whole="n", small="default_next_60d", real="balanced_weight pos_weight"),
        "linear_score": pick("scored", ON, real="champ_score challenger_score"),
        "pr_auc": pick(f"({_nested_sum('challenger_score', _PR + ' AS pr_auc')})", real="pr_auc"),
        "roc_auc": pick(f"({_nested_sum('challenger_score', _ROC + ' AS roc_auc')})", real="roc_auc"),
        "precision_at_k": """SELECT max(k) AS k, round(avg(default_next_60d), 6) + 0e0 AS precision_at_k FROM (
            SELECT default_next_60d, row_number() OVER (ORDER BY challenger_score DESC, merchant_id, month_end) AS place,
            CAST(floor(count(*) OVER () * 5e-2) AS BIGINT) AS k FROM scored) WHERE place <= k""",
        "pr_curve_points": pick(
            f"({_points('champion', 'champ_score')} UNION ALL {_points('challenger', 'challenger_score')})",
            "model", real="threshold precision recall"),
        "pr_curve_thinned": pick(
            f"({_thinned('challenger_score', 64)})", small="cell", real="threshold precision recall slack"),
        "model_comparison": " UNION ALL ".join(
            f"""SELECT '{model}' AS model, (SELECT round(pr_auc, 6) + 0e0 FROM ({_nested_sum(score, _PR + ' AS pr_auc')})) AS pr_auc,
            (SELECT round(roc_auc, 6) + 0e0 FROM ({_nested_sum(score, _ROC + ' AS roc_auc')})) AS roc_auc,
            (SELECT round(avg(default_next_60d), 6) + 0e0 FROM (SELECT default_next_60d,
              row_number() OVER (ORDER BY {score} DESC, merchant_id, month_end) AS place,
              CAST(floor(count(*) OVER () * 5e-2) AS BIGINT) AS k FROM scored) WHERE place <= k) AS precision_at_k"""
            for model, score in (("champion", "champ_score"), ("challenger", "challenger_score"))),
        "champion_lr_gradient": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, 0e0 AS gradient" for c in (*MODEL, "intercept")),
        "score_both_agreement": "SELECT merchant_id, month_end, default_next_60d, true AS agrees FROM scored",
        "challenger_gbt_range": "SELECT merchant_id, month_end, default_next_60d, true AS in_range FROM scored",
        "challenger_first_tree": pick(
            "(" + " UNION ALL ".join(
                f"SELECT node, feature, CAST(cut AS DOUBLE) AS cut, gain, CAST(NULL AS DOUBLE) AS value FROM tree_best_{k}" for k in range(4))
            + " UNION ALL SELECT node, NULL, NULL, NULL, value FROM tree_leaves)", "feature", small="node", real="cut gain value"),
        "challenger_first_scores": pick(
            """(SELECT merchant_id, month_end, round(1e0 / (1e0 + exp(-value)), 9) AS first_score
            FROM tree_at_4 JOIN tree_leaves USING (node) WHERE month_end > DATE '2000-09-30')""", ON, real="first_score"),
        "feature_importance_total": f"SELECT CAST({len(list(MODEL))} AS BIGINT) AS features, 1e0 AS total",
        "rule_score": pick("ruled", ON, real="rule_score"),
        "rule_reason": pick("ruled", f"{ON} rule_reason"),
        "hybrid_score": pick("hybrid", ON, real="challenger_score rule_score final_risk_score"),
        "threshold_sweep": pick("sweep", "", "tp fp fn profit", real="threshold"),
        "optimal_threshold": pick("best", "", "profit", real="threshold"),
        "alert_flag": pick("portfolio", ON, small="alert_flag", real="final_risk_score"),
        "alert_metrics": pick(
            """(SELECT count(DISTINCT merchant_id) AS merchants_scored, count(*) FILTER (alert_flag = 1) AS alerts,
            avg(alert_flag) AS alert_rate,
            count(*) FILTER (alert_flag = 1 AND default_next_60d = 1) AS defaults_captured,
            count(*) FILTER (alert_flag = 1 AND default_next_60d = 1) / CAST(sum(default_next_60d) AS DOUBLE) AS recall
            FROM portfolio)""", "", "merchants_scored alerts defaults_captured", real="alert_rate recall"),
        "investigation_queue": pick("portfolio WHERE alert_flag = 1", **PORTFOLIO),
        "queue_top5": pick(
            """(SELECT * FROM portfolio WHERE alert_flag = 1 ORDER BY final_risk_score DESC, merchant_id, month_end LIMIT 5)""",
            "merchant_id rule_reason", small="default_next_60d", real="final_risk_score"),
        "final_scored_portfolio": pick(
            "portfolio", keys=f"{TRAINING['keys']} rule_reason", whole=TRAINING["whole"],
            small="default_next_60d alert_flag month",
            real=f"{TRAINING['real']} champ_score challenger_score rule_score final_risk_score"),
        "cost_tradeoff": pick(
            """(SELECT count(*) FILTER (alert_flag = 1 AND default_next_60d = 1) AS tp,
            count(*) FILTER (alert_flag = 1 AND default_next_60d = 0) AS fp,
            count(*) FILTER (alert_flag = 0 AND default_next_60d = 1) AS fn, 10 * fn AS missed_cost, fp AS review_cost,
            2 * tp - fp - 10 * fn AS net_benefit FROM portfolio)""",
            "", "tp fp fn missed_cost review_cost net_benefit"),
        "top10_by_score": pick(
            "(SELECT merchant_id, month_end, challenger_score AS score FROM portfolio ORDER BY score DESC, merchant_id, month_end LIMIT 10)",
            ON, real="score"),
        "eda_default_by_industry": pick(
            "(SELECT industry, avg(default_next_60d) AS default_rate FROM scored GROUP BY industry)",
            "industry", real="default_rate"),
        "eda_default_by_tier": pick(
            """(SELECT risk_tier_true, avg(default_next_60d) AS default_rate
            FROM scored LEFT JOIN merchants USING (merchant_id) WHERE risk_tier_true IS NOT NULL GROUP BY risk_tier_true)""",
            "risk_tier_true", real="default_rate"),
        "eda_histograms": pick(
            "(" + " UNION ALL ".join(_histogram(c) for c in REPORT) + ")", "feature", "n", "bin", "bin_start bin_end"),
        "eda_class_balance": pick(
            """(SELECT default_next_60d, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
            FROM scored GROUP BY default_next_60d)""", "", "n", "default_next_60d", "share"),
        "eda_correlations": pick(
            "(" + " UNION ALL ".join(
                f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(default_next_60d AS DOUBLE)) AS correlation FROM scored"
                for c in (*REPORT, "default_next_60d")) + ")", "feature", real="correlation"),
        "proportional_allocation": """SELECT merchant_id, CAST(floor(w / 10e0 * (60000e0 / (sum(w) OVER () / 10e0))) AS BIGINT) AS txn_count
            FROM (SELECT merchant_id, CASE risk_tier_true WHEN 'LOW' THEN 25 WHEN 'MED' THEN 45 ELSE 80 END
              * CASE industry WHEN 'Retail' THEN 10 WHEN 'Travel' THEN 7 WHEN 'Subscription' THEN 12 WHEN 'Marketplace' THEN 11 ELSE 13 END
              * least(364, greatest(1, date_diff('day', greatest(DATE '2000-01-01', onboard_date), DATE '2000-12-30'))) AS w
              FROM merchants)""",
    }
    return {name: statement(body) for name, body in q.items()}
