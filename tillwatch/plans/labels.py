"""Forward-looking default label and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.config import GRID_CHARGEBACK, GRID_FRAUD, GRID_KEEP, KEY, LABEL, MONTH, LabelRule, Spine
from tillwatch.functions.columns import or_zero_double, ratio
from tillwatch.operators.rollup import daily_activity
from tillwatch.operators.windows import at_anchors, future_months, future_totals, month_members

ON = [KEY, MONTH]
SUMS = (
    "n_txn_id", "n_status", "declined", "n_fraud", "fraud", "n_chargeback", "chargeback",
    "n_sla", "n_breached", "breached",
)


def forward_rates(
    txns: DataFrame | None,
    sla: DataFrame | None,
    merchants: DataFrame,
    spine: Spine = Spine(),
    width: int = 60,
    as_written: bool = True,
    clock: str = "date",
    daily: DataFrame | None = None,
) -> DataFrame:
    """Rates and counts in ``(month_end, month_end + width]``.

    ``as_written`` keeps the original's product of payments and service events: both payment counts are multiplied
    by the number of service events in the window (if any). Rates are not affected. ``daily`` is a finished rollup of
    both event tables under the same clock, to be used instead of the events.
    """
    days = spine.ahead(width)
    if daily is None:
        daily = daily_activity(txns, sla, txn_days=days, sla_days=days, clock=clock)
    members = month_members(daily, merchants, future_months(F.col("day"), width, spine), days, spine)
    return at_anchors(members, future_totals(SUMS, width)).select(*ON, *rate_columns(as_written))


def rate_columns(as_written: bool) -> list[Column]:
    """Forward rates and counts from the ``next_*`` totals of ``SUMS``."""
    copies = F.greatest(F.col("next_n_sla"), F.lit(1)) if as_written else F.lit(1)

    def rate(part, whole):
        return or_zero_double(ratio(F.col(f"next_{part}"), F.col(f"next_{whole}")))

    def count(column):
        return (F.col(f"next_{column}") * copies).cast("bigint")

    return [
        rate("chargeback", "n_chargeback").alias("future_chargeback_rate"),
        rate("fraud", "n_fraud").alias("future_fraud_rate"),
        rate("declined", "n_status").alias("future_decline_rate"),
        count("fraud").alias("future_fraud_count"),
        count("n_txn_id").alias("future_txn_count"),
        rate("breached", "n_breached").alias("future_sla_breach_rate"),
    ]


def _decline_clause(decline: float, fraud_count: int) -> Column:
    return (F.col("future_decline_rate") >= decline) & (F.col("future_fraud_count") >= fraud_count)


def _sla_clause(breach_rate: float, txn_count: int) -> Column:
    return (F.col("future_sla_breach_rate") >= breach_rate) & (F.col("future_txn_count") >= txn_count)


def default_label(rates: DataFrame, rule: LabelRule = LabelRule()) -> DataFrame:
    """Adds the 0/1 label: any of four clauses over the forward rates."""
    hit = (
        (F.col("future_chargeback_rate") >= rule.chargeback)
        | (F.col("future_fraud_rate") >= rule.fraud)
        | _decline_clause(rule.decline, rule.fraud_count)
        | _sla_clause(rule.sla, rule.txn_count)
    )
    return rates.withColumn(LABEL, F.when(hit, 1).otherwise(0))


def label_condition_rates(rates: DataFrame) -> DataFrame:
    """Share of merchant-months that meet each of four looser conditions, in one pass."""

    def share(condition):
        return F.avg(condition.cast("int"))

    # The looser thresholds.
    return rates.agg(
        share(F.col("future_chargeback_rate") >= 0.012).alias("chargeback_share"),
        share(F.col("future_fraud_rate") >= 0.018).alias("fraud_share"),
        share(_decline_clause(0.20, 5)).alias("decline_share"),
        share(_sla_clause(0.10, 200)).alias("sla_share"),
    )


def threshold_grid(
    rates: DataFrame,
    chargebacks: tuple[float, ...] = GRID_CHARGEBACK,
    frauds: tuple[float, ...] = GRID_FRAUD,
    keep: tuple[float, float] | None = GRID_KEEP,
    rule: LabelRule = LabelRule(),
) -> DataFrame:
    """Default rate of the rule without its service clause for every pair of thresholds; ``keep`` filters by the rate.

    A row goes to the cell of the thresholds that its two rates reach, and cells are counted once (map-side first). A pair
    misses the rows that reach neither of its thresholds: a sum over the cells before both, so two running sums along the
    axes of the grid give all pairs. Cells and pairs are as many as thresholds multiplied, whatever the rows. A row whose label
    would be NULL (a rate is missing and nothing else decides) counts for no pair.
    """
    chargebacks, frauds = sorted(set(chargebacks)), sorted(set(frauds))
    other = _decline_clause(rule.decline, rule.fraud_count)

    def reached(rate: str, cuts: list[float]) -> Column:
        return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col(rate))), F.lit(0))

    known = F.col("future_chargeback_rate").isNotNull() & F.col("future_fraud_rate").isNotNull() & other.isNotNull()
    undecided = F.coalesce(~other, F.lit(True))
    cells = rates.select(
        F.when(F.col("future_chargeback_rate").isNull(), 0).otherwise(reached("future_chargeback_rate", chargebacks)).alias("i"),
        F.when(F.col("future_fraud_rate").isNull(), 0).otherwise(reached("future_fraud_rate", frauds)).alias("j"),
        undecided.alias("undecided"),
        (undecided & known).alias("negative"),
    )
    cells = cells.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("undecided").alias("undecided"), F.count_if("negative").alias("negative")
    )
    pairs = [(a, b, c, f) for a, c in enumerate(chargebacks) for b, f in enumerate(frauds)]
    grid = rates.sparkSession.createDataFrame(pairs, "i int, j int, chargeback_threshold double, fraud_threshold double")
    grid = grid.join(cells.drop("rows"), ["i", "j"], "left")
    along = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    for window in (along, across):
        grid = grid.withColumns({n: F.sum(F.coalesce(n, F.lit(0).cast("bigint"))).over(window) for n in ("undecided", "negative")})
    positive = cells.agg(F.sum("rows")).scalar() - F.col("undecided")
    grid = grid.select(
        "chargeback_threshold", "fraud_threshold",
        F.try_divide(positive.cast("double"), (positive + F.col("negative")).cast("double")).alias("default_rate"),
    )
    return grid if keep is None else grid.where(F.col("default_rate").between(*keep))


def outcomes_monthly(labels: DataFrame) -> DataFrame:
    """The label table that datasets and reports join."""
    return labels.select(*ON, LABEL)


def write_outcomes(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by month; the rebalance hint gives few, evenly sized files per month."""
    outcomes_monthly(labels).hint("rebalance", MONTH).write.mode(mode).partitionBy(MONTH).parquet(path)
