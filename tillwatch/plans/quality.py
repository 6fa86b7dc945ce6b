"""Data-quality exceptions and the constraints that the storage does not enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, MONTH, Spine
from tillwatch.operators.orphans import not_in, orphans
from tillwatch.operators.rollup import daily_activity, partitions
from tillwatch.operators.windows import future_months, month_members, past_months

ON = [KEY, MONTH]


def orphan_transactions(txns: DataFrame, merchants: DataFrame) -> DataFrame:
    return not_in(txns, merchants, KEY)


def _non_positive() -> Column:
    return F.col("amount") <= 0


def _in_future(as_of: str | None) -> Column:
    now = F.expr("to_utc_timestamp(current_timestamp(), current_timezone())") if as_of is None else F.lit(as_of)
    return F.col("txn_ts") > now.cast("timestamp_ntz")


def non_positive_amounts(txns: DataFrame) -> DataFrame:
    """Amounts of zero or less."""
    return txns.where(_non_positive())


def future_timestamps(txns: DataFrame, as_of: str | None = None) -> DataFrame:
    """Payments dated after ``as_of`` (UTC), by default after now."""
    return txns.where(_in_future(as_of))


#: tasks over which the rows of one key are spread at first
SPREAD = 16


def spread_totals(rows: DataFrame, columns: list[str], name: str, total: Column) -> DataFrame:
    """``total`` (a count or sum) of each key, for keys of which nearly all are on one row.

    Counted in the scan tasks, such keys would all be held there. Rows are spread by key first, and one key's rows over
    ``SPREAD`` partitions, as a key may be on a third of all rows; what is summed then is one row for a key and partition.
    """
    apart = rows.withColumn("apart_", F.spark_partition_id() % SPREAD)
    apart = apart.repartition(partitions(rows), *columns, "apart_").groupBy(*columns, "apart_").agg(total.alias(name))
    return apart.repartition(partitions(rows), *columns).groupBy(*columns).agg(F.sum(name).alias(name))


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows; NULL is no key value."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return spread_totals(df.where(known).select(*columns), columns, "copies", F.count(F.lit(1))).where(F.col("copies") > 1)


def duplicate_ids(txns: DataFrame, key: str = "txn_id") -> DataFrame:
    """Values of ``key`` on more than one row; rows without a value count as one group."""
    return spread_totals(txns.select(key), [key], "copies", F.count(F.lit(1))).where(F.col("copies") > 1)


def leakage_guard(features: DataFrame, txns: DataFrame) -> DataFrame:
    """Number of payments dated after each non-empty feature row, as ``(reference_id, occurrences)``.

    The original emits one identical row per (feature row, later payment). The count says the same without pairing
    every payment with every month: months are counted first, then summed backwards over each merchant's months.
    """
    paid = (
        txns.where(F.col(KEY).isNotNull() & F.col("txn_ts").isNotNull())
        .groupBy(KEY, F.last_day("txn_ts").alias(MONTH))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("listed", F.lit(0))
    )
    rows = features.where(F.col("txn_count_30d") > 0).select(
        *ON, F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("listed")
    )
    later = Window.partitionBy(KEY).orderBy(F.col(MONTH).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        paid.unionByName(rows)
        .groupBy(*ON)
        .agg(F.sum("n").alias("n"), F.max("listed").alias("listed"))
        .withColumn("occurrences", F.sum("n").over(later))
        .where((F.col("listed") == 1) & (F.col("occurrences") > 0))
        .select(reference_id(ON).alias("reference_id"), "occurrences")
    )


def window_bounds(members: DataFrame, windows: dict[str, tuple[str, int, int]]) -> DataFrame:
    """First and last day in each window of each merchant and month, and whether they lie where they should.

    ``members``: day rows at their month ends, as the features aggregate them. ``windows``: by name, the rollup column
    that counts its events, and the least and greatest distance in days from the month end that the window is defined
    to have. The days are picked by ``age`` as the features do it and then held against the calendar.
    """

    def bounds(name, column, low, high):
        inside = F.when((F.col(column) > 0) & F.col("age").between(low, high), F.col("day"))
        return [F.min(inside).alias(f"{name}_first"), F.max(inside).alias(f"{name}_last")]

    totals = [x for n, w in windows.items() for x in bounds(n, *w)]
    # months of the spine only, as in the features
    found = members.groupBy(*ON).agg(F.max("anchor").alias("anchor"), *totals).where(F.col("anchor"))
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("window_name"),
                F.col(f"{n}_first").alias("first_day"),
                F.col(f"{n}_last").alias("last_day"),
                F.date_sub(MONTH, high).alias("may_start"),
                F.date_sub(MONTH, low).alias("may_end"),
            )
            for n, (_, low, high) in windows.items()
        ]
    )
    each = found.select(*ON, F.inline(rows)).where(F.col("first_day").isNotNull())
    outside = (F.col("first_day") < F.col("may_start")) | (F.col("last_day") > F.col("may_end"))
    return each.select("window_name", *ON, "first_day", "last_day", outside.cast("int").alias("violation"))


def leakage_check(txns: DataFrame, sla: DataFrame, merchants: DataFrame, spine: Spine = Spine()) -> DataFrame:
    """``window_bounds`` of the windows that features and label use; right windows have no violation.

    Past windows must end at the month end, the label's window must begin behind it. Events are reduced to days before
    they are copied to month ends.
    """
    daily = daily_activity(txns, sla, txn_days=(None, spine.ahead(60)[1]), sla_days=(None, spine.ahead(60)[1]))
    past = month_members(daily, merchants, past_months(F.col("day"), 90, spine), spine.past(90), spine)
    ahead = month_members(daily, merchants, future_months(F.col("day"), 60, spine), spine.ahead(60), spine)
    behind = {f"txn_{w}": ("n_txn", 0, w - 1) for w in (30, 60, 90)} | {"sla_60": ("n_sla", 0, 59)}
    before = {"label_txn_60": ("n_txn", -60, -1), "label_sla_60": ("n_sla", -60, -1)}
    return window_bounds(past, behind).unionByName(window_bounds(ahead, before))


def reference_id(columns: list[str]) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def data_exceptions(
    txns: DataFrame, merchants: DataFrame, features: DataFrame, as_of: str | None = None
) -> DataFrame:
    """All five tests as ``(exception_type, reference_id, occurrences)``; see ``expand_occurrences``.

    The last step counts equal rows, an id on a third of all rows in many tasks.
    """

    one = F.lit(1).cast("bigint").alias("occurrences")
    reference = F.col("txn_id").cast("string").alias("reference_id")

    def rows(kind, df):
        return df.select(F.lit(kind).alias("exception_type"), reference, one)

    # tests of single rows share one filtered scan
    negative, future = _non_positive(), _in_future(as_of)
    failed = F.array_compact(F.array(F.when(negative, "NEG_AMOUNT"), F.when(future, "FUTURE_TS")))
    parts = [
        rows("ORPHAN_TXN", orphan_transactions(txns, merchants)),
        txns.where(negative | future).select(F.explode(failed).alias("exception_type"), reference, one),
        rows("DUP_TXN_ID", duplicate_ids(txns)),
        leakage_guard(features, txns).withColumn("exception_type", F.lit("LEAKAGE_GUARD")),
    ]
    found = reduce(DataFrame.unionByName, parts)
    return spread_totals(found, ["exception_type", "reference_id"], "occurrences", F.sum("occurrences"))


def expand_occurrences(exceptions: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row per occurrence, the original shape.

    A count is first cut into chunks that are spread over the cluster, so no task writes out one big count alone.
    """
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("occurrences") - 1) / chunk).cast("bigint"))
    size = F.least(F.lit(chunk).cast("bigint"), F.col("occurrences") - F.col("chunk") * chunk)
    others = [c for c in exceptions.columns if c != "occurrences"]
    return (
        exceptions.withColumn("chunk", F.explode(chunks))
        .withColumn("size", size.cast("int"))
        .repartition(*others, "chunk")
        .select(*others, F.explode(F.sequence(F.lit(1), F.col("size"))).alias("copy"))
        .drop("copy")
    )


def exception_summary(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("exception_type").agg(F.sum("occurrences").alias("exceptions"))


def label_sanity(outcomes: DataFrame, merchants: DataFrame) -> DataFrame:
    """Default rate by risk tier, highest first; expected HIGH, MED, LOW."""
    return (
        outcomes.join(merchants.select(KEY, "risk_tier_true"), KEY)
        .groupBy("risk_tier_true")
        .agg(
            F.count(F.lit(1)).alias("total_months"),
            F.sum(LABEL).alias("default_count"),
            F.avg(LABEL).alias("default_rate"),
        )
        .orderBy(F.col("default_rate").desc(), "risk_tier_true")
    )


def check_primary_keys(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """``(table_name, key_value, copies)`` for every key used more than once."""
    found = [
        repeated_keys(tables[name], columns).select(
            F.lit(name).alias("table_name"), reference_id(columns).alias("key_value"), "copies"
        )
        for name, columns in keys.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, found)


def check_foreign_keys(tables: dict[str, DataFrame], parent: DataFrame, ids: dict[str, list[str]]) -> DataFrame:
    """``(table_name, reference_id)`` for every row whose merchant does not exist; a NULL merchant is no violation."""
    found = [
        orphans(tables[name].select(KEY, *[c for c in columns if c != KEY]), parent, KEY)
        .select(F.lit(name).alias("table_name"), reference_id(columns).alias("reference_id"))
        for name, columns in ids.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, found)


def _unpivot_counts(df: DataFrame, table: str, tests: dict[str, Column], label: str, value: str) -> DataFrame:
    """Counts the rows for which each test is true in one pass, then one row per test."""
    names = list(tests)
    counts = df.agg(*[F.count_if(tests[n]).alias(f"t{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"t{i}").alias(value)) for i, n in enumerate(names)])
    return counts.select(F.lit(table).alias("table_name"), F.inline(pairs))


def check_not_null(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """``(table_name, column_name, null_rows)`` for every declared column."""
    found = [
        _unpivot_counts(tables[name], name, {c: F.col(c).isNull() for c in cols}, "column_name", "null_rows")
        for name, cols in columns.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, found)


def check_domains(tables: dict[str, DataFrame], domains: dict[str, dict[str, tuple]]) -> DataFrame:
    """``(table_name, rule, violations)``: values outside their list, and amounts that are not positive."""
    found = [
        _unpivot_counts(tables[name], name, _outside(tables[name], rules), "rule", "violations")
        for name, rules in domains.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, found)


def _outside(df: DataFrame, rules: dict[str, tuple]) -> dict[str, Column]:
    tests = {f"{column} in list": ~F.col(column).isin(*values) for column, values in rules.items()}
    if "amount" in df.columns:
        tests["amount > 0"] = ~(F.col("amount") > 0)
    return tests


class Watch:
    """``check_not_null`` and ``check_domains`` of one table, counted while it is written: no scan of their own.

    ``on`` puts the counts on a frame; use its result in one write or other action, as the last step before it, so that
    tasks that run again aren't counted twice. The two tables of counts wait for that action. One watch, one action.
    """

    def __init__(self, table: str, columns: list[str], domains: dict[str, tuple]):
        self.table, self._columns, self._domains = table, columns, domains
        self._observation, self._rules = Observation(), []

    def on(self, df: DataFrame) -> DataFrame:
        outside = _outside(df, self._domains)
        self._rules = list(outside)
        tests = [F.col(c).isNull() for c in self._columns] + list(outside.values())
        return df.observe(self._observation, *[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests)])

    def null_rows(self, spark: SparkSession) -> DataFrame:
        return self._counts(spark, self._columns, 0, "column_name string, null_rows bigint")

    def violations(self, spark: SparkSession) -> DataFrame:
        return self._counts(spark, self._rules, len(self._columns), "rule string, violations bigint")

    def _counts(self, spark: SparkSession, names: list[str], start: int, columns: str) -> DataFrame:
        found = self._observation.get
        rows = [(self.table, name, found[f"t{start + i}"]) for i, name in enumerate(names)]
        return spark.createDataFrame(rows, f"table_name string, {columns}")
