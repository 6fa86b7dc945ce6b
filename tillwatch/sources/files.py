"""Typed readers for the raw tables and readers/writers for scored tables."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.config import MONTH_PARTITION
from tillwatch.sources import schemas


def _load(spark: SparkSession, path: str, schema: T.StructType, fmt: str, validate: bool) -> DataFrame:
    if fmt == "csv":
        # columns are found by their header, in any order; columns that aren't declared are left out
        header = spark.read.option("header", True).csv(path).columns
        declared = {f.name: f for f in schema.fields}
        if lacking := [n for n in declared if n not in header]:
            raise ValueError(f"{path} has no column {', '.join(lacking)}")
        in_file = T.StructType([declared.get(n, T.StructField(n, T.StringType())) for n in header])
        # FAILFAST: a value that does not fit the declared type stops the load, it does not become NULL
        found = (
            spark.read.schema(in_file)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .option("timestampNTZFormat", "yyyy-MM-dd[ ]['T']HH:mm[:ss][.SSSSSS]")
            .csv(path)
        )
        found = found.select(*schema.names)
        if validate:
            # queries convert the columns they read alone; this pass converts all, as a bulk load does
            found.write.format("noop").mode("overwrite").save()
        return found
    found = spark.read.format(fmt).load(path)
    partition = [MONTH_PARTITION] if MONTH_PARTITION in found.columns else []
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *partition)


def load_merchants(spark: SparkSession, path: str, fmt: str = "csv", validate: bool = True) -> DataFrame:
    return _load(spark, path, schemas.MERCHANTS, fmt, validate)


def load_transactions(spark: SparkSession, path: str, fmt: str = "csv", validate: bool = True) -> DataFrame:
    return _load(spark, path, schemas.TRANSACTIONS, fmt, validate)


def load_sla_events(spark: SparkSession, path: str, fmt: str = "csv", validate: bool = True) -> DataFrame:
    return _load(spark, path, schemas.SLA_EVENTS, fmt, validate)


def load_outcomes(spark: SparkSession, path: str, fmt: str = "parquet", validate: bool = True) -> DataFrame:
    return _load(spark, path, schemas.OUTCOMES, fmt, validate)


def save_transactions(
    txns: DataFrame, path: str, mode: str = "errorifexists", watch: Callable[[DataFrame], DataFrame] = lambda df: df
) -> None:
    """Columnar copy of the payments, partitioned by month of the timestamp and sorted inside the files by it.

    Window bounds then skip whole months and row groups; the reader keeps the partition column for that. The
    rebalance hint splits a heavy month into even files. ``watch`` is put on the rows as they are written, such as the
    ``on`` of a ``quality.Watch``.
    """
    rows = (
        txns.withColumn(MONTH_PARTITION, F.trunc("txn_ts", "MM"))
        .hint("rebalance", MONTH_PARTITION)
        .sortWithinPartitions(MONTH_PARTITION, "txn_ts")
    )
    watch(rows).write.mode(mode).partitionBy(MONTH_PARTITION).parquet(path)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Scored merchant-months as Parquet (default) or as CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_scored(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Reads what ``write_scored`` wrote; in CSV an empty text comes back as NULL."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # an empty text and a NULL are written differently; read both as NULL, as the usual CSV readers do
        text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        found = reader.option("header", True).option("mode", "FAILFAST").option("emptyValue", "").csv(path)
        return found.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in text}) if text else found
    return reader.format(fmt).load(path)
