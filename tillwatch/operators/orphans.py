"""Rows whose key is missing from another table, without shuffling the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-NULL ``key`` is not in ``parent``.

    Only distinct keys are compared, reduced map-side first, so a key on a third of all rows costs one row per task.
    Nothing runs until the result is asked for. The size of the missing keys is known when they are computed: the
    planner then broadcasts them if they are below its limit (the usual case: there are few) and otherwise shuffles
    with skew handling.
    """
    keys = child.where(F.col(key).isNotNull()).select(key).distinct()
    missing = keys.join(parent.select(key), key, "left_anti")
    return child.join(missing, key, "left_semi")


def not_in(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` for which SQL's ``key NOT IN (SELECT key FROM parent)`` is true.

    A NULL in the parent makes the test unknown for every row, a NULL key only for its own row, and against an empty
    parent every row passes. The built-in null-aware anti join would copy the parent to every executor.
    """
    facts = parent.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("known"))
    empty = facts.select(F.col("rows") == 0).scalar()
    complete = facts.select(F.col("rows") == F.col("known")).scalar()
    return orphans(child, parent, key).where(complete).unionByName(child.where(F.col(key).isNull() & empty))
