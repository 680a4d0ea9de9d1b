"""Prefix sums and ranks within groups that may hold a third of all rows.

A plain window puts a group into one task. Here a coarse key that follows the order (a day, a rounded value) splits the group: totals
per coarse key are summed first, their prefix sums are a window over few rows, and the fine window runs within a coarse key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ordered(names: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in names]


def prefix_sum(df: DataFrame, group: list[str], coarse: str, order: list[Column], value: str, out: str, descending: bool = False) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row (exclusive) in (coarse, order) within its group.

    ``coarse`` must be the leading key of the order. Null values count 0; rows with a null group or coarse key drop out. Ties are broken by the last order key, which should be an id.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    ahead = Window.partitionBy(*group).orderBy(*_ordered([coarse], descending)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, coarse).agg(F.sum(amount).alias("_part")).withColumn("_ahead", F.coalesce(F.sum("_part").over(ahead), F.lit(0))).drop("_part")
    inside = Window.partitionBy(*group, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(totals, [*group, coarse]).withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside")


def rank_in_group(df: DataFrame, group: list[str], coarse: str, order: list[Column], out: str, descending: bool = False) -> DataFrame:
    """Adds ``out``: the row number (from 1) in (coarse, order) within the group."""
    one = prefix_sum(df.withColumn("_one", F.lit(1)), group, coarse, order, "_one", out, descending)
    return one.withColumn(out, (F.col(out) + 1).cast("long")).drop("_one")
