"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_HOT_KEYS = 200


#: Rows of a hot key that one task takes, and the salts a join uses at most.
ROWS_PER_SALT, MAX_SALTS = 500_000, 2_000


def hot_counts(df: DataFrame, key: str, share: float = 1.0 / MAX_HOT_KEYS, least_rows: int = 20_000) -> dict:
    """Keys holding more than ``share`` of the rows (and more than ``least_rows``), with their number of rows.

    By construction at most ``1 / share`` keys can qualify, so what reaches the driver is bounded whatever the data. Costs one map-side
    combined count of the key column.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total = df.count()
    limit = max(least_rows, int(total * share))
    return {r[0]: r[1] for r in counts.where(F.col("count") > limit).select(key, "count").collect()}


def hot_keys(df: DataFrame, key: str, share: float = 1.0 / MAX_HOT_KEYS, least_rows: int = 20_000) -> list:
    """The keys of ``hot_counts``."""
    return list(hot_counts(df, key, share, least_rows))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 16, salt_by: list[str] | None = None, hot: list | dict | None = None) -> DataFrame:
    """Equi join on ``key`` that spreads the left rows of hot keys over ``salts`` tasks, or as many as the largest of them needs.

    Only the right rows of hot keys are repeated (once a salt); all others join as usual. Every row is kept, and nulls in
    ``key`` match nothing, as in a plain join. ``salt_by`` names the left columns that choose the salt (default: all columns),
    so a retried task draws the same salt again. Left and right must share no column name but ``key``.
    """
    hot = hot_counts(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    if isinstance(hot, dict):
        salts = min(MAX_SALTS, max(salts, -(-max(hot.values()) // ROWS_PER_SALT)))
    is_hot = F.col(key).isin(list(hot))
    cols = [F.col(c) for c in (salt_by or [f.name for f in left.schema.fields if not f.dataType.typeName() in ("map", "variant")])]
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*cols), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
