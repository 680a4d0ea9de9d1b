"""Writers: delimited tables with the domain's rounding, partitioned series, and the manifest of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def rounds_to_whole(column: str) -> bool:
    """Megawatt columns and prices per megawatt hour are written as whole numbers."""
    c = column.lower()
    return c.endswith("_mw") or "eur/mwh" in c


def rounded(df: DataFrame) -> DataFrame:
    """Such columns as nullable whole numbers, halves to even; everything else as it is."""
    return df.select(*[(F.bround(F.col(f"`{f.name}`"), 0).cast("long").alias(f.name) if rounds_to_whole(f.name) and f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")) for f in df.schema.fields])


def fixed_decimals(df: DataFrame, digits: dict[str, int], tiny: float = 1e-9) -> DataFrame:
    """Columns as text with fixed decimals; values nearer to 0 than ``tiny`` are 0, nulls stay null."""
    return df.withColumns({c: F.format_string(f"%.{n}f", F.when(F.abs(c) < tiny, 0.0).otherwise(F.col(c).cast("double"))) for c, n in digits.items()})


def write_table(df: DataFrame, path: str, sep: str = ";") -> None:
    """A delimited table with header, rounded, replaced as a whole; written by as many tasks as the frame has parts."""
    rounded(df).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_series(df: DataFrame, path: str, partitions: list[str]) -> None:
    """A long series as Parquet, compressed with zstd, in folders by the given columns (technology and year); one writer per folder's
    rows, so that folders hold few files."""
    df.repartition(*partitions).write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def write_manifest(spark: SparkSession, path: str, settings: dict, inputs: dict[str, str], totals: dict[str, float]) -> str:
    """What a run read and gave, as JSON text in one file; returned as well."""
    text = json.dumps({"settings": settings, "inputs": inputs, "totals": totals, "spark": spark.version}, indent=2, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def totals_of(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Sums of columns, for a manifest."""
    row = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns], F.count(F.lit(1)).alias("rows")).first()
    return row.asDict()
