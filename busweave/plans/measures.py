"""Problem 7 on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.outliers import implausible
from ..session import table


def _inflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hydro_bus_inflows")
    return implausible(rows, ["national_inflow_source", "bus", "plant_type", "technology"], "weather_year", "week", "national_inflow_mwh_week")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hydro_bus_constraints")
    return implausible(rows, ["bus", "plant_type", "technology"], "ref_year", "week", "max_turb_mw", limit="installed_turb_mw")


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inflows(spark, sf_dir).withColumn("table_name", F.lit("hydro_bus_inflows"))
    return found.unionByName(_limits(spark, sf_dir).withColumn("table_name", F.lit("hydro_bus_constraints")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_kinds(spark, sf_dir).select("table_name", "row_id")


QUERIES = {"p7_found": p7_found, "p7_kinds": p7_kinds}
SQL: dict[str, str] = {}
