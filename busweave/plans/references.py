"""Problem 5 on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.orphans import clean_reference, existence_deltas, orphan_references, orphan_report, reference_deltas
from ..session import table

SOURCES = (("hydro_bus_capacities", "bus"), ("decommissioned_sites", "bus_id"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = None
    for name, col in SOURCES:
        one = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), "row_id", clean_reference(F.col(col)).alias("key"), "recorded_at").where("key is not null")
        refs = one if refs is None else refs.unionByName(one)
    existence = existence_deltas(table(spark, sf_dir, "buses_with_clusters"), "bus_id", "valid_from", "valid_to")
    return orphan_references(reference_deltas(refs.dropDuplicates(["table_name", "row_id"])), existence)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id", "orphan_kind")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_FOUND = """
with refs as (
  select distinct 'hydro_bus_capacities' as table_name, row_id, trim(bus, chr(32) || chr(9) || chr(10) || chr(13)) as k, recorded_at from hydro_bus_capacities
  union
  select distinct 'decommissioned_sites', row_id, trim(bus_id, chr(32) || chr(9) || chr(10) || chr(13)), recorded_at from decommissioned_sites),
firsts as (select bus_id, min(coalesce(valid_from, timestamp '0001-01-01')) as f from buses_with_clusters where bus_id is not null group by 1),
orphans as (
  select table_name, row_id, k, recorded_at, case when f is null then 'missing' when recorded_at < f then 'late' else 'deleted' end as orphan_kind
  from refs left join firsts on bus_id = k
  where k is not null and k <> '' and (f is null or recorded_at is not null) and not exists (
    select 1 from buses_with_clusters b where b.bus_id = k and coalesce(b.valid_from, timestamp '0001-01-01') <= recorded_at and (b.valid_to is null or recorded_at < b.valid_to)))
"""
SQL = {
    "p5_found": _FOUND + "select table_name, row_id, orphan_kind from orphans",
    "p5_report": _FOUND + "select table_name, date_trunc('month', recorded_at)::timestamp as month, orphan_kind, count(*) as n_references, count(distinct k) as n_keys from orphans group by 1, 2, 3",
}
