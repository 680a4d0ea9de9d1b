"""National demand to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import loose_number
from ..operators.shares import partition_share, proxy_shares

PROTECTED = ("NI", "UA", "MD")


def model_country(df: DataFrame, mapping: DataFrame, column: str = "country", out: str = "country_model", protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Adds the model country: the target of the mapping (source_country, target_country), the country itself where it has none or is
    protected."""
    m = mapping.select(F.col("source_country").alias(column), F.col("target_country").alias("_to"))
    return df.join(m, column, "left").withColumn(out, F.when(F.col(column).isin(*protected), F.col(column)).otherwise(F.coalesce("_to", F.col(column)))).drop("_to")


def load_nodes(buses: DataFrame, reduced: DataFrame) -> DataFrame:
    """AC nodes whose cluster is part of the reduced network: the flag decides, then the carrier, then the id's prefix."""
    carrier = F.lower(F.col("carrier")) if "carrier" in buses.columns else F.lit(None).cast("string")
    dc = F.coalesce(F.col("dc_bool"), carrier == "dc", F.lower("bus_id").startswith("dc"))
    return buses.where(~dc).join(reduced.select(F.col("bus_id").alias("cluster_id")).distinct(), "cluster_id", "left_semi")


def national_load(rows: DataFrame, mapping: DataFrame, value: str, time: list[str], excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(model country totals by time with their sources, rows skipped per reason): blank and unreadable values are skipped and counted."""
    df = rows.withColumn("_v", loose_number(F.col(value).cast("string")))
    if excluded is not None:
        df = df.join(excluded.select("country").distinct(), "country", "left_anti")
    reason = F.when(F.col("_v").isNull(), F.when(F.length(F.trim(F.coalesce(F.col(value).cast("string"), F.lit("")))) == 0, "blank").otherwise("unreadable"))
    skipped = df.where("_v is null").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    mapped = model_country(df.where("_v is not null"), mapping)
    total = mapped.groupBy("country_model", *time).agg(F.sum("_v").alias("load"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("source_countries"))
    return total, skipped


def disaggregate(load: DataFrame, shares: DataFrame, skip_missing: bool = False) -> DataFrame:
    """(country, time, bus, allocated): totals times shares. A country with load but no shares fails the job unless it may be skipped."""
    s = shares.select(F.col("country").alias("country_model"), "bus", "share")
    if skip_missing:
        return load.join(s, "country_model").withColumn("allocated", F.col("load") * F.col("share"))
    joined = load.join(s, "country_model", "left")
    told = F.raise_error(F.concat(F.lit("no shares for "), F.col("country_model"))).cast("double")
    return joined.withColumn("allocated", F.when(F.col("bus").isNull(), told).otherwise(F.col("load") * F.col("share")))


def node_shares(regions: DataFrame, buses: DataFrame, population: float = 0.4, product: float = 0.6, alpha: float = 1.0) -> DataFrame:
    """(country, bus, population_share, gdp_share, share) from proxy regions (region_id, country, pop, gdp, lat, lon) around the nodes."""
    r = regions.where("lat is not null and lon is not null").select("country", F.col("region_id").alias("region"), "lat", "lon", F.greatest(F.coalesce("pop", F.lit(0.0)), F.lit(0.0)).alias("population"), F.greatest(F.coalesce("gdp", F.lit(0.0)), F.lit(0.0)).alias("gdp"))
    n = buses.where("lat is not null and lon is not null").select("country", F.col("bus_id").alias("node"), F.col("cluster_id").alias("cluster"), "lat", "lon").dropDuplicates(["country", "node"])
    return proxy_shares(r, n, "country", {"population": population, "gdp": product}, alpha).withColumnRenamed("cluster", "bus")


def proxy_free_shares(nodes: DataFrame, group: str, value: str) -> DataFrame:
    """Nodes with their share of the group by a value of their own, where no proxy regions are needed."""
    return partition_share(nodes, [group], value)
