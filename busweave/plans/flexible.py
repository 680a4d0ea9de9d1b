"""Transfer limits, demand response and availability profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import number_or_zero, safe_div, zone_country
from ..operators.aggregate import directed_pairs, islands
from ..operators.joining import reconcile, replicate_profile, split_by_share
from .load import model_country


def transfer_limits(raw: DataFrame, mapping: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(first, second, to_mw, from_mw, n_rows, kind) from borders written ``A-B`` with forward and backward limits.

    Zones become countries, countries model countries; borders inside one drop out; kind is hvac, hvdc or mixed by the zones' names.
    """
    ends = F.split("border", r"\s*-\s*")
    df = raw.select(F.get(ends, F.lit(0)).alias("zone_a"), F.get(ends, F.lit(1)).alias("zone_b"), number_or_zero(F.col("forward").cast("string")).alias("forward"), number_or_zero(F.col("backward").cast("string")).alias("backward"))
    df = df.withColumns({"country_a": zone_country(F.col("zone_a")), "country_b": zone_country(F.col("zone_b")), "kind": F.when(F.upper(F.concat("zone_a", "zone_b")).contains("DC"), "hvdc").otherwise("hvac")})
    if excluded is not None:
        gone = excluded.select("country").distinct()
        df = df.join(gone.withColumnRenamed("country", "country_a"), "country_a", "left_anti").join(gone.withColumnRenamed("country", "country_b"), "country_b", "left_anti")
    df = model_country(model_country(df, mapping, "country_a", "a"), mapping, "country_b", "b")
    return directed_pairs(df, "a", "b", "forward", "backward", "kind")


def response_bands(sheet: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Price bands from cells (file, row, col, value): one row per column with the values of the labelled rows.

    ``labels`` maps a row's text in the first column to the output column.
    """
    rows = sheet.where("col = 1").select("file", "row", F.trim("value").alias("label")).where(F.col("label").isin(*labels))
    cells = sheet.where("col > 1").join(rows, ["file", "row"])
    wide = cells.groupBy("file", "col").pivot("label", list(labels)).agg(F.first("value"))
    return wide.select("file", F.col("col").alias("band_col"), *[F.col(f"`{k}`").alias(v) for k, v in labels.items()])


def merged_bands(bands: DataFrame, keys: list[str], place: str, label: str, values: list[str]) -> DataFrame:
    """Neighbouring columns with one label as one band: the mean of their values."""
    return islands(bands, keys, place, label, values)


def availability_factor(rows: DataFrame) -> DataFrame:
    """Adds availability_factor: available over installed, 0 where nothing is installed."""
    return rows.withColumn("availability_factor", safe_div(F.col("available_capacity_mw"), F.col("installed_capacity_mw"), 0.0))


def bus_bands(bands: DataFrame, shares: DataFrame, mapping: DataFrame) -> DataFrame:
    """Price bands of market nodes for every node of their model country: capacity and units by share; ``band_uid`` and ``unit_id``."""
    m = model_country(bands, mapping).withColumn("band_uid", F.concat_ws("|", "market_node", F.col("band_id").cast("string")))
    out = split_by_share(m.drop("country").withColumnRenamed("country_model", "country"), shares, "country", ["installed_capacity_mw", "units"])
    return out.withColumn("unit_id", F.concat_ws("|", F.lit("dsr"), "band_uid", "bus"))


def band_diagnostics(bands: DataFrame, by_bus: DataFrame) -> DataFrame:
    """Totals of the countries before and after, their difference, and which side has them."""
    a = bands.groupBy("country").agg(F.sum("installed_capacity_mw").alias("installed_capacity_mw"))
    b = by_bus.groupBy("country").agg(F.sum("installed_capacity_mw").alias("installed_capacity_mw"))
    return reconcile(a, b, ["country"], "installed_capacity_mw")


def bus_availability(profile: DataFrame, shares: DataFrame, mapping: DataFrame, time: list[str]) -> DataFrame:
    """Availability of a country's market nodes summed, as a factor, for every node with load: factors are replicated, not shared."""
    m = model_country(profile, mapping)
    total = m.groupBy("country_model", *time).agg(F.sum("available_capacity_mw").alias("available_capacity_mw"), F.sum("installed_capacity_mw").alias("installed_capacity_mw"))
    return replicate_profile(availability_factor(total).withColumnRenamed("country_model", "country"), shares, "country")


def flexible_series(series: DataFrame, shares: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hourly available capacity of bands for every node of their model country. No shuffle of the series but on the country, and none
    where the shares are small enough to be sent to the tasks."""
    m = model_country(series, mapping).drop("country").withColumnRenamed("country_model", "country")
    return split_by_share(m, shares, "country", ["available_capacity_mw"])
