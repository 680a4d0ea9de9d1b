"""Renewable capacity to raster cells and generation to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.allocate import scale_to_total, water_fill
from ..operators.joining import last_match
from ..operators.raster import clip_low, node_capacity_factor


def keep_cells(cells: DataFrame, technology: str, min_potential: dict[str, float], min_cf: dict[str, float]) -> DataFrame:
    """Cells with at least the technology's least potential and mean capacity factor (0 where none is set)."""
    return cells.where((F.col("p_nom_max_mw") > 0) & (F.col("p_nom_max_mw") >= min_potential.get(technology, 0.0)) & (F.coalesce("mean_cf", F.lit(0.0)) >= min_cf.get(technology, 0.0)))


def current_by_cell(cells: DataFrame, current: DataFrame, node: str = "bus_id") -> DataFrame:
    """Existing capacity of nodes over their cells by potential, equally where there is none."""
    total = cells.groupBy(node).agg(F.sum("p_nom_max_mw").alias("_p"), F.count(F.lit(1)).alias("_n"))
    df = cells.join(total, node).join(current.select(node, F.col("capacity_mw").alias("_c")), node, "left")
    share = F.when(F.col("_p") > 0, F.col("p_nom_max_mw") / F.col("_p")).otherwise(1.0 / F.col("_n"))
    return df.withColumn("current_capacity_mw", F.coalesce("_c", F.lit(0.0)) * share).drop("_p", "_n", "_c")


def scenario_cells(cells: DataFrame, targets: DataFrame, group: str = "country", cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Cells with scenario capacity: what is there plus the growth to the target, best classes first; nothing is taken away.

    Returns cells and (group, delta, allocated, remainder, target, current).
    """
    have = cells.groupBy(group).agg(F.sum("current_capacity_mw").alias("current"))
    goal = targets.join(have, group, "left").fillna(0.0, ["current"]).withColumn("delta", F.greatest(F.col("target") - F.col("current"), F.lit(0.0)))
    c = cells.withColumns({"headroom": F.greatest(F.col("p_nom_max_mw") - F.col("current_capacity_mw"), F.lit(0.0)), "class": F.col("resource_class")})
    added, report = water_fill(c, goal.select(group, "delta"), group, cell)
    out = cells.join(added, [group, cell], "left").withColumn("scenario_capacity_mw", F.col("current_capacity_mw") + F.coalesce("addition", F.lit(0.0))).drop("addition")
    return out, report.join(goal.select(group, "target", "current"), group)


def generation(national: DataFrame, series: DataFrame, cells: DataFrame, node_country: DataFrame, time: list[str], node: str = "bus_id", threshold: float = 0.0) -> DataFrame:
    """(country, time, node, generation, mode, factor): national generation by the nodes' profiles, or by capacity where there is none.

    ``series`` holds capacity factors of the wanted hours only (filter it before: folders by technology and year are pruned).
    """
    s = series.withColumn("cf", clip_low(F.col("cf"), threshold)) if threshold else series
    profile = node_capacity_factor(s, cells, node, time)
    cap = cells.groupBy(node).agg(F.sum("scenario_capacity_mw").alias("capacity"))
    grid = national.select("country", *time, F.col("generation").alias("total"))
    nodes = node_country.join(cap, node, "left").fillna(0.0, ["capacity"])
    raw = grid.select("country", *time).distinct().join(nodes, "country").join(profile.select(node, *time, "raw"), [node, *time], "left")
    return scale_to_total(raw, grid, ["country", *time], "raw", "capacity").select("country", *time, node, F.col("scaled").alias("generation"), "mode", "factor")


def protected_area_filter(areas: DataFrame, marine: bool, iucn_in: list[str] | None = None, iucn_out: list[str] | None = None, status_in: list[str] | None = None, status_out: list[str] | None = None) -> DataFrame:
    """Protected areas of sea or land with the wanted categories and states; a list of wanted ones wins over one of unwanted."""
    df = areas.where(F.col("marine") == marine)
    for column, wanted, unwanted in (("iucn", iucn_in, iucn_out), ("status", status_in, status_out)):
        if wanted:
            df = df.where(F.col(column).isin(wanted))
        elif unwanted:
            df = df.where(F.col(column).isNull() | ~F.col(column).isin(unwanted))
    return df


def offshore_cells(cells: DataFrame, least_km: float | None, most_km: float | None) -> DataFrame:
    """Cells whose distance to the shore lies within the bounds, both included."""
    out = cells
    if least_km is not None:
        out = out.where(F.col("shore_km") >= least_km)
    if most_km is not None:
        out = out.where(F.col("shore_km") <= most_km)
    return out


def runoff_profiles(runoff: DataFrame, reference: DataFrame, capacity: DataFrame, reductions: DataFrame | None = None) -> DataFrame:
    """(bus_id, time, plant_type, inflow): runoff of countries scaled to a reference total, per unit of run-of-river and reservoir
    capacity, times each node's capacity of the type. Each type gets the full per-unit series."""
    r = runoff
    if reductions is not None:
        r = r.join(reductions.select(F.col("source_country").alias("country"), "target_country"), "country", "left").withColumn("country", F.coalesce("target_country", "country")).groupBy("country", "time").agg(F.sum("runoff").alias("runoff"))
    scale = r.agg(F.sum("runoff").alias("r")).first()["r"]
    ref = reference.agg(F.sum("inflow").alias("f")).first()["f"]
    factor = float(ref) / float(scale) if scale else 0.0
    natural = capacity.where(F.col("plant_type").isin("ror", "wr"))
    per_country = natural.groupBy("country").agg(F.sum("capacity_mw").alias("_c"))
    pu = r.join(per_country, "country").where("_c > 0").select("country", "time", (F.col("runoff") * factor / F.col("_c")).alias("pu"))
    return capacity.join(pu, "country").select("bus_id", "time", "plant_type", (F.col("pu") * F.col("capacity_mw")).alias("inflow"))


def sync_area(country, lon, lat):
    """Synchronous area of a node by country and place: Denmark is divided at 10.95 degrees east, Northern Ireland by a box."""
    ni = (country.isin("GB", "UK")) & lon.between(-8.5, -5.0) & lat.between(54.0, 55.6)
    east = (country == "DK") & (lon >= 10.95)
    return last_match([(country.isin("GB", "UK"), "GB"), ((country == "IE") | ni, "IE_NOIE"), (country.isin("NO", "SE", "FI") | east, "NORDICS")], "CESA")
