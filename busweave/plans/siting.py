"""Where units go: thermal units in stages, other units by basis, retired sites and load, batteries by a cascade, and their costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import EARTH_KM, fuel_group, find_column, loose_number, positive, safe_div
from ..operators.aggregate import weighted_passthrough
from ..operators.allocate import capped_proportional, largest_remainder, priority_fill, round_robin_with_offset, unit_packing
from ..operators.joining import nearest_in_group_else_any
from ..operators.shares import fallback_cascade, partition_share, ranked_nodes

# Weeks of a standard and a long revision by technology, where no list gives them.
REVISION_WEEKS = {"NUCLEAR": (4, 8), "CCGT": (3, 6), "OCGT": (2, 4), "STEAM": (4, 8)}
OTHER_WEEKS = (2, 4)


def plants_at_nodes(plants: DataFrame, buses: DataFrame) -> DataFrame:
    """Plants (plant_id, country, lat, lon, ...) with their nearest AC node of the country, else the nearest of all; distance in km."""
    points = plants.select(F.col("plant_id").alias("point"), "country", "lat", "lon")
    nodes = buses.where("not coalesce(dc_bool, false)").select(F.col("bus_id").alias("node"), "country", "lat", "lon")
    near = nearest_in_group_else_any(points, nodes, "country", EARTH_KM)
    return plants.join(near.select(F.col("point").alias("plant_id"), F.col("node").alias("bus_id"), F.col("km").alias("distance_km"), "in_group"), "plant_id", "left")


def country_membership(buses: DataFrame, split: bool = True) -> DataFrame:
    """(bus_id, country, membership): a cluster's share of each country by its member nodes, or its first country in full."""
    n = buses.where("cluster_id is not null and country is not null").groupBy(F.col("cluster_id").alias("bus_id"), "country").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if split:
        return partition_share(n, ["bus_id"], "n", "membership").select("bus_id", "country", "membership")
    return ranked_nodes(n, "bus_id", [("n", True)], "country").where("rank = 1").select("bus_id", "country", F.lit(1.0).alias("membership"))


def network_plants(plants: DataFrame, membership: DataFrame) -> DataFrame:
    """Plants by the countries of their node: capacity and unit count by membership; rows without capacity drop out."""
    df = plants.join(membership, "bus_id")
    return df.withColumns({"capacity_mw": F.col("capacity_mw") * F.col("membership"), "n_plants": F.coalesce("n_plants", F.lit(1.0)) * F.col("membership")}).where("capacity_mw > 0").drop("membership")


def retired_sites(plants: DataFrame, buses: DataFrame, year: int, lookback: int) -> DataFrame:
    """(country, site, fuel_group, capacity, date_out, units): plants that closed in [year - lookback, year), by node and fuel."""
    df = plants.where((F.col("date_out") >= year - lookback) & (F.col("date_out") < year) & (F.col("capacity_mw") > 0))
    at = df.join(buses.select("bus_id", F.coalesce("cluster_id", "bus_id").alias("site")), "bus_id")
    return at.groupBy("country", "site", "fuel_group").agg(F.sum("capacity_mw").alias("capacity"), F.max("date_out").alias("date_out"), F.count(F.lit(1)).alias("units"))


def target_groups(targets: DataFrame, least_unit_mw: float = 100.0) -> DataFrame:
    """Capacity and units by country, fuel and technology; never so many units that one is smaller than the least size, and at least one."""
    g = targets.groupBy("country", "fuel_code", "tech").agg(F.sum("capacity_mw").alias("cap_total_mw"), F.sum("n_units").alias("_n")).where("cap_total_mw > 0")
    most = F.greatest(F.floor(F.col("cap_total_mw") / least_unit_mw), F.lit(1))
    return g.withColumn("n_units", F.greatest(F.lit(1), F.least(F.coalesce(F.round("_n").cast("long"), F.lit(1).cast("long")), most)).cast("long")).drop("_n")


def plant_weights(plants: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bus_id, weight, chp_share): half by capacity and half by unit count where both are known, else by the one there is."""
    at = plants.groupBy(*keys, "bus_id").agg(F.sum(positive(F.col("capacity_mw"))).alias("c"), F.sum(positive(F.col("n_plants"))).alias("u"))
    all_ = plants.groupBy(*keys).agg(F.sum(positive(F.col("capacity_mw"))).alias("_c"), F.sum(positive(F.col("n_plants"))).alias("_u"), safe_div(F.sum(F.when(F.col("chp"), F.col("n_plants"))), F.sum("n_plants"), 0.0).alias("chp_share"))
    w = F.when((F.col("_c") > 0) & (F.col("_u") > 0), F.col("c") / F.col("_c") / 2 + F.col("u") / F.col("_u") / 2).when(F.col("_c") > 0, F.col("c") / F.col("_c")).when(F.col("_u") > 0, F.col("u") / F.col("_u"))
    return at.join(all_, keys).withColumn("weight", w).where("weight > 0").select(*keys, "bus_id", "weight", "chp_share")


def thermal_units(groups: DataFrame, plants: DataFrame, priority: DataFrame, sites: DataFrame) -> DataFrame:
    """(country, fuel_code, tech, bus_id, stage, assigned, unit_mw, chp_share): whole units of each group in stages.

    Nodes with plants of the fuel and technology, else of the fuel, share the units by largest remainders; groups without any go to
    retired sites, and what finds no room there goes round the country's nodes by rank, each group starting where the last stopped.
    ``priority`` has country, bus_id, rank.
    """
    g = groups.withColumn("group_id", F.concat_ws("|", "country", "fuel_code", "tech"))
    both = plant_weights(plants, ["country", "fuel_code", "tech"]).join(g.select("country", "fuel_code", "tech", "group_id"), ["country", "fuel_code", "tech"])
    fuel = plant_weights(plants, ["country", "fuel_code"]).join(g.select("country", "fuel_code", "group_id"), ["country", "fuel_code"]).join(both.select("group_id").distinct(), "group_id", "left_anti")
    weights = both.select("group_id", "bus_id", "weight", "chp_share", F.lit("fuel_tech").alias("stage")).unionByName(fuel.select("group_id", "bus_id", "weight", "chp_share", F.lit("fuel").alias("stage")))
    placed = largest_remainder(weights.select("group_id", "bus_id", "weight"), g.select("group_id", "n_units"), "group_id", "bus_id").join(weights.select("group_id", "bus_id", "stage", "chp_share"), ["group_id", "bus_id"])
    rest = g.join(weights.select("group_id").distinct(), "group_id", "left_anti").withColumn("fuel_group", fuel_group(F.col("fuel_code")))
    units = rest.select("country", "fuel_group", "group_id", (F.col("cap_total_mw") / F.col("n_units")).alias("size"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_units"))).alias("i")).withColumn("unit", F.concat_ws("#", "group_id", F.lpad(F.col("i").cast("string"), 6, "0")))
    packed = unit_packing(units, sites).withColumn("group_id", F.substring_index("unit", "#", 1))
    brown = packed.where("site is not null").groupBy("group_id", F.col("site").alias("bus_id"), F.concat(F.lit("decommissioned_"), "site_fuel_group").alias("stage")).agg(F.count(F.lit(1)).alias("assigned"))
    left = packed.where("site is null").groupBy("country", "group_id").agg(F.count(F.lit(1)).alias("n"))
    turn = round_robin_with_offset(left, priority.select("country", "bus_id", "rank"), "country", "group_id", "n", "bus_id", "rank")
    rows = placed.select("group_id", "bus_id", "stage", "assigned", "chp_share").unionByName(brown.withColumn("chp_share", F.lit(0.0)).select("group_id", "bus_id", "stage", "assigned", "chp_share"))
    rows = rows.unionByName(turn.select("group_id", "bus_id", F.lit("bus_sequence").alias("stage"), "assigned", F.lit(0.0).alias("chp_share")))
    return rows.join(g, "group_id").select("country", "fuel_code", "tech", "bus_id", "stage", "assigned", (F.col("cap_total_mw") / F.col("n_units")).alias("unit_mw"), "chp_share")


def with_revisions(units: DataFrame, durations: DataFrame) -> DataFrame:
    """Adds standard and long revision weeks: the country's median for fuel and technology, else the technology's, else of others."""
    known = durations.groupBy("country", "fuel_code", "tech").agg(F.median("weeks").alias("_w"), F.median("long_weeks").alias("_l"))
    table = F.create_map(*[F.lit(x) for t, w in REVISION_WEEKS.items() for x in (t, float(w[0]))])
    long = F.create_map(*[F.lit(x) for t, w in REVISION_WEEKS.items() for x in (t, float(w[1]))])
    out = units.join(known, ["country", "fuel_code", "tech"], "left")
    return out.withColumns({"revision_weeks": F.coalesce("_w", F.try_element_at(table, "tech"), F.lit(float(OTHER_WEEKS[0]))), "long_revision_weeks": F.coalesce("_l", F.try_element_at(long, "tech"), F.lit(float(OTHER_WEEKS[1])))}).drop("_w", "_l")


def residual_basis(plants: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Existing capacity by keys less what was assigned, not below 0."""
    have = plants.groupBy(*keys).agg(F.sum("capacity_mw").alias("basis_mw"))
    used = taken.groupBy(*keys).agg(F.sum("capacity_mw").alias("_used"))
    return have.join(used, keys, "left").withColumn("residual_mw", F.greatest(F.col("basis_mw") - F.coalesce("_used", F.lit(0.0)), F.lit(0.0))).drop("_used")


def other_renewables(targets: DataFrame, basis: DataFrame, sites: DataFrame, offshore: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(country, kind, bus, capacity_mw, mode) and what was left over: targets of country and kind over nodes.

    Marine kinds lie equally at nodes with offshore wind and load. Others take the existing basis first, then retired sites of their
    fuel, newest first; the rest is split equally over the country's nodes with load.
    """
    t = targets.groupBy("country", "kind").agg(F.sum("target_mw").alias("target")).withColumn("g", F.concat_ws("|", "country", "kind"))
    marine = t.where("kind = 'marine'")
    spots = offshore.where("eligible").select("country", "bus").join(shares.select("country", "bus"), ["country", "bus"], "left_semi").distinct()
    n = spots.groupBy("country").agg(F.count(F.lit(1)).alias("_n"))
    sea = marine.join(spots, "country").join(n, "country").select("g", "bus", (F.col("target") / F.col("_n")).alias("capacity_mw"), F.lit("offshore_eligible").alias("mode"))
    land = t.where("kind <> 'marine'")
    b = basis.join(land.select("country", "kind", "g"), ["country", "kind"]).select("g", "bus", F.col("capacity_mw").alias("capacity"))
    first, report = capped_proportional(b, land.select("g", "target"), "g")
    after = report.select("g", F.col("remainder").alias("target")).where("target > 1e-9")
    s = sites.select("country", F.col("fuel_group").alias("kind"), F.col("site").alias("bus"), "capacity", "date_out").join(land.select("country", "kind", "g"), ["country", "kind"])
    second = priority_fill(s.select("g", "bus", "capacity", "date_out"), after, "g", "bus", "date_out")
    used = second.groupBy("g").agg(F.sum("filled").alias("_f"))
    last = after.join(used, "g", "left").withColumn("target", F.col("target") - F.coalesce("_f", F.lit(0.0))).where("target > 1e-9").drop("_f")
    rest = fallback_cascade(land.select("g", "country").join(shares.select("country", "bus"), "country").select("g", "bus"), last, "g", [])
    rows = sea.unionByName(first.select("g", "bus", F.col("allocated").alias("capacity_mw"), F.lit("existing_basis").alias("mode"))).unionByName(second.select("g", "bus", F.col("filled").alias("capacity_mw"), F.lit("decommissioned").alias("mode"))).unionByName(rest.select("g", "bus", F.col("allocated").alias("capacity_mw"), F.lit("uniform").alias("mode")))
    got = rows.groupBy("g").agg(F.sum("capacity_mw").alias("_got"))
    left = t.join(got, "g", "left").select("country", "kind", "target", F.coalesce("_got", F.lit(0.0)).alias("allocated"), (F.col("target") - F.coalesce("_got", F.lit(0.0))).alias("left_over"))
    return rows.join(t.select("g", "country", "kind"), "g").drop("g"), left


def batteries(targets: DataFrame, current: DataFrame, renewables: DataFrame, load: DataFrame, buses: DataFrame) -> DataFrame:
    """Battery targets (country, discharge_mw, charge_mw, energy_mwh, eff) over the country's nodes: by existing batteries plus
    renewables, else by load, else equally. All quantities share one split; the power is divided into current and added parts."""
    c = buses.select("country", "bus").distinct().join(current.select("country", "bus", F.col("capacity_mw").alias("current")), ["country", "bus"], "left").join(renewables.select("country", "bus", F.col("weight_mw").alias("res")), ["country", "bus"], "left").join(load.select("country", "bus", F.col("share").alias("load_share")), ["country", "bus"], "left")
    c = c.fillna(0.0, ["current", "res", "load_share"]).withColumn("combined", F.col("current") + F.col("res"))
    out = fallback_cascade(c, targets.select("country", F.col("discharge_mw").alias("target")), "country", ["combined", "load_share"]).drop("target")
    out = out.join(targets, "country").where("share > 0")
    part = safe_div(F.col("current"), F.col("combined"), 0.0)
    return out.select(
        "country", "bus", "rule", "share", F.col("allocated").alias("discharge_mw"), (F.col("charge_mw") * F.col("share")).alias("charge_mw"), (F.col("energy_mwh") * F.col("share")).alias("energy_mwh"), "eff",
        (F.col("allocated") * F.coalesce("eff", F.lit(1.0))).alias("effective_mw"), (F.col("allocated") * part).alias("current_part_mw"), (F.col("allocated") * (1 - part)).alias("added_part_mw"),
    )


def battery_targets(rows: DataFrame) -> DataFrame:
    """Powers and energy summed by country, efficiency from the sum of power times efficiency."""
    s = rows.groupBy("country").agg(F.sum("discharge_mw").alias("discharge_mw"), F.sum("charge_mw").alias("charge_mw"), F.sum("energy_mwh").alias("energy_mwh"), F.sum(F.col("discharge_mw") * F.coalesce("eff", F.lit(1.0))).alias("_e"))
    return s.withColumn("eff", safe_div(F.col("_e"), F.col("discharge_mw"))).drop("_e")


# The other headers under which a cost or performance figure is delivered.
FIGURES = {
    "efficiency": ("efficiency", "efficiency_percent", "net_efficiency", "eta"),
    "co2_em_factor_kg_gj": ("co2_em_factor_kg_gj", "co2_factor_kg_gj", "co2_kg_gj", "co2_emissions_kg_gj"),
    "co2_intensity_t_mwh": ("co2_intensity_t_mwh", "co2_factor_t_per_mwh", "co2_t_per_mwh", "co2_t_mwh", "emission_factor_t_mwh", "emission_factor_tco2_mwh"),
    "co2_price_eur_t": ("co2_price_eur_t", "co2_price_eur_ton", "co2_eur_t", "co2_eur_ton"),
    "fuel_price_eur_mwh": ("fuel_price_eur_mwh", "fuel_cost_eur_mwh", "fuel_price_eur_mwh_th"),
    "fuel_price_eur_gj": ("fuel_price_eur_gj", "price_eur_gj", "fuel_cost_eur_gj"),
    "variable_cost_eur_mwh": ("variable_cost_eur_mwh", "variable_costs_eur_mwh", "var_cost_eur_mwh", "var_cost_om_eur_mwh", "vom_eur_mwh", "variable_om_eur_mwh"),
    "fixed_cost_eur_mw_a": ("fixed_cost_eur_mw_a", "fixed_cost_eur_mw_year", "fixed_cost_eur_mw_per_year", "fixed_costs_eur_mw_a", "fixed_cost_eur_kw_a", "fixed_costs_eur_kw_a", "fixed_cost_eur_kw_year", "fixed_cost_eur_kw", "fom_eur_mw_a", "fom_eur_kw_a"),
    "fixed_cost_eur_mwh": ("fixed_cost_eur_mwh", "fixed_costs_eur_mwh", "fixed_om_eur_mwh"),
    "total_cost_eur_mwh": ("total_cost_eur_mwh", "cost_eur_mwh", "costs_eur_mwh", "price_eur_mwh", "generation_cost_eur_mwh"),
    "marginal_cost_eur_mwh": ("marginal_cost_eur_mwh", "marginal_costs_eur_mwh", "mc_eur_mwh"),
}


def cost_attributes(df: DataFrame, with_fixed: bool = False) -> DataFrame:
    """Figures under their common names, and the marginal cost: stated (marginal, else total), else the sum of the parts that are known.

    An efficiency above 1.5 is per cent; a fixed cost under a header per kW is taken a thousandfold.
    """
    cols: dict[str, Column] = {}
    for name, candidates in FIGURES.items():
        c = find_column(df.columns, list(candidates), required=False)
        v = loose_number(F.col(f"`{c}`").cast("string"), always=True) if c else F.lit(None).cast("double")
        if name == "efficiency":
            v = F.when(v > 1.5, v / 100).otherwise(v)
        if name == "fixed_cost_eur_mw_a" and c and "kw" in c.lower():
            v = v * 1000
        cols[name] = v
    out = df.withColumns(cols)
    eta = F.when(F.col("efficiency") > 0, F.col("efficiency"))
    fuel = F.coalesce(F.col("fuel_price_eur_mwh") / eta, F.col("fuel_price_eur_gj") * 3.6 / eta)
    co2 = F.coalesce(F.col("co2_price_eur_t") * F.col("co2_intensity_t_mwh"), F.col("co2_price_eur_t") * (F.col("co2_em_factor_kg_gj") * 3.6 / 1000 / eta))
    parts = [F.col("variable_cost_eur_mwh"), fuel, co2] + ([F.col("fixed_cost_eur_mwh")] if with_fixed else [])
    known, total = F.lit(False), F.lit(0.0)
    for p in parts:
        known, total = known | p.isNotNull(), total + F.coalesce(p, F.lit(0.0))
    stated = F.coalesce("marginal_cost_eur_mwh", "total_cost_eur_mwh")
    status = F.when(stated.isNotNull(), "direct_eur_mwh").when(known, "calculated_components").otherwise("missing")
    return out.withColumn("marginal_cost_status", status).withColumn("marginal_cost_eur_mwh", F.coalesce(stated, F.when(known, total)))


def summed_targets(df: DataFrame, keys: list[str], numeric: list[str], text: list[str]) -> DataFrame:
    """Targets summed by keys with their attributes weighted."""
    return weighted_passthrough(df, keys, "target_capacity_mw", numeric, text)


def unit_sizes(capacity: Column, units: Column) -> Column:
    """Array of unit sizes: as many equal units as stated, one where none are; empty without capacity."""
    n = F.greatest(F.coalesce(F.round(units).cast("int"), F.lit(1)), F.lit(1))
    return F.when(capacity > 0, F.array_repeat(capacity / n, n)).otherwise(F.array().cast("array<double>"))
