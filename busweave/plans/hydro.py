"""Hydro: weekly constraints and inflows of countries to nodes.

Types are wr (reservoir), ror (run of river), phs (pumped); technologies open_loop and closed_loop. Countries and nodes are short
tables (windows over a country are fine); the weekly facts only meet them by equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import clamp, positive, safe_div
from ..operators.series import climatology, complete_weeks, fill_gaps
from ..operators.shares import top_site
from ..session import materialise

EPS = 1e-9
KEY = ["country", "plant_type", "technology"]


def has_capacity(*columns: str) -> Column:
    """Any capacity above zero."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.abs(F.coalesce(F.col(c), F.lit(0.0))) > EPS)
    return out


def resolve_pumped(capacity: DataFrame, presence: DataFrame | None = None, region: str = "country", keep: bool = False) -> DataFrame:
    """(region, plant_type, technology, to_type, to_technology): where each component's capacity and series go.

    Pumped storage goes to the reservoir type; closed loops to run of river where there is only that, and to a closed reservoir where
    there is neither. With ``keep`` pumped storage stays, but an open loop beside a closed one joins the closed one.
    """
    rows = capacity.where(has_capacity("installed_turb_mw", "installed_pump_mw", "installed_storage_mwh"))
    there = (presence if presence is not None else capacity).where(has_capacity("installed_turb_mw", "installed_pump_mw", "installed_storage_mwh"))
    has = lambda t, k: F.coalesce(F.bool_or((F.col("plant_type") == t) & (F.col("technology") == k)), F.lit(False))
    facts = there.groupBy(region).agg(has("wr", "open_loop").alias("_wr"), has("ror", "open_loop").alias("_ror"), has("phs", "open_loop").alias("_po"), has("phs", "closed_loop").alias("_pc"))
    df = rows.select(region, "plant_type", "technology").distinct().join(facts, region, "left").fillna(False, ["_wr", "_ror", "_po", "_pc"])
    phs, closed = F.col("plant_type") == "phs", F.col("technology") == "closed_loop"
    if keep:
        joins = phs & F.col("_po") & F.col("_pc") & (F.col("technology") == "open_loop")
        return df.select(region, "plant_type", "technology", F.col("plant_type").alias("to_type"), F.when(joins, "closed_loop").otherwise(F.col("technology")).alias("to_technology"))
    only_ror, neither = closed & ~F.col("_wr") & F.col("_ror"), closed & ~F.col("_wr") & ~F.col("_ror")
    to_type = F.when(phs, F.when(only_ror, "ror").otherwise("wr")).otherwise(F.col("plant_type"))
    to_tech = F.when(phs, F.when(neither, "closed_loop").otherwise("open_loop")).otherwise(F.col("technology"))
    return df.select(region, "plant_type", "technology", to_type.alias("to_type"), to_tech.alias("to_technology"))


def merged_capacity(capacity: DataFrame, mapping: DataFrame, region: str = "country") -> DataFrame:
    """Capacities summed over what was merged; a type that took pumped storage has no pump of its own."""
    df = capacity.join(mapping, [region, "plant_type", "technology"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = df.groupBy(region, F.col("to_type").alias("_t"), F.col("to_technology").alias("_k")).agg(
        F.sum(z("installed_turb_mw")).alias("installed_turb_mw"), F.when(F.bool_or(F.col("plant_type") == "phs"), 0.0).otherwise(F.sum(F.abs(z("installed_pump_mw")))).alias("installed_pump_mw"), F.sum(z("installed_storage_mwh")).alias("installed_storage_mwh")
    )
    return out.withColumnRenamed("_t", "plant_type").withColumnRenamed("_k", "technology")


def bounded_constraints(weekly: DataFrame, capacity: DataFrame, region: str = "country") -> DataFrame:
    """Weekly limits between 0 and the installed capacity, with defaults for what is missing: minima 0, maxima the capacity, daily
    energies 24 hours of it at most, reservoir levels 0 and 1; and ``imputed`` (no, yes, missing row)."""
    df = weekly.join(capacity, [region, "plant_type", "technology"])
    top = {"turb": F.col("installed_turb_mw"), "pump": F.col("installed_pump_mw")}
    cols: dict[str, Column] = {}
    changed = F.lit(False)
    for side, cap in top.items():
        for end in ("min", "max"):
            c = f"{end}_{side}_mw"
            if c in weekly.columns:
                v = F.coalesce(clamp(F.col(c), 0.0, cap), F.lit(0.0) if end == "min" else cap)
                changed = changed | F.col(c).isNull() | (F.col(c) != v)
                cols[c] = v
            e = f"{end}_{side}_en_mwh_day"
            if e in weekly.columns:
                v = F.coalesce(clamp(F.col(e), 0.0, 24 * cap), F.lit(0.0) if end == "min" else 24 * cap)
                changed = changed | F.col(e).isNull() | (F.col(e) != v)
                cols[e] = v
    for c, default in (("min_res_tech_pu", 0.0), ("max_res_tech_pu", 1.0)):
        if c in weekly.columns:
            cols[c] = F.coalesce(clamp(F.col(c), 0.0, 1.0), F.lit(default))
            changed = changed | F.col(c).isNull()
    return df.withColumn("imputed", F.when(changed, "yes").otherwise("no")).withColumns(cols)


def type_profiles(target: DataFrame, current: DataFrame, load: DataFrame, quantity: str) -> DataFrame:
    """(country, plant_type, bus, share, rule) of a quantity (turb or storage).

    Existing capacity gives the shares. Where some types of a country shrink while others grow, the growing ones take over part of the
    shrinking ones' places: the shift is the lesser of all growth and all shrinking, dealt by growth, and lies where the shrinking
    types lie. What is new beyond that goes to the country's largest hydro node (by the quantity, then turbines, then load).
    ``target`` has country, plant_type and the quantity, ``current`` country, plant_type, bus, turb, storage, ``load`` country, bus, load.
    """
    want = target.groupBy("country", "plant_type").agg(F.coalesce(F.sum(quantity), F.lit(0.0)).alias("t"))
    have = current.groupBy("country", "plant_type").agg(F.coalesce(F.sum(quantity), F.lit(0.0)).alias("c"))
    types = want.join(have, ["country", "plant_type"], "full").fillna(0.0, ["t", "c"])
    types = types.withColumns({"plus": F.greatest(F.col("t") - F.col("c"), F.lit(0.0)), "minus": F.greatest(F.col("c") - F.col("t"), F.lit(0.0))})
    country = types.groupBy("country").agg(F.sum("plus").alias("_p"), F.sum("minus").alias("_m"))
    types = types.join(country, "country").withColumn("shift", F.when((F.col("plus") > EPS) & (F.least("_p", "_m") > EPS), F.col("plus") * F.least("_p", "_m") / F.col("_p")).otherwise(0.0))
    # A row per country and type, read by every branch below.
    types = materialise(types.withColumn("new", F.greatest(F.col("t") - F.col("c") - F.col("shift"), F.lit(0.0))), "types")
    at = current.where(F.col(quantity) > EPS).select("country", "plant_type", "bus", F.col(quantity).alias("v"))
    own = at.join(types.select("country", "plant_type"), ["country", "plant_type"]).select("country", "plant_type", "bus", "v")
    # Places given up: each shrinking type's nodes by their part of it, for a part of the shift by its part of all shrinking.
    lost = at.join(types.where("minus > 0").select("country", "plant_type", "minus", "c", "_m"), ["country", "plant_type"])
    lost = lost.groupBy("country", "bus").agg(F.sum(F.col("minus") / F.col("_m") * F.col("v") / F.col("c")).alias("_part"))
    moved = types.where(F.col("shift") > EPS).join(lost, "country").select("country", "plant_type", "bus", (F.col("shift") * F.col("_part")).alias("v"))
    sites = current.groupBy("country", "bus").agg(F.sum(quantity).alias("q"), F.sum("turb").alias("turb")).join(load, ["country", "bus"], "full").fillna(0.0, ["q", "turb", "load"])
    best = top_site(sites, "country", "bus", ["q", "turb", "load"]).select("country", "bus")
    kept = own.select("country", "plant_type").unionByName(moved.select("country", "plant_type")).distinct().withColumn("_any", F.lit(True))
    fresh = types.join(kept, ["country", "plant_type"], "left")
    amount = F.when(F.col("_any").isNull() & (F.col("t") > EPS), F.col("t")).otherwise(F.col("new"))
    added = fresh.withColumn("v", amount).where(F.col("v") > EPS).join(best.where("bus is not null"), "country").select("country", "plant_type", "bus", "v")
    places = own.unionByName(moved).unionByName(added).groupBy("country", "plant_type", "bus").agg(F.sum("v").alias("v"))
    total = places.groupBy("country", "plant_type").agg(F.sum("v").alias("_s"))
    rule = F.concat_ws(
        ";",
        F.when(F.col("c") > EPS, F.when(F.col("t") < F.col("c") - EPS, "existing_country_plant_type_shares_downscale").otherwise("existing_country_plant_type_shares")),
        F.when(F.col("shift") > EPS, "internal_type_shift"),
        F.when((F.col("new") > EPS) | ((F.col("c") <= EPS) & (F.col("shift") <= EPS) & (F.col("t") > EPS)), "true_new_highest_hydro_bus"),
    )
    return places.join(total, ["country", "plant_type"]).join(types.withColumn("rule", rule).select("country", "plant_type", "rule"), ["country", "plant_type"]).select("country", "plant_type", "bus", (F.col("v") / F.col("_s")).alias("share"), "rule")


def target_rows(capacity: DataFrame, current: DataFrame, load: DataFrame) -> DataFrame:
    """(country, plant_type, technology, bus, turbine_share, storage_share, target_turb_mw, target_storage_mwh, allocation_rule)."""
    turb = type_profiles(capacity.select("country", "plant_type", F.col("installed_turb_mw").alias("turb")), current, load, "turb").select("country", "plant_type", "bus", F.col("share").alias("turbine_share"), F.col("rule").alias("_tr"))
    stor = type_profiles(capacity.select("country", "plant_type", F.col("installed_storage_mwh").alias("storage")), current, load, "storage").select("country", "plant_type", "bus", F.col("share").alias("storage_share"), F.col("rule").alias("_sr"))
    both = turb.join(stor, ["country", "plant_type", "bus"], "full").fillna(0.0, ["turbine_share", "storage_share"])
    rule = F.when(F.col("_tr").eqNullSafe(F.col("_sr")), F.col("_tr")).otherwise(F.concat(F.lit("turb="), F.coalesce("_tr", F.lit("no_capacity")), F.lit("|storage="), F.coalesce("_sr", F.lit("no_capacity"))))
    out = capacity.join(both, ["country", "plant_type"])
    out = out.select(*KEY, "bus", "turbine_share", "storage_share", (F.coalesce("installed_turb_mw", F.lit(0.0)) * F.col("turbine_share")).alias("target_turb_mw"), (F.coalesce("installed_storage_mwh", F.lit(0.0)) * F.col("storage_share")).alias("target_storage_mwh"), rule.alias("allocation_rule"))
    return materialise(out, "targets")


def constraint_rows(weekly: DataFrame, targets: DataFrame) -> DataFrame:
    """Weekly constraints of countries for each node: powers and energies by its part of the turbines (pump limits too), storage by its
    own target, per-unit values as they are."""
    totals = targets.groupBy(*KEY).agg(F.sum("target_turb_mw").alias("_t"), F.sum("target_storage_mwh").alias("_s"))
    t = targets.join(totals, KEY).select(*KEY, "bus", safe_div(F.col("target_turb_mw"), F.col("_t"), 0.0).alias("turbine_share"), safe_div(F.col("target_storage_mwh"), F.col("_s"), 0.0).alias("storage_share"), F.col("target_storage_mwh").alias("_storage"))
    df = weekly.join(t, KEY)
    scaled = [c for c in weekly.columns if c.endswith(("_mw", "_mwh_day", "_mwh_period"))]
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) * F.col("turbine_share") for c in scaled})
    return out.withColumn("installed_storage_mwh", F.col("_storage")).withColumn("allocation_rule", F.lit("capacity_weighted_country_tech_bus_scaling")).drop("_storage")


def clean_inflows(inflows: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """(key, weather_year, week, inflow, year_missing): 52 weeks per year, gaps filled by straight lines, missing years (all null or all
    zero) by each week's mean over the others; a series without any year stays missing (null). Closed pumped loops without inflow are 0."""
    rows = inflows.where("week <= 52")
    if years:
        rows = rows.where(F.col("weather_year").between(*years))
    grid = complete_weeks(rows.select(*KEY, "weather_year", "week", "inflow"), [*KEY, "weather_year"])
    filled = fill_gaps(grid, [*KEY, "weather_year"], "week", "inflow")
    closed = (F.col("plant_type") == "phs") & (F.col("technology") == "closed_loop")
    out = climatology(filled, KEY, "weather_year", "week", "inflow")
    return out.withColumn("inflow", F.when(closed & F.col("year_missing"), 0.0).otherwise(F.col("inflow")))


def inflow_groups(inflows: DataFrame, mapping: DataFrame, targets: DataFrame, other_total: DataFrame, other_by_type: DataFrame, resolve: bool = True) -> DataFrame:
    """(country, weather_year, week, source, inflow, eligible) of national budgets by where they come from.

    ``inflows`` are cleaned series, ``mapping`` from ``resolve_pumped``, ``other_total`` (country, weather_year, week, inflow) and
    ``other_by_type`` (with plant_type) a second source. Rules, in order: a country with a closed loop and any usable open one takes
    the other source's total; usable open combinations take their own sum; redirected pumped inflow goes to natural hydro; combinations
    without any year take the other source's type series, or its total where there is one such combination and no type series.
    ``eligible`` lists the (type:technology) that share a budget.
    """
    combo = F.concat_ws(":", "plant_type", "technology")
    open_ = targets.where("technology <> 'closed_loop'").select("country", "plant_type", "technology").distinct()
    redirected = (F.col("plant_type") == "phs") & (F.col("to_type") != "phs")
    series = inflows.join(mapping, KEY)
    usable = series.where(~redirected).groupBy("country", F.col("to_type").alias("plant_type"), F.col("to_technology").alias("technology")).agg((F.count(F.when(F.abs("inflow") > EPS, 1)) > 0).alias("_ok"))
    state = open_.join(usable, KEY, "left").fillna(False, ["_ok"])
    closed = mapping.where("plant_type = 'phs' and technology = 'closed_loop'").select("country").distinct().withColumn("_closed", F.lit(True))
    per = state.groupBy("country").agg(
        F.bool_or("_ok").alias("_any"), F.array_sort(F.collect_set(combo)).alias("_open"), F.array_sort(F.collect_set(F.when(F.col("_ok"), combo))).alias("_valid"),
        F.array_sort(F.collect_set(F.when(~F.col("_ok"), combo))).alias("_missing"), F.array_sort(F.collect_set(F.when(F.col("plant_type").isin("wr", "ror"), combo))).alias("_natural"),
    )
    per = per.join(closed, "country", "left").fillna(False, ["_closed"]).withColumn("_override", F.lit(resolve) & F.col("_closed") & F.col("_any"))
    t = ["country", "weather_year", "week"]
    over = other_total.join(per.where("_override"), "country").select(*t, F.lit("nc_total_closed_loop_override").alias("source"), "inflow", F.col("_open").alias("eligible"))
    rest = per.where("not _override")
    own = series.where(~redirected).join(state.where("_ok").select("country", F.col("plant_type").alias("to_type"), F.col("technology").alias("to_technology")), ["country", "to_type", "to_technology"])
    own = own.groupBy(*t).agg(F.coalesce(F.sum("inflow"), F.lit(0.0)).alias("inflow")).join(rest.where("_any"), "country").select(*t, F.lit("tyndp_resolved_open_loop").alias("source"), "inflow", F.col("_valid").alias("eligible"))
    sent = series.where(redirected & (F.col("technology") == "open_loop")).groupBy(*t).agg(F.sum("inflow").alias("inflow")).where(F.abs("inflow") > EPS)
    sent = sent.join(rest.where(F.size("_natural") > 0), "country").select(*t, F.lit("tyndp_phs_open_redirect_to_natural_hydro").alias("source"), "inflow", F.col("_natural").alias("eligible"))
    gaps = rest.where(F.size("_missing") > 0).select("country", "_missing", F.size("_missing").alias("_n"), F.explode("_missing").alias("_c")).withColumn("plant_type", F.substring_index("_c", ":", 1))
    typed = gaps.join(other_by_type.withColumnRenamed("inflow", "_by_type"), ["country", "plant_type"]).select(*t, F.when(F.col("_n") == 1, "nc_tech_missing_combo").otherwise("nc_tech_missing_combos").alias("source"), F.col("_by_type").alias("inflow"), F.array("_c").alias("eligible"))
    single = gaps.where("_n = 1").join(other_total, "country").join(other_by_type.select("country", "plant_type", "weather_year", "week"), ["country", "plant_type", "weather_year", "week"], "left_anti")
    single = single.select(*t, F.lit("nc_total_missing_combo").alias("source"), "inflow", F.array("_c").alias("eligible"))
    return over.unionByName(own).unionByName(sent).unionByName(typed).unionByName(single)


def inflow_rows(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Budgets for each node and technology by its part of the eligible open turbines: the node's share and the technology's within it."""
    t = targets.where((F.col("technology") != "closed_loop") & (F.col("target_turb_mw") > EPS)).select(*KEY, "bus", F.col("target_turb_mw").alias("v"))
    sets = groups.select("country", "eligible").distinct()
    # Shares depend on the set of technologies only: they are worked out once per set, not per week.
    each = sets.withColumn("_c", F.explode("eligible")).withColumns({"plant_type": F.substring_index("_c", ":", 1), "technology": F.substring_index("_c", ":", -1)}).join(t, KEY)
    total = each.groupBy("country", "eligible").agg(F.sum("v").alias("_all"))
    bus = each.groupBy("country", "eligible", "bus").agg(F.sum("v").alias("_bus"))
    shares = each.join(bus, ["country", "eligible", "bus"]).join(total, ["country", "eligible"])
    shares = shares.select("country", "eligible", "bus", "plant_type", "technology", (F.col("_bus") / F.col("_all")).alias("bus_share"), (F.col("v") / F.col("_bus")).alias("tech_share"))
    out = groups.join(shares, ["country", "eligible"])
    return out.select("country", "weather_year", "week", "source", "bus", "plant_type", "technology", F.col("inflow").alias("national_inflow_mwh_week"), "bus_share", "tech_share", (F.col("inflow") * F.col("bus_share") * F.col("tech_share")).alias("allocated_inflow_mwh_week"))


def check_budget(groups: DataFrame, rows: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Rows as they are; the job fails where a country, year, week and source has another sum than its budget (if any node can take it)."""
    k = ["country", "weather_year", "week", "source"]
    got = rows.groupBy(*k).agg(F.sum("allocated_inflow_mwh_week").alias("_got"))
    want = groups.groupBy(*k).agg(F.sum("inflow").alias("_want"))
    bad = got.join(want, k).where(F.abs(F.col("_got") - F.col("_want")) > tolerance * F.greatest(F.lit(1.0), F.abs("_want")))
    told = F.raise_error(F.concat(F.lit("inflow budget broken: "), F.to_json(F.struct(*k, "_got", "_want"))))
    return rows.join(bad.select(*k, told.cast("boolean").alias("_bad")), k, "left").where(F.col("_bad").isNull()).drop("_bad")


def by_physical_key(rows: DataFrame, keys: list[str], additive: list[str], ratios: dict[str, tuple[str, str]], levels: list[str], storage: str, labels: list[str]) -> DataFrame:
    """Rows of one physical key summed: ratios worked out again, levels weighted by storage, labels joined."""
    aggs = [F.coalesce(F.sum(positive(F.col(c))), F.lit(0.0)).alias(c) for c in additive]
    aggs += [safe_div(F.sum(F.col(c) * F.col(storage)), F.sum(F.when(F.col(c).isNotNull(), F.col(storage)))).alias(c) for c in levels]
    aggs += [F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c) for c in labels]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.withColumns({c: F.when((F.col(a) == 0) & (F.col(b) == 0), 0.0).otherwise(F.try_divide(F.col(a), F.col(b))) for c, (a, b) in ratios.items()})
