"""Allocation of targets to sites: proportional under caps, whole units, ordered fills, water-filling.

All conserve: what is allocated and what is left over add up to the target.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import PRIORITY, clamp, positive
from .ranking import prefix_sum, rank_in_group


def capped_proportional(basis: DataFrame, targets: DataFrame, group: str, value: str = "capacity", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Basis scaled down to the target where it is larger, else the basis itself; and (group, target, allocated, remainder).

    Rows without a positive basis get nothing and no row. Negative targets count 0.
    """
    rows = basis.where(F.col(value) > 0)
    sums = rows.groupBy(group).agg(F.sum(value).alias("_sum"))
    goals = targets.select(group, positive(F.col(target)).alias(target)).join(sums, group, "left").withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
    given = F.least(F.col("_sum"), F.col(target))
    report = goals.select(group, target, given.alias("allocated"), (F.col(target) - given).alias("remainder"))
    spread = rows.join(goals, group).where(F.col(target) > 0).withColumn("allocated", F.when(F.col("_sum") >= F.col(target), F.col(value) / F.col("_sum") * F.col(target)).otherwise(F.col(value))).drop("_sum")
    return spread, report


def largest_remainder(weights: DataFrame, units: DataFrame, group: str, ident: str, weight: str = "weight", n: str = "n_units") -> DataFrame:
    """(group, id, assigned): whole units by weight (weights of a group sum to 1), exact in total; rows that get none are dropped.

    Each gets the floor of its expectation; the units left go by fraction, then weight (both falling), then id. Candidates of a group
    are nodes of a country or the like, few enough for a window.
    """
    df = weights.join(units.select(group, n), group).withColumn("_expected", F.col(weight) * F.col(n)).withColumn("_floor", F.floor("_expected"))
    w = Window.partitionBy(group)
    order = w.orderBy((F.col("_expected") - F.col("_floor")).desc(), F.col(weight).desc(), F.col(ident))
    df = df.withColumn("_left", F.col(n) - F.sum("_floor").over(w)).withColumn("_place", F.row_number().over(order))
    return df.withColumn("assigned", (F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("long")).where("assigned > 0").select(group, ident, "assigned")


def integer_budget(groups: DataFrame, keys: list[str], total: int, size: str = "n", weight: str | None = None, least: int = 1, out: str = "k") -> DataFrame:
    """Adds ``out``: a total of whole units over groups, at least ``least`` for each with members and never more than its members.

    In four steps, each a column: the least; the floor of what the weights (sizes where they are not positive in sum) give of the
    rest; one more by falling fraction, the larger group first on ties; what is still left to the groups with most room, filled one
    after the other. A total below the sum of the minima gives the minima. There is one row a group, few enough for an ordered window.
    """
    whole, key = Window.partitionBy(), [F.col(c) for c in keys]
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    df = groups.withColumns({"_ib_n": n, "_ib_w": positive(F.col(weight)) if weight else n.cast("double")}).withColumn("_ib_w", F.when(F.sum("_ib_w").over(whole) > 0, F.col("_ib_w")).otherwise(F.col("_ib_n").cast("double")))
    df = df.withColumn("_ib_k", F.least(F.lit(int(least)).cast("long"), F.col("_ib_n")))
    left = lambda: F.greatest(F.lit(int(total)) - F.sum("_ib_k").over(whole), F.lit(0))
    room = lambda: F.col("_ib_n") - F.col("_ib_k")
    df = df.withColumn("_ib_ideal", F.coalesce(F.try_divide(F.col("_ib_w"), F.sum("_ib_w").over(whole)), F.lit(0.0)) * left())
    df = df.withColumn("_ib_k", F.col("_ib_k") + F.least(F.floor("_ib_ideal"), room())).withColumn("_ib_left", left())
    by_fraction = whole.orderBy((room() > 0).desc(), (F.col("_ib_ideal") - F.floor("_ib_ideal")).desc(), F.col("_ib_n").desc(), *key)
    df = df.withColumn("_ib_k", F.col("_ib_k") + F.when((room() > 0) & (F.row_number().over(by_fraction) <= F.col("_ib_left")), 1).otherwise(0)).withColumn("_ib_left", left())
    before = F.coalesce(F.sum(room()).over(whole.orderBy(room().desc(), *key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_ib_more", F.greatest(F.lit(0), F.least(room(), F.col("_ib_left") - before)))
    return df.withColumn(out, (F.col("_ib_k") + F.col("_ib_more")).cast("int")).drop("_ib_n", "_ib_w", "_ib_k", "_ib_ideal", "_ib_left", "_ib_more")


def apportion(size: np.ndarray, total: int, least: int = 1) -> np.ndarray:
    """``integer_budget`` by size for the components of one group, inside a kernel: the same four steps on arrays."""
    size = np.asarray(size, dtype=np.int64)
    base = np.minimum(size, least)
    ideal = max(total - base.sum(), 0) * size / max(size.sum(), 1)
    got = base + np.minimum(ideal.astype(np.int64), size - base)
    order = np.lexsort((np.arange(len(size)), -size, -(ideal % 1), got >= size))
    more = np.zeros_like(got)
    more[order[: max(total - got.sum(), 0)]] = 1
    got = np.minimum(got + more, size)
    order = np.lexsort((np.arange(len(size)), got - size))
    reach = np.minimum(np.cumsum((size - got)[order]), max(total - got.sum(), 0))
    got[order] += np.diff(reach, prepend=0)
    return got


def water_fill(cells: DataFrame, deltas: DataFrame, group: str, ident: str, headroom: str = "headroom", klass: str = "class", delta: str = "delta") -> tuple[DataFrame, DataFrame]:
    """New capacity by class, best (highest) first: equal increments within a class up to each cell's headroom.

    Closed form: with headrooms in rising order, the level of a class is where filling every smaller headroom and levelling the rest
    spends what the better classes left. Cells with a null or negative class or no headroom get 0. Returns (group, id, addition) for
    all cells and (group, delta, allocated, remainder).
    """
    room = positive(F.col(headroom))
    base = cells.withColumn("_room", room).withColumn("_k", F.floor(klass).cast("int"))
    can = base.where((F.col("_k") >= 0) & (F.col("_room") > 0))
    per_class = can.groupBy(group, "_k").agg(F.sum("_room").alias("_class_room"), F.count(F.lit(1)).alias("_n"))
    better = Window.partitionBy(group).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    goals = deltas.select(group, positive(F.col(delta)).alias(delta))
    classes = per_class.withColumn("_better", F.coalesce(F.sum("_class_room").over(better), F.lit(0.0))).join(goals, group)
    classes = classes.withColumn("_budget", F.least(F.col("_class_room"), F.greatest(F.lit(0.0), F.col(delta) - F.col("_better"))))
    # Within a class, in rising headroom: after the i smallest are filled, the level the rest could reach.
    inside = prefix_sum(can.withColumn("_coarse", F.floor("_room")), [group, "_k"], "_coarse", [F.col("_room"), F.col(ident)], "_room", "_below")
    inside = rank_in_group(inside, [group, "_k"], "_coarse", [F.col("_room"), F.col(ident)], "_i").join(classes, [group, "_k"])
    level = (F.col("_budget") - F.col("_below")) / (F.col("_n") - F.col("_i") + 1)
    # The level is the greatest such bound over cells that it doesn't drown.
    levels = inside.withColumn("_level", level).groupBy(group, "_k").agg(F.max("_level").alias("_level"))
    filled = can.join(levels, [group, "_k"]).select(group, ident, F.least(F.col("_room"), F.greatest(F.lit(0.0), F.col("_level"))).alias("addition"))
    all_cells = cells.select(group, ident).join(filled, [group, ident], "left").fillna(0.0, ["addition"])
    spent = classes.groupBy(group).agg(F.sum("_budget").alias("allocated"))
    report = goals.join(spent, group, "left").fillna(0.0, ["allocated"]).withColumn("remainder", F.col(delta) - F.col("allocated"))
    return all_cells, report


def priority_fill(sites: DataFrame, targets: DataFrame, group: str, ident: str, newest: str, capacity: str = "capacity", target: str = "target") -> DataFrame:
    """Sites filled one after the other up to the target: newest first, then larger, then id; adds ``filled`` (sites that get none drop out)."""
    order = [F.col(newest).desc(), F.col(capacity).desc(), F.col(ident)]
    cum = prefix_sum(sites.where(F.col(capacity) > 0), [group], newest, order, capacity, "_before", descending=True)
    got = F.least(F.col(capacity), F.col(target) - F.col("_before"))
    return cum.join(targets.select(group, target), group).withColumn("filled", got).where("filled > 1e-9").drop("_before")


def clamp_and_flag(value: Column, capacity: Column) -> tuple[Column, Column]:
    """(value between 0 and the capacity, or the capacity where it is missing; whether it was imputed: missing, yes, no)."""
    bounded = clamp(value, 0.0, capacity)
    return F.coalesce(bounded, capacity), F.when(value.isNull(), "missing").when(bounded != value, "yes").otherwise("no")


def scale_to_total(raw: DataFrame, totals: DataFrame, keys: list[str], value: str = "raw", capacity: str | None = None, total: str = "total") -> DataFrame:
    """Profiles scaled to national totals: adds factor, scaled and mode.

    Modes: ``zero_national`` (total 0), ``scaled``, ``profile_zero`` (a profile of zeros: nothing), ``capacity_fallback`` (no profile:
    by capacity), ``no_profile_no_capacity``. ``raw`` null means that there is no profile.
    """
    cap = F.col(capacity) if capacity else F.lit(0.0)
    sums = raw.groupBy(*keys).agg(F.sum(value).alias("_raw"), F.count(value).alias("_known"), F.sum(positive(cap)).alias("_cap"))
    df = raw.join(sums, keys).join(totals.select(*keys, total), keys)
    mode = (
        F.when(F.coalesce(F.col(total), F.lit(0.0)) <= 0, "zero_national")
        .when(F.col("_raw") > 0, "scaled")
        .when(F.col("_known") > 0, "profile_zero")
        .when(F.col("_cap") > 0, "capacity_fallback")
        .otherwise("no_profile_no_capacity")
    )
    df = df.withColumn("mode", mode).withColumn("factor", F.when(F.col("mode") == "scaled", F.col(total) / F.col("_raw")))
    scaled = F.when(F.col("mode") == "scaled", F.coalesce(F.col(value), F.lit(0.0)) * F.col("factor")).when(F.col("mode") == "capacity_fallback", positive(cap) / F.col("_cap") * F.col(total)).otherwise(0.0)
    return df.withColumn("scaled", scaled).drop("_raw", "_known", "_cap")


def round_robin(units: DataFrame, nodes: DataFrame, group: str, unit: str, size: str, node: str, share: str, ascending: bool = True, coarse: Column | None = None) -> DataFrame:
    """(group, unit, node): units by falling size dealt over the group's nodes by rising (or falling) share, round and round."""
    order = F.col(share).asc() if ascending else F.col(share).desc()
    w = Window.partitionBy(group)
    ranked = nodes.select(group, node, (F.row_number().over(w.orderBy(order, F.col(node))) - 1).alias("_at"), F.count(F.lit(1)).over(w).alias("_n"))
    sizes = ranked.groupBy(group).agg(F.max("_n").alias("_n"))
    dealt = units.where(F.col(size) > 0).withColumn("_coarse", F.floor(size) if coarse is None else coarse)
    dealt = rank_in_group(dealt, [group], "_coarse", [F.col(size).desc(), F.col(unit)], "_i", descending=True).join(sizes, group)
    return dealt.withColumn("_at", F.pmod(F.col("_i") - 1, F.col("_n")).cast("int")).join(ranked.drop("_n"), [group, "_at"]).select(group, unit, size, node)


def round_robin_with_offset(demands: DataFrame, nodes: DataFrame, group: str, demand: str, n: str, node: str, rank: str) -> DataFrame:
    """(group, demand, node, assigned): demands of whole units in order take ranked nodes in turn; each goes on where the last stopped."""
    w = Window.partitionBy(group).orderBy(demand).rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.select(group, node, (F.col(rank) - 1).alias("_at"))
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_k"))
    starts = demands.withColumn("_start", F.coalesce(F.sum(n).over(w), F.lit(0))).join(sizes, group)
    # How often a node is met by n steps from the start: full rounds and whether the rest reaches it.
    met = starts.join(ranked, group).withColumn("_off", F.pmod(F.col("_at") - F.col("_start"), F.col("_k")))
    count = F.floor(F.col(n) / F.col("_k")) + F.when(F.col("_off") < F.col(n) % F.col("_k"), 1).otherwise(0)
    return met.withColumn("assigned", count.cast("long")).where("assigned > 0").select(group, demand, node, "assigned")


# ---- stateful packing --------------------------------------------------------------------------------------------------------

_COAL = {"hard_coal", "lignite"}


def _pack_country(units: pd.DataFrame, sites: pd.DataFrame) -> pd.DataFrame:
    """Units of a country into its retired sites, fuel group by fuel group, with use of sites shared among them."""
    sites = sites.sort_values(["date_out", "capacity", "site"], ascending=[False, False, True])
    by_group = {g: list(s.itertuples(index=False)) for g, s in sites.groupby("fuel_group", sort=False)}
    used: dict = defaultdict(float)
    taken_by: dict = defaultdict(set)
    rows = []
    units = units[units["size"] > 0].sort_values(["fuel_group", "size", "unit"], ascending=[True, False, True])
    for u in units.itertuples(index=False):
        place, stage_no = None, 0
        for stage_no, groups in enumerate(PRIORITY.get(u.fuel_group, ((u.fuel_group,),)), start=1):
            pool = [s for g in groups for s in by_group.get(g, ())]
            if len(groups) > 1:
                pool.sort(key=lambda s: (-s.date_out, -s.capacity, s.site))
            for s in pool:
                coal_again = u.fuel_group in {"gas", "oil", "oil_shale"} and s.fuel_group in _COAL and taken_by[s.site] & _COAL
                if used[s.site, s.fuel_group] < s.capacity and not coal_again:
                    place = s
                    break
            if place is not None:
                break
        if place is None:
            rows.append((u.country, u.fuel_group, u.unit, float(u.size), None, None, None))
        else:
            used[place.site, place.fuel_group] += u.size
            taken_by[place.site].add(u.fuel_group)
            rows.append((u.country, u.fuel_group, u.unit, float(u.size), str(place.site), place.fuel_group, stage_no))
    return pd.DataFrame(rows, columns=["country", "fuel_group", "unit", "size", "site", "site_fuel_group", "stage"])


def unit_packing(units: DataFrame, sites: DataFrame) -> DataFrame:
    """(country, fuel_group, unit, size, site, site_fuel_group, stage): whole units, larger first, each into the first site with room.

    A site has room while what it took is below its capacity, so the last unit may overshoot once. Sites are tried by fuel stage, then
    newest, larger, id. A site that took a coal unit takes no gas or oil as a coal site. Units without a place have a null site.
    ``units`` has country, fuel_group, unit, size; ``sites`` country, site, fuel_group, capacity, date_out. Order matters and the state
    is shared, so a country is one group; its units and sites are national lists (thousands), not facts.
    """
    schema = "country string, fuel_group string, unit string, size double, site string, site_fuel_group string, stage int"
    u = units.select(F.col("country").cast("string").alias("country"), "fuel_group", F.col("unit").cast("string").alias("unit"), F.col("size").cast("double").alias("size"))
    s = sites.select(F.col("country").cast("string").alias("country"), F.col("site").cast("string").alias("site"), "fuel_group", F.col("capacity").cast("double").alias("capacity"), F.col("date_out").cast("double").alias("date_out"))
    return u.groupBy("country").cogroup(s.groupBy("country")).applyInPandas(_pack_country, schema)
