"""Shares of a total, and the cascades that choose between several bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import EARTH_KM, equirectangular_km, positive
from ..session import materialise


def _with_totals(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Adds ``_total_<value>`` of each value and ``_n`` per group: one aggregate, joined once. A null group is a group."""
    totals = df.groupBy(*group).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_total_{v}") for v in values], F.count(F.lit(1)).alias("_n"))
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(f"_l.{g}").eqNullSafe(F.col(f"_t.{g}"))
    return df.alias("_l").join(totals.alias("_t"), cond).select("_l.*", *[f"_total_{v}" for v in values], "_n")


def _share(value: str, uniform: bool) -> Column:
    return F.when(F.col(f"_total_{value}") > 0, F.coalesce(F.col(value), F.lit(0.0)) / F.col(f"_total_{value}")).otherwise(1.0 / F.col("_n") if uniform else F.lit(0.0))


def partition_share(df: DataFrame, group: list[str], value: str, out: str = "share", uniform: bool = False) -> DataFrame:
    """Adds ``out``: value over the group's total; where the total is not positive 0, or an equal part with ``uniform``.

    Totals are aggregated before they are joined back, so a group of any size is summed in parts. Null and negative values count as
    they are (use ``positive`` before where that is wanted); a null group is a group.
    """
    return _with_totals(df, group, [value]).withColumn(out, _share(value, uniform)).drop(f"_total_{value}", "_n")


def blended_share(df: DataFrame, group: list[str], weights: dict[str, float], out: str = "share") -> DataFrame:
    """Adds ``<column>_share`` of each weighted column (equal parts where its total is not positive) and their weighted sum ``out``."""
    df = _with_totals(df, group, list(weights)).withColumns({f"{c}_share": _share(c, True) for c in weights})
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.col(f"{c}_share")
    return df.withColumn(out, total).drop(*[f"_total_{c}" for c in weights], "_n")


def distance_weights(regions: DataFrame, nodes: DataFrame, group: str, alpha: float = 1.0, together_km: float = 1e-6, radius: float = EARTH_KM) -> DataFrame:
    """(group, region, node, km, weight): each region spread over the nodes of its group by inverse distance.

    Where the nearest node is at the same place, the nodes there share equally and the others get nothing (no row). ``regions`` has
    group, region, lat, lon; ``nodes`` group, node, lat, lon. The result has every region with every node of its group, as the
    weights are defined; totals are aggregated per region before they are joined back.
    """
    n = nodes.select(group, "node", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    pairs = regions.select(group, "region", "lat", "lon").join(n, group)
    pairs = pairs.withColumn("km", equirectangular_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), radius)).drop("lat", "lon", "_lat", "_lon").where("km is not null")
    pairs = materialise(pairs.select(group, "region", "node", "km"), "pairs")  # read for the totals and for the weights
    near = pairs.groupBy(group, "region").agg(F.min("km").alias("_least"), F.sum(F.when(F.col("km") > together_km, F.pow(F.col("km"), F.lit(-alpha)))).alias("_sum"), F.count(F.when(F.col("km") <= together_km, 1)).alias("_same"))
    same = F.col("_least") <= together_km
    weight = F.when(same & (F.col("km") <= together_km), 1.0 / F.col("_same")).when(~same, F.pow(F.col("km"), F.lit(-alpha)) / F.col("_sum"))
    return pairs.join(near, [group, "region"]).withColumn("weight", weight).where("weight is not null").select(group, "region", "node", "km", "weight")


def with_fallback_regions(regions: DataFrame, nodes: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Regions plus, for each group of nodes without any, one region at the mean position of its nodes with value 1."""
    missing = nodes.join(regions.select(group).distinct(), group, "left_anti").groupBy(group).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    made = missing.select(group, F.concat(F.lit("fallback_"), F.col(group).cast("string")).alias("region"), "lat", "lon", *[F.lit(1.0).alias(v) for v in values])
    return regions.select(group, F.col("region").cast("string").alias("region"), "lat", "lon", *values).unionByName(made)


def proxy_shares(regions: DataFrame, nodes: DataFrame, group: str, weights: dict[str, float], alpha: float = 1.0) -> DataFrame:
    """(group, cluster, <column>_share, share): node clusters' shares of their group by what the regions around them hold.

    Each column of the regions (population, product) is shared within the group, spread over nodes by distance, summed by cluster,
    normalised; the columns are blended by ``weights`` and normalised again. ``nodes`` has group, node, cluster, lat, lon.
    """
    regions = materialise(with_fallback_regions(regions, nodes, group, list(weights)), "regions")
    based = blended_share(regions, [group], weights, "_blend")
    spread = distance_weights(regions, nodes, group, alpha).join(based.select(group, "region", *[f"{c}_share" for c in weights]), [group, "region"]).join(nodes.select(group, "node", "cluster"), [group, "node"])
    summed = spread.groupBy(group, "cluster").agg(*[F.sum(F.col(f"{c}_share") * F.col("weight")).alias(c) for c in weights])
    summed = materialise(summed, "summed")
    return partition_share(blended_share(summed, [group], weights, "_blend"), [group], "_blend", "share").select(group, "cluster", *[f"{c}_share" for c in weights], "share")


def fallback_cascade(candidates: DataFrame, targets: DataFrame, group: str, bases: list[str], target: str = "target") -> DataFrame:
    """Target of each group over its candidates by the first basis with a positive sum, else equally; with the rule used.

    ``candidates`` has the group, an id and the basis columns, ``targets`` the group and the target. Negative and null bases count 0.
    A group without candidates gives no row (see ``unallocated``).
    """
    sums = candidates.groupBy(group).agg(*[F.sum(positive(F.col(b))).alias(f"_sum_{b}") for b in bases], F.count(F.lit(1)).alias("_n"))
    rule: Column = F.lit("uniform")
    share: Column = 1.0 / F.col("_n")
    for b in reversed(bases):
        has = F.col(f"_sum_{b}") > 0
        rule = F.when(has, b).otherwise(rule)
        share = F.when(has, positive(F.col(b)) / F.col(f"_sum_{b}")).otherwise(share)
    joined = candidates.join(sums, group).join(targets.select(group, target), group)
    return joined.withColumns({"rule": rule, "share": share}).withColumn("allocated", F.col("share") * F.col(target)).drop("_n", *[f"_sum_{b}" for b in bases])


def unallocated(targets: DataFrame, allocation: DataFrame, group: str, target: str = "target", amount: str = "allocated") -> DataFrame:
    """What each target is, how much of it was allocated, what is left."""
    got = allocation.groupBy(group).agg(F.sum(amount).alias("allocated"), F.count(F.lit(1)).alias("n_rows"))
    return targets.select(group, target).join(got, group, "left").fillna(0, ["allocated", "n_rows"]).withColumn("left_over", F.col(target) - F.col("allocated"))


def ranked_nodes(nodes: DataFrame, group: str, order: list[tuple[str, bool]], ident: str, out: str = "rank") -> DataFrame:
    """Nodes of each group ranked by columns (name, falling), then id. Groups are nodes of a country: a window is enough."""
    keys = [F.col(c).desc() if falling else F.col(c).asc() for c, falling in order]
    return nodes.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*keys, F.col(ident))))


def top_site(sites: DataFrame, group: str, ident: str, chain: list[str]) -> DataFrame:
    """(group, id, rule): the site with the largest value of the first column of the chain that has a positive one; ties to the largest id."""
    best = sites.groupBy(group).agg(*[F.max(F.struct(positive(F.col(c)).alias("v"), F.col(ident).alias("i"))).alias(f"_{c}") for c in chain])
    site, rule = F.lit(None), F.lit(None)
    for c in reversed(chain):
        has = F.col(f"_{c}.v") > 0
        site, rule = F.when(has, F.col(f"_{c}.i")).otherwise(site), F.when(has, c).otherwise(rule)
    return best.select(group, site.alias(ident), rule.alias("rule"))
