"""Joins by distance, guards, reconciliations, and tables of decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import EARTH_KM, haversine_km, safe_div
from ..session import materialise

#: Degrees of latitude of the first search grid; each further one is four times as wide, the last holds the whole group.
CELL_DEG, ROUNDS = 0.5, 4
#: Parts the nodes are dealt to in the last round.
LAST_PARTS = 32


def nearest(points: DataFrame, nodes: DataFrame, group: str | None = None, cell: float = CELL_DEG, rounds: int = ROUNDS, radius: float = EARTH_KM) -> DataFrame:
    """(point, node, km): the nearest node of each point (within its group), ties to the smaller node id.

    ``points`` has point, lat, lon, ``nodes`` node, lat, lon, both the group if given. Cells of a grid and their neighbours are joined;
    a point is settled once its best node is nearer than anything outside those cells can be. The few points left go on to a grid
    four times as wide, the last of which is everything in the group. Points without coordinates or nodes in their group have a null
    node; equal points count once.
    """
    g = [group] if group else []
    p = points.select("point", *g, F.col("lat").alias("_plat"), F.col("lon").alias("_plon")).distinct()
    n = nodes.where("lat is not null and lon is not null and node is not null").select("node", *g, F.col("lat").alias("_nlat"), F.col("lon").alias("_nlon")).distinct()
    open_ = p.where(F.col("_plat").isNotNull() & F.col("_plon").isNotNull())
    done: list[DataFrame] = []
    for i in range(rounds + 1):
        size = cell * 4**i
        last = i == rounds
        if last:
            # The nodes are dealt to parts, and each point left looks into every part: no task meets all nodes of a group.
            left, right, keys = open_.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LAST_PARTS - 1)))), n.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(LAST_PARTS)).cast("int")), [*g, "_part"]
        else:
            row, col = lambda c: F.floor((c + 90) / size), lambda c: F.floor((c + 180) / size)
            right = n.withColumn("_r", row(F.col("_nlat"))).withColumn("_c", col(F.col("_nlon")))
            near = lambda c: F.sequence(c - 1, c + 1)
            left = open_.withColumn("_r", F.explode(near(row(F.col("_plat"))))).withColumn("_c", F.explode(near(col(F.col("_plon")))))
            keys = [*g, "_r", "_c"]
        km = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_nlat"), F.col("_nlon"), radius)
        met = left.join(right, keys).groupBy("point", *g, "_plat", "_plon").agg(F.min(F.struct(km.alias("km"), F.col("node"))).alias("_b"))
        if last:
            done.append(met)
            break
        # Outside the nine cells everything is at least one cell away: in latitude, or in longitude at the row's far edge. Near the
        # date line and the poles the wide grids decide.
        far_lat = F.least(F.lit(89.9), F.abs("_plat") + 2 * size)
        reach = F.lit(radius) * F.asin(F.sin(F.radians(F.lit(float(min(size, 89.0))))) * F.cos(F.radians(far_lat)))
        inside = (F.abs("_plon") + 2 * size < 180) & (F.abs("_plat") + 2 * size < 90)
        sure = inside & (F.col("_b.km") <= F.least(reach, F.lit(radius * math.radians(size))))
        # One write a round: points with their best so far, settled or not. Lineage stays one round long.
        state = open_.join(met.select("point", "_b"), "point", "left").withColumn("_sure", F.coalesce(sure, F.lit(False)))
        state = materialise(state, "nearest")
        done.append(state.where("_sure").drop("_sure"))
        open_ = state.where("not _sure").drop("_b", "_sure")
        if not open_.limit(1).count():
            break
    found = None
    for part in done:
        part = part.select("point", F.col("_b.node").alias("node"), F.col("_b.km").alias("km"))
        found = part if found is None else found.unionByName(part)
    return p.select("point", *g).distinct().join(found, "point", "left")


def nearest_in_group_else_any(points: DataFrame, nodes: DataFrame, group: str, radius: float = EARTH_KM) -> DataFrame:
    """(point, node, km, in_group): the nearest node of the point's own group; for points whose group has none, the nearest of all."""
    own = materialise(nearest(points, nodes, group, radius=radius), "nearest-own")
    found = own.where("node is not null").select("point", "node", "km", F.lit(True).alias("in_group"))
    rest = points.join(found.select("point"), "point", "left_anti")
    any_ = nearest(rest, nodes, None, radius=radius).select("point", "node", "km", F.lit(False).alias("in_group"))
    return found.unionByName(any_)


def snap_quality(km: Column, good: float = 10.0, review: float = 20.0) -> Column:
    """good, review, poor or missing by the (larger) distance to the node."""
    return F.when(km.isNull(), "missing").when(km <= good, "good").when(km <= review, "review").otherwise("poor")


def last_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """A table of decisions in which the last matching rule wins; null conditions don't match."""
    return F.coalesce(*[F.when(condition, F.lit(action)) for condition, action in reversed(rules)], F.lit(default))


# What is proposed for a planned line by the match it has (none, the same voltage, another voltage), whether that
# corridor is in the snapshot, and whether the project is an upgrade.
LINE_ACTIONS = {
    "none|new": "candidate_add_new_line",
    "none|upgraded": "candidate_add_or_reroute_upgraded_line",
    "same in snapshot|new": "likely_already_in_base",
    "same in snapshot|upgraded": "likely_already_in_base",
    "same|new": "review_existing_corridor_or_parallel_line",
    "same|upgraded": "candidate_update_existing_line",
    "other voltage|new": "review_existing_corridor_voltage_mismatch",
    "other voltage|upgraded": "review_voltage_upgrade_existing_corridor",
}
# What is proposed for a planned link that is matched, and for one that isn't by how near its ends are to DC and AC nodes
# and where its voltage was taken from.
LINK_ACTIONS = {
    "matched in snapshot|new": "likely_already_in_base",
    "matched in snapshot|upgraded": "likely_already_in_base",
    "matched|new": "review_existing_link_corridor",
    "matched|upgraded": "candidate_update_existing_link",
    "dc|existing_pair": "candidate_add_link_reusing_dc_terminals",
    "dc|country_pair_mode": "candidate_add_link_reusing_nearby_dc_terminals",
    "dc|global_mode": "manual_review_voltage_assumption",
    "ac|country_pair_mode": "review_add_link_with_new_dc_terminals",
    "ac|global_mode": "manual_review_voltage_and_terminal_topology",
    "far": "manual_review_snap_far",
}
# The short recommendation and its note for each action; any other is inspected.
RECOMMENDATIONS = {
    "skip_after_target_year": ("ignore", "ignore: build_year > target_year"),
    "likely_already_in_base": ("ignore", "ignore: likely already represented in base grid"),
    "manual_review_snap_far": ("ignore", "ignore: endpoint snap too far from plausible bus"),
    "manual_review_voltage_and_terminal_topology": ("ignore", "ignore: link voltage and terminal topology too uncertain"),
    "manual_review_voltage_assumption": ("ignore", "ignore: link voltage inference too weak"),
    "manual_review_no_voltage_inference": ("ignore", "ignore: no reliable link voltage inference"),
    "candidate_add_new_line": ("include_new_line", "add as new AC line"),
    "candidate_add_link_reusing_dc_terminals": ("include_new_link_reuse_dc", "add HVDC link and reuse matched DC terminals"),
    "candidate_add_link_reusing_nearby_dc_terminals": ("include_new_link_reuse_dc", "add HVDC link and reuse nearby DC terminals"),
    "review_add_link_with_new_dc_terminals": ("include_new_link_to_nearest_ac", "add HVDC link and attach directly to nearest AC buses"),
    "candidate_add_or_reroute_upgraded_line": ("include_as_upgrade", "treat as upgrade"),
    "review_voltage_upgrade_existing_corridor": ("include_as_upgrade", "treat as voltage upgrade on existing corridor"),
    "review_existing_corridor_voltage_mismatch": ("include_as_upgrade", "treat as upgrade / corridor adaptation"),
    "candidate_update_existing_line": ("include_as_upgrade", "treat as upgrade of existing AC line"),
    "candidate_update_existing_link": ("include_as_upgrade", "treat as upgrade of existing HVDC link"),
    "review_existing_link_corridor": ("include_as_upgrade", "treat as upgrade of existing HVDC corridor"),
    "review_existing_corridor_or_parallel_line": ("include_as_upgrade", "treat as upgrade / existing corridor adaptation"),
    "manual_review_no_line_template": ("inspect", "inspect manually: no matching AC line parameter template"),
}
OTHER_RECOMMENDATION = ("inspect", "inspect manually")


def _looked_up(situation: Column, table: dict[str, str]) -> Column:
    """The entry of a fixed table, null for a situation that isn't in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), situation)


def line_actions(in_target: Column, in_snapshot: Column, snap: Column, has_match: Column, relaxed: Column, upgraded: Column, template: Column) -> Column:
    """What to do with a planned line.

    Its situation (match and kind of project) is looked up in ``LINE_ACTIONS``, after what keeps it from being judged: it comes after the
    target year, an end is too far from any node, or it lies well but nothing is known of such lines. An unknown fact is
    ``manual_review``.
    """
    match = F.when(~has_match, "none").when(has_match & relaxed & in_snapshot, "same in snapshot").when(has_match & relaxed & ~in_snapshot, "same").when(has_match & ~relaxed, "other voltage")
    proposed = _looked_up(F.concat(match, F.when(upgraded, "|upgraded").when(~upgraded, "|new")), LINE_ACTIONS)
    judged = F.when(~F.coalesce(snap.isin("good", "review"), F.lit(False)), "manual_review_snap_far").when((snap == "good") & ~template, "manual_review_no_line_template").otherwise(proposed)
    return F.coalesce(F.when(in_target, judged).when(~in_target, "skip_after_target_year"), F.lit("manual_review"))


def link_actions(in_target: Column, in_snapshot: Column, snap_dc: Column, snap_ac: Column, has_match: Column, upgraded: Column, voltage_source: Column, voltage: Column) -> Column:
    """What to do with a planned link: as for lines, by its match or else by the nodes its ends are near and by where its voltage is from.

    Without any voltage nothing is proposed; an end that is near neither kind of node is too far, whatever the voltage rests on.
    """
    dc, ac = F.coalesce(snap_dc.isin("good", "review"), F.lit(False)), F.coalesce(snap_ac.isin("good", "review"), F.lit(False))
    kind = F.when(upgraded, "|upgraded").otherwise("|new")
    known = voltage_source.isin("existing_pair", "country_pair_mode", "global_mode")
    free = F.when(~ac, F.lit("far")).when(dc, F.concat(F.lit("dc|"), voltage_source)).otherwise(F.concat(F.lit("ac|"), voltage_source))
    situation = F.when(has_match, F.concat(F.when(in_snapshot, "matched in snapshot").otherwise("matched"), kind)).otherwise(free)
    blind = voltage.isNull() | (~has_match & F.coalesce(snap_dc == "good", F.lit(False)) & ~F.coalesce(known, F.lit(False)))
    judged = F.when(blind, "manual_review_no_voltage_inference").otherwise(_looked_up(situation, LINK_ACTIONS))
    return F.coalesce(F.when(in_target, judged).when(~in_target, "skip_after_target_year"), F.lit("manual_review"))


def recommendation(action: Column) -> tuple[Column, Column]:
    """(recommendation, note) of an action."""
    short, note = ({a: r[i] for a, r in RECOMMENDATIONS.items()} for i in (0, 1))
    return F.coalesce(_looked_up(action, short), F.lit(OTHER_RECOMMENDATION[0])), F.coalesce(_looked_up(action, note), F.lit(OTHER_RECOMMENDATION[1]))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: both values (0 where a side is missing), their difference, and which sides there were."""
    l, r = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = l.join(r, keys, "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    both = both.withColumn("sides", side).fillna(0.0, ["left_value", "right_value"])
    return both.withColumn("difference", F.col("right_value") - F.col("left_value")).drop("_l", "_r")


def corridor_agreement(raw: DataFrame, reduced: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: corridors in both, precision, recall, Jaccard, and the errors of the values over all corridors."""
    c = reconcile(raw, reduced, keys, value)
    n = lambda side: F.count(F.when(F.col("sides") == side, 1))
    both, only_raw, only_red = n("both"), n("left_only"), n("right_only")
    t, err = F.abs("left_value"), F.abs("difference")
    return c.agg(
        both.alias("n_common"), only_raw.alias("n_missing"), only_red.alias("n_extra"),
        safe_div(both.cast("double"), (both + only_red).cast("double"), 0.0).alias("precision"), safe_div(both.cast("double"), (both + only_raw).cast("double"), 0.0).alias("recall"),
        safe_div(both.cast("double"), (both + only_raw + only_red).cast("double"), 0.0).alias("jaccard"), safe_div(F.sum(err * t), F.sum(t * t)).alias("wape"), safe_div(F.sum(err), F.sum(t)).alias("wape_plain"),
    )


def only_if_present(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows of the wanted scenario if it occurs at all (up to case and blanks), else every row. One look for a single match."""
    same = F.lower(F.trim(F.col(column))) == wanted.strip().lower()
    return df.where(same) if df.where(same).limit(1).count() else df


def keep_members(df: DataFrame, members: DataFrame, keys: list[str], label: str = "kept") -> DataFrame:
    """All rows with a flag whether their key is among the members; the members may repeat keys."""
    known = members.select(*keys).distinct().withColumn(label, F.lit(True))
    return df.join(known, keys, "left").fillna(False, [label])


def drop_touching(edges: DataFrame, removed: DataFrame, a: str = "bus0", b: str = "bus1", ident: str = "bus_id") -> DataFrame:
    """Edges none of whose ends is among the removed nodes."""
    gone = removed.select(ident).distinct()
    return edges.join(gone.withColumnRenamed(ident, a), a, "left_anti").join(gone.withColumnRenamed(ident, b), b, "left_anti")


def inside(edges: DataFrame, nodes: DataFrame, a: str = "bus0", b: str = "bus1", ident: str = "bus_id") -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    here = nodes.select(ident).distinct()
    return edges.join(here.withColumnRenamed(ident, a), a, "left_semi").join(here.withColumnRenamed(ident, b), b, "left_semi")


def replicate_profile(profile: DataFrame, shares: DataFrame, group: str) -> DataFrame:
    """A profile of each group for every node of the group, not scaled: availability is the same at all of them."""
    return profile.join(shares.where("share > 0"), group)


def split_by_share(df: DataFrame, shares: DataFrame, group: str, amounts: list[str]) -> DataFrame:
    """Amounts of each group times the shares of its nodes."""
    out = df.join(shares.where("share > 0"), group)
    return out.withColumns({a: F.col(a) * F.col("share") for a in amounts})
