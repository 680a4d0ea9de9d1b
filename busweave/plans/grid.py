"""Network preparation and reduction as a composition of graph, aggregation and kernel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import EARTH_KM_IUGG, flag, haversine_km, loose_number, safe_div, voltage_class
from ..operators.aggregate import border_imputation, exact_median, medoid, parallel_branches
from ..operators.allocate import integer_budget
from ..operators.graph import collapse_dc, components, contract_leaves, keep_one_per_country, pointer_jump, relabel, unused_nodes
from ..operators.joining import drop_touching, inside, line_actions, nearest, snap_quality
from ..operators.kernels import cluster
from ..session import materialise
from .renewables import sync_area

MIN_KV = 380


def prepare_buses(raw: DataFrame) -> DataFrame:
    """Typed nodes with sync area; a node without id drops out, equal ids stay once."""
    n = lambda c: loose_number(F.col(c).cast("string"))
    df = raw.select(F.trim(F.col("bus_id").cast("string")).alias("bus_id"), F.upper(F.trim("country")).alias("country"), n("lat").alias("lat"), n("lon").alias("lon"), n("voltage").alias("voltage"), flag(F.col("dc_bool")).alias("dc_bool"))
    return df.where("bus_id is not null and bus_id <> ''").dropDuplicates(["bus_id"]).withColumn("sync_area", sync_area(F.col("country"), F.col("lon"), F.col("lat")))


def prepare_lines(raw: DataFrame) -> DataFrame:
    """Typed lines; circuits default to 1, ids are made of the ends where missing; lines without both ends drop out."""
    n = lambda c: loose_number(F.col(c).cast("string")) if c in raw.columns else F.lit(None).cast("double")
    a, b = F.col("bus0").cast("string"), F.col("bus1").cast("string")
    made = F.coalesce(F.col("line_id").cast("string") if "line_id" in raw.columns else F.lit(None), F.concat_ws("_", F.lit("line"), a, b))
    return raw.where("bus0 is not null and bus1 is not null").select(made.alias("line_id"), a.alias("a"), b.alias("b"), *[n(c).alias(c) for c in ("r", "x", "b_siemens", "s_nom", "length", "voltage")], F.coalesce(n("circuits"), F.lit(1.0)).alias("circuits"))


def exclude_countries(buses: DataFrame, excluded: DataFrame, *edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes of the excluded countries and every edge (a, b) that touches them taken out."""
    gone = buses.join(excluded.select("country").distinct(), "country", "left_semi").select("bus_id")
    return buses.join(gone, "bus_id", "left_anti"), [drop_touching(e, gone, "a", "b") for e in edges]


def per_unit(lines: DataFrame, base_mva: float = 100.0) -> DataFrame:
    """r and x of lines on the system base: Z = V^2 / S."""
    z = F.col("voltage") * F.col("voltage") / base_mva
    return lines.withColumns({"r": safe_div(F.col("r"), z), "x": safe_div(F.col("x"), z)})


def to_upper_level(buses: DataFrame, lines: DataFrame, transformers: DataFrame, min_kv: float = MIN_KV) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes below the level mapped through domestic transformers to the node at the level, chains followed to their end.

    Returns (nodes at the level with numbers of members, lines between them, mapping node -> target). A transformer maps its lower
    side to its higher one; of several the one with the largest rating, then the smaller id.
    """
    v = buses.select("bus_id", "voltage", "country")
    t = transformers.join(v.select(F.col("bus_id").alias("a"), F.col("voltage").alias("_va"), F.col("country").alias("_ca")), "a").join(v.select(F.col("bus_id").alias("b"), F.col("voltage").alias("_vb"), F.col("country").alias("_cb")), "b").where("_ca = _cb and _va <> _vb")
    up = t.select(F.when(F.col("_va") < F.col("_vb"), F.col("a")).otherwise(F.col("b")).alias("source"), F.when(F.col("_va") < F.col("_vb"), F.col("b")).otherwise(F.col("a")).alias("target"), F.least("_va", "_vb").alias("_low"), "s_nom").where(F.col("_low") < min_kv)
    one = up.groupBy("source").agg(F.min_by("target", F.struct(-F.coalesce("s_nom", F.lit(0.0)), F.col("target"))).alias("target"))
    mapping = pointer_jump(one)
    full = buses.select("bus_id").join(mapping.withColumnRenamed("source", "bus_id"), "bus_id", "left").select(F.col("bus_id").alias("node"), F.coalesce("target", "bus_id").alias("target"))
    full = materialise(full, "level")
    kept = buses.join(full.groupBy(F.col("target").alias("bus_id")).agg(F.count(F.lit(1)).alias("members")), "bus_id")
    return kept, relabel(lines, full), full


def sub_networks(buses: DataFrame, lines: DataFrame) -> DataFrame:
    """AC nodes with the component of their synchronous area they belong to (lone nodes are their own)."""
    ac = buses.where("not dc_bool")
    area = ac.select("bus_id", "sync_area")
    same = lines.join(area.select(F.col("bus_id").alias("a"), F.col("sync_area").alias("_sa")), "a").join(area.select(F.col("bus_id").alias("b"), F.col("sync_area").alias("_sb")), "b").where("_sa = _sb").select("a", "b")
    comp = components(same.unionByName(ac.select(F.col("bus_id").alias("a"), F.col("bus_id").alias("b"))))
    return buses.join(comp.withColumnRenamed("node", "bus_id"), "bus_id", "left").withColumn("sub_network", F.when(F.col("component").isNotNull(), F.concat_ws("_", "sync_area", F.col("component").cast("string")))).drop("component")


def impute_ratings(lines: DataFrame, buses: DataFrame) -> DataFrame:
    """Ratings of 0 or null by country and voltage class medians."""
    c = buses.select("bus_id", "country")
    df = lines.join(c.select(F.col("bus_id").alias("a"), F.col("country").alias("country_a")), "a", "left").join(c.select(F.col("bus_id").alias("b"), F.col("country").alias("country_b")), "b", "left").withColumn("_class", voltage_class(F.col("voltage").cast("int")))
    out = border_imputation(df, "s_nom", "country_a", "country_b", "_class")
    return out.withColumn("s_nom", F.col("imputed")).withColumnRenamed("source", "s_nom_source").drop("imputed", "_class", "country_a", "country_b")


def cluster_budget(nodes: DataFrame, total: int, group: list[str], weight: str) -> DataFrame:
    """(group, k): how many clusters each group gets: at least one, at most its nodes, the rest by weight."""
    g = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col(weight), F.lit(0.0))).alias("_w"))
    return integer_budget(g, group, total, "_n", "_w").select(*group, "k")


def edge_weights(lines: DataFrame, nodes: DataFrame | None = None, by: str = "susceptance") -> DataFrame:
    """(a, b, w), a < b: circuits over reactance, times the rating for ``rated``, or one over the distance for ``distance``; parallel
    lines add up."""
    df = lines.where("a <> b")
    if by == "distance":
        at = lambda s: nodes.select(F.col("bus_id").alias(s), F.col("lat").alias(f"_lat{s}"), F.col("lon").alias(f"_lon{s}"))
        df = df.join(at("a"), "a").join(at("b"), "b")
        w = 1.0 / F.greatest(haversine_km(F.col("_lata"), F.col("_lona"), F.col("_latb"), F.col("_lonb"), EARTH_KM_IUGG), F.lit(1e-3))
    else:
        w = F.try_divide(F.coalesce("circuits", F.lit(1.0)), F.abs("x"))
        if by == "rated":
            w = w * F.col("s_nom")
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def reduce_network(buses: DataFrame, lines: DataFrame, total: int, method: str = "spectral", electrical: bool = True, weight: str = "weight") -> dict[str, DataFrame]:
    """Clusters of AC nodes per country and sub-network, their representatives, and the equivalent branches between them.

    ``buses`` as prepared, with a weight for the budget (load and generation). Returns nodes (bus_id, cluster_id), clusters (position of
    the medoid), branches (a, b, r, x, rating, n_branches).
    """
    ac = sub_networks(buses, lines).where("not dc_bool").withColumn("group_id", F.concat_ws("|", "country", "sub_network"))
    ac = materialise(ac, "ac")
    k = cluster_budget(ac, total, ["group_id"], weight)
    nodes = ac.join(k, "group_id").select("group_id", F.col("bus_id").alias("node"), "k", F.col("lon").alias("x"), F.col("lat").alias("y"))
    g = ac.select("bus_id", "group_id")
    w = edge_weights(lines, ac).join(g.withColumnRenamed("bus_id", "a").withColumnRenamed("group_id", "_ga"), "a").join(g.withColumnRenamed("bus_id", "b").withColumnRenamed("group_id", "_gb"), "b").where("_ga = _gb")
    labels = cluster(nodes, w.select(F.col("_ga").alias("group_id"), "a", "b", "w"), "group_id", method, electrical)
    member = materialise(labels.select(F.col("node").alias("bus_id"), F.concat_ws("_", F.lit("cl"), "group_id", F.col("label").cast("string")).alias("cluster_id")), "clusters")
    placed = ac.join(member, "bus_id")
    centre = medoid(placed, "cluster_id", "bus_id").join(ac.select("bus_id", "lat", "lon"), "bus_id")
    branches = relabel(lines, member.select(F.col("bus_id").alias("node"), F.col("cluster_id").alias("target")))
    branches = parallel_branches(branches.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")}), ["_a", "_b", "voltage"], rating="s_nom", length="length").withColumnsRenamed({"_a": "a", "_b": "b"})
    return {"nodes": placed.select("bus_id", "country", "sub_network", "cluster_id"), "clusters": centre.select("cluster_id", F.col("bus_id").alias("medoid"), "lat", "lon"), "branches": branches}


def prune(buses: DataFrame, lines: DataFrame, links: DataFrame, converters: DataFrame, cross_border: bool = False) -> dict[str, DataFrame]:
    """Small leaves merged into their neighbours, point-to-point DC systems made links, nodes without any edge listed."""
    protected = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(converters.select(F.col("ac").alias("node")))
    nodes = buses.select(F.col("bus_id").alias("node"), "members", F.col("weight").alias("size"), "country")
    merges = contract_leaves(nodes, lines.select("a", "b"), protected=protected)
    if cross_border:
        merges = keep_one_per_country(merges, nodes.select("node", "country"))
    kept_lines = relabel(lines, merges)
    made, summary = collapse_dc(links, converters)
    lone = unused_nodes(nodes.select("node"), (kept_lines, "a", "b"), (links, "a", "b"), (converters, "ac", "dc"))
    return {"merges": merges, "lines": kept_lines, "dc_links": made, "dc_components": summary, "unused": lone}


def line_templates(lines: DataFrame) -> DataFrame:
    """Median parameters per length, circuit and class: r, x and rating of existing lines."""
    df = lines.where("length > 0").withColumn("class", voltage_class(F.col("voltage").cast("int")))
    per = df.select("class", (F.col("r") * F.col("circuits") / F.col("length")).alias("r_per"), (F.col("x") * F.col("circuits") / F.col("length")).alias("x_per"), (F.col("s_nom") / F.col("circuits")).alias("s_per"))
    out = per.select("class").distinct()
    for c in ("r_per", "x_per", "s_per"):
        out = out.join(exact_median(per, ["class"], c, c), "class", "left")
    return out


def diagnose_projects(projects: DataFrame, buses: DataFrame, lines: DataFrame, target_year: int, snapshot_year: int) -> DataFrame:
    """Planned lines (project_id, build_year, upgraded, v_nom, lat0, lon0, lat1, lon1) with their nodes, matches and what to do.

    Both ends go to the nearest AC node; the worse end decides the quality. A match is a line between the same nodes; it is relaxed where
    its voltage class is the project's, 380 and 400 kV being one.
    """
    nodes = buses.where("not dc_bool").select(F.col("bus_id").alias("node"), "lat", "lon")
    end = lambda i: nearest(projects.select(F.col("project_id").alias("point"), F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon")), nodes, radius=EARTH_KM_IUGG).select(F.col("point").alias("project_id"), F.col("node").alias(f"bus{i}"), F.col("km").alias(f"km{i}"))
    df = projects.join(end(0), "project_id", "left").join(end(1), "project_id", "left").withColumns({"a": F.least("bus0", "bus1"), "b": F.greatest("bus0", "bus1")})
    there = lines.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "line_id", voltage_class(F.col("voltage").cast("int")).alias("_class")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("matched"), F.array_sort(F.collect_set("_class")).alias("_classes"), F.array_join(F.array_sort(F.collect_set("line_id")), ",").alias("matched_lines"))
    df = df.join(there, ["a", "b"], "left").join(line_templates(lines).select("class", F.lit(True).alias("_template")), F.col("class") == voltage_class(F.col("v_nom").cast("int")), "left")
    worst = F.when(F.col("km0").isNotNull() & F.col("km1").isNotNull(), F.greatest("km0", "km1"))
    q = snap_quality(worst)
    relaxed = F.coalesce(F.array_contains("_classes", voltage_class(F.col("v_nom").cast("int"))), F.lit(False))
    action = line_actions(F.col("build_year") <= target_year, F.col("build_year") <= snapshot_year, q, F.coalesce("matched", F.lit(0)) > 0, relaxed, F.coalesce("upgraded", F.lit(False)), F.coalesce("_template", F.lit(False)))
    return df.withColumns({"snap_quality": q, "action": action}).drop("_classes", "_template", "class")


def lines_within(lines: DataFrame, buses: DataFrame) -> DataFrame:
    """Lines both of whose ends are among the nodes."""
    return inside(lines, buses, "a", "b", "bus_id")
