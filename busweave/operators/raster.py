"""Raster cells as long tables: masks, coverage, resource classes, potentials, capacity factors.

A grid is a table (row_ix, col_ix, attributes); a series is (year, hour_ix, row_ix, col_ix, cf), partitioned by technology and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import clamp, laea_xy, safe_div
from .joining import nearest
from .proximity import containing_regions


def resource_class(cells: DataFrame, group: list[str], value: str, available: Column, n: int, out: str = "resource_class") -> DataFrame:
    """Equal-width classes 0..n-1 of a value between its least and largest available one of the group; the last class is closed.

    Cells that aren't available get -1; where all values are equal the class is 0. No group: one range for all cells.
    """
    ends = cells.where(available & F.col(value).isNotNull()).groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if group:
        joined = cells.join(ends, group, "left")
    else:
        row = ends.first()
        joined = cells.withColumns({"_lo": F.lit(row["_lo"]).cast("double"), "_hi": F.lit(row["_hi"]).cast("double")})
    k = F.when(F.col("_hi") <= F.col("_lo"), 0).otherwise(F.least(F.lit(n - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n)))
    return joined.withColumn(out, F.when(available & F.col(value).isNotNull(), k).otherwise(-1).cast("int")).drop("_lo", "_hi")


def potential(area_km2: Column, availability: Column, density_mw_km2: float) -> Column:
    """Capacity a cell can hold."""
    return area_km2 * clamp(availability, 0.0, 1.0) * density_mw_km2


def potential_by_class(cells: DataFrame, node: str, density_mw_km2: float) -> DataFrame:
    """Potential by node and resource class; cells without a class don't count."""
    return cells.where("resource_class >= 0").groupBy(node, "resource_class").agg(F.sum(potential(F.col("area_km2"), F.col("availability"), density_mw_km2)).alias("p_nom_max_mw"))


def node_capacity_factor(series: DataFrame, cells: DataFrame, node: str, time: list[str], weight: str = "scenario_capacity_mw") -> DataFrame:
    """(node, time, cf, raw): capacity factors weighted by the cells' capacity over the cells with a value, and their product with the
    whole capacity of the node."""
    w = cells.select("row_ix", "col_ix", node, F.col(weight).alias("_w")).where("_w > 0")
    whole = w.groupBy(node).agg(F.sum("_w").alias("_all"))
    known = F.col("cf").isNotNull() & ~F.isnan("cf")
    mean = series.where(known).join(w, ["row_ix", "col_ix"]).groupBy(node, *time).agg(safe_div(F.sum(F.col("cf") * F.col("_w")), F.sum("_w"), 0.0).alias("cf"))
    return mean.join(whole, node).withColumn("raw", F.col("cf") * F.col("_all")).drop("_all")


def clip_low(cf: Column, threshold: float) -> Column:
    """Capacity factors below a threshold are 0."""
    return F.when(cf < threshold, 0.0).otherwise(cf)


def combine_masks(masks: list[Column]) -> Column:
    """Product of masks, clipped to 0..1; a missing mask excludes."""
    out = F.lit(1.0)
    for m in masks:
        out = out * F.coalesce(clamp(m, 0.0, 1.0), F.lit(0.0))
    return out


def fuse_land_cover(a: Column, b: Column, valid_a: Column, valid_b: Column, how: str) -> Column:
    """Two land-cover masks as one: ``intersection``, or one preferred where it is valid (``prefer_a``, ``prefer_b``)."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return {"intersection": a * b, "prefer_a": a + b * (1 - F.coalesce(valid_a, F.lit(0.0))), "prefer_b": b + a * (1 - F.coalesce(valid_b, F.lit(0.0)))}[how]


def class_mask(pixels: DataFrame, code: str, include: list[int] | None = None, exclude: list[int] | None = None) -> DataFrame:
    """(row_ix, col_ix, mask): share of a cell's pixels whose class is included, or isn't excluded. One of both lists is given."""
    if (include is None) == (exclude is None):
        raise ValueError("either included or excluded classes")
    ok = F.col(code).isin(include) if include is not None else ~F.col(code).isin(exclude)
    return pixels.groupBy("row_ix", "col_ix").agg(F.avg(F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)).alias("mask"))


def depth_ok(depth: Column, least: float | None, most: float | None) -> Column:
    """Depth within a window (metres below the sea, positive down); unknown depths are out."""
    ok = depth.isNotNull() & ~F.isnan(depth)
    if least is not None:
        ok = ok & (depth >= least)
    if most is not None:
        ok = ok & (depth <= most)
    return ok


def assign_to_nodes(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells (cell, lat, lon) with their nearest node in an equal-area projection: the same as lying in the node's Voronoi cell."""
    def flat(df: DataFrame, key: str) -> DataFrame:
        x, y = laea_xy(F.col("lat"), F.col("lon"))
        # One degree of the nearest join is 100 km of the plane, near its equator, where both its axes are equally long.
        return df.select(F.col(key), (y / 1e5 - 32.1).alias("lat"), (x / 1e5 - 43.21).alias("lon"))

    near = nearest(flat(cells, "cell").withColumnRenamed("cell", "point"), flat(nodes, "node"))
    return near.select(F.col("point").alias("cell"), "node")


def assign_by_region(cells: DataFrame, regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells with the region that contains them and, within it, the nearest node; cells in no region drop out.

    ``regions`` has region_id, country, geometry; ``nodes`` node, country, lat, lon.
    """
    held = containing_regions(cells.select(F.col("cell").cast("string").alias("key"), "lat", "lon"), regions)
    placed = cells.withColumn("key", F.col("cell").cast("string")).join(held, "key").join(regions.select("region_id", "country"), "region_id")
    near = nearest(placed.select(F.col("cell").alias("point"), "country", "lat", "lon"), nodes, "country")
    return placed.select("cell", "region_id", "country").join(near.select(F.col("point").alias("cell"), "node"), "cell")


def coverage_by_samples(cells: DataFrame, regions: DataFrame, step: float, per_side: int = 4) -> DataFrame:
    """(cell, region_id, share): share of a square cell (centre lat, lon; side ``step`` degrees) that lies in each region, by a grid of
    sample points; off by at most about 1 / per_side along a border."""
    at = [(i + 0.5) / per_side - 0.5 for i in range(per_side)]
    shifts = F.array(*[F.struct(F.lit(a * step).alias("dy"), F.lit(b * step).alias("dx")) for a in at for b in at])
    s = cells.select("cell", "lat", "lon", F.posexplode(shifts).alias("i", "d"))
    s = s.select(F.concat_ws("|", F.col("cell").cast("string"), F.col("i").cast("string")).alias("key"), (F.col("lat") + F.col("d.dy")).alias("lat"), (F.col("lon") + F.col("d.dx")).alias("lon"))
    held = containing_regions(s, regions).withColumn("cell", F.regexp_extract("key", r"^(.*)\|\d+$", 1))
    return held.groupBy("cell", "region_id").agg((F.count(F.lit(1)) / float(per_side * per_side)).alias("share"))
