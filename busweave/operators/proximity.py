"""Points near other points, and the region that contains a point.

Near points meet in cells of a grid whose columns widen towards the poles, so that a neighbour is never further than one cell.
Regions are split into vertical slabs between neighbouring vertices (a trapezoidal decomposition): inside a slab no edge begins,
ends or crosses another, so edges are ordered by height and a point is located by binary search among them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .skew import salted_join

EARTH_KM = 6371.0
#: Degrees of longitude in one strip of slabs, and the most points one task locates at once in a strip.
STRIP_DEG, POINTS_PER_TASK = 0.5, 50_000


def usable(lat: Column, lon: Column) -> Column:
    """Coordinates that can be real: not null or NaN, in range, not both exactly 0."""
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return known & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def near_pairs(points: DataFrame, km: float, radius: float = EARTH_KM, hot: list | None = None) -> DataFrame:
    """(key_a, key_b, km): pairs of different keys at most ``km`` apart, the smaller key first; each pair once, its least distance.

    ``points`` has key, lat, lon; rows with unusable coordinates or a null key take no part, equal rows count once. One side keeps
    its own cell, the other looks into the cells its circle touches to the east and in the row above (about four, more near the
    poles); cells wrap at 180 degrees. Cells holding many points are salted.
    """
    lat_step = math.degrees(km / radius) * (1 + 1e-9) + 1e-12
    p = points.where(usable(F.col("lat"), F.col("lon")) & F.col("key").isNotNull()).select("key", "lat", "lon").distinct()
    row_of = lambda lat: F.floor((lat + 90) / F.lit(lat_step))

    def columns_in(row: Column) -> Column:
        """Cells in a row; at the pole end of the row a cell is still as wide as the distance."""
        edge = F.greatest(F.abs(row * F.lit(lat_step) - 90), F.abs((row + 1) * F.lit(lat_step) - 90))
        return F.greatest(F.lit(1), F.floor(F.lit(360 / lat_step) * F.cos(F.radians(F.least(edge, F.lit(90.0)))))).cast("long")

    def column_of(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)

    own = p.withColumn("row", row_of(F.col("lat"))).withColumn("column", column_of(F.col("lon"), columns_in(F.col("row"))))
    # Only one of two neighbours looks: the southern one into the row above, the western one along its own row (east of 180 degrees
    # the count starts anew).
    looking = own.select("key", "lat", "lon", F.col("row").alias("home"), F.col("column").alias("here"), F.explode(F.sequence(F.col("row"), F.col("row") + 1)).alias("row")).withColumn("n", columns_in(F.col("row")))
    # In longitude the circle reaches asin(sin(d) / cos(lat)); where it holds the pole, everywhere.
    s = F.sin(F.lit(km / radius)) / F.cos(F.radians("lat"))
    reach = F.when(s < 1, F.degrees(F.asin(s)) + 1e-9).otherwise(180.0)
    west, east = F.floor((F.col("lon") - reach + 180) / 360 * F.col("n")), F.floor((F.col("lon") + reach + 180) / 360 * F.col("n"))
    first = F.when(F.col("row") == F.col("home"), F.floor((F.col("lon") + 180) / 360 * F.col("n"))).otherwise(west)
    last = F.when(reach >= 180, first + F.col("n") - 1).otherwise(F.least(east, first + F.col("n") - 1))
    looking = looking.withColumn("column", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("column", F.pmod("column", F.col("n")))
    cell = F.xxhash64("row", "column").alias("cell_id")  # one long to join on; that cells may share it does no harm, the distance decides
    own = own.select(cell, "key", "lat", "lon")
    looking = looking.select(cell, F.col("key").alias("key_2"), F.col("lat").alias("lat_2"), F.col("lon").alias("lon_2"))
    met = salted_join(own, looking, "cell_id", "inner", salt_by=["key", "lat", "lon"], hot=hot).where("key <> key_2")
    far = great_circle_km(F.col("lat"), F.col("lon"), F.col("lat_2"), F.col("lon_2"), radius)
    found = met.withColumn("km", far).where(F.col("km") <= km).select(F.least("key", "key_2").alias("key_a"), F.greatest("key", "key_2").alias("key_b"), "km")
    return found.groupBy("key_a", "key_b").agg(F.min("km").alias("km"))


def _edges(batches: Iterator[pd.DataFrame], strip: float) -> Iterator[pd.DataFrame]:
    """Edges of GeoJSON areas, west end first, once for each strip they cross. Vertical edges bound no slab; broken geometry has none."""
    for batch in batches:
        out = []
        for region, text in zip(batch["region_id"], batch["geometry"]):
            try:
                g = json.loads(text)
                areas = {"Polygon": [g["coordinates"]], "MultiPolygon": g["coordinates"]}[g["type"]]
                rings = [np.asarray(r, dtype=float)[:, :2] for a in areas for r in a]
            except (TypeError, ValueError, KeyError, IndexError):
                continue
            for r in rings:
                a, b = r, np.roll(r, -1, axis=0)
                swap = a[:, 0] > b[:, 0]
                west, east = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
                for (x1, y1), (x2, y2) in zip(west, east):
                    if x1 < x2:
                        out += [(int(s), region, x1, y1, x2, y2) for s in range(math.floor(x1 / strip), math.floor(x2 / strip) + 1)]
        yield pd.DataFrame(out, columns=["strip", "region_id", "x1", "y1", "x2", "y2"])


class Slabs:
    """The trapezoidal decomposition of a set of edges (x1 < x2): slabs are built when a point first falls into them."""

    def __init__(self, region: np.ndarray, x1, y1, x2, y2):
        self.region, self.x1, self.y1, self.x2, self.y2 = region, x1, y1, x2, y2
        self.bounds = np.unique(np.concatenate([x1, x2]))

    def _locate(self, live: np.ndarray, lo: float, hi: float, x: np.ndarray, y: np.ndarray, index: np.ndarray, out: list) -> None:
        """Points of the slab from ``lo`` to ``hi`` among its edges ``live``."""
        if not len(live):
            return
        slope = (self.y2[live] - self.y1[live]) / (self.x2[live] - self.x1[live])
        at = lambda v: self.y1[live] + slope * (v - self.x1[live])
        left, right = at(lo), at(hi)
        order = np.lexsort((right, left))
        turned = right[order]
        drop = np.flatnonzero(turned[1:] < turned[:-1] - 1e-12)
        if len(drop):  # edges of different regions cross here: halve the slab at a crossing, which makes it a proper one
            i, j = order[drop[0]], order[drop[0] + 1]
            cut = lo + (left[j] - left[i]) / ((left[j] - left[i]) - (right[j] - right[i])) * (hi - lo)
            if lo < cut < hi:
                west = x < cut
                self._locate(live, lo, cut, x[west], y[west], index[west], out)
                self._locate(live, cut, hi, x[~west], y[~west], index[~west], out)
                return
        order = np.lexsort((left + right,))
        live, slope = live[order], slope[order]
        low, high = np.zeros(len(x), int), np.full(len(x), len(live))
        while (open_ := low < high).any():  # binary search of all points at once; edges below are those at or under the point
            mid = np.where(open_, (low + high) // 2, 0)
            below = self.y1[live[mid]] + slope[mid] * (x - self.x1[live[mid]]) <= y
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        first: dict = {}
        for k, r in enumerate(self.region[live]):  # a region covers what lies between its 1st and 2nd, 3rd and 4th ... edge
            if r in first:
                inside = (low > first[r]) & (low <= k)
                out += [(i, r) for i in index[inside]]
                del first[r]
            else:
                first[r] = k

    def containing(self, x: np.ndarray, y: np.ndarray) -> list:
        """(index of the point, region) for each region that contains it. A point on an edge belongs to the area above or east of it."""
        out: list = []
        slab = np.searchsorted(self.bounds, x, side="right") - 1
        order = np.argsort(slab, kind="stable")
        # The slabs are swept from west to east: an edge joins those at hand at its first slab and leaves them after its last.
        first, last = np.searchsorted(self.bounds, self.x1), np.searchsorted(self.bounds, self.x2)
        coming = np.argsort(first, kind="stable")
        starts = first[coming]
        live, met = np.empty(0, dtype=int), 0
        for part in np.split(order, np.flatnonzero(np.diff(slab[order])) + 1):
            if len(part) and 0 <= slab[part[0]] < len(self.bounds) - 1:
                s = slab[part[0]]
                upto = int(np.searchsorted(starts, s, side="right"))
                live = np.concatenate([live, coming[met:upto]])
                live, met = live[last[live] > s], upto
                self._locate(live, self.bounds[s], self.bounds[s + 1], x[part], y[part], part, out)
        return out


def _locate_strip(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    if points.empty or edges.empty:
        return pd.DataFrame({"key": [], "region_id": []}, dtype=object)
    slabs = Slabs(edges["region_id"].to_numpy(object), *(edges[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2")))
    found = slabs.containing(points["lon"].to_numpy(float), points["lat"].to_numpy(float))
    keys = points["key"].to_numpy(object)
    return pd.DataFrame({"key": [keys[i] for i, _ in found], "region_id": [r for _, r in found]}, dtype=object)


def containing_regions(points: DataFrame, regions: DataFrame, strip: float = STRIP_DEG, per_task: int = POINTS_PER_TASK) -> DataFrame:
    """(key, region_id): each point (key, lat, lon) with each region (region_id, geometry as GeoJSON) whose area holds it.

    Holes are outside; parts of a multi-polygon count together; parity decides, so rings may run either way. Unusable points, null
    keys, and null or broken geometries take no part; points in no region give no row. Strips are dealt to tasks by strip and part:
    a strip with many points has as many parts as keep each under ``per_task`` points, and only its edges are repeated.
    """
    p = points.where(usable(F.col("lat"), F.col("lon")) & F.col("key").isNotNull()).select("key", "lat", "lon").distinct()
    p = p.withColumn("strip", F.floor(F.col("lon") / F.lit(strip)).cast("int"))
    edges = regions.where("geometry is not null and region_id is not null").select("region_id", "geometry").distinct()
    edges = edges.mapInPandas(lambda it: _edges(it, strip), "strip int, region_id string, x1 double, y1 double, x2 double, y2 double")
    parts = p.groupBy("strip").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).cast("int").alias("parts"))
    dealt = p.join(parts, "strip").withColumn("part", F.pmod(F.xxhash64("key", "lat", "lon"), F.col("parts")).cast("int")).drop("parts")
    spread = edges.join(parts, "strip").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("strip", "part").cogroup(spread.groupBy("strip", "part")).applyInPandas(_locate_strip, "key string, region_id string").distinct()
