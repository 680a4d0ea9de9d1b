"""Problem 2 on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.proximity import containing_regions, near_pairs
from ..session import table

NEAR_KM = 0.25


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "buses_with_clusters").select(F.col("bus_id").alias("key"), "lat", "lon")


def p2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_points(spark, sf_dir), NEAR_KM).select("key_a", "key_b", F.round("km", 6).alias("km"))


def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containing_regions(_points(spark, sf_dir), table(spark, sf_dir, "proxy_regions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    near = near_pairs(points, NEAR_KM).select(F.lit("bus_bus").alias("pair_kind"), "key_a", "key_b")
    held = containing_regions(points, table(spark, sf_dir, "proxy_regions"))
    return near.unionByName(held.select(F.lit("bus_region").alias("pair_kind"), F.col("key").alias("key_a"), F.col("region_id").alias("key_b")))


QUERIES = {"p2_found": p2_found, "p2_near": p2_near, "p2_regions": p2_regions}

_POINTS = """points as (select distinct bus_id, lat, lon from buses_with_clusters
  where bus_id is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0))"""
_NEAR = """near as (select key_a, key_b, min(km) as km from (
  select a.bus_id as key_a, b.bus_id as key_b, 2 * 6371.0::double * asin(least(1.0::double, sqrt(
    pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) as km
  from points a join points b on a.bus_id < b.bus_id and abs(a.lat - b.lat) < 0.01) where km <= 0.25 group by 1, 2)"""
# Rings by their place in the GeoJSON; a point is inside where an odd number of edges of the region lies south of it.
_HELD = """areas as (select distinct region_id, json_extract(geometry, '$.coordinates') as c, json_extract_string(geometry, '$.type') as kind from proxy_regions where geometry is not null),
polygons as (select region_id, c as polygon from areas where kind = 'Polygon' union all select region_id, unnest(cast(c as json[])) from areas where kind = 'MultiPolygon'),
rings as (select region_id, unnest(cast(polygon as double[][][])) as ring from polygons),
edges as (select region_id, ring[i][1] as xa, ring[i][2] as ya, ring[i % len(ring) + 1][1] as xb, ring[i % len(ring) + 1][2] as yb from (select region_id, ring, unnest(range(1, len(ring) + 1)) as i from rings)),
held as (select bus_id, region_id from points join edges on (xa <= lon) <> (xb <= lon)
  where ya + (yb - ya) / (xb - xa) * (lon - xa) <= lat group by 1, 2, lat, lon having count(*) % 2 = 1)"""
SQL = {
    "p2_found": f"with {_POINTS}, {_NEAR}, {_HELD} select 'bus_bus' as pair_kind, key_a, key_b from near union all select distinct 'bus_region', bus_id, region_id from held",
    "p2_near": f"with {_POINTS}, {_NEAR} select key_a, key_b, round(km, 6) as km from near",
    "p2_regions": f"with {_POINTS}, {_HELD} select distinct bus_id as key, region_id from held",
}
