"""Readers: delimited files with sniffed delimiters, network and project tables, GeoJSON areas, metered load, country definitions.

Delimiters and columns are settled on the driver from the first line of one file; rows are always read by Spark with text columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import find_column, iso_duration_hours, loose_number, members
from ..operators.aggregate import energy_mean, require_no_conflicts


def sniff_delimiter(line: str, candidates: str = ";,\t|", default: str = ";") -> str:
    """The candidate that occurs most in a header line; ties and none go to the default if it is among the most frequent, else the first."""
    counts = {c: line.count(c) for c in candidates}
    most = max(counts.values())
    best = [c for c in candidates if counts[c] == most]
    return default if most == 0 or default in best else best[0]


def header_of(spark: SparkSession, path: str) -> str:
    """The first line of a file (of a glob: of its first file), without a byte order mark."""
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0].lstrip("﻿") if rows else ""


def read_delimited(spark: SparkSession, path: str, default: str = ";", quote: str = '"', delimiter: str | None = None) -> DataFrame:
    """A CSV with sniffed delimiter; every column nullable text, header names trimmed, byte order mark dropped."""
    sep = delimiter or sniff_delimiter(header_of(spark, path), default=default)
    df = spark.read.csv(path, sep=sep, header=True, quote=quote, escape=quote, inferSchema=False, multiLine=False)
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Comma CSV whose quote is the single one, as it holds line geometry."""
    return read_delimited(spark, path, delimiter=",", quote="'")


def read_expecting(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """A CSV read with each known delimiter until the expected columns are there; otherwise an error."""
    head = header_of(spark, path)
    for sep in dict.fromkeys([sniff_delimiter(head), ";", ",", "\t", "|"]):
        if set(expected) <= {c.strip().strip('"') for c in head.split(sep)}:
            return read_delimited(spark, path, delimiter=sep)
    raise ValueError(f"{path} lacks some of {expected}")


def typed(df: DataFrame, columns: dict[str, tuple[str, list[str]]], required: bool = True) -> DataFrame:
    """Columns by their alternative names and types: {name: (type, candidates)}; numbers are read loosely, others trimmed text.

    A column that isn't there is null, or an error if required.
    """
    out = []
    for name, (kind, candidates) in columns.items():
        c = find_column(df.columns, candidates or [name], required)
        if c is None:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kind == "string":
            out.append(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(name))
        else:
            out.append(loose_number(F.col(f"`{c}`").cast("string")).cast(kind).alias(name))
    return df.select(*out)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(region_id, country, pop, gdp, geometry, lat, lon) of a GeoJSON feature collection; lat and lon are the area centroid."""
    feature = "struct<id:string, properties:map<string,string>, geometry:variant>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features:array<{feature}>>").alias("d")).select(F.explode("d.features").alias("f"))
    p = F.col("f.properties")
    df = raw.select(
        F.coalesce(p["index"], p["region_id"], p["NUTS_ID"], F.col("f.id")).alias("region_id"), F.coalesce(p["country"], p["CNTR_CODE"]).alias("country"),
        p["pop"].try_cast("double").alias("pop"), p["gdp"].try_cast("double").alias("gdp"), F.to_json("f.geometry").alias("geometry"),
    )
    return with_centroids(df)


def with_centroids(regions: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds lat and lon: the centroid weighted by signed areas, so holes take away; the mean of the vertices where there is no area."""
    multi = f"get_json_object({geometry}, '$.type') = 'MultiPolygon'"
    areas = F.expr(f"if({multi}, from_json(get_json_object({geometry}, '$.coordinates'), 'array<array<array<array<double>>>>'), array(from_json(get_json_object({geometry}, '$.coordinates'), 'array<array<array<double>>>')))")
    # Outer rings turn one way and holes the other, however they were written.
    rings = F.flatten(F.transform(areas, lambda a: F.transform(a, lambda r, i: F.struct(r.alias("r"), F.when(i == 0, 1.0).otherwise(-1.0).alias("s")))))

    def part(x):
        r = x["r"]
        n = F.size(r)
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def step(acc, i):
            p, q = F.get(r, i), F.get(r, (i + 1) % n)
            cross = p[0] * q[1] - q[0] * p[1]
            return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (p[0] + q[0]) * cross).alias("x"), (acc["y"] + (p[1] + q[1]) * cross).alias("y"))

        total = F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)
        sign = x["s"] * F.when(total["a"] < 0, -1.0).otherwise(1.0)
        points = F.struct((total["a"] * sign).alias("a"), (total["x"] * sign).alias("x"), (total["y"] * sign).alias("y"), F.aggregate(r, F.lit(0.0), lambda s, v: s + v[0]).alias("sx"), F.aggregate(r, F.lit(0.0), lambda s, v: s + v[1]).alias("sy"), n.alias("n"))
        return points

    df = regions.withColumn("_p", F.transform(rings, part))
    add = lambda f: F.aggregate("_p", F.lit(0.0), lambda s, v: s + v[f])
    flat = F.abs(add("a")) < 1e-12
    lon = F.when(flat, F.try_divide(add("sx"), add("n"))).otherwise(F.try_divide(add("x"), 3 * add("a")))
    lat = F.when(flat, F.try_divide(add("sy"), add("n"))).otherwise(F.try_divide(add("y"), 3 * add("a")))
    return df.withColumns({"lat": lat, "lon": lon}).drop("_p")


def parse_time(text) -> object:
    """A timestamp written the ISO way or day first; null if neither."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd/MM/yyyy HH:mm"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms])


def read_metered_load(spark: SparkSession, path: str, year: int, excluded: list[str] | None = None) -> DataFrame:
    """(country, mean_load) from metering files: mean per country and time, then energy over hours by the rows' resolution."""
    df = read_delimited(spark, path, default="\t")
    t, area, load, res = (find_column(df.columns, c) for c in (["DateTime(UTC)", "DateTime"], ["AreaMapCode", "MapCode"], ["TotalLoad[MW]", "TotalLoadValue", "TotalLoad"], ["ResolutionCode"]))
    rows = df.select(F.upper(F.substring(F.trim(f"`{area}`"), 1, 2)).alias("country"), F.trim(f"`{area}`").alias("_code"), parse_time(F.col(f"`{t}`")).alias("time"), loose_number(F.col(f"`{load}`")).alias("load"), iso_duration_hours(F.col(f"`{res}`")).alias("hours"))
    rows = rows.where((F.year("time") == year) & F.col("load").isNotNull())
    if excluded:
        rows = rows.where(~F.col("_code").isin(excluded))
    return energy_mean(rows, ["country"], "time", "load", "hours")


def country_map(df: DataFrame) -> DataFrame:
    """(source_country, target_country, target_label): one target per source, two of them fail the job."""
    out = typed(df, {"source_country": ("string", ["source_country", "country", "member"]), "target_country": ("string", ["target_country", "country_code"]), "target_label": ("string", ["target_label", "country_label", "label"])}, required=False)
    out = out.where("source_country is not null").select("source_country", "target_country", F.coalesce("target_label", "target_country").alias("target_label"))
    return require_no_conflicts(out, ["source_country"], ["target_country", "target_label"])


def country_members(df: DataFrame, code: str = "country_code", listed: str = "member_countries") -> DataFrame:
    """(source_country, target_country, target_label) of a table that lists the members of each aggregate in a cell."""
    label = find_column(df.columns, ["country_label", "label"], required=False)
    return df.select(F.upper(F.explode(members(F.col(listed)))).alias("source_country"), F.upper(F.trim(code)).alias("target_country"), (F.trim(label) if label else F.upper(F.trim(code))).alias("target_label")).distinct()


def for_year(df: DataFrame, path: str, year: int, years: tuple[int, ...] = (2030, 2040, 2050), column: str = "year") -> DataFrame:
    """Rows of the target year; without a year column the path must name that year and no other."""
    if year not in years:
        raise ValueError(f"{year} is none of {years}")
    c = find_column(df.columns, [column, "target_year", "ref_year"], required=False)
    if c is None:
        named = {y for y in years if str(y) in path}
        if named != {year}:
            raise ValueError(f"no year column, and {path} names {sorted(named) or 'no year'}")
        return df
    return df.where(loose_number(F.col(f"`{c}`").cast("string")) == year)


def for_scenario(df: DataFrame, scenario: str, column: str = "scenario", strict: bool = False) -> DataFrame:
    """Rows of the scenario; where it doesn't occur all rows, or none if strict."""
    from ..operators.joining import only_if_present

    if column not in df.columns:
        return df
    return df.where(F.lower(F.trim(F.col(column))) == scenario.strip().lower()) if strict else only_if_present(df, column, scenario)


def read_load_shares(df: DataFrame) -> DataFrame:
    """(country, bus, share) from any of the known layouts: a share column, or a load column to be shared; normalised per country.

    Only positive rows stay.
    """
    from ..operators.shares import partition_share

    country = find_column(df.columns, ["country", "country_model", "target_country"])
    bus = find_column(df.columns, ["bus", "bus_id", "cluster_id", "reduced_bus"])
    value = find_column(df.columns, ["load_share", "share", "share_load", "mean_load_mw", "load_mw", "mean_load"])
    rows = df.select(F.trim(f"`{country}`").alias("country"), F.trim(f"`{bus}`").alias("bus"), loose_number(F.col(f"`{value}`").cast("string")).alias("v")).where("country is not null and bus is not null and v > 0")
    summed = rows.groupBy("country", "bus").agg(F.sum("v").alias("v"))
    return partition_share(summed, ["country"], "v", "share").select("country", "bus", "share")


def grid_cell_centre(cell: str) -> tuple:
    """(x, y) in metres of the centre of a one-kilometre cell from its id (``...N2689000E4337000``)."""
    n, e = F.regexp_extract(cell, r"N(\d+)", 1).try_cast("double"), F.regexp_extract(cell, r"E(\d+)", 1).try_cast("double")
    return e + 500, n + 500
