"""Generic operators on hand-worked fixtures, invariants and random checks."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from busweave.functions import scalar as fn
from busweave.operators import aggregate as ag, allocate as al, graph as gr, joining as jo, kernels as ke, raster as ra, series as se, shares as sh

from .conftest import rows


def approx(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1]), (a, b)


# ---- scalar ------------------------------------------------------------------------------------------------------------------


def _one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_scalars(spark):
    r = _one(
        spark,
        zero=fn.safe_ratio(F.lit(0.0), F.lit(0.0)), null=fn.safe_ratio(F.lit(1.0), F.lit(0.0)), div=fn.safe_div(F.lit(1.0), F.lit(0.0), 7.0), loose=fn.loose_number(F.lit(" 1 234,5 ")), bad=fn.loose_number(F.lit("n/a")), nan=fn.loose_number(F.lit("NaN")),
        week=fn.week_of_year(F.lit(dt.date(2024, 12, 31))), days=fn.week_days(F.lit(2024), F.lit(53)), pt=fn.iso_duration_hours(F.lit("PT15M")), pt1=fn.iso_duration_hours(F.lit("PT1H")), pt0=fn.iso_duration_hours(F.lit("PT0M")),
        key=fn.pair_key(F.lit("b"), F.lit("a")), fuel=fn.fuel_code(F.lit("Oil Shale")), lig=fn.fuel_code(F.lit("Brown coal / lignite")), none=fn.fuel_code(F.lit(None).cast("string")), zone=fn.zone_country(F.lit("uk00")), volt=fn.voltage_class(F.lit(400)), flag=fn.flag(F.lit("Yes")), noflag=fn.flag(F.lit(None).cast("string")),
        mem=fn.members(F.lit("DE, LU; ")), seg=fn.segment_distance_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0)),
    )
    assert (r.zero, r.null, r.div, r.loose, r.bad, r.nan) == (0.0, None, 7.0, 1234.5, None, None)
    assert r.week == 53 and [d.day for d in r.days] == [30, 31] and (r.pt, r.pt1, r.pt0) == (0.25, 1.0, None)
    assert (r.key, r.fuel, r.lig, r.none, r.zone, r.volt, r.flag, r.noflag, r.mem) == ("a|b", "B07", "B02", "B20", "GB", 380, True, False, ["DE", "LU"])
    assert r.seg == pytest.approx(math.radians(1) * 6371.0, rel=1e-6)


def test_marginal_cost(spark):
    cost, status = fn.marginal_cost(F.lit(20.0), F.lit(0.5), F.lit(80.0), F.lit(56.0), F.lit(2.0), F.lit(False))
    assert _one(spark, c=cost, s=status) == (pytest.approx(74.256), "formula")
    cost, status = fn.marginal_cost(F.lit(None).cast("double"), F.lit(0.5), F.lit(80.0), F.lit(56.0), F.lit(2.0), F.lit(False))
    assert _one(spark, c=cost, s=status) == (1e6, "high_fallback")


# ---- shares and allocation ---------------------------------------------------------------------------------------------------


def test_partition_share(spark):
    df = spark.createDataFrame([("A", 1, 3.0), ("A", 2, 1.0), ("B", 3, 0.0), ("B", 4, None), (None, 5, 2.0)], "g string, i int, v double")
    assert rows(sh.partition_share(df, ["g"], "v"), "g", "i", "share") == sorted([("A", 1, 0.75), ("A", 2, 0.25), ("B", 3, 0.0), ("B", 4, 0.0), (None, 5, 1.0)], key=repr)
    assert {r.share for r in sh.partition_share(df, ["g"], "v", uniform=True).where("g = 'B'").collect()} == {0.5}


def test_distance_weights(spark):
    deg = 1 / (math.radians(1) * 6371.0)
    regions = spark.createDataFrame([("c", "r", 0.0, 0.0), ("c", "s", 0.0, 5.0), ("d", "t", 1.0, 1.0)], "country string, region string, lat double, lon double")
    nodes = spark.createDataFrame([("c", "x", 1 * deg, 0.0), ("c", "y", 3 * deg, 0.0), ("c", "p", 0.0, 5.0), ("c", "q", 0.0, 5.0)], "country string, node string, lat double, lon double")
    w = sh.distance_weights(regions, nodes.where("node in ('x', 'y')"), "country")
    approx(rows(w.where("region = 'r'"), "node", "weight"), [("x", 0.75), ("y", 0.25)])
    approx(rows(sh.distance_weights(regions, nodes, "country").where("region = 's'"), "node", "weight"), [("p", 0.5), ("q", 0.5)])


def test_proxy_shares_sum_to_one_and_fall_back(spark):
    regions = spark.createDataFrame([("c", "r", 0.0, 0.0, 2.0, 0.0), ("c", "s", 1.0, 1.0, 1.0, 0.0)], "country string, region string, lat double, lon double, pop double, gdp double")
    nodes = spark.createDataFrame([("c", "x", "k1", 0.1, 0.0), ("c", "y", "k2", 0.9, 1.0), ("d", "z", "k3", 5.0, 5.0)], "country string, node string, cluster string, lat double, lon double")
    got = sh.proxy_shares(regions, nodes, "country", {"pop": 0.4, "gdp": 0.6})
    assert {r.country: r.s for r in got.groupBy("country").agg(F.round(F.sum("share"), 9).alias("s")).collect()} == {"c": 1.0, "d": 1.0}


def test_cascade(spark):
    c = spark.createDataFrame([("a", 1, 0.0, 0.2), ("a", 2, 0.0, 0.8), ("b", 3, 0.0, 0.0), ("b", 4, None, 0.0), ("b", 5, 0.0, 0.0), ("b", 6, 0.0, 0.0)], "g string, i int, basis double, load double")
    t = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("none", 5.0)], "g string, target double")
    out = sh.fallback_cascade(c, t, "g", ["basis", "load"])
    approx(rows(out, "g", "i", "rule", "allocated"), [("a", 1, "load", 2.0), ("a", 2, "load", 8.0), *[("b", i, "uniform", 2.5) for i in (3, 4, 5, 6)]])
    assert {r.g: r.left_over for r in sh.unallocated(t, out, "g").collect()} == {"a": 0.0, "b": 0.0, "none": 5.0}


def test_capped_proportional(spark):
    b = spark.createDataFrame([("x", 1, 6.0), ("x", 2, 2.0), ("y", 3, 6.0), ("y", 4, 2.0), ("y", 5, 0.0)], "g string, i int, capacity double")
    t = spark.createDataFrame([("x", 4.0), ("y", 11.0), ("z", 1.0)], "g string, target double")
    got, report = al.capped_proportional(b, t, "g")
    approx(rows(got, "i", "allocated"), [(1, 3.0), (2, 1.0), (3, 6.0), (4, 2.0)])
    assert rows(report, "g", "remainder") == [("x", 0.0), ("y", 3.0), ("z", 1.0)]


def test_largest_remainder(spark):
    w = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.3), ("p", "c", 0.2), ("q", "a", 0.5), ("q", "b", 0.5)], "g string, i string, weight double")
    n = spark.createDataFrame([("p", 4), ("q", 1)], "g string, n_units int")
    assert rows(al.largest_remainder(w, n, "g", "i"), "g", "i", "assigned") == [("p", "a", 2), ("p", "b", 1), ("p", "c", 1), ("q", "a", 1)]


def _stepwise(sizes, total, weights, least=1):
    """The budget dealt unit by unit."""
    got = [min(least, s) for s in sizes]
    left = max(0, total - sum(got))
    weights = weights if sum(weights) > 0 else sizes
    ideal = [left * w / sum(weights) if sum(weights) > 0 else 0.0 for w in weights]
    got = [g + min(math.floor(x), s - g) for g, x, s in zip(got, ideal, sizes)]
    for i in sorted(range(len(sizes)), key=lambda i: (-(ideal[i] - math.floor(ideal[i])), -sizes[i], i)):
        if sum(got) < total and got[i] < sizes[i]:
            got[i] += 1
    for i in sorted(range(len(sizes)), key=lambda i: (got[i] - sizes[i], i)):
        while sum(got) < total and got[i] < sizes[i]:
            got[i] += 1
    return got


def test_integer_budget(spark):
    def dealt(sizes, total, weights):
        df = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, n int, w double")
        return [k for _, k in rows(al.integer_budget(df, ["i"], total, "n", "w"), "i", "k")]

    assert dealt([5, 1, 3], 6, [1, 1, 1]) == [3, 1, 2]
    assert dealt([0, 4], 1, [1, 1]) == [0, 1] and dealt([2, 2], 1, [0, 0]) == [1, 1] and dealt([], 3, []) == []
    rng = np.random.default_rng(3)
    for _ in range(4):
        sizes, weights = rng.integers(0, 12, 7).tolist(), rng.integers(0, 5, 7).tolist()
        assert dealt(sizes, 25, weights) == _stepwise(sizes, 25, weights)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=8), st.integers(1, 60))
def test_apportion(sizes, k):
    got = al.apportion(sizes, k).tolist()
    assert got == _stepwise(sizes, k, sizes)
    assert all(0 <= g <= s for g, s in zip(got, sizes)) and sum(got) == max(min(k, sum(sizes)), sum(s > 0 for s in sizes))


def _fill(spark, cells, delta):
    df = spark.createDataFrame([("g", i, float(h), k) for i, (h, k) in enumerate(cells)], "g string, i int, headroom double, class int")
    got, report = al.water_fill(df, spark.createDataFrame([("g", float(delta))], "g string, delta double"), "g", "i")
    return [v for _, v in sorted(rows(got, "i", "addition"))], report.first().remainder


def test_water_fill(spark):
    assert _fill(spark, [(1, 1), (4, 1), (10, 1)], 9) == (pytest.approx([1, 4, 4]), pytest.approx(0))
    assert _fill(spark, [(2, 2), (5, 1), (5, 1)], 6) == (pytest.approx([2, 2, 2]), pytest.approx(0))
    assert _fill(spark, [(1, 1), (1, 1), (3, -1), (3, None), (0, 5)], 5) == (pytest.approx([1, 1, 0, 0, 0]), pytest.approx(3))


def test_water_fill_random(spark):
    rng = np.random.default_rng(0)
    for _ in range(3):
        n = 12
        cells = [(round(float(h), 2), int(k)) for h, k in zip(rng.exponential(3, n), rng.integers(0, 3, n))]
        delta = float(rng.uniform(1, 40))
        want, left = np.zeros(n), delta
        for k in (2, 1, 0):
            at = [i for i in range(n) if cells[i][1] == k]
            room = np.array([cells[i][0] for i in at])
            lo, hi = 0.0, room.max(initial=0) + 1
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.minimum(room, mid).sum() < left else (lo, mid)
            give = np.minimum(room, hi) if room.sum() > left else room
            want[at] = give
            left -= give.sum()
            left = max(left, 0)
        got, rest = _fill(spark, cells, delta)
        assert got == pytest.approx(want.tolist(), abs=1e-6) and sum(got) + rest == pytest.approx(delta)


def test_priority_fill(spark):
    s = spark.createDataFrame([("g", "a", 5.0, 2029), ("g", "b", 4.0, 2028), ("g", "c", 9.0, 2020)], "g string, i string, capacity double, d int")
    got = al.priority_fill(s, spark.createDataFrame([("g", 7.0)], "g string, target double"), "g", "i", "d")
    assert rows(got, "i", "filled") == [("a", 5.0), ("b", 2.0)]


def test_unit_packing(spark):
    units = spark.createDataFrame([("c", "gas", "u1", 4.0), ("c", "gas", "u2", 4.0), ("c", "gas", "u3", 4.0), ("d", "gas", "u4", 1.0), ("c", "nuclear", "n1", 1.0), ("c", "hard_coal", "h1", 3.0)], "country string, fuel_group string, unit string, size double")
    sites = spark.createDataFrame([("c", "s", "gas", 5.0, 2029), ("c", "k", "lignite", 3.0, 2028)], "country string, site string, fuel_group string, capacity double, date_out int")
    got = {u: s for u, s in rows(al.unit_packing(units, sites), "unit", "site")}
    assert got == {"u1": "s", "u2": "s", "u3": "k", "u4": None, "n1": None, "h1": None}


def test_round_robin(spark):
    nodes = spark.createDataFrame([("c", "b1", 1), ("c", "b2", 2), ("c", "b3", 3)], "g string, n string, rank int")
    demands = spark.createDataFrame([("c", "d1", 2), ("c", "d2", 2), ("c", "d3", 7)], "g string, d string, k int")
    got = rows(al.round_robin_with_offset(demands, nodes, "g", "d", "k", "n", "rank"), "d", "n", "assigned")
    assert got[:4] == [("d1", "b1", 1), ("d1", "b2", 1), ("d2", "b1", 1), ("d2", "b3", 1)] and sum(x[2] for x in got) == 11
    assert got[4:] == [("d3", "b1", 2), ("d3", "b2", 3), ("d3", "b3", 2)]


def test_scale_to_total(spark):
    raw = spark.createDataFrame([("a", 1, 2.0, 1.0), ("a", 2, 6.0, 1.0), ("b", 1, 0.0, 1.0), ("c", 1, None, 3.0), ("c", 2, None, 1.0), ("d", 1, None, 0.0), ("e", 1, 1.0, 1.0)], "g string, i int, raw double, cap double")
    tot = spark.createDataFrame([(g, 4.0) for g in "abcd"] + [("e", 0.0)], "g string, total double")
    got = rows(al.scale_to_total(raw, tot, ["g"], "raw", "cap"), "g", "i", "mode", "scaled")
    assert got == [("a", 1, "scaled", 1.0), ("a", 2, "scaled", 3.0), ("b", 1, "profile_zero", 0.0), ("c", 1, "capacity_fallback", 3.0), ("c", 2, "capacity_fallback", 1.0), ("d", 1, "no_profile_no_capacity", 0.0), ("e", 1, "zero_national", 0.0)]


# ---- aggregation -------------------------------------------------------------------------------------------------------------


def test_passthrough_and_parallel(spark):
    df = spark.createDataFrame([("x", 10.0, 0.4, "b"), ("x", 30.0, None, "a"), ("y", 0.0, 2.0, None), ("y", None, 4.0, " ")], "g string, target double, eta double, src string")
    got = {r.g: r for r in ag.weighted_passthrough(df, ["g"], "target", ["eta"], ["src"]).collect()}
    assert got["x"].eta == pytest.approx(0.1) and got["x"].src == "a,b" and got["y"].eta == 3.0 and got["y"].src is None
    lines = spark.createDataFrame([("u", 0.0, 2.0), ("u", 0.0, 2.0), ("v", 0.0, 0.0)], "k string, r double, x double")
    assert rows(ag.parallel_branches(lines, ["k"]), "k", "r", "x", "n_branches") == [("u", 0.0, 1.0, 2), ("v", None, None, 1)]


def test_directed_pairs(spark):
    df = spark.createDataFrame([("A", "B", 10.0, 5.0), ("B", "A", 3.0, 0.0), ("A", "A", 9.0, 9.0), (None, "A", 1.0, 1.0)], "a string, b string, f double, w double")
    assert rows(ag.directed_pairs(df, "a", "b", "f", "w"), "first", "second", "to_mw", "from_mw") == [("A", "B", 10.0, 8.0)]


def test_medians_and_imputation(spark):
    df = spark.createDataFrame([(1, "DE", 380, 100.0), (2, "DE", 380, 300.0), (3, "DE", 380, None), (4, "FR", 380, None), (5, "XX", 110, None)], "i int, c string, v int, s double")
    got = {i: (round(x, 6), s) for i, x, s in rows(ag.median_imputation(df, "s", [["c", "v"], ["v"], []]), "i", "imputed", "source")}
    assert got[3] == (200.0, "c_v") and got[4] == (200.0, "v") and got[5] == (200.0, "global") and got[1] == (100.0, "given")
    edges = spark.createDataFrame([("DE", "DE", 380, 200.0), ("FR", "FR", 380, 400.0), ("DE", "FR", 380, None), ("DE", "XX", 380, 0.0), ("XX", "YY", 220, None)], "a string, b string, k int, s double")
    got = {(a, b): (v, s) for a, b, v, s in rows(ag.border_imputation(edges, "s", "a", "b", "k"), "a", "b", "imputed", "source")}
    assert got["DE", "FR"] == (300.0, "both_sides") and got["DE", "XX"] == (200.0, "one_side") and got["XX", "YY"][1] == "global"


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(x)) for x in rng.integers(-5, 5, 101)] + [("b", float(x)) for x in rng.normal(0, 100, 50)] + [("c", 1.5), ("d", None), ("d", float("nan"))]
    got = {(g, q): v for g, q, v in rows(ag.exact_quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", [0.0, 0.05, 0.5, 1.0]), "g", "quantile", "value")}
    for g in "abc":
        x = [v for k, v in data if k == g]
        for q in (0.0, 0.05, 0.5, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(x, q))
    assert not [k for k in got if k[0] == "d"]


def test_conflicts(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (3, None), (3, 1.0)], "k int, v double")
    assert rows(ag.conflicts(df, ["k"], ["v"]), "k", "n_rows", "conflict") == [(1, 2, False), (2, 2, True), (3, 2, True)]
    assert rows(ag.require_no_conflicts(df.where("k = 1"), ["k"], ["v"]), "k", "v") == [(1, 2.0)]
    with pytest.raises(Exception, match="contradicting"):
        ag.require_no_conflicts(df, ["k"], ["v"]).collect()


def test_islands(spark):
    df = spark.createDataFrame([("f", 1, "a", 1.0), ("f", 2, "a", 3.0), ("f", 3, "b", 5.0), ("f", 4, "a", 7.0)], "k string, p int, l string, v double")
    assert rows(ag.islands(df, ["k"], "p", "l", ["v"]), "l", "first_place", "last_place", "v") == [("a", 1, 2, 2.0), ("a", 4, 4, 7.0), ("b", 3, 3, 5.0)]


# ---- joins, series -----------------------------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = [(i, "x" if i % 3 else "y", float(a), float(b)) for i, (a, b) in enumerate(np.c_[rng.uniform(-85, 85, 60), rng.uniform(-179, 179, 60)])] + [(99, "x", None, 1.0), (98, "z", 1.0, 1.0)]
    n = [(i, "x" if i % 2 else "y", float(a), float(b)) for i, (a, b) in enumerate(np.c_[rng.uniform(-85, 85, 25), rng.uniform(-179, 179, 25)])]

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    want = {i: min(((km((a, b), (c, d)), j) for j, h, c, d in n if h == g), default=(None, None))[1] if a is not None else None for i, g, a, b in p}
    pts, nodes = spark.createDataFrame(p, "point int, g string, lat double, lon double"), spark.createDataFrame(n, "node int, g string, lat double, lon double")
    assert dict(rows(jo.nearest(pts, nodes, "g"), "point", "node")) == want
    assert dict(rows(jo.nearest(pts, nodes, "g", cell=20.0, rounds=1), "point", "node")) == want
    assert dict(rows(jo.nearest(pts, nodes.limit(0), "g"), "point", "node")) == dict.fromkeys(want)


def test_fill_gaps_and_weeks(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])] + [("b", i, v) for i, v in enumerate([None, 5.0, None])] + [("c", 0, None)], "k string, o int, v double")
    assert [v for _, _, v in rows(se.fill_gaps(df, ["k"], "o", "v"), "k", "o", "v")] == [2, 2, 4, 6, 8, 8, 5, 5, 5, None]
    hours = spark.range(8760).select(F.lit("x").alias("k"), (F.lit(dt.datetime(2023, 1, 1)) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"), F.lit(1.0).alias("v"))
    got = rows(se.hourly_to_weekly(hours, ["k"], "t", "v"), "week", "v")
    assert len(got) == 52 and {v for _, v in got} == {168_000.0}


def test_climatology_and_single_week(spark):
    data = [("k", y, w, v) for y, vs in {2001: [1.0, 3.0], 2002: [0.0, 0.0], 2003: [3.0, 5.0], 2004: [None, None]}.items() for w, v in enumerate(vs, 1)]
    got = rows(se.climatology(spark.createDataFrame(data, "k string, y int, w int, v double"), ["k"], "y", "w", "v"), "y", "w", "v")
    assert got == [(2001, 1, 1.0), (2001, 2, 3.0), (2002, 1, 2.0), (2002, 2, 4.0), (2003, 1, 3.0), (2003, 2, 5.0), (2004, 1, 2.0), (2004, 2, 4.0)]
    one = spark.createDataFrame([("a", 1, 7.0)], "k string, week int, v double")
    assert se.replicate_single_week(one, ["k"]).count() == 52
    with pytest.raises(Exception, match="neither complete"):
        se.replicate_single_week(one.unionByName(spark.createDataFrame([("a", 3, 7.0)], one.schema)), ["k"]).collect()


def test_resource_class(spark):
    df = spark.createDataFrame([("b", 0.0, True), ("b", 0.25, True), ("b", 0.5, True), ("b", 1.0, True), ("b", 0.7, False), ("flat", 0.3, True)], "g string, cf double, ok boolean")
    assert rows(ra.resource_class(df, ["g"], "cf", F.col("ok"), 4), "g", "cf", "resource_class") == [("b", 0.0, 0), ("b", 0.25, 1), ("b", 0.5, 2), ("b", 0.7, -1), ("b", 1.0, 3), ("flat", 0.3, 0)]


def test_clamp_and_flag(spark):
    v, f = al.clamp_and_flag(F.lit(120.0), F.lit(100.0))
    assert _one(spark, v=v, f=f) == (100.0, "yes")


# ---- graphs and kernels ------------------------------------------------------------------------------------------------------


def test_pointer_jump(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "y")], "source string, target string")
    assert rows(gr.pointer_jump(m), "source", "target") == [("a", "c"), ("b", "c"), ("c", "c"), ("x", "y")]
    with pytest.raises(ValueError, match="cycle"):
        gr.pointer_jump(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string"), max_rounds=5)


def test_components_random(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100, 100)] + [(i, i + 1) for i in range(200, 260)]
    label = {v: v for ab in e for v in ab}
    for _ in range(80):
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(rows(gr.components(spark.createDataFrame(e, "a long, b long")), "node", "component")) == label
    assert gr.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaves(spark):
    nodes = spark.createDataFrame([(x, 1, 1.0) for x in "abcde"], "node string, members int, size double")
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    assert rows(gr.contract_leaves(nodes, path), "node", "target") == [("a", "b"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "d")]
    assert rows(gr.contract_leaves(nodes, path, protected=nodes.where("node = 'a'").select("node")).where("node <> target"), "node", "target") == [("c", "b"), ("e", "d")]
    c = nodes.select("node", F.when(F.col("node") == "c", "S").otherwise("R").alias("country"))
    assert ("c", "c") in rows(gr.keep_one_per_country(gr.contract_leaves(nodes, path), c))


def test_dc_collapse(spark):
    links = spark.createDataFrame([("l1", "d1", "d2", 500.0, 80.0), ("l2", "e1", "e2", 400.0, 10.0)], "link_id string, a string, b string, p_nom double, length double")
    conv = spark.createDataFrame([("A", "d1", 300.0), ("A", "d1", 100.0), ("B", "d2", 450.0), ("C", "e1", 400.0)], "ac string, dc string, p_nom double")
    made, summary = gr.collapse_dc(links, conv)
    assert rows(made, "first", "second", "p_nom", "length") == [("A", "B", 400.0, 80.0)] and rows(summary, "n_ac") == [(1,), (2,)]


def test_effective_distance_path():
    d = ke.effective_distance(ke.weight_matrix(3, np.array([0, 1]), np.array([1, 2]), np.array([1.0, 1.0])))
    assert d[0, 1] == pytest.approx(1) and d[1, 2] == pytest.approx(1) and d[0, 2] == pytest.approx(2)


def test_clusterings_find_two_cliques():
    n, w = 10, np.zeros((10, 10))
    for a in range(n):
        for b in range(n):
            if a != b and (a < 5) == (b < 5):
                w[a, b] = 1
    w[4, 5] = w[5, 4] = 0.05
    x = np.c_[np.arange(n) + (np.arange(n) >= 5) * 100.0, np.zeros(n)]
    for label in (ke.spectral(w, 2), ke.mst_cut(w, 2), ke.kmeans(x, 2), ke.ward(x, w > 0, 2)):
        assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[9]
    assert set(ke.kmeans(np.zeros((4, 2)), 2)) == {0, 1} and ke.kmeans(np.zeros((0, 2)), 2).size == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=25), st.integers(1, 9), st.integers(0, 3))
def test_kmeans_fills_every_cluster(points, k, seed):
    x = np.array(points, dtype=float)
    label = ke.kmeans(x, k, seed)
    assert len(set(label)) == min(k, len(x)) and (label == ke.kmeans(x, k, seed)).all()


def test_kmeans_reads_unknown_coordinates_as_the_mean():
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, np.nan], [np.nan, 1]])
    assert len(set(ke.kmeans(x, 2))) == 2 and len(set(ke.kmeans(np.full((3, 2), np.nan), 2))) == 2


def _facts(spark, names, options):
    import itertools

    text = [isinstance(o[0], str) or o[-1] is not None and isinstance(o[-1], str) for o in options]
    return spark.createDataFrame(list(itertools.product(*options)), ", ".join(f"{n} {'string' if t else 'boolean'}" for n, t in zip(names, text)))


def test_line_actions(spark):
    """Every situation against the rules in their order, the last one that matches standing."""
    yes = (True, False)
    names = ("t", "b", "s", "m", "x", "u", "p")
    df = _facts(spark, names, (yes, yes, ("good", "review", "poor", "missing"), yes, yes, yes, yes))
    got = df.withColumn("action", jo.line_actions(*[F.col(n) for n in names])).collect()
    for r in got:
        ok, up = r.s in ("good", "review"), r.u
        want = "manual_review"
        for holds, action in [
            (not r.t, "skip_after_target_year"), (r.t and not ok, "manual_review_snap_far"), (r.t and ok and not r.m and not up, "candidate_add_new_line"), (r.t and ok and not r.m and up, "candidate_add_or_reroute_upgraded_line"),
            (r.t and ok and r.m and r.x and r.b, "likely_already_in_base"), (r.t and ok and r.m and r.x and not r.b, "candidate_update_existing_line" if up else "review_existing_corridor_or_parallel_line"),
            (r.t and ok and r.m and not r.x, "review_voltage_upgrade_existing_corridor" if up else "review_existing_corridor_voltage_mismatch"), (r.t and r.s == "good" and not r.p, "manual_review_no_line_template"),
        ]:
            want = action if holds else want
        assert r.action == want, r


def test_link_actions_and_recommendations(spark):
    cases = [
        ((False, True, "good", "good", True, True, "existing_pair", 400), "skip_after_target_year", "ignore"),
        ((True, True, "good", "good", True, False, "existing_pair", 400), "likely_already_in_base", "ignore"),
        ((True, False, "good", "good", True, True, "existing_pair", 400), "candidate_update_existing_link", "include_as_upgrade"),
        ((True, False, "poor", "poor", True, False, "global_mode", 400), "review_existing_link_corridor", "include_as_upgrade"),
        ((True, False, "review", "good", False, False, "existing_pair", 400), "candidate_add_link_reusing_dc_terminals", "include_new_link_reuse_dc"),
        ((True, False, "good", "good", False, False, "country_pair_mode", 400), "candidate_add_link_reusing_nearby_dc_terminals", "include_new_link_reuse_dc"),
        ((True, False, "poor", "review", False, False, "country_pair_mode", 400), "review_add_link_with_new_dc_terminals", "include_new_link_to_nearest_ac"),
        ((True, False, "poor", "good", False, False, "global_mode", 400), "manual_review_voltage_and_terminal_topology", "ignore"),
        ((True, False, "good", "good", False, False, "global_mode", 400), "manual_review_voltage_assumption", "ignore"),
        ((True, False, "good", "poor", False, False, "existing_pair", 400), "manual_review_snap_far", "ignore"),
        ((True, False, "good", "good", True, False, "existing_pair", None), "manual_review_no_voltage_inference", "ignore"),
        ((True, False, "good", "good", False, False, None, 400), "manual_review_no_voltage_inference", "ignore"),
        ((True, False, "poor", "good", False, False, "existing_pair", 400), "manual_review", "inspect"),
        ((None, False, "good", "good", False, False, "existing_pair", 400), "manual_review", "inspect"),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, t boolean, b boolean, d string, a string, m boolean, u boolean, v string, kv int")
    action = jo.link_actions(*[F.col(c) for c in ("t", "b", "d", "a", "m", "u", "v", "kv")])
    got = {r[0]: r[1:] for r in rows(df.select("i", action.alias("x"), jo.recommendation(action)[0].alias("y")), "i", "x", "y")}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_dc_flow_and_indices():
    w = ke.weight_matrix(3, np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([1.0, 1.0, 1.0]))
    theta = ke.dc_angles(w, np.array([[1.0], [0.0], [-1.0]]))[:, 0]
    assert theta[0] - theta[2] == pytest.approx(2 / 3) and theta[0] - theta[1] == pytest.approx(1 / 3)
    assert ke.algebraic_connectivity(w) == pytest.approx(3) and ke.kirchhoff_index(w) == pytest.approx(2)
