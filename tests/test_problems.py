"""The data problems of the core on small fixtures with the edge cases they must take."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from busweave.operators import orphans, outliers, proximity, reject, rescue, skew, units
from busweave.plans.deliveries import FEEDS, NONRES
from busweave.plans.units import FIELDS

from .conftest import rows

T = dt.datetime

# ---- units -------------------------------------------------------------------------------------------------------------------

SCALES = {
    "efficiency": [(11, "multiply", 1.0), (12, "multiply", 0.01), (13, "multiply", 0.001), (14, "divide", 3.6), (15, "divide", 3600.0), (16, "divide", 1.0)],
    "fixed_cost_eur_mw_a": [(1, "multiply", 1.0), (2, "multiply", 1000.0), (3, "multiply", 1e6), (4, "multiply", 12.0), (5, "multiply", 12000.0), (6, "multiply", 8760.0), (7, "multiply", 4.0)],
}
UNIT_ROWS = "row_id long, efficiency string, efficiency_unit string, fixed_cost_eur_mw_a string, fixed_cost_unit string, remark string, source_file string, extra string"


def _units(spark, data, notes=()):
    df = spark.createDataFrame(data, UNIT_ROWS)
    note = spark.createDataFrame(list(notes), "source_file string, note string")
    out = units.assign_scales(units.stated(df, FIELDS, note, ["row_id"]), SCALES, ["row_id"])
    return {(r.row_id, r.field_name): r for r in out.collect()}


def test_units_rare_scale_in_one_file(spark):
    rng = np.random.default_rng(5)
    common = lambda n: np.round(np.exp(rng.triangular(np.log(8000), np.log(90000), np.log(120000), n)))
    data = [(i, None, None, f"{v:.0f}", "EUR/MW/a", None, f"f{i % 5}", "x") for i, v in enumerate(common(500))]
    data += [(1000 + i, None, None, f"{v:.0f}", None, None, f"f{i % 5}", "x") for i, v in enumerate(common(3000))]
    data += [(9000 + i, None, None, f"{v / 12:.0f}", None, None, "monthly", "x") for i, v in enumerate(common(40))]
    got = _units(spark, data)
    monthly = [got[k, "fixed_cost_eur_mw_a"] for k in range(9000, 9040)]
    assert sum(r.scale_id == 4 for r in monthly) >= 38
    assert all(r.scale_id == 4 for r in monthly if r.number < 5000)
    others = [r for k, r in got.items() if 1000 <= k[0] < 9000]
    assert len(others) == 3000 and all(r.scale_id == 1 or r.uncertain for r in others) and sum(r.scale_id != 1 for r in others) <= 3


def test_units_nearest_statement(spark):
    got = _units(
        spark,
        [
            (1, "35,5 %", "[-]", "45 EUR/kW/a", None, "efficiency: GJ/MWh", "f1", "x"),
            (2, "9.0", "GJ/MWh", "0,045", "M€ per MW p.a.", None, "f1", "x"),
            (3, "38", None, "3 750", None, "12 months data; eta in pct / FOM given as euro per MW, monthly", "f1", "x"),
            (4, "7200", None, "12'000", None, "Variable O&M quoted in EUR/MWh.", "f2", "x"),
            (5, "n/a", None, "siehe Anhang", None, None, "f2", None),
            (6, None, "%", "", None, None, None, None),
            (7, "~0.4 p.u.", None, "eur/(mw*yr) 24000", None, None, "f2", None),
            (8, "≈ 41 % LHV", None, "ca. 8.2 euro per kilowatt and calendar month", None, None, None, None),
        ],
        [("f2", "heat rates as kJ/kWh; capacity fees per quarter, EUR/MW."), ("f1", None)],
    )
    ids = {k: v.scale_id for k, v in got.items()}
    assert ids == {
        (1, "efficiency"): 12, (1, "fixed_cost_eur_mw_a"): 2, (2, "efficiency"): 14, (2, "fixed_cost_eur_mw_a"): 3, (3, "efficiency"): 12, (3, "fixed_cost_eur_mw_a"): 4,
        (4, "efficiency"): 15, (4, "fixed_cost_eur_mw_a"): 7, (7, "efficiency"): 11, (7, "fixed_cost_eur_mw_a"): 1, (8, "efficiency"): 12, (8, "fixed_cost_eur_mw_a"): 5,
    }
    assert got[2, "efficiency"].common_value == pytest.approx(0.4)
    assert got[4, "fixed_cost_eur_mw_a"].common_value == pytest.approx(48000)
    assert {k[0] for k in got} == {1, 2, 3, 4, 7, 8}


def test_units_by_size(spark):
    rng = random.Random(1)
    data, truth = [], {}
    for i in range(600):
        eta, cost = rng.uniform(0.25, 0.6), math.exp(rng.uniform(math.log(9000), math.log(110000)))
        if i < 300:
            data.append((i, f"{eta:.3f} p.u.", None, f"{cost:.0f} EUR/MW/a", None, None, "a", None))
        else:
            pct, k = i % 2, i % 3
            data.append((i, f"{eta * 100:.1f}" if pct else f"{eta:.3f}", None, f"{cost / 1000:.2f}" if k == 0 else f"{cost:.0f}", None, None, "b", None))
            truth[i] = (12 if pct else 11, 2 if k == 0 else 1)
    got = _units(spark, data)
    for i, (e, c) in truth.items():
        assert got[i, "efficiency"].scale_id == e and got[i, "efficiency"].said_by == "size"
        assert got[i, "fixed_cost_eur_mw_a"].scale_id == c


def test_units_empty(spark):
    assert _units(spark, []) == {}


@pytest.mark.parametrize("text,how,factor", [("Mio. €/MW/Jahr", "multiply", 1e6), ("T€/MW/Jahr", "multiply", 1e3), ("MEUR/GW/a", "multiply", 1e3), ("€/kW mtl.", "multiply", 12e3), ("€/MW/h avail.", "multiply", 8760.0), ("EUR/MWh", None, None), ("per kilowatt-year in euro", "multiply", 1e3)])
def test_cost_units(spark, text, how, factor):
    r = spark.range(1).select(units.read_cost_unit(F.lit(text)).alias("u")).first().u
    assert (r.how, r.factor) == (how, factor) if how else r is None


# ---- places ------------------------------------------------------------------------------------------------------------------


def _km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(3)
    pts = [(f"k{i:03}", 50 + rng.gauss(0, 0.01), 9 + rng.gauss(0, 0.01)) for i in range(120)]
    pts += [("date_a", 10.0, 179.9995), ("date_b", 10.0, -179.9995), ("pole_a", 89.9995, 10.0), ("pole_b", 89.9995, -170.0), ("same_a", 1.0, 1.0), ("same_b", 1.0, 1.0), ("same_b", 1.0, 1.0)]
    pts += [("zero", 0.0, 0.0), ("zero2", 0.0, 0.0), ("null", None, 1.0), ("far", 95.0, 0.1), ("nan", float("nan"), 0.1), (None, 1.0, 1.0)]
    good = {(k, la, lo) for k, la, lo in pts if k and la is not None and la == la and abs(la) <= 90 and (la, lo) != (0, 0)}
    want = sorted((a[0], b[0]) for a in good for b in good if a[0] < b[0] and _km(a[1:], b[1:]) <= 0.25)
    df = spark.createDataFrame(pts, "key string, lat double, lon double").withColumn("cell", F.lit(1))
    assert rows(proximity.near_pairs(df, 0.25), "key_a", "key_b") == want
    assert ("date_a", "date_b") in want and ("pole_a", "pole_b") in want
    assert rows(proximity.near_pairs(df, 0.25, hot=[r[0] for r in df.select(F.xxhash64("key")).collect()]), "key_a", "key_b") == want
    assert proximity.near_pairs(df.limit(0), 0.25).count() == 0


def test_regions_holes_and_parts(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    regions = [
        ("outer", json.dumps({"type": "Polygon", "coordinates": [square(0, 0, 10), square(4, 4, 2)[::-1]]})),
        ("inner", json.dumps({"type": "Polygon", "coordinates": [square(4.5, 4.5, 1)]})),
        ("two", json.dumps({"type": "MultiPolygon", "coordinates": [[square(20, 0, 1)], [square(22, 0, 1)]]})),
        ("crossing", json.dumps({"type": "Polygon", "coordinates": [[[-1, 9], [11, 11], [11, 12], [-1, 9]]]})),
        ("broken", "{"), ("none", None), ("point", json.dumps({"type": "Point", "coordinates": [1, 1]})),
    ]
    pts = [("a", 1.0, 1.0), ("hole", 4.2, 4.2), ("core", 5.0, 5.0), ("p1", 0.5, 20.5), ("gap", 0.5, 21.5), ("p2", 0.5, 22.5), ("x", 11.2, 10.5), ("out", -1.0, 5.0), ("null", None, 5.0)]
    p = spark.createDataFrame(pts, "key string, lat double, lon double")
    r = spark.createDataFrame(regions, "region_id string, geometry string").withColumn("strip", F.lit("clash"))
    want = [("a", "outer"), ("core", "inner"), ("p1", "two"), ("p2", "two"), ("x", "crossing")]
    assert rows(proximity.containing_regions(p, r), "key", "region_id") == want
    assert rows(proximity.containing_regions(p, r, strip=3.0, per_task=1), "key", "region_id") == want
    assert proximity.containing_regions(p, r.limit(0)).count() == 0


def test_regions_random_against_ray_casting(spark):
    rng = np.random.default_rng(5)
    regions, rings = [], {}
    for k in range(12):
        c, n = rng.uniform(0, 10, 2), int(rng.integers(3, 12))
        ang = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = (c + np.c_[np.cos(ang), np.sin(ang)] * rng.uniform(0.5, 3, (n, 1))).round(4).tolist()
        rings[f"r{k}"] = ring
        regions.append((f"r{k}", json.dumps({"type": "Polygon", "coordinates": [ring + ring[:1]]})))
    pts = [(f"p{i}", float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(-2, 12, (400, 2)))]

    def inside(x, y, ring):
        hit = False
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            if (xa <= x) != (xb <= x) and ya + (yb - ya) / (xb - xa) * (x - xa) <= y:
                hit = not hit
        return hit

    want = sorted((k, r) for k, la, lo in pts for r, ring in rings.items() if inside(lo, la, ring))
    got = proximity.containing_regions(spark.createDataFrame(pts, "key string, lat double, lon double"), spark.createDataFrame(regions, "region_id string, geometry string"))
    assert rows(got, "key", "region_id") == sorted(want, key=repr)


# ---- schema drift ------------------------------------------------------------------------------------------------------------

ROWS = "file_id long, line_no int, feed string, sender string, delivered_at timestamp_ntz, payload string"


def _files(spark, files, feed="nonres_attributes", sender="s"):
    data = [(fid, n, feed, sender, T(2024, 1, day), p if isinstance(p, (str, type(None))) else json.dumps(p)) for fid, day, payloads in files for n, p in enumerate(payloads, 1)]
    return spark.createDataFrame(data, ROWS)


def _ingested(df):
    return rescue.promote(rescue.ingest(df, NONRES, ["feed", "sender", "file_id", "delivered_at", "line_no"]), NONRES)


def test_schema_changes(spark):
    df = _files(
        spark,
        [
            (9, 1, [{"country": "DE", "eta": 0.4, "units": 2, "note": "x"}, {"country": "DE", "must_run": True}]),
            (4, 2, [{"country": "DE", "eta": 0.4, "units": 2, "note": "x", "must_run": True}]),
            (7, 3, [{"country": "DE", "efficiency": "0,41", "units": None, "must_run": 1}]),
            (5, 4, [{"zone": "DE", "efficiency": 0.4, "units": [3], "must_run": 0}, None, "not json"]),
        ],
    )
    want = sorted([
        (7, "efficiency", "renamed"), (7, "efficiency", "retyped"), (7, "note", "removed"), (7, "must_run", "retyped"),
        (5, "zone", "renamed"), (5, "efficiency", "retyped"), (5, "units", "retyped"),
    ], key=repr)
    assert rows(rescue.schema_changes(_ingested(df.unionByName(df.limit(2))), FEEDS)) == want
    assert rescue.schema_changes(_ingested(df.limit(0)), FEEDS).count() == 0


def test_rescue_and_promote(spark):
    first = {"zone": "DE", "eta": "0,4", "units": {"value": 3}, "strange": [1, 2], "must_run": "yes"}
    df = _files(spark, [(1, 1, [first, {"efficiency": 0.3, "eta": 0.5, "year": "soon"}, None, {}])])
    raw = {x.line_no: x for x in rescue.ingest(df, NONRES, ["line_no"]).collect()}
    assert (raw[1].country, raw[1].efficiency, raw[1].units, raw[1].must_run) == (None, None, 3, True)
    assert json.loads(raw[1]._rescued) == {"zone": "DE", "eta": "0,4", "strange": [1, 2]}
    got = rescue.promote(rescue.ingest(df, NONRES, ["line_no"]), NONRES)
    r = {x.line_no: x for x in got.collect()}
    assert (r[1].country, r[1].efficiency, r[1].units, r[1].must_run) == ("DE", 0.4, 3, True)
    assert json.loads(r[1]._rescued) == {"strange": [1, 2]}
    assert r[2].efficiency == 0.3 and json.loads(r[2]._rescued) == {"eta": 0.5, "year": "soon"}
    assert r[3]._rescued is None and r[4]._rescued is None
    # A list of several values is no string: it stays rescued until a field is approved that it fits.
    again = {y.line_no: y for y in rescue.promote(got, [rescue.TargetField("odd", "string", ("strange",))]).collect()}
    assert again[1].odd is None and json.loads(again[1]._rescued) == {"strange": [1, 2]}


def test_nothing_of_a_value_is_dropped(spark):
    """What isn't typed as a whole is rescued as a whole: lists, units, other keys, nested values, numbers out of range."""
    target = [rescue.TargetField("cost", "double", ("price",), "EUR/MWh"), rescue.TargetField("n", "int", ("count",)), rescue.TargetField("it's", "string")]
    cases = [
        ({"cost": {"value": "1,5", "unit": "eur/mwh"}}, 1.5, None), ({"cost": {"value": 2, "unit": "EUR/kWh"}}, None, {"cost": {"value": 2, "unit": "EUR/kWh"}}), ({"cost": {"value": 2, "note": "x"}}, None, {"cost": {"value": 2, "note": "x"}}),
        ({"cost": [3]}, 3.0, None), ({"cost": [3, 4]}, None, {"cost": [3, 4]}), ({"cost": []}, None, {"cost": []}), ({"cost": [[3]]}, None, {"cost": [[3]]}), ({"cost": {"value": [3]}}, None, {"cost": {"value": [3]}}),
        ({"price": [5], "cost": None}, 5.0, None), ({"price": [5, 6], "cost": 1}, 1.0, {"price": [5, 6]}), ({"cost": "NaN"}, None, {"cost": "NaN"}), ({"n": 1e12, "it's": "a"}, None, {"n": 1e12}), ({"n": 2.5, "count": 3}, None, {"n": 2.5}),
    ]
    out = rescue.promote(rescue.ingest(_files(spark, [(1, 1, [c[0] for c in cases])]), target, ["line_no"]), target)
    got = {r.line_no: r for r in out.collect()}
    for i, (payload, cost, left) in enumerate(cases, start=1):
        assert got[i].cost == cost and (got[i]._rescued and json.loads(got[i]._rescued)) == left, payload
    assert got[12]["it's"] == "a" and got[13].n == 3


def test_names_nobody_approved(spark):
    """An unknown name goes on with the quantity of the name that goes when it comes, unless the two ever stand in one file."""
    df = _files(spark, [(1, 1, [{"country": "DE", "eta": 0.4}]), (2, 2, [{"country": "DE", "wirkungsgrad": 0.4}]), (3, 3, [{"country": "DE", "wirkungsgrad": "x"}]), (4, 4, [{"land": "DE", "wirkungsgrad": "x"}]), (5, 5, [{"land": "DE", "country": "DE", "wirkungsgrad": "x"}])])
    got = rows(rescue.schema_changes(_ingested(df), FEEDS))
    assert got == [(2, "wirkungsgrad", "renamed"), (3, "wirkungsgrad", "retyped"), (4, "country", "removed"), (4, "land", "added"), (5, "country", "added")]


def test_a_quantity_that_comes_back_begins_anew(spark):
    df = _files(spark, [(1, 1, [{"eta": 0.4}]), (2, 2, [{"eta": None}]), (3, 3, [{"eta": "x"}]), (4, 4, [{}]), (5, 5, [{"efficiency": 0.4}])])
    assert rows(rescue.schema_changes(_ingested(df), FEEDS)) == [(3, "eta", "retyped"), (4, "eta", "removed"), (5, "efficiency", "added")]


# ---- orphans -----------------------------------------------------------------------------------------------------------------


def test_orphans(spark):
    buses = spark.createDataFrame([("a", T(2010, 1, 1), T(2015, 1, 1)), ("a", T(2016, 1, 1), None), ("a", T(2016, 1, 1), None), ("b", T(2012, 1, 1), T(2012, 1, 1)), (None, T(2010, 1, 1), None), ("c", None, None)], "bus_id string, f timestamp_ntz, t timestamp_ntz")
    refs = [("a", T(2009, 1, 1)), ("a", T(2010, 1, 1)), ("a", T(2015, 1, 1)), ("a", T(2016, 1, 1)), ("b", T(2012, 6, 1)), ("x", T(2012, 1, 1)), (" \ta ", T(2014, 1, 1)), ("  ", T(2014, 1, 1)), (None, T(2014, 1, 1)), ("A", T(2014, 1, 1)), ("c", T(1900, 1, 1)), ("a", None), ("zz", None)]
    df = spark.createDataFrame([("t", i, k, at, "extra") for i, (k, at) in enumerate(refs)], "table_name string, row_id long, key string, recorded_at timestamp_ntz, periods string")
    df = df.withColumn("key", orphans.clean_reference(F.col("key")))
    ex = orphans.existence_deltas(buses, "bus_id", "f", "t")
    want = [(0, "late"), (12, "missing"), (2, "deleted"), (4, "deleted"), (5, "missing"), (9, "missing")]
    assert rows(orphans.orphan_references(df, ex), "row_id", "orphan_kind") == want
    assert rows(orphans.orphan_references(df, ex, hot=["a"]), "row_id", "orphan_kind") == want
    assert orphans.orphan_report(orphans.orphan_references(df, ex)).agg(F.sum("n_references")).first()[0] == 6
    assert orphans.orphan_references(df.limit(0), ex).count() == 0
    assert rows(orphans.orphan_references(df.where("row_id = 1"), orphans.existence_deltas(buses.limit(0), "bus_id", "f", "t")), "row_id", "orphan_kind") == [(1, "missing")]


def test_withdrawn_references(spark):
    buses = spark.createDataFrame([("a", T(2010, 1, 1), T(2015, 1, 1))], "bus_id string, f timestamp_ntz, t timestamp_ntz")
    schema = "table_name string, row_id long, key string, recorded_at timestamp_ntz"
    refs = spark.createDataFrame([("t", 1, "a", T(2016, 3, 1)), ("t", 2, "a", T(2016, 3, 5)), ("t", 3, "x", T(2016, 3, 1)), ("t", 4, "a", T(2012, 3, 1)), ("t", 5, "a", T(2009, 3, 1))], schema)
    gone = refs.where("row_id in (2, 3, 4)")
    ex = orphans.existence_deltas(buses, "bus_id", "f", "t")
    left = orphans.orphan_report(orphans.orphan_references(orphans.reference_deltas(refs, gone), ex))
    assert rows(left, "month", "orphan_kind", "n_references", "n_keys") == [(T(2009, 3, 1), "late", 1, 1), (T(2016, 3, 1), "deleted", 1, 1)]
    assert orphans.orphan_report(orphans.orphan_references(orphans.reference_deltas(refs, refs), ex)).count() == 0


# ---- rejected rows -----------------------------------------------------------------------------------------------------------


def test_rejected_lines(spark):
    lines = [
        (1, "f", 1, "﻿country;cap;remark\r"), (2, "f", 2, "Germany;1.234,5;ok\r"), (3, "f", 3, 'Germany;"12";"a;b ""c"" d"'), (4, "f", 4, 'Ger"many;12;x'), (5, "f", 5, "Germany;12"), (6, "f", 6, "12;5;x"),
        (7, "f", 7, "DE;-5;x"), (8, "f", 8, "DE; ;x"), (9, "f", 9, 'DE;"5;x'), (10, "f", 10, "DE;1e999;x"), (11, "f", 11, "DE;5 MW;x"), (12, "f", 12, 'DE;5;"a\nb"'), (13, "f", 13, None), (14, "f", 14, ""),
        (15, "g", 2, "no;header"), (16, "f", 16, "Bosnia (BA), R. of/'x' & y-z;+1,234.5e+02;x"), (17, "f", 17, "D@E;nan;x"), (18, "f", 18, "DE;1'000;x"), (19, "f", 19, "DE;1 000,5;x"), (20, "f", 20, '"DE" x;1;y'), (2, "f", 2, "Germany;1.234,5;ok\r"),
    ]
    df = spark.createDataFrame(lines, "line_id long, file_name string, line_no int, raw_line string").withColumns({"delimiter": F.lit("clash"), "names": F.lit("clash"), "fields": F.lit("clash")})
    checked = reject.check_lines(df)
    want = {4: "quoting", 5: "column_count", 6: "bad_country", 7: "bad_cap", 9: "quoting", 10: "bad_cap", 11: "bad_cap", 13: "column_count", 14: "column_count", 15: "column_count", 17: "bad_country", 20: "quoting"}
    assert dict(rows(reject.rejected(checked))) == want
    good = {r.line_id: r for r in reject.accepted(checked, {"country": "string", "cap": "number", "remark": "string"}).collect()}
    assert set(good) == {2, 3, 8, 12, 16, 18, 19}
    assert good[2].cap == 1234.5 and good[3].remark == 'a;b "c" d' and good[8].cap is None and good[16].cap == 123450.0 and good[18].cap == 1000 and good[19].cap == 1000.5
    assert dict(rows(reject.rejected(reject.check_lines(df, hot=["f"])))) == want
    assert reject.rejected(reject.check_lines(df.limit(0))).count() == 0


def test_very_long_line(spark):
    long = "x" * 300_000
    df = spark.createDataFrame([(1, "f", 1, "country,cap"), (2, "f", 2, f'"{long}""{long}",5'), (3, "f", 3, '"' * 50_001 + ",5")], "line_id long, file_name string, line_no int, raw_line string")
    assert rows(reject.rejected(reject.check_lines(df))) == [(2, "bad_country"), (3, "quoting")]


# ---- implausible readings ----------------------------------------------------------------------------------------------------


def _season(rng, years=4, level=1000.0):
    w = np.arange(52)
    base = level * np.exp(0.8 * np.sin(2 * np.pi * (w - 10) / 52))
    return np.concatenate([base * np.exp(rng.normal(0, 0.1, 52)) for _ in range(years)])


def test_judge_kinds():
    rng = np.random.default_rng(2)
    x = np.stack([_season(rng) for _ in range(6)])
    x[0, [30, 31]] *= 8
    x[0, 100] /= 50
    x[1, 60:70] = x[1, 60]
    x[2, 12] = -5
    x[3, [20, 72, 124, 176]] *= 9  # the same week of every year
    x[4, 50:57] *= 10  # a shift of seven weeks is no spike
    x[5, 40:52] = 0
    x[5, 92:104] = 0
    x[5, 144:156] = 0
    x[5, 196:208] = 0  # frozen every winter
    kind, _, _, _ = outliers.judge(x, None, 52)
    assert np.flatnonzero(kind[0]).tolist() == [30, 31, 100] and set(kind[0][[30, 31, 100]]) == {3}
    assert np.flatnonzero(kind[1] == 4).tolist() == list(range(60, 70))
    assert np.flatnonzero(kind[2]).tolist() == [12] and kind[2, 12] == 1
    assert not kind[3].any() and not kind[4].any() and not kind[5].any()


def test_judge_steady_and_limits():
    x = np.full((3, 104), 45.0)
    top = np.full((3, 104), 60.0)
    x[0, 10], x[0, 20:24], x[0, 50:70] = 45000, 0.5, 25.0
    x[1, 5] = 60.7
    x[2, :] = np.nan
    kind, _, _, _ = outliers.judge(x, top, 52)
    assert kind[0, 10] == 2 and (kind[0, 20:24] == 3).all() and not kind[0, 50:70].any() and (kind[0] > 0).sum() == 5
    assert np.flatnonzero(kind[1]).tolist() == [5] and not kind[2].any()


def test_implausible_rows(spark):
    rng = np.random.default_rng(7)
    data, n = [], 0
    for s in ("a", None):
        for t, v in enumerate(_season(rng)):
            data.append((n, s, 2001 + t // 52, t % 52 + 1, float(v), None))
            n += 1
    bad = {20: 99999.0, 300: -1.0}
    data = [(i, s, y, w, bad.get(i, v), lim) for i, s, y, w, v, lim in data]
    data += [data[20], (n, "a", None, 3, -2.0, None), (n + 1, "a", 2001, None, 5.0, 1.0), (n + 2, "a", 2001, 5, None, None), (n + 3, "a", 2001, 6, float("nan"), None), (n + 4, "b", 2001, 1, 3.0, None)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "row_id long, s string, y int, w int, v double, lim double").withColumn("h1", F.lit("clash"))
    got = rows(outliers.implausible(df, ["s"], "y", "w", "v", limit="lim"), "row_id", "kind")
    assert got == sorted([(20, "spike"), (300, "negative"), (n, "negative"), (n + 1, "limit")], key=repr)
    assert outliers.implausible(df.limit(0), ["s"], "y", "w", "v").count() == 0


# ---- skew --------------------------------------------------------------------------------------------------------------------


def test_salted_join_keeps_all(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.range(1).select(F.lit(1).cast("long").alias("k"), F.lit(7).cast("long").alias("v")))
    plain = rows(left.join(right, "k", "left"), "id", "k", "v")
    assert rows(skew.salted_join(left, right, "k", hot=[1]), "id", "k", "v") == plain
    assert skew.hot_keys(left, "k", share=0.2, least_rows=10) == [1]


def test_noise_widens_what_counts_as_the_level():
    """A spike of 4.2 times is one where the level is only roughly known, and none where it is known well."""
    rng = np.random.default_rng(5)
    for noise, want in ((0.25, 3), (0.02, 0)):
        x = np.exp(rng.normal(0, noise, (1, 104)) + 4)
        x[0, 50] = np.median(x) * 4.2
        kind, low, high, limit = outliers.judge(x, None, 52)
        assert np.log(5) / 2 <= limit[0, 0] <= np.log(5)
        assert kind[0, 50] == (want if x[0, 50] / high[0, 50] >= np.exp(limit[0, 0]) else 0) and (np.delete(kind[0], 50) == 0).all()
    shift = np.exp(rng.normal(0, 0.05, (1, 104)) + np.where(np.arange(104) < 60, 3, 5))
    assert (outliers.judge(shift, None, 52)[0] == 0).all()


def test_salts_follow_the_size_of_the_hottest_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 1000)
    left = spark.range(90_000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, name string")
    counts = skew.hot_counts(left, "k")
    assert counts == {0: 60_000}
    out = skew.salted_join(left, right, "k", salt_by=["v"], hot=counts)
    assert out.count() == 90_000 and out.where("k = 0 and name = 'a'").count() == 60_000


def test_steps_are_removed(spark):
    import os

    from busweave import session

    session.clear_steps(spark)
    df = session.materialise(spark.range(5), "kept")
    path = session._steps[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.clear_steps(spark) == 1 and not os.path.isdir(path) and session.clear_steps(spark) == 0
