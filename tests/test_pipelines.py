"""Readers, writers, pipelines and streams end to end on small inputs."""

import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busweave.operators import kernels
from busweave.plans import benchmark, flexible, grid, hydro, load, renewables, siting
from busweave.sources import files, sinks, xlsx
from busweave.streaming.disaggregate import disaggregate_stream, weekly_stream

from .conftest import rows


# ---- sources and sinks -------------------------------------------------------------------------------------------------------


def test_read_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿ Country ;"Total, load";x\nDE;"1;5";\n;2;y\n')
    df = files.read_delimited(spark, str(p))
    assert df.columns == ["Country", "Total, load", "x"] and rows(df) == sorted([("DE", "1;5", None), (None, "2", "y")], key=repr)
    t = files.typed(df, {"country": ("string", ["country"]), "load": ("double", ["total load"]), "gone": ("double", ["nothing"])}, required=False)
    assert rows(t.where("country = 'DE'"), "load", "gone") == [(None, None)]
    with pytest.raises(KeyError):
        files.typed(df, {"gone": ("double", ["nothing"])})
    assert files.sniff_delimiter("a;b,c", default=",") == "," and files.sniff_delimiter("abc") == ";" and files.sniff_delimiter("a\tb\tc;d") == "\t"
    with pytest.raises(ValueError):
        files.read_expecting(spark, str(p), ["nope"])


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"properties": {"index": "r1", "country": "DE", "pop": "5", "gdp": None}, "geometry": {"type": "Polygon", "coordinates": [ring, hole]}}, {"properties": {"index": "r2", "country": "FR"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(doc))
    got = {r.region_id: r for r in files.read_regions(spark, str(tmp_path / "r.geojson")).collect()}
    assert got["r2"].lat == pytest.approx(2) and got["r2"].lon == pytest.approx(2) and got["r1"].pop == 5.0
    assert got["r1"].lon == pytest.approx((16 * 2 - 4 * 1) / 12)


def _workbook(path, cells):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    strings = sorted({v for v in cells.values() if isinstance(v, str)})
    body = "".join(f'<c r="{k}" t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{k}"><v>{v}</v></c>' for k, v in cells.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{body}</row></sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    _workbook(tmp_path / "w.xlsx", {"A1": "note", "A3": "Date", "B3": "Hour", "C3": "DE00", "AA3": "FR00", "A4": "01.01.", "B4": 1, "C4": 5.5, "AA4": 7, "A5": "01.01.", "B5": 2, "C5": 6})
    got = xlsx.read_cells(spark, str(tmp_path), "Data")
    assert got.where("row = 3 and col = 27").first().value == "FR00"
    assert rows(xlsx.hourly_rows(got), "label", "hour", "timestep", "value") == [("DE00", 1, 0, 5.5), ("DE00", 2, 1, 6.0), ("FR00", 1, 0, 7.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.5, 1.25, None), ("b", 3.5, -1e-12, 7.0)], "k string, cap_mw double, x double, y_mw double")
    sinks.write_table(df, str(tmp_path / "t"))
    assert rows(files.read_delimited(spark, str(tmp_path / "t")), "k", "cap_mw", "y_mw") == [("a", "2", None), ("b", "4", "7")]
    assert rows(sinks.fixed_decimals(df, {"x": 2}), "x") == [("0.00",), ("1.25",)]
    text = sinks.write_manifest(spark, str(tmp_path / "m"), {"year": 2030}, {"in": "p"}, sinks.totals_of(df, ["x"]))
    assert json.loads(text)["totals"]["rows"] == 2
    sinks.write_series(df, str(tmp_path / "s"), ["k"])
    assert spark.read.parquet(str(tmp_path / "s")).where("k = 'a'").count() == 1


def test_guards(spark):
    df = spark.createDataFrame([("2030", "X"), ("2040", "Y")], "year string, scenario string")
    assert files.for_year(df, "x", 2030).count() == 1 and files.for_scenario(df, "x ").count() == 1 and files.for_scenario(df, "none").count() == 2 and files.for_scenario(df, "none", strict=True).count() == 0
    with pytest.raises(ValueError):
        files.for_year(df.drop("year"), "data/2030_2040.csv", 2030)
    assert files.for_year(df.drop("year"), "data/2030.csv", 2030).count() == 2
    m = spark.createDataFrame([("DE", "X", None), ("DE", "X", None)], "source_country string, target_country string, target_label string")
    assert rows(files.country_map(m)) == [("DE", "X", "X")]


def test_metered_load(spark, tmp_path):
    (tmp_path / "l.csv").write_text("DateTime(UTC)\tAreaMapCode\tTotalLoad[MW]\tResolutionCode\n2023-01-01 00:00:00\tDE\t100\tPT15M\n2023-01-01 00:15:00\tDE\t300\tPT15M\n01.01.2023 01:00\tDE\t500\tPT1H\n2022-01-01 00:00:00\tDE\t9\tPT1H\n")
    assert files.read_metered_load(spark, str(tmp_path / "l.csv"), 2023).first().mean_load == pytest.approx((100 * 0.25 + 300 * 0.25 + 500) / 1.5)


# ---- load, transfer, flexibility ---------------------------------------------------------------------------------------------


def test_load(spark):
    m = spark.createDataFrame([("LU", "DE"), ("NI", "GB")], "source_country string, target_country string")
    raw = spark.createDataFrame([("DE", "10", 1), ("LU", "2,5", 1), ("LU", " ", 1), ("LU", "x", 1), ("NI", "4", 1), ("XX", "1", 1)], "country string, load string, t int")
    total, skipped = load.national_load(raw, m, "load", ["t"], spark.createDataFrame([("XX",)], "country string"))
    assert rows(total, "country_model", "load", "source_countries") == [("DE", 12.5, "DE,LU"), ("NI", 4.0, "NI")]
    assert rows(skipped, "reason", "n") == [("blank", 1), ("unreadable", 1)]
    shares = spark.createDataFrame([("DE", "b1", 0.2), ("DE", "b2", 0.8)], "country string, bus string, share double")
    assert rows(load.disaggregate(total, shares, skip_missing=True), "bus", "allocated") == [("b1", 2.5), ("b2", 10.0)]
    with pytest.raises(Exception, match="no shares for"):
        load.disaggregate(total, shares).collect()


def test_transfer_limits(spark):
    m = spark.createDataFrame([("LU", "DE")], "source_country string, target_country string")
    raw = spark.createDataFrame([("DE00-FR00", "10", "5"), ("FR00-DE00", "3", None), ("DEDC - FR00", "1", "1"), ("LU00-DE00", "9", "9"), ("CH00-IT00", "2", "4")], "border string, forward string, backward string")
    got = flexible.transfer_limits(raw, m, spark.createDataFrame([("IT",)], "country string"))
    assert rows(got, "first", "second", "to_mw", "from_mw", "kind") == [("DE", "FR", 11.0, 9.0, "mixed")]


def test_bands_and_availability(spark):
    m = spark.createDataFrame([("LU", "DE")], "source_country string, target_country string")
    shares = spark.createDataFrame([("DE", "b1", 0.25), ("DE", "b2", 0.75), ("DE", "b3", 0.0)], "country string, bus string, share double")
    bands = spark.createDataFrame([("DE", "DE00", 1, 100.0, 4.0), ("LU", "LU00", 1, 20.0, 1.0)], "country string, market_node string, band_id int, installed_capacity_mw double, units double")
    got = flexible.bus_bands(bands, shares, m)
    assert got.count() == 4 and got.agg(F.sum("installed_capacity_mw")).first()[0] == pytest.approx(120)
    p = spark.createDataFrame([("DE", 0, 50.0, 100.0), ("LU", 0, 0.0, 100.0), ("DE", 1, 0.0, 0.0)], "country string, timestep int, available_capacity_mw double, installed_capacity_mw double")
    assert rows(flexible.bus_availability(p, shares, m, ["timestep"]), "bus", "timestep", "availability_factor") == [("b1", 0, 0.25), ("b1", 1, 0.0), ("b2", 0, 0.25), ("b2", 1, 0.0)]
    sheet = spark.createDataFrame([("f", 1, 1, "Price"), ("f", 2, 1, "Capacity"), ("f", 1, 2, "80"), ("f", 2, 2, "5"), ("f", 2, 3, "7"), ("f", 3, 1, "other")], "file string, row int, col int, value string")
    assert rows(flexible.response_bands(sheet, {"Price": "price", "Capacity": "mw"}), "band_col", "price", "mw") == sorted([(2, "80", "5"), (3, None, "7")], key=repr)


# ---- siting ------------------------------------------------------------------------------------------------------------------


def test_thermal(spark):
    groups = spark.createDataFrame([("DE", "B04", "CCGT", 500.0, 5), ("DE", "B02", "STEAM", 300.0, 3), ("DE", "B14", "NUCLEAR", 200.0, 2)], "country string, fuel_code string, tech string, capacity_mw double, n_units int")
    plants = spark.createDataFrame([("DE", "B04", "CCGT", "b1", 300.0, 3.0, True), ("DE", "B04", "OCGT", "b3", 10.0, 1.0, False), ("DE", "B04", "CCGT", "b2", 100.0, 1.0, False)], "country string, fuel_code string, tech string, bus_id string, capacity_mw double, n_plants double, chp boolean")
    priority = spark.createDataFrame([("DE", "b1", 1), ("DE", "b2", 2)], "country string, bus_id string, rank int")
    sites = spark.createDataFrame([("DE", "s1", "lignite", 150.0, 2028)], "country string, site string, fuel_group string, capacity double, date_out int")
    got = siting.thermal_units(siting.target_groups(groups), plants, priority, sites)
    assert rows(got, "fuel_code", "bus_id", "stage", "assigned") == [("B02", "b1", "bus_sequence", 1), ("B02", "s1", "decommissioned_lignite", 2), ("B04", "b1", "fuel_tech", 4), ("B04", "b2", "fuel_tech", 1), ("B14", "b1", "bus_sequence", 1), ("B14", "b2", "bus_sequence", 1)]
    d = spark.createDataFrame([("DE", "B04", "CCGT", 3.0, 5.0)], "country string, fuel_code string, tech string, weeks double, long_weeks double")
    assert rows(siting.with_revisions(got, d), "fuel_code", "revision_weeks")[0] == ("B02", 4.0)  # steam without a listed duration: 4 weeks


def test_batteries(spark):
    t = siting.battery_targets(spark.createDataFrame([("DE", 10.0, 8.0, 40.0, 0.9), ("DE", 30.0, 24.0, 120.0, 0.5), ("FR", 6.0, 6.0, 6.0, None)], "country string, discharge_mw double, charge_mw double, energy_mwh double, eff double"))
    buses = spark.createDataFrame([("DE", "a"), ("DE", "b"), ("FR", "c"), ("FR", "d")], "country string, bus string")
    cur = spark.createDataFrame([("DE", "a", 1.0)], "country string, bus string, capacity_mw double")
    res = spark.createDataFrame([("DE", "a", 1.0), ("DE", "b", 2.0)], "country string, bus string, weight_mw double")
    got = {r.bus: r for r in siting.batteries(t, cur, res, spark.createDataFrame([], "country string, bus string, share double"), buses).collect()}
    assert got["a"].discharge_mw == pytest.approx(20) and got["a"].current_part_mw == pytest.approx(10) and got["b"].energy_mwh == pytest.approx(80) and got["c"].rule == "uniform" and got["d"].discharge_mw == pytest.approx(3)
    assert got["a"].eff == pytest.approx(24 / 40)


def test_other_renewables(spark):
    t = spark.createDataFrame([("DE", "bio", 10.0), ("DE", "marine", 4.0), ("FR", "bio", 3.0)], "country string, kind string, target_mw double")
    basis = spark.createDataFrame([("DE", "bio", "b1", 3.0)], "country string, kind string, bus string, capacity_mw double")
    sites = spark.createDataFrame([("DE", "b2", "bio", 2.0, 2028)], "country string, site string, fuel_group string, capacity double, date_out int")
    off = spark.createDataFrame([("DE", "b1", True), ("DE", "b2", True), ("DE", "b9", True)], "country string, bus string, eligible boolean")
    shares = spark.createDataFrame([("DE", "b1", 0.5), ("DE", "b2", 0.5)], "country string, bus string, share double")
    got, left = siting.other_renewables(t, basis, sites, off, shares)
    assert rows(got, "kind", "bus", "mode", "capacity_mw") == [("bio", "b1", "existing_basis", 3.0), ("bio", "b1", "uniform", 2.5), ("bio", "b2", "decommissioned", 2.0), ("bio", "b2", "uniform", 2.5), ("marine", "b1", "offshore_eligible", 2.0), ("marine", "b2", "offshore_eligible", 2.0)]
    assert rows(left, "country", "kind", "left_over") == [("DE", "bio", 0.0), ("DE", "marine", 0.0), ("FR", "bio", 3.0)]


def test_cost_attributes(spark):
    df = spark.createDataFrame([(1, "40", "80", "3", None), (2, None, "80", None, "55"), (3, None, None, None, None)], "i int, eta string, fom_eur_kw_a string, vom_eur_mwh string, costs_eur_mwh string").withColumn("fuel_price_eur_gj", F.lit("5"))
    got = {r.i: r for r in siting.cost_attributes(df).collect()}
    assert got[1].efficiency == 0.4 and got[1].fixed_cost_eur_mw_a == 80000 and got[1].marginal_cost_eur_mwh == pytest.approx(3 + 45) and got[1].marginal_cost_status == "calculated_components"
    assert got[2].marginal_cost_status == "direct_eur_mwh" and got[3].marginal_cost_status == "missing"


# ---- hydro -------------------------------------------------------------------------------------------------------------------


def test_hydro(spark):
    cap = spark.createDataFrame([("DE", "wr", "open_loop", 100.0, 0.0, 50.0), ("DE", "phs", "open_loop", 40.0, 30.0, 20.0), ("AT", "phs", "closed_loop", 10.0, 9.0, 5.0), ("CH", "ror", "open_loop", 0.0, 0.0, 0.0)], "country string, plant_type string, technology string, installed_turb_mw double, installed_pump_mw double, installed_storage_mwh double")
    m = hydro.resolve_pumped(cap)
    assert rows(m, "country", "plant_type", "to_type", "to_technology") == [("AT", "phs", "wr", "closed_loop"), ("DE", "phs", "wr", "open_loop"), ("DE", "wr", "wr", "open_loop")]
    merged = hydro.merged_capacity(cap, m)
    assert rows(merged.where("country = 'DE'"), "plant_type", "installed_turb_mw", "installed_pump_mw") == [("wr", 140.0, 0.0)]
    cur = spark.createDataFrame([("DE", "wr", "b1", 60.0, 10.0), ("DE", "ror", "b2", 40.0, 0.0), ("DE", "wr", "b3", 20.0, 30.0)], "country string, plant_type string, bus string, turb double, storage double")
    ld = spark.createDataFrame([("AT", "a1", 5.0), ("AT", "a2", 7.0)], "country string, bus string, load double")
    t = hydro.target_rows(merged, cur, ld)
    got = {(r.country, r.bus): r for r in t.collect()}
    # 140 wanted, 80 there: 40 of the growth moves in from run of river at b2, 20 is new at the largest site.
    assert got["DE", "b2"].target_turb_mw == pytest.approx(40) and got["DE", "b1"].target_turb_mw == pytest.approx(80) and got["DE", "b3"].target_turb_mw == pytest.approx(20)
    assert got["DE", "b1"].allocation_rule.startswith("turb=existing_country_plant_type_shares;internal_type_shift;true_new_highest_hydro_bus")
    assert got["AT", "a2"].target_turb_mw == pytest.approx(10) and ("AT", "a1") not in got
    weekly = spark.createDataFrame([("DE", "wr", "open_loop", 1, 200.0, None, 0.7)], "country string, plant_type string, technology string, week int, max_turb_mw double, min_turb_mw double, max_turb_pu double")
    b = hydro.bounded_constraints(weekly, merged)
    assert b.first().max_turb_mw == 140.0 and b.first().min_turb_mw == 0.0 and b.first().imputed == "yes"
    cons = hydro.constraint_rows(b.drop("installed_turb_mw", "installed_pump_mw", "installed_storage_mwh"), t)
    assert cons.agg(F.sum("max_turb_mw")).first()[0] == pytest.approx(140) and {r.max_turb_pu for r in cons.collect()} == {0.7}


def test_hydro_inflows(spark):
    key = "country string, plant_type string, technology string, weather_year int, week int, inflow double"
    weeks = range(1, 53)
    raw = [("DE", "wr", "open_loop", y, w, 0.0 if y == 2002 else (None if w == 10 else float(w))) for y in (2001, 2002) for w in weeks]
    raw += [("DE", "phs", "open_loop", 2001, w, 1.0) for w in weeks] + [("FR", "ror", "open_loop", 2001, w, None) for w in weeks]
    clean = hydro.clean_inflows(spark.createDataFrame(raw, key))
    assert clean.where("country = 'DE' and plant_type = 'wr' and week = 10").agg(F.min("inflow"), F.max("inflow")).first() == (10.0, 10.0)
    mapping = spark.createDataFrame([("DE", "wr", "open_loop", "wr", "open_loop"), ("DE", "phs", "open_loop", "wr", "open_loop"), ("FR", "ror", "open_loop", "ror", "open_loop")], "country string, plant_type string, technology string, to_type string, to_technology string")
    targets = spark.createDataFrame([("DE", "wr", "open_loop", "b1", 30.0), ("DE", "wr", "open_loop", "b2", 10.0), ("FR", "ror", "open_loop", "f1", 5.0)], "country string, plant_type string, technology string, bus string, target_turb_mw double")
    total = spark.createDataFrame([("FR", 2001, w, 8.0) for w in weeks], "country string, weather_year int, week int, inflow double")
    by_type = spark.createDataFrame([("FR", "ror", 2001, 1, 6.0)], "country string, plant_type string, weather_year int, week int, inflow double")
    g = hydro.inflow_groups(clean, mapping, targets, total, by_type)
    n = {r.source: r.n for r in g.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"tyndp_resolved_open_loop": 104, "tyndp_phs_open_redirect_to_natural_hydro": 52, "nc_tech_missing_combo": 1, "nc_total_missing_combo": 51}
    out = hydro.check_budget(g, hydro.inflow_rows(g, targets))
    assert out.agg(F.sum("allocated_inflow_mwh_week")).first()[0] == pytest.approx(g.agg(F.sum("inflow")).first()[0])
    assert rows(out.where("country = 'DE' and week = 4 and weather_year = 2001 and source like '%resolved%'"), "bus", "allocated_inflow_mwh_week") == [("b1", 3.0), ("b2", 1.0)]
    with pytest.raises(Exception, match="budget broken"):
        hydro.check_budget(g, hydro.inflow_rows(g, targets).withColumn("allocated_inflow_mwh_week", F.col("allocated_inflow_mwh_week") * 2)).collect()


# ---- renewables --------------------------------------------------------------------------------------------------------------


def test_renewables(spark):
    cells = spark.createDataFrame([(1, 1, 1, "DE", "b1", 5.0, 2), (2, 1, 2, "DE", "b1", 5.0, 1), (3, 2, 1, "DE", "b2", 4.0, 2)], "cell int, row_ix int, col_ix int, country string, bus_id string, p_nom_max_mw double, resource_class int")
    cur = renewables.current_by_cell(cells, spark.createDataFrame([("b1", 2.0)], "bus_id string, capacity_mw double"))
    out, report = renewables.scenario_cells(cur, spark.createDataFrame([("DE", 11.0)], "country string, target double"))
    assert out.agg(F.sum("scenario_capacity_mw")).first()[0] == pytest.approx(11) and report.first().remainder == pytest.approx(0)
    series = spark.createDataFrame([(0, 1, 1, 0.5), (0, 1, 2, 0.1), (0, 2, 1, None), (1, 1, 1, 0.0), (1, 1, 2, 0.0), (1, 2, 1, 0.0)], "t int, row_ix int, col_ix int, cf double")
    nat = spark.createDataFrame([("DE", 0, 100.0), ("DE", 1, 50.0)], "country string, t int, generation double")
    nodes = spark.createDataFrame([("b1", "DE"), ("b2", "DE")], "bus_id string, country string")
    got = rows(renewables.generation(nat, series, out, nodes, ["t"]), "t", "bus_id", "mode", "generation")
    assert got[0] == (0, "b1", "scaled", pytest.approx(100)) and got[2][2] == "profile_zero"


# ---- grid --------------------------------------------------------------------------------------------------------------------


def _grid(spark):
    ids = [f"n{i}" for i in range(8)]
    buses = spark.createDataFrame([(b, "DE", 50.0 + (i // 4) * 2 + (i % 4) * 0.01, 9.0, 380.0, "f") for i, b in enumerate(ids)] + [("low", "DE", 50.0, 9.0, 110.0, "f"), ("dc1", "DE", 50.0, 9.0, 380.0, "t")], "bus_id string, country string, lat double, lon double, voltage double, dc_bool string")
    pairs = [(a, b) for half in (ids[:4], ids[4:]) for i, a in enumerate(half) for b in half[i + 1 :]] + [("n3", "n4")]
    lines = spark.createDataFrame([(f"l{i}", a, b, 0.1, 0.1 if (a, b) != ("n3", "n4") else 5.0, None if i == 0 else 100.0, 10.0, 380.0) for i, (a, b) in enumerate(pairs)], "line_id string, bus0 string, bus1 string, r double, x double, s_nom double, length double, voltage double")
    return grid.prepare_buses(buses), grid.prepare_lines(lines)


def test_grid_reduction(spark):
    buses, lines = _grid(spark)
    lines = grid.impute_ratings(lines, buses)
    assert lines.where("line_id = 'l0'").first().s_nom == 100.0
    t = spark.createDataFrame([("low", "n0", 50.0)], "a string, b string, s_nom double")
    kept, _, mapping = grid.to_upper_level(buses, lines, t)
    assert dict(rows(mapping))["low"] == "n0" and kept.where("bus_id = 'n0'").first().members == 2
    weighted = kept.where("not dc_bool").withColumn("weight", F.lit(1.0))
    out = grid.reduce_network(weighted, lines, 2)
    by = {}
    for b, c in rows(out["nodes"], "bus_id", "cluster_id"):
        by.setdefault(c, set()).add(b)
    assert sorted(map(sorted, by.values())) == [["n0", "n1", "n2", "n3"], ["n4", "n5", "n6", "n7"]]
    assert rows(out["branches"], "r", "x", "rating", "n_branches") == [(pytest.approx(0.1), pytest.approx(5.0), 100.0, 1)]
    corridors = benchmark.cluster_corridors(lines, out["nodes"])
    assert benchmark.corridor_metrics(corridors, corridors).first().jaccard == 1.0
    assert benchmark.compactness(out["nodes"].join(weighted.select("bus_id", "lat", "lon"), "bus_id")).count() == 2
    w = grid.edge_weights(lines)
    nodes = out["nodes"].select(F.lit("g").alias("group"), F.col("bus_id").alias("node"), F.col("cluster_id").alias("cluster"), F.lit(1.0).alias("weight"))
    red = corridors.select(F.lit("g").alias("group"), F.col("first").alias("a"), F.col("second").alias("b"), F.col("b").alias("w"))
    f = benchmark.transfer_fidelity(nodes, w.withColumn("group", F.lit("g")), red, samples=5)
    assert f.count() == 5 and f.agg(F.max("nrmse")).first()[0] == pytest.approx(0, abs=1e-6)


def _mesh(side, seed=3):
    """Edges (a, b, w) of a square mesh, some of them twice, and a lone pair of nodes."""
    rng = np.random.default_rng(seed)
    node = np.arange(side * side).reshape(side, side)
    a = np.concatenate([node[:, :-1].ravel(), node[:-1].ravel(), [0, side * side]])
    b = np.concatenate([node[:, 1:].ravel(), node[1:].ravel(), [1, side * side + 1]])
    return side * side + 2, a, b, rng.uniform(0.5, 2, len(a))


def test_sparse_angles():
    n, a, b, w = _mesh(12)
    p = np.random.default_rng(4).normal(size=(n, 3))
    m = kernels.weight_matrix(n, a, b, w)
    want = np.zeros_like(p)
    for at in (np.arange(n - 2), np.array([n - 2, n - 1])):
        want[at] = kernels.dc_angles(m[np.ix_(at, at)], p[at])
    np.testing.assert_allclose(kernels.sparse_angles(n, *kernels.merged_edges(n, a, b, w), p), want, atol=1e-9)


def test_networks_of_more_than_the_dense_kernels_take(spark):
    n, a, b, w = _mesh(55)
    assert n > kernels.MAX_NODES
    e = spark.createDataFrame(pd.DataFrame({"group": "g", "a": a, "b": b, "w": w}))
    p = np.random.default_rng(6).normal(size=n)
    flows = kernels.dc_flows(spark.createDataFrame(pd.DataFrame({"group": "g", "node": np.arange(n), "p": p})), e, "group").toPandas()
    out = np.bincount(flows["a"], weights=flows["flow"], minlength=n) - np.bincount(flows["b"], weights=flows["flow"], minlength=n)
    slack = [0, n - 2]
    np.testing.assert_allclose(np.delete(out, slack), np.delete(p, slack), atol=1e-8)
    # Clusters are quarters of the mesh; the reduced corridors are the sums of the raw lines between them.
    side = 55
    cluster = np.append((np.arange(side * side) // side >= 27) * 2 + (np.arange(side * side) % side >= 27), [0, 0])
    nodes = spark.createDataFrame(pd.DataFrame({"group": "g", "node": np.arange(n), "cluster": cluster, "weight": 1.0}))
    cross = pd.DataFrame({"group": "g", "a": cluster[a], "b": cluster[b], "w": w}).query("a != b")
    got = benchmark.transfer_fidelity(nodes, e, spark.createDataFrame(cross), samples=4).toPandas()
    assert len(got) == 4 and got["nrmse"].notna().all() and (got["cosine"] > 0.9).all()


def test_projects_and_pruning(spark):
    buses, lines = _grid(spark)
    p = spark.createDataFrame([("p1", 2028, False, 380.0, 50.0, 9.0, 50.01, 9.0), ("p2", 2028, False, 380.0, 50.0, 9.0, 52.0, 9.0), ("p3", 2045, False, 380.0, 50.0, 9.0, 52.0, 9.0), ("p4", 2020, True, 220.0, 50.0, 9.0, 50.01, 9.0)], "project_id string, build_year int, upgraded boolean, v_nom double, lat0 double, lon0 double, lat1 double, lon1 double")
    got = dict(rows(grid.diagnose_projects(p, buses.where("voltage >= 380"), lines, 2030, 2025), "project_id", "action"))
    assert got == {"p1": "review_existing_corridor_or_parallel_line", "p2": "candidate_add_new_line", "p3": "skip_after_target_year", "p4": "manual_review_no_line_template"}
    empty = spark.createDataFrame([], "a string, b string, p_nom double, length double")
    conv = spark.createDataFrame([], "ac string, dc string, p_nom double")
    out = grid.prune(buses.withColumns({"members": F.lit(1), "weight": F.lit(1.0)}), lines, empty, conv, cross_border=True)
    assert {r.node for r in out["unused"].collect()} == {"low", "dc1"}


# ---- streams -----------------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows_ = [("DE", dt.datetime(2024, 1, 1 + i), 10.0) for i in range(14)]
    spark.createDataFrame(rows_, "country string, time timestamp, load double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("country string, time timestamp, load double").parquet(str(tmp_path / "in"))
    shares = spark.createDataFrame([("DE", "b1", 0.3), ("DE", "b2", 0.7)], "country string, bus string, share double")
    for name, df, mode in (("alloc", disaggregate_stream(stream, shares), "append"), ("weeks", weekly_stream(stream, ["country"], "time", "load", start="4 days"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("alloc").agg(F.sum("allocated")).first()[0] == pytest.approx(140)
    assert spark.table("weeks").agg(F.sum("load")).first()[0] == 140.0
