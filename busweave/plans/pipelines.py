"""The domain pipelines on the domain tables and the star schema, each with DuckDB SQL of the same result.

Records that arrive twice count once. Numbers are rounded late, in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as fn
from ..operators import aggregate as ag, allocate as al, joining as jo, series as se
from ..session import materialise, table
from . import benchmark, flexible, grid, hydro, load, renewables, siting
from .tables import _FLOWS, _KM, _flows, _lat, _lon

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _once(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).distinct()


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- load --------------------------------------------------------------------------------------------------------------------

_OPEN = "buses_with_clusters where valid_to is null and bus_id is not null and country is not null and cluster_id is not null and lat between -90 and 90 and lon between -180 and 180"
_BUSES = f"buses as (select country, bus_id, min(cluster_id) as cluster_id, min(lat) as lat, min(lon) as lon from {_OPEN} group by 1, 2)"


def _buses(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buses_with_clusters").where(_OPEN.split(" where ")[1])
    return b.groupBy("country", "bus_id").agg(F.min("cluster_id").alias("cluster_id"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))


@_query(
    "node_load_shares",
    f"""with {_BUSES}, own as (select country, region_id, lat, lon, greatest(coalesce(pop, 0), 0)::double as pop, greatest(coalesce(gdp, 0), 0)::double as gdp from (select distinct * from proxy_regions) where lat is not null and lon is not null),
    r as (select * from own union all select country, 'fallback_' || country, avg(lat), avg(lon), 1, 1 from buses where country not in (select country from own) group by 1),
    based as (select *, case when sum(pop) over c > 0 then pop / sum(pop) over c else 1 / cast(count(*) over c as double) end as ps, case when sum(gdp) over c > 0 then gdp / sum(gdp) over c else 1 / cast(count(*) over c as double) end as gs from r window c as (partition by country)),
    pairs as (select r.country, region_id, ps, gs, cluster_id, 6371.0::double * sqrt(pow((radians(b.lon) - radians(r.lon)) * cos((radians(r.lat) + radians(b.lat)) / 2), 2) + pow(radians(b.lat) - radians(r.lat), 2)) as km from based r join buses b on b.country = r.country),
    near as (select *, min(km) over w as least, count(*) filter (km <= 1e-6) over w as same, sum(case when km > 1e-6 then 1 / km end) over w as s from pairs window w as (partition by country, region_id)),
    w as (select country, cluster_id, ps, gs, case when least <= 1e-6 then case when km <= 1e-6 then 1 / cast(same as double) end else 1 / km / s end as weight from near),
    c as (select country, cluster_id, sum(ps * weight) as p, sum(gs * weight) as g from w where weight is not null group by 1, 2),
    n as (select *, p / sum(p) over k as pn, g / sum(g) over k as gn from c window k as (partition by country)), f as (select *, 0.4::double * pn + 0.6::double * gn as b from n)
    select country, cluster_id as bus, round(pn, 6) as population_share, round(gn, 6) as gdp_share, round(b / sum(b) over (partition by country), 6) as share from f""",
)
def node_load_shares(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(load.node_shares(_once(spark, d, "proxy_regions"), _buses(spark, d)), 6, "population_share", "gdp_share", "share")


_MAP = "m(source_country, target_country) as (values ('LU', 'BE'), ('LI', 'CH'), ('NI', 'GB'), ('ME', 'RS'))"


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("LU", "BE"), ("LI", "CH"), ("NI", "GB"), ("ME", "RS")], "source_country string, target_country string")


@_query(
    "national_totals",
    f"""with {_MAP}, t as (select case when country in ('NI', 'UA', 'MD') then country else coalesce(target_country, country) end as country_model, year, decommissioned_capacity_mw as v, country from
      (select distinct country, row_id, decommissioned_date_out as year, decommissioned_capacity_mw from decommissioned_sites) left join m on source_country = country where country <> 'FR' and decommissioned_capacity_mw is not null)
    select country_model, year, round(sum(v), 4) as load, string_agg(distinct country, ',' order by country) as source_countries from t group by 1, 2""",
)
def national_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decommissioned_sites").select("row_id", "country", F.col("decommissioned_date_out").alias("year"), F.col("decommissioned_capacity_mw").alias("mw")).where("country is not null").distinct()
    out = load.national_load(rows, _mapping(spark), "mw", ["year"], spark.createDataFrame([("FR",)], "country string"))[0]
    return _rounded(out, 4, "load")


# ---- hydro -------------------------------------------------------------------------------------------------------------------

_CAP = """h as (select distinct * from hydro_bus_capacities where country is not null and plant_type is not null and technology is not null),
cap as (select country, plant_type, technology, coalesce(sum(target_turb_mw), 0) as turb, coalesce(sum(current_turb_mw), 0) / 2 as pump, coalesce(sum(target_storage_mwh), 0) as storage from h group by 1, 2, 3),
live as (select * from cap where abs(turb) > 1e-9 or abs(pump) > 1e-9 or abs(storage) > 1e-9),
facts as (select country, bool_or(plant_type = 'wr' and technology = 'open_loop') as wr, bool_or(plant_type = 'ror' and technology = 'open_loop') as ror from live group by 1),
mapping as (select country, plant_type, technology, case when plant_type = 'phs' then case when technology = 'closed_loop' and not wr and ror then 'ror' else 'wr' end else plant_type end as to_type,
  case when plant_type = 'phs' then case when technology = 'closed_loop' and not wr and not ror then 'closed_loop' else 'open_loop' end else technology end as to_technology from live join facts using (country)),
merged as (select country, to_type as plant_type, to_technology as technology, sum(turb) as turb, case when bool_or(mapping.plant_type = 'phs') then 0 else sum(abs(pump)) end as pump, sum(storage) as storage from mapping join cap on cap.country = mapping.country and cap.plant_type = mapping.plant_type and cap.technology = mapping.technology group by 1, 2, 3)"""
_CAP = _CAP.replace("select country, to_type as plant_type", "select mapping.country, to_type as plant_type")


def _hydro_rows(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "hydro_bus_capacities").where("country is not null and plant_type is not null and technology is not null")


def _hydro_capacity(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return _hydro_rows(spark, d).groupBy("country", "plant_type", "technology").agg(z("target_turb_mw").alias("installed_turb_mw"), (z("current_turb_mw") / 2).alias("installed_pump_mw"), z("target_storage_mwh").alias("installed_storage_mwh"))


@_query("hydro_pumped_mapping", f"with {_CAP} select * from mapping")
def hydro_pumped_mapping(spark: SparkSession, d: str) -> DataFrame:
    return hydro.resolve_pumped(_hydro_capacity(spark, d))


@_query("hydro_merged_capacity", f"with {_CAP} select country, plant_type, technology, round(turb, 4) as installed_turb_mw, round(pump, 4) as installed_pump_mw, round(storage, 4) as installed_storage_mwh from merged")
def hydro_merged_capacity(spark: SparkSession, d: str) -> DataFrame:
    c = _hydro_capacity(spark, d)
    return _rounded(hydro.merged_capacity(c, hydro.resolve_pumped(c)), 4, "installed_turb_mw", "installed_pump_mw", "installed_storage_mwh")


def _profile_sql(q: str) -> str:
    """CTEs of the profiles of a quantity (turb or storage), named by it."""
    return f"""{q}_types as (select country, plant_type, coalesce(t, 0) as t, coalesce(c, 0) as c from (select country, plant_type, sum(target_{q}) as t from want group by 1, 2) full join (select country, plant_type, sum({q}) as c from cur group by 1, 2) using (country, plant_type)),
{q}_sums as (select *, greatest(t - c, 0) as plus, greatest(c - t, 0) as minus, sum(greatest(t - c, 0)) over k as p, sum(greatest(c - t, 0)) over k as m from {q}_types window k as (partition by country)),
{q}_shift as (select *, case when plus > 1e-9 and least(p, m) > 1e-9 then plus * least(p, m) / p else 0 end as shift from {q}_sums), {q}_all as (select *, greatest(t - c - shift, 0) as fresh from {q}_shift),
{q}_lost as (select s.country, bus, sum(minus / m * {q} / c) as part from cur s join {q}_all a on a.country = s.country and a.plant_type = s.plant_type where {q} > 1e-9 and minus > 0 group by 1, 2),
{q}_best as (select country, case when max(v) > 0 then (max({{'v': v, 'i': bus}})).i when max(tt) > 0 then (max({{'v': tt, 'i': bus}})).i when max(l) > 0 then (max({{'v': l, 'i': bus}})).i end as bus
  from (select country, bus, greatest(coalesce(sum({q}), 0), 0) as v, greatest(coalesce(sum(turb), 0), 0) as tt, coalesce(max(l), 0) as l from cur full join loads using (country, bus) group by 1, 2) group by 1),
{q}_own as (select s.country, s.plant_type, bus, {q} as v from cur s where {q} > 1e-9), {q}_moved as (select a.country, plant_type, bus, shift * part as v from {q}_all a join {q}_lost l on l.country = a.country where shift > 1e-9),
{q}_kept as (select distinct country, plant_type from (select country, plant_type from {q}_own union all select country, plant_type from {q}_moved)),
{q}_added as (select a.country, a.plant_type, bus, case when k.country is null and t > 1e-9 then t else fresh end as v from {q}_all a left join {q}_kept k on k.country = a.country and k.plant_type = a.plant_type join {q}_best b on b.country = a.country where bus is not null),
{q}_places as (select country, plant_type, bus, sum(v) as v from (select * from {q}_own union all select * from {q}_moved union all select * from {q}_added where v > 1e-9) group by 1, 2, 3),
{q}_profile as (select p.country, p.plant_type, bus, p.v / sum(p.v) over (partition by p.country, p.plant_type) as share, concat_ws(';', case when c > 1e-9 then case when t < c - 1e-9 then 'existing_country_plant_type_shares_downscale' else 'existing_country_plant_type_shares' end end,
  case when shift > 1e-9 then 'internal_type_shift' end, case when fresh > 1e-9 or (c <= 1e-9 and shift <= 1e-9 and t > 1e-9) then 'true_new_highest_hydro_bus' end) as rule from {q}_places p join {q}_all a on a.country = p.country and a.plant_type = p.plant_type)"""


_PROFILES = f"""h as (select distinct * from hydro_bus_capacities where country is not null and plant_type is not null and technology is not null),
cur as (select country, plant_type, trim(bus, ' ') as bus, coalesce(sum(current_turb_mw), 0) as turb, coalesce(sum(current_storage_mwh), 0) as storage from h where bus is not null and trim(bus, ' ') <> '' group by 1, 2, 3),
want as (select country, plant_type, technology, coalesce(sum(target_turb_mw), 0) as target_turb, coalesce(sum(target_storage_mwh), 0) as target_storage from h group by 1, 2, 3), loads as (select country, trim(bus, ' ') as bus, count(*)::double as l from h where bus is not null and trim(bus, ' ') <> '' group by 1, 2),
{_profile_sql('turb')}, {_profile_sql('storage')}"""


def _hydro_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = _hydro_rows(spark, d).withColumn("bus", F.trim("bus")).where("bus <> ''")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    current = h.groupBy("country", "plant_type", "bus").agg(z("current_turb_mw").alias("turb"), z("current_storage_mwh").alias("storage"))
    return current, h.groupBy("country", "bus").agg(F.count(F.lit(1)).cast("double").alias("load"))


@_query("hydro_type_profiles", f"with {_PROFILES} select country, plant_type, bus, round(share, 6) as share, rule from turb_profile")
def hydro_type_profiles(spark: SparkSession, d: str) -> DataFrame:
    current, loads = _hydro_sites(spark, d)
    target = _hydro_capacity(spark, d).select("country", "plant_type", F.col("installed_turb_mw").alias("turb"))
    return _rounded(hydro.type_profiles(target, current, loads, "turb"), 6, "share")


_TARGETS = f"""{_PROFILES}, both_ as (select country, plant_type, bus, coalesce(a.share, 0) as ts, coalesce(b.share, 0) as ss, a.rule as tr, b.rule as sr from turb_profile a full join storage_profile b using (country, plant_type, bus)),
targets as (select w.country, w.plant_type, technology, bus, ts, ss, target_turb * ts as tt, target_storage * ss as st,
  case when tr is not distinct from sr then tr else 'turb=' || coalesce(tr, 'no_capacity') || '|storage=' || coalesce(sr, 'no_capacity') end as rule from want w join both_ b on b.country = w.country and b.plant_type = w.plant_type)"""


@_query("hydro_target_rows", f"with {_TARGETS} select country, plant_type, technology, bus, round(ts, 6) as turbine_share, round(ss, 6) as storage_share, round(tt, 4) as target_turb_mw, round(st, 4) as target_storage_mwh, rule as allocation_rule from targets")
def hydro_target_rows(spark: SparkSession, d: str) -> DataFrame:
    out = hydro.target_rows(_hydro_capacity(spark, d), *_hydro_sites(spark, d))
    return _rounded(_rounded(out, 6, "turbine_share", "storage_share"), 4, "target_turb_mw", "target_storage_mwh")


_WEEKLY = """w as (select country, plant_type, technology, ref_year, week, sum(max_turb_mw) as max_turb_mw, sum(min_turb_mw) as min_turb_mw, sum(max_pump_mw) as max_pump_mw, avg(min_res_tech_pu) as min_res_tech_pu from (select distinct * from hydro_bus_constraints) where country is not null group by 1, 2, 3, 4, 5)"""


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    c = _once(spark, d, "hydro_bus_constraints").where("country is not null")
    return c.groupBy("country", "plant_type", "technology", "ref_year", "week").agg(*[F.sum(x).alias(x) for x in ("max_turb_mw", "min_turb_mw", "max_pump_mw")], F.avg("min_res_tech_pu").alias("min_res_tech_pu"))


@_query(
    "hydro_bounded_constraints",
    f"""with {_CAP}, {_WEEKLY}, j as (select w.*, turb, pump from w join cap using (country, plant_type, technology)),
    b as (select *, coalesce(least(greatest(max_turb_mw, 0), turb), turb) as xt, coalesce(least(greatest(min_turb_mw, 0), turb), 0) as nt, coalesce(least(greatest(max_pump_mw, 0), pump), pump) as xp, coalesce(least(greatest(min_res_tech_pu, 0), 1), 0) as nr from
      (select country, plant_type, technology, ref_year, week, turb, pump, max_turb_mw, min_turb_mw, max_pump_mw, min_res_tech_pu from j))
    select country, plant_type, technology, ref_year, week, round(case when max_turb_mw is null then turb else xt end, 4) as max_turb_mw, round(case when min_turb_mw is null then 0 else nt end, 4) as min_turb_mw, round(case when max_pump_mw is null then pump else xp end, 4) as max_pump_mw, round(case when min_res_tech_pu is null then 0 else nr end, 6) as min_res_tech_pu,
      case when max_turb_mw is null or min_turb_mw is null or max_pump_mw is null or min_res_tech_pu is null or max_turb_mw <> xt or min_turb_mw <> nt or max_pump_mw <> xp then 'yes' else 'no' end as imputed from b""",
)
def hydro_bounded_constraints(spark: SparkSession, d: str) -> DataFrame:
    out = hydro.bounded_constraints(_weekly(spark, d), _hydro_capacity(spark, d))
    out = out.select("country", "plant_type", "technology", "ref_year", "week", "max_turb_mw", "min_turb_mw", "max_pump_mw", "min_res_tech_pu", "imputed")
    return _rounded(_rounded(out, 4, "max_turb_mw", "min_turb_mw", "max_pump_mw"), 6, "min_res_tech_pu")


@_query(
    "hydro_constraint_rows",
    f"""with {_TARGETS}, {_WEEKLY}, tot as (select *, sum(tt) over k as at_ from targets window k as (partition by country, plant_type, technology))
    select w.country, w.plant_type, w.technology, ref_year, week, bus, round(case when at_ <> 0 then tt / at_ else 0 end, 6) as turbine_share, round(coalesce(max_turb_mw, 0) * case when at_ <> 0 then tt / at_ else 0 end, 4) + 0 as max_turb_mw, round(coalesce(max_pump_mw, 0) * case when at_ <> 0 then tt / at_ else 0 end, 4) + 0 as max_pump_mw, round(st, 4) as installed_storage_mwh
    from w join tot t on t.country = w.country and t.plant_type = w.plant_type and t.technology = w.technology""",
)
def hydro_constraint_rows(spark: SparkSession, d: str) -> DataFrame:
    targets = hydro.target_rows(_hydro_capacity(spark, d), *_hydro_sites(spark, d))
    out = hydro.constraint_rows(_weekly(spark, d), targets).select("country", "plant_type", "technology", "ref_year", "week", "bus", "turbine_share", "max_turb_mw", "max_pump_mw", "installed_storage_mwh")
    out = _rounded(_rounded(out, 6, "turbine_share"), 4, "max_turb_mw", "max_pump_mw", "installed_storage_mwh")
    return out.withColumns({c: F.col(c) + 0 for c in ("max_turb_mw", "max_pump_mw")})  # no negative zeros


_INFLOW = """i as (select distinct * from hydro_bus_inflows where country is not null), s as (select country, plant_type, technology, weather_year, week, sum(case when national_inflow_mwh_week >= 0 then national_inflow_mwh_week end) as inflow from i where week <= 52 group by 1, 2, 3, 4, 5)"""


def _inflows(spark: SparkSession, d: str) -> DataFrame:
    i = _once(spark, d, "hydro_bus_inflows").where("country is not null and week <= 52")
    return i.groupBy("country", "plant_type", "technology", "weather_year", "week").agg(F.sum(F.when(F.col("national_inflow_mwh_week") >= 0, F.col("national_inflow_mwh_week"))).alias("inflow"))


@_query(
    "hydro_clean_inflows",
    f"""with {_INFLOW}, grid as (select k.*, w as week from (select distinct country, plant_type, technology, weather_year from s) k, range(1, 53) t(w)), g as (select grid.*, inflow as v from grid left join s using (country, plant_type, technology, weather_year, week)),
    n as (select *, last_value(case when v is not null then week end ignore nulls) over b as pw, last_value(v ignore nulls) over b as pv, first_value(case when v is not null then week end ignore nulls) over a as nw, first_value(v ignore nulls) over a as nv from g
      window b as (partition by country, plant_type, technology, weather_year order by week rows between unbounded preceding and current row), a as (partition by country, plant_type, technology, weather_year order by week rows between current row and unbounded following)),
    f as (select *, coalesce(v, case when pv is null then nv when nv is null then pv else pv + (nv - pv) / (nw - pw) * (week - pw) end) as x from n),
    st as (select country, plant_type, technology, weather_year, count(*) filter (x <> 0) = 0 as miss from f group by 1, 2, 3, 4),
    m as (select country, plant_type, technology, week, avg(x) as mean from f join st using (country, plant_type, technology, weather_year) where not miss group by 1, 2, 3, 4)
    select f.country, f.plant_type, f.technology, f.weather_year, f.week::int as week, miss as year_missing, round(case when miss and f.plant_type = 'phs' and f.technology = 'closed_loop' then 0 when miss then coalesce(mean, x) else x end, 4) as inflow
    from f join st using (country, plant_type, technology, weather_year) left join m on m.country = f.country and m.plant_type = f.plant_type and m.technology = f.technology and m.week = f.week""",
)
def hydro_clean_inflows(spark: SparkSession, d: str) -> DataFrame:
    out = hydro.clean_inflows(_inflows(spark, d)).select("country", "plant_type", "technology", "weather_year", "week", "year_missing", "inflow")
    return _rounded(out, 4, "inflow")


@_query(
    "hydro_inflow_rows",
    f"""with {_TARGETS}, {_INFLOW}, budget as (select country, weather_year, week, plant_type, sum(inflow) as inflow from s where technology = 'open_loop' group by 1, 2, 3, 4),
    open_ as (select country, plant_type, technology, bus, sum(tt) as v from targets where technology <> 'closed_loop' and tt > 1e-9 group by 1, 2, 3, 4), sh as (select *, sum(v) over (partition by country, plant_type) as al, sum(v) over (partition by country, plant_type, bus) as bv from open_)
    select b.country, weather_year, week, b.plant_type as source, bus, technology, round(bv / al, 6) as bus_share, round(v / bv, 6) as tech_share, round(inflow * (bv / al) * (v / bv), 4) as allocated_inflow_mwh_week from budget b join sh on sh.country = b.country and sh.plant_type = b.plant_type where technology = 'open_loop' and inflow is not null""",
)
def hydro_inflow_rows(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of countries and plant types to nodes, checked against the budgets."""
    g = _inflows(spark, d).where("technology = 'open_loop'").groupBy("country", "weather_year", "week", F.col("plant_type").alias("source")).agg(F.sum("inflow").alias("inflow")).where("inflow is not null")
    g = materialise(g.withColumn("eligible", F.array(F.concat("source", F.lit(":open_loop")))), "budgets")
    targets = hydro.target_rows(_hydro_capacity(spark, d), *_hydro_sites(spark, d))
    out = hydro.check_budget(g, hydro.inflow_rows(g, targets))
    out = out.select("country", "weather_year", "week", "source", "bus", "technology", "bus_share", "tech_share", "allocated_inflow_mwh_week")
    return _rounded(_rounded(out, 6, "bus_share", "tech_share"), 4, "allocated_inflow_mwh_week")


@_query(
    "constraint_days",
    """select country, ref_year, week, d::date as day, round(sum(max_turb_mw), 4) as max_turb_mw from (select distinct * from hydro_bus_constraints), unnest(generate_series(make_date(ref_year, 1, 1) + (week - 1) * 7, least(make_date(ref_year, 1, 1) + week * 7 - 1, make_date(ref_year, 12, 31)), interval 1 day)) t(d) where week is not null group by 1, 2, 3, 4""",
)
def constraint_days(spark: SparkSession, d: str) -> DataFrame:
    w = _once(spark, d, "hydro_bus_constraints").where("week is not null").groupBy("country", "ref_year", "week").agg(F.sum("max_turb_mw").alias("max_turb_mw"))
    return _rounded(se.weeks_to_days(w, "ref_year"), 4, "max_turb_mw").select("country", "ref_year", "week", "day", "max_turb_mw")


@_query(
    "constraint_levels",
    """with c as (select distinct * from hydro_bus_constraints), l as (select country, plant_type, avg(least(greatest(max_turb_mw / installed_turb_mw, 0), 1)) as level from c where installed_turb_mw > 0 and max_turb_mw is not null group by 1, 2)
    select row_id, case when max_turb_mw is not null then 'no' when level is not null then 'mean_level' else 'default' end as imputed, round(coalesce(max_turb_mw, level * installed_turb_mw, installed_turb_mw), 4) as max_turb_mw from c left join l using (country, plant_type)""",
)
def constraint_levels(spark: SparkSession, d: str) -> DataFrame:
    c = _once(spark, d, "hydro_bus_constraints").select("row_id", "country", "plant_type", "installed_turb_mw", "max_turb_mw")
    return _rounded(se.level_imputation(c, ["country", "plant_type"], "installed_turb_mw", "max_turb_mw", F.col("installed_turb_mw")), 4, "max_turb_mw").select("row_id", "imputed", "max_turb_mw")


# ---- units and targets -------------------------------------------------------------------------------------------------------

_FUEL_CODE = "case fuel_group " + " ".join(f"when '{g}' then '{c}'" for c, g in fn.FUEL_GROUPS.items()) + " else 'B20' end"
_TECH = "case when lower(technology) like '%ccgt%' then 'CCGT' when lower(technology) like '%ocgt%' or lower(technology) like '%open cycle%' then 'OCGT' when lower(technology) like '%steam%' then 'STEAM' else 'OTHERS' end"
_UNITS = f"t as (select country, {_FUEL_CODE} as fuel_code, case when {_FUEL_CODE} = 'B14' then 'NUCLEAR' else {_TECH} end as tech, target_capacity_mw as capacity_mw, units as n_units from (select distinct * from nonres_targets) where country is not null and fuel_group is not null)"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "nonres_targets").where("country is not null and fuel_group is not null")
    codes = {g: c for c, g in fn.FUEL_GROUPS.items()}
    code = fn.mapped(F.col("fuel_group"), codes, F.lit("B20"))
    return t.select("country", code.alias("fuel_code"), fn.thermal_technology(F.col("technology"), code).alias("tech"), F.col("target_capacity_mw").alias("capacity_mw"), F.col("units").alias("n_units"))


@_query("thermal_groups", f"with {_UNITS}, g as (select country, fuel_code, tech, sum(capacity_mw) as cap, sum(n_units) as n from t group by 1, 2, 3) select country, fuel_code, tech, round(cap, 4) as cap_total_mw, greatest(1, least(coalesce(n, 1), greatest(floor(cap / 100), 1)))::bigint as n_units from g where cap > 0")
def thermal_groups(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(siting.target_groups(_targets(spark, d)), 4, "cap_total_mw")


@_query(
    "revision_weeks",
    f"""with {_UNITS}, k as (select country, fuel_code, tech, quantile_cont(n_units % 9 + 1, 0.5) as w, quantile_cont(n_units % 9 + 3, 0.5) as l from t where country < 'M' group by 1, 2, 3), g as (select distinct country, fuel_code, tech from t)
    select country, fuel_code, tech, coalesce(w, case tech when 'NUCLEAR' then 4 when 'CCGT' then 3 when 'OCGT' then 2 when 'STEAM' then 4 else 2 end)::double as revision_weeks, coalesce(l, case tech when 'NUCLEAR' then 8 when 'CCGT' then 6 when 'OCGT' then 4 when 'STEAM' then 8 else 4 end)::double as long_revision_weeks
    from g left join k using (country, fuel_code, tech)""",
)
def revision_weeks(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    listed = t.where("country < 'M'").select("country", "fuel_code", "tech", (F.col("n_units") % 9 + 1).alias("weeks"), (F.col("n_units") % 9 + 3).alias("long_weeks"))
    return siting.with_revisions(t.select("country", "fuel_code", "tech").distinct(), listed)


@_query(
    "plant_weights",
    f"""with {_UNITS}, at_ as (select country, fuel_code, tech, greatest(coalesce(capacity_mw, 0), 0) as c, greatest(coalesce(n_units, 0), 0)::double as u from t), s as (select country, fuel_code, tech, sum(c) as c, sum(u) as u from at_ group by 1, 2, 3),
    w as (select *, sum(c) over k as ac, sum(u) over k as au from s window k as (partition by country, fuel_code)), x as (select *, case when ac > 0 and au > 0 then c / ac / 2 + u / au / 2 when ac > 0 then c / ac when au > 0 then u / au end as weight from w)
    select country, fuel_code, tech as bus_id, round(weight, 6) as weight from x where weight > 0""",
)
def plant_weights(spark: SparkSession, d: str) -> DataFrame:
    plants = _targets(spark, d).select("country", "fuel_code", F.col("tech").alias("bus_id"), "capacity_mw", F.col("n_units").cast("double").alias("n_plants"), F.lit(False).alias("chp"))
    return _rounded(siting.plant_weights(plants, ["country", "fuel_code"]), 6, "weight").select("country", "fuel_code", "bus_id", "weight")


@_query(
    "unit_sizes",
    """select row_id, round(s, 6) as size, count(*) as n from (select row_id, case when target_capacity_mw > 0 then target_capacity_mw / greatest(coalesce(units, 1), 1) end as s, unnest(range(greatest(coalesce(units, 1), 1)::bigint)) as i from (select distinct * from nonres_targets)) where s is not null group by 1, 2""",
)
def unit_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "nonres_targets").select("row_id", F.explode(siting.unit_sizes(F.col("target_capacity_mw"), F.col("units"))).alias("size"))
    return _rounded(t, 6, "size").groupBy("row_id", "size").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "retired_sites",
    """with s as (select distinct * from decommissioned_sites), p as (select country, trim(bus_id, ' ') as bus_id, lower(trim(fuel_group, ' ')) as fuel_group, decommissioned_capacity_mw as mw, decommissioned_date_out as date_out from s where decommissioned_capacity_mw > 0 and decommissioned_date_out >= 2019 and decommissioned_date_out < 2024),
    b as (select distinct bus_id, coalesce(cluster_id, bus_id) as site from buses_with_clusters where valid_to is null and bus_id is not null)
    select country, site, fuel_group, round(sum(mw), 4) as capacity, max(date_out) as date_out, count(*) as units from p join b using (bus_id) group by 1, 2, 3""",
)
def retired_sites(spark: SparkSession, d: str) -> DataFrame:
    s = _once(spark, d, "decommissioned_sites")
    plants = s.select("country", F.trim("bus_id").alias("bus_id"), F.lower(F.trim("fuel_group")).alias("fuel_group"), F.col("decommissioned_capacity_mw").alias("capacity_mw"), F.col("decommissioned_date_out").alias("date_out"))
    b = table(spark, d, "buses_with_clusters").where("valid_to is null and bus_id is not null").select("bus_id", "cluster_id").distinct()
    return _rounded(siting.retired_sites(plants, b, 2024, 5), 4, "capacity")


@_query(
    "residual_basis",
    """with s as (select distinct * from decommissioned_sites), have as (select country, fuel_group, sum(decommissioned_capacity_mw) as b from s group by 1, 2), used as (select country, fuel_group, sum(target_capacity_mw) / 3 as u from (select distinct * from nonres_targets) group by 1, 2)
    select country, fuel_group, round(b, 4) as basis_mw, round(greatest(b - coalesce(u, 0), 0), 4) as residual_mw from have left join used using (country, fuel_group)""",
)
def residual_basis(spark: SparkSession, d: str) -> DataFrame:
    have = _once(spark, d, "decommissioned_sites").select("country", "fuel_group", F.col("decommissioned_capacity_mw").alias("capacity_mw"))
    used = _once(spark, d, "nonres_targets").select("country", "fuel_group", (F.col("target_capacity_mw") / 3).alias("capacity_mw"))
    return _rounded(siting.residual_basis(have, used, ["country", "fuel_group"]), 4, "basis_mw", "residual_mw")


@_query(
    "cluster_membership",
    "with n as (select cluster_id as bus_id, country, count(*) as n from (select distinct * from buses_with_clusters) where cluster_id is not null and country is not null group by 1, 2) select bus_id, country, round(n / sum(n) over (partition by bus_id), 6) as membership from n",
)
def cluster_membership(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(siting.country_membership(_once(spark, d, "buses_with_clusters")), 6, "membership")


@_query(
    "battery_sites",
    """with s as (select distinct country, cluster_id as bus from buses_with_clusters where country is not null and cluster_id is not null), t as (select country, sum(cap) as d, sum(cap) * 0.9::double as ch, sum(cap) * 4 as e, sum(cap * coalesce((year - 2000) / cast(100 as double), 1)) as w from (select distinct * from res_targets) where length(country) = 2 group by 1),
    c as (select s.country, s.bus, case when ascii(right(bus, 1)) % 2 = 0 and s.country < 'F' then 10.0 else 0 end::double as cur, case when ascii(right(bus, 1)) % 3 = 0 and s.country < 'P' then 5.0 else 0 end::double as res, case when s.country < 'S' then length(bus) + ascii(right(bus, 1)) % 5 else 0 end::double as ld from s),
    x as (select *, sum(cur + res) over k as sc, sum(ld) over k as sl, count(*) over k as n from c window k as (partition by country)), y as (select *, case when sc > 0 then 'combined' when sl > 0 then 'load_share' else 'uniform' end as rule, case when sc > 0 then (cur + res) / sc when sl > 0 then ld / sl else 1 / cast(n as double) end as share from x)
    select y.country, bus, rule, round(share, 6) as share, round(d * share, 6) as discharge_mw, round(e * share, 6) as energy_mwh, round(w / d, 6) as eff, round(d * share * (w / d), 6) as effective_mw, round(d * share * case when cur + res <> 0 then cur / (cur + res) else 0 end, 6) as current_part_mw from y join t on t.country = y.country where share > 0 and d is not null""",
)
def battery_sites(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "buses_with_clusters").where("country is not null and cluster_id is not null").select("country", F.col("cluster_id").alias("bus")).distinct()
    k = F.ascii(F.right("bus", F.lit(1)))
    current = s.where((k % 2 == 0) & (F.col("country") < "F")).withColumn("capacity_mw", F.lit(10.0))
    res = s.where((k % 3 == 0) & (F.col("country") < "P")).withColumn("weight_mw", F.lit(5.0))
    loads = s.where("country < 'S'").withColumn("share", (F.length("bus") + k % 5).cast("double"))
    rows = _once(spark, d, "res_targets").where("length(country) = 2").select("country", F.col("cap").alias("discharge_mw"), (F.col("cap") * 0.9).alias("charge_mw"), (F.col("cap") * 4).alias("energy_mwh"), ((F.col("year") - 2000) / 100).alias("eff"))
    out = siting.batteries(siting.battery_targets(rows).where("discharge_mw is not null"), current, res, loads, s)
    out = out.select("country", "bus", "rule", "share", "discharge_mw", "energy_mwh", "eff", "effective_mw", "current_part_mw")
    return _rounded(out, 6, "share", "eff", "discharge_mw", "energy_mwh", "effective_mw", "current_part_mw")


@_query(
    "cost_attributes",
    """with t as (select distinct row_id, fuel_price_eur_gj as gj, variable_cost_eur_mwh as v, units as u, year as y from nonres_targets), e as (select *, case when u is null then null when u > 1.5 then u / cast(100 as double) else u end as eta from t),
    p as (select *, case when eta > 0 then gj * 3.6::double / eta end as fuel, case when y = 2050 then 100.0::double end as total from e)
    select row_id, case when total is not null then 'direct_eur_mwh' when v is not null or fuel is not null then 'calculated_components' else 'missing' end as marginal_cost_status, round(coalesce(total, case when v is not null or fuel is not null then coalesce(v, 0) + coalesce(fuel, 0) end), 4) as marginal_cost_eur_mwh, round(eta, 6) as efficiency from p""",
)
def cost_attributes(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, "nonres_targets").select("row_id", "fuel_price_eur_gj", F.col("variable_cost_eur_mwh").alias("VOM EUR/MWh"), F.col("units").cast("string").alias("eta"), F.when(F.col("year") == 2050, "100,0").alias("Cost €/MWh"))
    out = siting.cost_attributes(t).select("row_id", "marginal_cost_status", "marginal_cost_eur_mwh", "efficiency")
    return _rounded(_rounded(out, 4, "marginal_cost_eur_mwh"), 6, "efficiency")


# Fuels, sets and technologies of plants that are told apart.
_PLANTS = ("Hard Coal|PP|Steam Turbine", "Natural Gas|CHP|CCGT", "Natural Gas|PP|OCGT peaker", "Natural Gas|PP|Combustion Engine", "Nuclear|PP|Steam", "Hydro|Store|Pumped Storage", "Biogas|PP|Engine", "Solar|PP|PV", "Waste|CHP|Steam", "Oil Shale|cogeneration|Steam", "Battery|Store|Li", "Braunkohle|PP|", "Geothermal|PP|ORC", "Müll|PP|Steam", "Brown Coal|PP|open cycle")


@_query(
    "plant_predicates",
    f"""with p as (select unnest([{', '.join(repr(x) for x in _PLANTS)}]) as x), q as (select split_part(x, '|', 1) as fuel, split_part(x, '|', 2) as set_name, split_part(x, '|', 3) as technology from p),
    c as (select *, case upper(fuel) when 'NATURAL GAS' then 'B04' when 'HARD COAL' then 'B05' when 'NUCLEAR' then 'B14' when 'BIOGAS' then 'B01' when 'WASTE' then 'B17' when 'OIL SHALE' then 'B07' when 'GEOTHERMAL' then 'B09' when 'BROWN COAL' then 'B02' else 'B20' end as code,
      case when fuel in ('Waste', 'Geothermal', 'Müll') then true else false end as renewable, case when lower(technology) like '%ccgt%' then 'CCGT' when lower(technology) like '%ocgt%' or lower(technology) like '%open cycle%' then 'OCGT' when lower(technology) like '%steam%' then 'STEAM' else 'OTHERS' end as tt from q)
    select fuel, set_name, technology, code, case when code = 'B14' then 'NUCLEAR' else tt end as tech, set_name in ('CHP', 'cogeneration') as heat, not renewable and set_name <> 'Store' and fuel not in ('Hydro', 'Solar', 'Battery') as thermal,
      case when code = 'B04' then case tt when 'CCGT' then 5.0 when 'OCGT' then 4.0 when 'OTHERS' then 4.5 else 4.5 end else case code when 'B01' then 4.0 when 'B02' then 5.5 when 'B05' then 5.5 when 'B07' then 5.0 when 'B09' then 4.0 when 'B14' then 6.0 when 'B17' then 4.0 else 4.0 end end::double as inertia_s,
      fuel in ('Hydro', 'Hard Coal', 'Natural Gas', 'Waste', 'Geothermal', 'Nuclear', 'Biogas') and technology not in ('PV') as synchronous from c""",
)
def plant_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([tuple(x.split("|")) for x in _PLANTS], "fuel string, set_name string, technology string")
    code = fn.fuel_code(F.col("fuel"))
    tech = fn.thermal_technology(F.col("technology"), code)
    sync = fn.is_synchronous(F.col("fuel"), F.col("technology"), benchmark.SYNCHRONOUS_FUELS, benchmark.NOT_SYNCHRONOUS)
    return p.select("fuel", "set_name", "technology", code.alias("code"), tech.alias("tech"), fn.has_heat(F.col("set_name"), F.col("technology")).alias("heat"), fn.is_thermal(F.col("fuel"), F.col("set_name")).alias("thermal"), fn.inertia_seconds(code, tech).alias("inertia_s"), sync.alias("synchronous"))


# ---- transmission and flexible loads -------------------------------------------------------------------------------------------

_CODES = "nc as (select n_nationkey as k, chr(80 + n_nationkey % 5) || chr(75 + n_nationkey // 5) as c from nation)"


def _borders(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations as borders ``A00-B00`` of every pair of nations and flag."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.concat(F.chr(80 + F.col("n_nationkey") % 5), F.chr((75 + F.floor(F.col("n_nationkey") / 5)).cast("int"))).alias("ca"))
    f = _flows(spark, d, "l_quantity", "l_returnflag").groupBy("a", "b", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    f = f.join(n, "a").join(n.withColumnsRenamed({"a": "b", "ca": "cb"}), "b")
    zone = lambda c: F.concat(c, F.when(F.col("l_returnflag") == "R", "00DC").otherwise("00"))
    return f.select(F.concat(zone(F.col("ca")), F.lit(" - "), zone(F.col("cb"))).alias("border"), F.col("q").alias("forward"), (F.col("q") / 2).alias("backward"))


@_query(
    "transfer_limits",
    f"""with {_FLOWS.replace('l_shipdate from', 'l_shipdate, l_returnflag from')}, {_CODES}, f as (select x.c as ca, y.c as cb, l_returnflag = 'R' as dc, sum(l_quantity) as q from flows join nc x on a = x.k join nc y on b = y.k group by a, b, 1, 2, 3, l_returnflag),
    m as (select case when ca = 'PK' then 'QL' else ca end as a, case when cb = 'PK' then 'QL' else cb end as b, case when dc then 'hvdc' else 'hvac' end as kind, q from f where ca <> 'RM' and cb <> 'RM')
    select least(a, b) as first, greatest(a, b) as second, round(sum(case when a < b then q else q / 2 end), 2) as to_mw, round(sum(case when a < b then q / 2 else q end), 2) as from_mw, count(*) as n_rows, case when min(kind) = max(kind) then min(kind) else 'mixed' end as kind from m where a <> b group by 1, 2""",
)
def transfer_limits(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("PK", "QL")], "source_country string, target_country string")
    return _rounded(flexible.transfer_limits(_borders(spark, d), mapping, spark.createDataFrame([("RM",)], "country string")), 2, "to_mw", "from_mw")


_BANDS = """bands as (select n_nationkey::varchar as market_node, (n_nationkey % 20)::varchar as country, p_size as band_id, sum(p_retailprice) as mw, count(*)::double as units from part join nation on p_partkey % 25 = n_nationkey group by 1, 2, 3),
shares as (select s_nationkey::varchar as country, s_suppkey as bus, greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) over (partition by s_nationkey) as share from supplier where s_nationkey < 15)"""


def _bands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey") % 25
    bands = table(spark, d, "part").groupBy(k.cast("string").alias("market_node"), (k % 20).cast("string").alias("country"), F.col("p_size").alias("band_id")).agg(F.sum("p_retailprice").alias("installed_capacity_mw"), F.count(F.lit(1)).cast("double").alias("units"))
    s = table(spark, d, "supplier").where("s_nationkey < 15").select(F.col("s_nationkey").cast("string").alias("country"), F.col("s_suppkey").alias("bus"), fn.positive(F.col("s_acctbal")).alias("v"))
    shares = load.proxy_free_shares(s, "country", "v").select("country", "bus", "share")
    return bands, shares, spark.createDataFrame([("7", "8")], "source_country string, target_country string")


@_query(
    "response_bands_by_bus",
    f"with {_BANDS}, m as (select case when country = '7' then '8' else country end as country, market_node || '|' || band_id as band_uid, mw, units from bands) select m.country, band_uid, bus, round(mw * share, 4) as installed_capacity_mw, round(units * share, 6) as units, 'dsr|' || band_uid || '|' || bus as unit_id from m join shares s on s.country = m.country where share > 0",
)
def response_bands_by_bus(spark: SparkSession, d: str) -> DataFrame:
    out = flexible.bus_bands(*_bands(spark, d)).select("country", "band_uid", "bus", "installed_capacity_mw", "units", "unit_id")
    return _rounded(_rounded(out, 4, "installed_capacity_mw"), 6, "units")


@_query(
    "response_band_totals",
    f"""with {_BANDS}, a as (select case when country = '7' then '8' else country end as country, sum(mw) as v from bands group by 1), b as (select country, v from a where country in (select country from shares where share > 0))
    select country, round(a.v, 2) as left_value, round(coalesce(b.v, 0), 2) as right_value, case when b.v is null then 'left_only' else 'both' end as sides, round(coalesce(b.v, 0) - a.v, 2) + 0 as difference from a left join b using (country)""",
)
def response_band_totals(spark: SparkSession, d: str) -> DataFrame:
    bands, shares, mapping = _bands(spark, d)
    model = load.model_country(bands, mapping).drop("country").withColumnRenamed("country_model", "country")
    out = flexible.band_diagnostics(model, flexible.bus_bands(bands, shares, mapping))
    return out.withColumns({c: F.round(c, 2) + 0 for c in ("left_value", "right_value", "difference")})


@_query(
    "availability_by_bus",
    f"""with {_BANDS}, p as (select case when country = '7' then '8' else country end as country, band_id as hour, sum(mw * (band_id % 3)) as av, sum(mw * 3) as ic from bands group by 1, 2)
    select p.country, hour, bus, round(av / ic, 6) as availability_factor from p join shares s on s.country = p.country where share > 0""",
)
def availability_by_bus(spark: SparkSession, d: str) -> DataFrame:
    bands, shares, mapping = _bands(spark, d)
    profile = bands.select("country", F.col("band_id").alias("hour"), (F.col("installed_capacity_mw") * (F.col("band_id") % 3)).alias("available_capacity_mw"), (F.col("installed_capacity_mw") * 3).alias("installed_capacity_mw"))
    return _rounded(flexible.bus_availability(profile, shares, mapping, ["hour"]).select("country", "hour", "bus", "availability_factor"), 6, "availability_factor")


# ---- renewables --------------------------------------------------------------------------------------------------------------

_CELLS = """cells as (select p_partkey as cell, p_partkey % 25 as country, p_brand as bus_id, p_retailprice - 800 as p_nom_max_mw, p_size / cast(50 as double) as mean_cf, (p_size % 6) - 1 as resource_class from part), kept as (select * from cells where p_nom_max_mw > 0 and p_nom_max_mw >= 150 and mean_cf >= 0.1),
cur as (select bus_id, sum(p_nom_max_mw) / 4 as c from kept where bus_id < 'Brand#4' group by 1), now as (select kept.*, coalesce(c, 0) * case when sum(p_nom_max_mw) over b > 0 then p_nom_max_mw / sum(p_nom_max_mw) over b else 1 / cast(count(*) over b as double) end as have from kept left join cur using (bus_id) window b as (partition by bus_id)),
goal as (select country, sum(have) as current, sum(p_nom_max_mw) * 0.6::double as target, greatest(sum(p_nom_max_mw) * 0.6::double - sum(have), 0) as delta from now group by 1)"""


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    cells = p.select(F.col("p_partkey").alias("cell"), (F.col("p_partkey") % 25).alias("country"), F.col("p_brand").alias("bus_id"), (F.col("p_retailprice") - 800).alias("p_nom_max_mw"), (F.col("p_size") / 50).alias("mean_cf"), (F.col("p_size") % 6 - 1).alias("resource_class"))
    kept = renewables.keep_cells(cells, "pv", {"pv": 150.0}, {"pv": 0.1})
    current = kept.where("bus_id < 'Brand#4'").groupBy("bus_id").agg((F.sum("p_nom_max_mw") / 4).alias("capacity_mw"))
    now = renewables.current_by_cell(kept, current)
    return now, now.groupBy("country").agg((F.sum("p_nom_max_mw") * 0.6).alias("target"))


@_query(
    "scenario_cells",
    f"""with {_CELLS}, room as (select *, greatest(p_nom_max_mw - have, 0) as room from now), cls as (select country, resource_class as k, sum(room) as cr, count(*) as n from room where resource_class >= 0 and room > 0 group by 1, 2),
    bud as (select cls.*, least(cr, greatest(0, delta - coalesce(sum(cr) over (partition by country order by k desc rows between unbounded preceding and 1 preceding), 0))) as budget from cls join goal using (country)),
    ins as (select r.country, r.resource_class as k, (budget - coalesce(sum(room) over (partition by r.country, r.resource_class order by room, cell rows between unbounded preceding and 1 preceding), 0)) / (n - row_number() over (partition by r.country, r.resource_class order by room, cell) + 1) as level from room r join bud on bud.country = r.country and bud.k = r.resource_class where room > 0),
    lev as (select country, k, max(level) as level from ins group by 1, 2)
    select r.country, cell, bus_id, round(have, 6) as current_capacity_mw, round(have + coalesce(case when room > 0 then least(room, greatest(0, level)) end, 0), 6) as scenario_capacity_mw from room r left join lev on lev.country = r.country and lev.k = r.resource_class""",
)
def scenario_cells(spark: SparkSession, d: str) -> DataFrame:
    cells, targets = _cells(spark, d)
    out = renewables.scenario_cells(cells, targets)[0].select("country", "cell", "bus_id", "current_capacity_mw", "scenario_capacity_mw")
    return _rounded(out, 6, "current_capacity_mw", "scenario_capacity_mw")


@_query(
    "renewable_generation",
    f"""with {_CELLS}, series as (select l_partkey as cell, extract(month from l_shipdate)::int as month, case when avg(l_discount) * 8 < 0.2013 then 0 else avg(l_discount) * 8 end as cf from lineitem group by 1, 2), caps as (select cell, bus_id || '@' || country as node, country, case when country % 7 = 3 then 0 else have end as w from now),
    prof as (select node, month, sum(cf * w) / sum(w) as cf from series join caps using (cell) where w > 0 group by 1, 2), nodes as (select node, country, sum(w) as cap from caps group by 1, 2),
    grid as (select c as country, m::int as month, case when c % 5 = 4 then 0 else 1000.0 * (c + m) end::double as total from range(25) a(c), range(1, 13) b(m)),
    raw as (select g.country, g.month, total, n.node, cap, cf * cap as raw from grid g join nodes n on n.country = g.country left join prof p on p.node = n.node and p.month = g.month),
    s as (select *, sum(raw) over k as sr, count(raw) over k as kn, sum(cap) over k as sc from raw window k as (partition by country, month)),
    o as (select *, case when total <= 0 then 'zero_national' when sr > 0 then 'scaled' when kn > 0 then 'profile_zero' when sc > 0 then 'capacity_fallback' else 'no_profile_no_capacity' end as mode from s)
    select country, month, node, mode, round(case mode when 'scaled' then coalesce(raw, 0) * (total / sr) when 'capacity_fallback' then cap / sc * total else 0 end, 3) as generation from o""",
)
def renewable_generation(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)[0].withColumn("node", F.concat_ws("@", "bus_id", "country")).select("node", "country", F.col("cell").alias("row_ix"), F.lit(0).alias("col_ix"), F.when(F.col("country") % 7 == 3, 0.0).otherwise(F.col("current_capacity_mw")).alias("scenario_capacity_mw"))
    series = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_ix"), F.month("l_shipdate").alias("month")).agg((F.avg("l_discount") * 8).alias("cf")).withColumn("col_ix", F.lit(0))
    c, m = F.col("c"), F.col("month")
    national = spark.range(25).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select(c.alias("country"), "month", F.when(c % 5 == 4, 0.0).otherwise(1000.0 * (c + m)).alias("generation"))
    out = renewables.generation(national, series, cells, cells.select("node", "country").distinct(), ["month"], "node", 0.2013)
    return _rounded(out.select("country", "month", "node", "mode", "generation"), 3, "generation")


@_query(
    "runoff_profiles",
    """with r as (select case when n_nationkey = 3 then 4 else n_nationkey end as country, extract(month from o_orderdate)::int as time, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2), f as (select (select sum(s_acctbal) from supplier) / (select sum(v) from r) as factor),
    cap as (select s_nationkey as country, s_suppkey as bus_id, ['ror', 'wr', 'phs'][s_suppkey % 3 + 1] as plant_type, s_acctbal + 2000 as mw from supplier), pc as (select country, sum(mw) as c from cap where plant_type <> 'phs' group by 1)
    select bus_id, time, plant_type, round(v * factor / c * mw, 6) as inflow from cap join pc using (country) join r using (country), f where c > 0""",
)
def runoff_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("country"))
    runoff = table(spark, d, "orders").groupBy("o_custkey", F.month("o_orderdate").alias("time")).agg(F.sum("o_totalprice").alias("v")).join(c, "o_custkey").groupBy("country", "time").agg(F.sum("v").alias("runoff"))
    s = table(spark, d, "supplier")
    kinds = F.array(F.lit("ror"), F.lit("wr"), F.lit("phs"))
    capacity = s.select(F.col("s_nationkey").alias("country"), F.col("s_suppkey").alias("bus_id"), kinds[(F.col("s_suppkey") % 3).cast("int")].alias("plant_type"), (F.col("s_acctbal") + 2000).alias("capacity_mw"))
    merged = spark.createDataFrame([(3, 4)], "source_country int, target_country int")
    return _rounded(renewables.runoff_profiles(runoff, s.select(F.col("s_acctbal").alias("inflow")), capacity, merged), 6, "inflow")


# ---- networks ----------------------------------------------------------------------------------------------------------------

_GRID = f"""nodes as (select s_suppkey as id, s_suppkey::varchar as bus_id, s_nationkey as country, {_lat('s_suppkey')} as lat, {_lon('s_suppkey')} as lon, s_suppkey % 11 = 0 as dc, case when s_suppkey % 4 = 0 then 220 when s_suppkey % 4 = 1 then 380 else 400 end as kv from supplier),
lines as (select p_partkey::varchar as line_id, a.bus_id as a, b.bus_id as b, a.country as ca, b.country as cb, 0.1::double * p_size as r, 1 + p_size % 7 as x, case when p_size % 6 = 0 then 0 else p_retailprice end as s_nom, 10.0::double + p_partkey % 90 as length, a.kv as voltage, 1 + p_partkey % 2 as circuits
  from part join (select *, max(id) over () + 1 as n from nodes) a on a.id = p_partkey % a.n join nodes b on b.id = (p_partkey * 7 + p_size) % a.n where a.id <> b.id)"""


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as nodes, parts as lines between two of them."""
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(k.alias("id"), k.cast("string").alias("bus_id"), F.col("s_nationkey").cast("string").alias("country"), F.expr(_lat("s_suppkey")).alias("lat"), F.expr(_lon("s_suppkey")).alias("lon"), (k % 11 == 0).alias("dc_bool"), F.when(k % 4 == 0, 220.0).when(k % 4 == 1, 380.0).otherwise(400.0).alias("voltage"), F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string")).alias("sync_area"))
    n = nodes.agg((F.max("id") + 1).alias("n"))
    p = table(spark, d, "part").crossJoin(F.broadcast(n))  # one row
    ends = p.select("*", (F.col("p_partkey") % F.col("n")).alias("ia"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.col("n")).alias("ib")).where("ia <> ib")
    at = lambda s: nodes.select(F.col("id").alias(f"i{s}"), F.col("bus_id").alias(s), F.col("voltage").alias(f"_kv{s}"))
    lines = ends.join(at("a"), "ia").join(at("b"), "ib")
    return nodes, lines.select(F.col("p_partkey").cast("string").alias("line_id"), "a", "b", (0.1 * F.col("p_size")).alias("r"), (1 + F.col("p_size") % 7).cast("double").alias("x"), F.when(F.col("p_size") % 6 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("s_nom"), (10.0 + F.col("p_partkey") % 90).alias("length"), F.col("_kva").alias("voltage"), (1 + F.col("p_partkey") % 2).cast("double").alias("circuits"))


@_query(
    "impute_ratings",
    f"""with {_GRID}, k as (select *, case when voltage in (380, 400) then 380 else voltage end as c from lines), side as (select ca as country, c, quantile_cont(s_nom, 0.5) as m from k where ca = cb and s_nom > 0 group by 1, 2), cls as (select c, quantile_cont(s_nom, 0.5) as m from k where s_nom > 0 group by 1), al as (select quantile_cont(s_nom, 0.5) as m from k where s_nom > 0)
    select line_id, case when s_nom > 0 then 'given' when a_.m is not null and b_.m is not null then 'both_sides' when coalesce(a_.m, b_.m) is not null then 'one_side' when cls.m is not null then 'class' when al.m is not null then 'global' else 'default' end as s_nom_source,
      round(case when s_nom > 0 then s_nom else coalesce((a_.m + b_.m) / 2, a_.m, b_.m, cls.m, al.m, 1) end, 6) as s_nom from k left join side a_ on a_.country = ca and a_.c = k.c left join side b_ on b_.country = cb and b_.c = k.c left join cls on cls.c = k.c, al""",
)
def impute_ratings(spark: SparkSession, d: str) -> DataFrame:
    nodes, lines = _grid(spark, d)
    return _rounded(grid.impute_ratings(lines, nodes), 6, "s_nom").select("line_id", "s_nom_source", "s_nom")


@_query("edge_weights", f"with {_GRID} select least(a, b) as a, greatest(a, b) as b, round(sum(circuits / cast(x as double) * s_nom), 6) as w from lines group by 1, 2")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    nodes, lines = _grid(spark, d)
    return _rounded(grid.edge_weights(lines, nodes, "rated"), 6, "w")


@_query("edge_distances", f"with {_GRID} select least(l.a, l.b) as a, greatest(l.a, l.b) as b, round(sum(1 / greatest({_KM.replace('6371.0', '6371.0088')}, 1e-3)), 9) as w from lines l join nodes a on a.bus_id = l.a join nodes b on b.bus_id = l.b group by 1, 2")
def edge_distances(spark: SparkSession, d: str) -> DataFrame:
    nodes, lines = _grid(spark, d)
    return _rounded(grid.edge_weights(lines, nodes, "distance"), 9, "w")


@_query("line_templates", f"with {_GRID} select case when voltage in (380, 400) then 380 else voltage end as class, round(quantile_cont(r * circuits / length, 0.5), 9) as r_per, round(quantile_cont(x * circuits / length, 0.5), 9) as x_per, round(quantile_cont(s_nom / circuits, 0.5), 6) as s_per from lines where length > 0 group by 1")
def line_templates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(grid.line_templates(_grid(spark, d)[1]), 9, "r_per", "x_per"), 6, "s_per")


@_query("exclude_countries", f"with {_GRID} select line_id from lines where ca not in (3, 9) and cb not in (3, 9)")
def exclude_countries(spark: SparkSession, d: str) -> DataFrame:
    nodes, lines = _grid(spark, d)
    return grid.exclude_countries(nodes, spark.createDataFrame([("3",), ("9",)], "country string"), lines)[1][0].select("line_id")


@_query(
    "cluster_budget",
    f"""with {_GRID}, g as (select country, count(*) as n, sum(lat) as w from nodes group by 1), a as (select *, least(1, n) as k0, greatest(60 - sum(least(1, n)) over (), 0) as left0 from g), b as (select *, w / sum(w) over () * left0 as ideal from a), c as (select *, k0 + least(floor(ideal), n - k0) as k1 from b),
    e as (select *, greatest(60 - sum(k1) over (), 0) as left1, row_number() over (order by n - k1 > 0 desc, ideal - floor(ideal) desc, n desc, country) as place from c), f as (select *, k1 + case when n - k1 > 0 and place <= left1 then 1 else 0 end as k2 from e),
    h as (select *, greatest(60 - sum(k2) over (), 0) as left2, coalesce(sum(n - k2) over (order by n - k2 desc, country rows between unbounded preceding and 1 preceding), 0) as before from f)
    select country::varchar as country, (k2 + greatest(0, least(n - k2, left2 - before)))::int as k from h""",
)
def cluster_budget(spark: SparkSession, d: str) -> DataFrame:
    nodes = _grid(spark, d)[0].withColumn("country", F.col("country").cast("int"))
    return grid.cluster_budget(nodes, 60, ["country"], "lat").withColumn("country", F.col("country").cast("string"))


@_query("cluster_corridors", f"with {_GRID} select least(ca, cb)::varchar as first, greatest(ca, cb)::varchar as second, round(sum(circuits / cast(x as double)), 6) as b from lines where ca <> cb group by 1, 2")
def cluster_corridors(spark: SparkSession, d: str) -> DataFrame:
    nodes, lines = _grid(spark, d)
    pad = nodes.select("bus_id", F.lpad("country", 3, "0").alias("cluster_id"))
    out = benchmark.cluster_corridors(lines, pad)
    return _rounded(out.withColumns({c: F.col(c).cast("int").cast("string") for c in ("first", "second")}), 6, "b")


@_query(
    "snap_projects",
    f"""with {_GRID}, pr as (select o_orderkey as project_id, 35 + cast(o_orderkey * 37 % 3600 as double) / 100 as lat, -10 + cast(o_orderkey * 53 % 4000 as double) / 100 as lon, year(o_orderdate) as y, o_orderstatus = 'F' as up from orders where o_orderkey % 50 = 0),
    near as (select project_id, y, up, min({{'km': {_KM.replace('6371.0', '6371.0088')}, 'n': b.bus_id}}) as m from pr a, nodes b where not dc group by 1, 2, 3)
    select project_id, m.n as bus_id, case when m.km <= 10 then 'good' when m.km <= 20 then 'review' else 'poor' end as quality from near""",
)
def snap_projects(spark: SparkSession, d: str) -> DataFrame:
    """The planned projects of the list (every fiftieth order is one) with their nearest AC node."""
    k = F.col("o_orderkey")
    projects = table(spark, d, "orders").where(k % 50 == 0).select(k.alias("point"), (35 + (k * 37 % 3600).cast("double") / 100).alias("lat"), (-10 + (k * 53 % 4000).cast("double") / 100).alias("lon"))
    nodes = _grid(spark, d)[0].where("not dc_bool").select(F.col("bus_id").alias("node"), "lat", "lon")
    out = jo.nearest(projects, nodes, radius=fn.EARTH_KM_IUGG)
    return out.select(F.col("point").alias("project_id"), F.col("node").alias("bus_id"), jo.snap_quality(F.col("km")).alias("quality"))


@_query(
    "link_decisions",
    """with f as (select year(o_orderdate) <= 2000 as t, year(o_orderdate) <= 1997 as b, ['good', 'review', 'poor'][o_orderkey % 3 + 1] as dc, ['good', 'review', 'poor', 'missing'][o_orderkey % 4 + 1] as ac, o_orderkey % 5 = 0 as m, o_orderstatus = 'F' as u, ['existing_pair', 'country_pair_mode', 'global_mode', 'none'][o_custkey % 4 + 1] as v, case when o_custkey % 9 <> 0 then 400 end as kv from orders),
    a as (select case when not t then 'skip_after_target_year' when kv is null or (not m and dc = 'good' and v = 'none') then 'manual_review_no_voltage_inference' when m then case when b then 'likely_already_in_base' when u then 'candidate_update_existing_link' else 'review_existing_link_corridor' end
      when ac not in ('good', 'review') then 'manual_review_snap_far' when dc in ('good', 'review') then case v when 'existing_pair' then 'candidate_add_link_reusing_dc_terminals' when 'country_pair_mode' then 'candidate_add_link_reusing_nearby_dc_terminals' when 'global_mode' then 'manual_review_voltage_assumption' else 'manual_review' end
      else case v when 'country_pair_mode' then 'review_add_link_with_new_dc_terminals' when 'global_mode' then 'manual_review_voltage_and_terminal_topology' else 'manual_review' end end as action from f)
    select action, case when action in ('skip_after_target_year', 'likely_already_in_base', 'manual_review_snap_far', 'manual_review_voltage_and_terminal_topology', 'manual_review_voltage_assumption', 'manual_review_no_voltage_inference') then 'ignore' when action like 'candidate_add_link%' then 'include_new_link_reuse_dc' when action = 'review_add_link_with_new_dc_terminals' then 'include_new_link_to_nearest_ac'
      when action in ('candidate_update_existing_link', 'review_existing_link_corridor') then 'include_as_upgrade' else 'inspect' end as recommendation, count(*) as n from a group by 1, 2""",
)
def link_decisions(spark: SparkSession, d: str) -> DataFrame:
    k, c, y = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    pick = lambda names, i: F.array(*[F.lit(x) for x in names])[(i % len(names)).cast("int")]
    action = jo.link_actions(y <= 2000, y <= 1997, pick(("good", "review", "poor"), k), pick(("good", "review", "poor", "missing"), k), k % 5 == 0, F.col("o_orderstatus") == "F", pick(("existing_pair", "country_pair_mode", "global_mode", "none"), c), F.when(c % 9 != 0, 400))
    out = table(spark, d, "orders").select(action.alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return out.select("action", jo.recommendation(F.col("action"))[0].alias("recommendation"), "n")
