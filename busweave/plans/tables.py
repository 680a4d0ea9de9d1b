"""The reference's operators on the star-schema tables, each with DuckDB SQL of the same result.

Roles: region = country, nation = proxy region, supplier = node, customer = demand or plant site, lineitem = fact series, part = raster
cell (brand = node, size bands = classes, retail price = headroom), orders = sites and dated rows. Coordinates follow from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as fn
from ..operators import aggregate as ag, allocate as al, graph as gr, joining as jo, kernels as ke, series as se, shares as sh
from ..operators.raster import resource_class as classes
from ..session import table


def _lat(key: str) -> str:
    return f"(35 + cast({key} * 37 % 3600 as double) / 100)"


def _lon(key: str) -> str:
    return f"(-10 + cast({key} * 91 % 4000 as double) / 100)"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- shares ------------------------------------------------------------------------------------------------------------------


@_query(
    "partition_share",
    """select s_nationkey, s_suppkey, round(case when t > 0 then v / t else 0 end, 6) as share
    from (select s_nationkey, s_suppkey, greatest(s_acctbal, 0) as v, sum(greatest(s_acctbal, 0)) over (partition by s_nationkey) as t from supplier)""",
)
def partition_share(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("v", fn.positive(F.col("s_acctbal")))
    return sh.partition_share(s, ["s_nationkey"], "v").select("s_nationkey", "s_suppkey", F.round("share", 6).alias("share"))


_PROXY = """
proxy as (select n_regionkey, n_nationkey, count(c_custkey)::double as pop, coalesce(sum(greatest(c_acctbal, 0)), 0) as gdp
  from nation left join customer on c_nationkey = n_nationkey group by 1, 2),
based as (select *, case when sum(pop) over r > 0 then pop / sum(pop) over r else 1 / cast(count(*) over r as double) end as pop_share,
  case when sum(gdp) over r > 0 then gdp / sum(gdp) over r else 1 / cast(count(*) over r as double) end as gdp_share from proxy window r as (partition by n_regionkey))"""


def _proxies(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("double").alias("pop"), F.sum(fn.positive(F.col("c_acctbal"))).alias("gdp"))
    return table(spark, d, "nation").join(c, "n_nationkey", "left").fillna(0.0, ["pop", "gdp"])


@_query("blended_share", f"with {_PROXY} select n_regionkey, n_nationkey, round(pop_share, 6) as pop_share, round(gdp_share, 6) as gdp_share, round(0.4::double * pop_share + 0.6::double * gdp_share, 6) as share from based")
def blended_share(spark: SparkSession, d: str) -> DataFrame:
    out = sh.blended_share(_proxies(spark, d), ["n_regionkey"], {"pop": 0.4, "gdp": 0.6})
    return out.select("n_regionkey", "n_nationkey", *[F.round(c, 6).alias(c) for c in ("pop_share", "gdp_share", "share")])


_WEIGHTS = f"""
nodes as (select n_regionkey, s_suppkey, {_lat('s_suppkey')} as lat, {_lon('s_suppkey')} as lon from supplier join nation on n_nationkey = s_nationkey),
regions as (select n_regionkey, n_nationkey, {_lat('n_nationkey')} as lat, {_lon('n_nationkey')} as lon from nation),
pairs as (select r.n_regionkey, n_nationkey, s_suppkey, 6371.0::double * sqrt(pow((radians(b.lon) - radians(r.lon)) * cos((radians(r.lat) + radians(b.lat)) / 2), 2) + pow(radians(b.lat) - radians(r.lat), 2)) as km
  from regions r join nodes b using (n_regionkey)),
weighted as (select n_regionkey, n_nationkey, s_suppkey, case when least <= 1e-6 then case when km <= 1e-6 then 1 / cast(same as double) end else (1 / km) / s end as weight
  from (select *, min(km) over w as least, count(*) filter (km <= 1e-6) over w as same, sum(case when km > 1e-6 then 1 / km end) over w as s from pairs window w as (partition by n_regionkey, n_nationkey)))"""


def _regions_and_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    regions = _proxies(spark, d).select("n_regionkey", F.col("n_nationkey").alias("region"), F.expr(_lat("n_nationkey")).alias("lat"), F.expr(_lon("n_nationkey")).alias("lon"), "pop", "gdp")
    nodes = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return regions, nodes.select("n_regionkey", F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("cluster"), F.expr(_lat("s_suppkey")).alias("lat"), F.expr(_lon("s_suppkey")).alias("lon"))


@_query("distance_weighted_share", f"with {_WEIGHTS} select n_regionkey, n_nationkey, s_suppkey, round(weight, 6) as weight from weighted where weight is not null")
def distance_weighted_share(spark: SparkSession, d: str) -> DataFrame:
    regions, nodes = _regions_and_nodes(spark, d)
    w = sh.distance_weights(regions, nodes, "n_regionkey")
    return w.select("n_regionkey", F.col("region").alias("n_nationkey"), F.col("node").alias("s_suppkey"), F.round("weight", 6).alias("weight"))


_SHARES = f"""{_PROXY}, {_WEIGHTS},
clusters as (select n_regionkey, s_suppkey, sum(pop_share * weight) as p, sum(gdp_share * weight) as g from weighted join based using (n_regionkey, n_nationkey) where weight is not null group by 1, 2),
blended as (select n_regionkey, s_suppkey, 0.4::double * p / sum(p) over r + 0.6::double * g / sum(g) over r as b from clusters window r as (partition by n_regionkey)),
shares as (select n_regionkey, s_suppkey, b / sum(b) over (partition by n_regionkey) as share from blended)"""


@_query(
    "national_to_bus",
    f"""with {_SHARES},
    facts as (select n_regionkey, date_trunc('month', l_shipdate)::timestamp as month, sum(l_extendedprice) as load
      from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2)
    select n_regionkey, month, s_suppkey, round(load * share, 2) as allocated from facts join shares using (n_regionkey)""",
)
def national_to_bus(spark: SparkSession, d: str) -> DataFrame:
    regions, nodes = _regions_and_nodes(spark, d)
    shares = sh.proxy_shares(regions, nodes, "n_regionkey", {"pop": 0.4, "gdp": 0.6})
    where = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    # The fact is summed by node and month before it meets anything.
    facts = table(spark, d, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.sum("l_extendedprice").alias("load"))
    facts = facts.join(where, "l_suppkey").groupBy("n_regionkey", "month").agg(F.sum("load").alias("load"))
    return facts.join(shares, "n_regionkey").select("n_regionkey", "month", F.col("cluster").alias("s_suppkey"), F.round(F.col("load") * F.col("share"), 2).alias("allocated"))


@_query(
    "fallback_cascade",
    """with c as (select s_nationkey, s_suppkey, greatest(s_acctbal - 9000, 0) as battery, greatest(s_acctbal - 6000, 0) as load from supplier),
    t as (select *, sum(battery) over n as sb, sum(load) over n as sl, count(*) over n as k from c window n as (partition by s_nationkey))
    select s_nationkey, s_suppkey, case when sb > 0 then 'battery' when sl > 0 then 'load' else 'uniform' end as rule,
      round(case when sb > 0 then battery / sb when sl > 0 then load / sl else 1 / cast(k as double) end * (100 + s_nationkey), 6) as allocated from t""",
)
def fallback_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", fn.positive(F.col("s_acctbal") - 9000).alias("battery"), fn.positive(F.col("s_acctbal") - 6000).alias("load"))
    targets = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.lit(100.0) + F.col("n_nationkey")).alias("target"))
    return sh.fallback_cascade(s, targets, "s_nationkey", ["battery", "load"]).select("s_nationkey", "s_suppkey", "rule", F.round("allocated", 6).alias("allocated"))


# ---- allocation --------------------------------------------------------------------------------------------------------------

_CAPPED = """with g as (select p_brand, count(*) * (case when length(p_brand) = 7 then 20 else 30 end)::double as target, sum(p_size)::double as s from part group by 1)"""


def _capped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("capacity"))
    goals = p.groupBy("p_brand").agg((F.count(F.lit(1)) * F.when(F.length("p_brand") == 7, 20.0).otherwise(30.0)).alias("target"))
    return al.capped_proportional(p, goals, "p_brand")


@_query("capped_proportional", _CAPPED + " select p_brand, p_partkey, round(case when s >= target then p_size / s * target else p_size end, 6) as allocated from part join g using (p_brand)")
def capped_proportional(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d)[0].select("p_brand", "p_partkey", F.round("allocated", 6).alias("allocated"))


@_query("capped_proportional_report", _CAPPED + " select p_brand, target, least(s, target) as allocated, target - least(s, target) as remainder from g")
def capped_proportional_report(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d)[1]


@_query(
    "largest_remainder",
    """with w as (select s_nationkey, s_suppkey, greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) over (partition by s_nationkey) as weight, 10 + s_nationkey % 5 as n from supplier),
    f as (select *, floor(weight * n) as fl, row_number() over (partition by s_nationkey order by weight * n - floor(weight * n) desc, weight desc, s_suppkey) as place, n - sum(floor(weight * n)) over (partition by s_nationkey) as rest from w)
    select s_nationkey, s_suppkey, cast(fl + case when place <= rest then 1 else 0 end as bigint) as assigned from f where fl + case when place <= rest then 1 else 0 end > 0""",
)
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("v", fn.positive(F.col("s_acctbal")))
    w = sh.partition_share(s, ["s_nationkey"], "v", "weight")
    units = s.select("s_nationkey").distinct().withColumn("n_units", 10 + F.col("s_nationkey") % 5)
    return al.largest_remainder(w, units, "s_nationkey", "s_suppkey")


_WATER = """with c as (select p_brand, p_partkey, greatest(p_retailprice - 950, 0) as room, case when p_size % 7 = 0 then -1 else p_size // 10 end as k from part),
d as (select p_brand, 0.45::double * sum(room) as delta from c group by 1),
cls as (select p_brand, k, sum(room) as cr, count(*) as n from c where k >= 0 and room > 0 group by 1, 2),
bud as (select cls.*, delta, least(cr, greatest(0, delta - coalesce(sum(cr) over (partition by p_brand order by k desc rows between unbounded preceding and 1 preceding), 0))) as budget from cls join d using (p_brand)),
ins as (select c.p_brand, c.k, p_partkey, room, (budget - coalesce(sum(room) over (partition by c.p_brand, c.k order by room, p_partkey rows between unbounded preceding and 1 preceding), 0))
  / (n - row_number() over (partition by c.p_brand, c.k order by room, p_partkey) + 1) as level from c join bud on c.p_brand = bud.p_brand and c.k = bud.k where room > 0),
lev as (select p_brand, k, max(level) as level from ins group by 1, 2)"""


def _water(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select("p_brand", "p_partkey", fn.positive(F.col("p_retailprice") - 950).alias("headroom"), F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.floor(F.col("p_size") / 10)).alias("class"))
    return al.water_fill(p, p.groupBy("p_brand").agg((F.lit(0.45) * F.sum("headroom")).alias("delta")), "p_brand", "p_partkey")


@_query("water_fill", _WATER + " select c.p_brand, p_partkey, round(coalesce(case when room > 0 then least(room, greatest(0, level)) end, 0), 4) as addition from c left join lev on c.p_brand = lev.p_brand and c.k = lev.k")
def water_fill(spark: SparkSession, d: str) -> DataFrame:
    return _water(spark, d)[0].select("p_brand", "p_partkey", F.round("addition", 4).alias("addition"))


@_query("water_fill_report", _WATER + " select p_brand, round(delta, 4) as delta, round(coalesce(s, 0), 4) as allocated, round(delta - coalesce(s, 0), 4) + 0 as remainder from d left join (select p_brand, sum(budget) as s from bud group by 1) using (p_brand)")
def water_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return _water(spark, d)[1].select("p_brand", *[(F.round(c, 4) + 0).alias(c) for c in ("delta", "allocated", "remainder")])


@_query(
    "priority_fill",
    """with r as (select o_custkey, o_orderkey, o_totalprice, coalesce(sum(o_totalprice) over (partition by o_custkey order by o_orderdate desc, o_totalprice desc, o_orderkey rows between unbounded preceding and 1 preceding), 0) as before
      from orders where o_totalprice > 0)
    select o_custkey, o_orderkey, round(least(o_totalprice, 800000 - before), 2) as filled from r where least(o_totalprice, 800000 - before) > 1e-9""",
)
def priority_fill(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_totalprice", "capacity")
    goals = o.select("o_custkey").distinct().withColumn("target", F.lit(800000.0))
    return al.priority_fill(o, goals, "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey", F.round("filled", 2).alias("filled"))


# A fuel for each kind of part.
_KINDS = {"STANDARD": "gas", "ECONOMY": "oil", "MEDIUM": "hard_coal", "PROMO": "lignite", "LARGE": "nuclear", "SMALL": "oil_shale"}


@_query("unit_packing")
def unit_packing(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "part").select((F.col("p_partkey") % 25).alias("country"), fn.mapped(F.col("p_type"), _KINDS).alias("fuel_group"), F.col("p_partkey").alias("unit"), F.col("p_size").alias("size"))
    fuels = F.array(*[F.lit(v) for v in _KINDS.values()])
    sites = table(spark, d, "supplier").select(F.col("s_nationkey").alias("country"), F.col("s_suppkey").alias("site"), fuels[(F.col("s_suppkey") % 6).cast("int")].alias("fuel_group"), (F.col("s_acctbal") / 20).alias("capacity"), (2000 + F.col("s_suppkey") % 30).alias("date_out"))
    return al.unit_packing(units, sites)


@_query(
    "round_robin",
    """with b as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) - 1 as pos, count(*) over (partition by s_nationkey) as n from supplier),
    u as (select p_partkey % 25 as g, p_partkey, p_retailprice, row_number() over (partition by p_partkey % 25 order by p_retailprice desc, p_partkey) - 1 as i from part)
    select g as country, p_partkey, p_retailprice, s_suppkey from u join b on s_nationkey = g and pos = i % n""",
)
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "part").select((F.col("p_partkey") % 25).alias("country"), "p_partkey", "p_retailprice")
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("country"), "s_suppkey", "s_acctbal")
    return al.round_robin(units, nodes, "country", "p_partkey", "p_retailprice", "s_suppkey", "s_acctbal")


@_query(
    "round_robin_offset",
    """with b as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as pos, count(*) over (partition by s_nationkey) as k from supplier),
    d as (select n_nationkey, dem, 1 + (n_nationkey + dem) % 5 as n from nation, range(6) t(dem)),
    s as (select *, coalesce(sum(n) over (partition by n_nationkey order by dem rows between unbounded preceding and 1 preceding), 0) as start from d)
    select s_nationkey, dem as demand, s_suppkey, count(*) as assigned from s, unnest(range(n::bigint)) u(i), b where s_nationkey = n_nationkey and pos = (start + i) % k group by 1, 2, 3""",
)
def round_robin_offset(spark: SparkSession, d: str) -> DataFrame:
    nodes = sh.ranked_nodes(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", [], "s_suppkey")
    demands = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("demand"))
    demands = demands.withColumn("n", 1 + (F.col("s_nationkey") + F.col("demand")) % 5)
    return al.round_robin_with_offset(demands, nodes, "s_nationkey", "demand", "n", "s_suppkey", "rank")


@_query(
    "bus_rank",
    """with m as (select s_nationkey, s_suppkey, max(l_quantity) as biggest, count(*) as n from supplier join lineitem on l_suppkey = s_suppkey group by 1, 2)
    select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by biggest desc, n desc, s_suppkey) as rank from m""",
)
def bus_rank(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_quantity").alias("biggest"), F.count(F.lit(1)).alias("n"))
    nodes = table(spark, d, "supplier").select("s_nationkey", "s_suppkey").join(m, "s_suppkey")
    return sh.ranked_nodes(nodes, "s_nationkey", [("biggest", True), ("n", True)], "s_suppkey").select("s_nationkey", "s_suppkey", F.col("rank").cast("long").alias("rank"))


@_query(
    "top_site_tie",
    """with v as (select c_nationkey, c_custkey, greatest(floor((c_acctbal - 9500) / 400), 0) as storage, greatest(floor(c_acctbal / 3000), 0) as load from customer),
    r as (select c_nationkey, max({'v': storage, 'i': c_custkey}) as s, max({'v': load, 'i': c_custkey}) as l from v group by 1)
    select c_nationkey, case when s.v > 0 then s.i when l.v > 0 then l.i end as c_custkey, case when s.v > 0 then 'storage' when l.v > 0 then 'load' end as rule from r""",
)
def top_site_tie(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.floor((F.col("c_acctbal") - 9500) / 400).cast("double").alias("storage"), F.floor(F.col("c_acctbal") / 3000).cast("double").alias("load"))
    return sh.top_site(c, "c_nationkey", "c_custkey", ["storage", "load"])


@_query(
    "clamp_and_flag",
    """with v as (select l_linestatus, case when l_linenumber = 7 then null else l_extendedprice / 1000 - 10 end as value, l_quantity as cap from lineitem),
    b as (select l_linestatus, coalesce(case when value is not null then least(greatest(value, 0), cap) end, cap) as bounded, case when value is null then 'missing' when least(greatest(value, 0), cap) <> value then 'yes' else 'no' end as flag from v)
    select l_linestatus, flag, count(*) as n, round(sum(bounded), 2) as total from b group by 1, 2""",
)
def clamp_and_flag(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000 - 10)
    bounded, flag = al.clamp_and_flag(value, F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_linestatus", flag.alias("flag"), bounded.alias("b")).groupBy("l_linestatus", "flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b"), 2).alias("total"))


@_query(
    "scale_to_total",
    """with raw as (select s_nationkey, s_suppkey, sum(l_quantity) filter (l_returnflag = 'R' and s_nationkey % 4 <> 1) as raw, max(s_acctbal) as cap from supplier join lineitem on l_suppkey = s_suppkey group by 1, 2),
    tot as (select s_nationkey, case when s_nationkey % 6 = 0 then 0 else sum(l_extendedprice) end as total from supplier join lineitem on l_suppkey = s_suppkey group by s_nationkey),
    m as (select raw.*, total, sum(raw) over n as sr, count(raw) over n as kn, sum(greatest(cap, 0)) over n as sc from raw join tot using (s_nationkey) window n as (partition by s_nationkey)),
    o as (select *, case when total <= 0 then 'zero_national' when sr > 0 then 'scaled' when kn > 0 then 'profile_zero' when sc > 0 then 'capacity_fallback' else 'no_profile_no_capacity' end as mode from m)
    select s_nationkey, s_suppkey, mode, round(case when mode = 'scaled' then total / sr end, 6) as factor,
      round(case when mode = 'scaled' then coalesce(raw, 0) * (total / sr) when mode = 'capacity_fallback' then greatest(cap, 0) / sc * total else 0 end, 2) as scaled from o""",
)
def scale_to_total(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"), F.sum("l_extendedprice").alias("e"))
    raw = raw.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("cap")), "s_suppkey").withColumn("raw", F.when(F.col("s_nationkey") % 4 != 1, F.col("r")))
    totals = raw.groupBy("s_nationkey").agg(F.sum("e").alias("e")).select("s_nationkey", F.when(F.col("s_nationkey") % 6 == 0, 0.0).otherwise(F.col("e")).alias("total"))
    out = al.scale_to_total(raw, totals, ["s_nationkey"], "raw", "cap")
    return out.select("s_nationkey", "s_suppkey", "mode", F.round("factor", 6).alias("factor"), F.round("scaled", 2).alias("scaled"))


# ---- aggregation -------------------------------------------------------------------------------------------------------------


@_query(
    "weighted_passthrough",
    """select l_suppkey, sum(l_quantity) as l_quantity, round(sum(coalesce(nullif(l_discount, 0.05::double), 0) * l_quantity) / sum(l_quantity), 6) as discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) as l_tax,
      string_agg(distinct l_returnflag, ',' order by l_returnflag) as l_returnflag from lineitem group by 1""",
)
def weighted_passthrough(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.05)))
    out = ag.weighted_passthrough(x, ["l_suppkey"], "l_quantity", ["discount", "l_tax"], ["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("discount", "l_tax")})


@_query("joined_unique_sources", "select c_nationkey, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as priorities, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as segments from orders join customer on o_custkey = c_custkey group by 1")
def joined_unique_sources(spark: SparkSession, d: str) -> DataFrame:
    # Distinct per customer first: the join then carries a few values per customer instead of every order.
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    j = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    return j.groupBy("c_nationkey").agg(fn.joined_unique(F.col("o_orderpriority"), "|").alias("priorities"), fn.joined_unique(F.col("c_mktsegment"), "|").alias("segments"))


_FLOWS = """flows as (select s_nationkey as a, c_nationkey as b, l_quantity, l_extendedprice, l_discount, l_shipdate from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""


def _flows(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Fact rows with the nation they come from and go to."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", *keep).join(s, "l_suppkey").join(o.join(c, "c_custkey").drop("c_custkey"), "l_orderkey").select("a", "b", *keep)


@_query(
    "directed_pair_flow",
    f"""with {_FLOWS} select least(a, b) as first, greatest(a, b) as second, round(coalesce(sum(l_extendedprice) filter (a < b), 0), 2) as to_mw, round(coalesce(sum(l_extendedprice) filter (a > b), 0), 2) as from_mw, count(*) as n_rows
    from flows where a <> b group by 1, 2""",
)
def directed_pair_flow(spark: SparkSession, d: str) -> DataFrame:
    out = ag.directed_pairs(_flows(spark, d, "l_extendedprice"), "a", "b", "l_extendedprice")
    return out.withColumns({c: F.round(c, 2) for c in ("to_mw", "from_mw")})


@_query(
    "corridor_admittance",
    f"""with {_FLOWS}, y as (select least(a, b) as first, greatest(a, b) as second, sum(l_quantity / z2) as g, sum(-x / z2) as q, sum(l_extendedprice) as rating, count(*) as n
      from (select *, l_discount + 0.01::double as x, l_quantity * l_quantity + (l_discount + 0.01::double) * (l_discount + 0.01::double) as z2 from flows where a <> b) group by 1, 2)
    select first, second, n as n_branches, round(rating, 2) as rating, round(g / (g * g + q * q), 9) as r, round(-q / (g * g + q * q), 9) as x from y""",
)
def corridor_admittance(spark: SparkSession, d: str) -> DataFrame:
    f = _flows(spark, d, "l_quantity", "l_discount", "l_extendedprice").where("a <> b")
    f = f.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), F.col("l_quantity").alias("r"), (F.col("l_discount") + 0.01).alias("x"), F.col("l_extendedprice").alias("s"))
    out = ag.parallel_branches(f, ["first", "second"], rating="s")
    return out.select("first", "second", "n_branches", F.round("rating", 2).alias("rating"), F.round("r", 9).alias("r"), F.round("x", 9).alias("x"))


@_query(
    "median_imputation",
    """with v as (select c_custkey, c_nationkey, c_mktsegment, case when c_acctbal >= 0 and c_nationkey <> 7 and not (c_nationkey = 9 and c_mktsegment = 'BUILDING') then c_acctbal end as v from customer),
    m1 as (select c_nationkey, c_mktsegment, quantile_cont(v, 0.5) as m from v group by 1, 2), m2 as (select c_nationkey, quantile_cont(v, 0.5) as m from v group by 1),
    m3 as (select c_mktsegment, quantile_cont(v, 0.5) as m from v group by 1), m4 as (select quantile_cont(v, 0.5) as m from v)
    select c_custkey, round(coalesce(v, m1.m, m2.m, m3.m, m4.m, 1), 6) as imputed,
      case when v is not null then 'given' when m1.m is not null then 'c_nationkey_c_mktsegment' when m2.m is not null then 'c_nationkey' when m3.m is not null then 'c_mktsegment' when m4.m is not null then 'global' else 'default' end as source
    from v left join m1 using (c_nationkey, c_mktsegment) left join m2 using (c_nationkey) left join m3 using (c_mktsegment), m4""",
)
def median_imputation(spark: SparkSession, d: str) -> DataFrame:
    known = (F.col("c_acctbal") >= 0) & (F.col("c_nationkey") != 7) & ~((F.col("c_nationkey") == 9) & (F.col("c_mktsegment") == "BUILDING"))
    c = table(spark, d, "customer").withColumn("v", F.when(known, F.col("c_acctbal")))
    out = ag.median_imputation(c, "v", [["c_nationkey", "c_mktsegment"], ["c_nationkey"], ["c_mktsegment"], []])
    return out.select("c_custkey", F.round("imputed", 6).alias("imputed"), "source")


@_query("conditional_scenario_filter", "select 'occurs' as asked, o_orderstatus, count(*) as n from orders where o_orderpriority = '2-HIGH' group by 2 union all select 'absent', o_orderstatus, count(*) from orders group by 2")
def conditional_scenario_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    count = lambda asked, wanted: jo.only_if_present(o, "o_orderpriority", wanted).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.lit(asked).alias("asked"), "o_orderstatus", "n")
    return count("occurs", " 2-high").unionByName(count("absent", "9-NONE"))


@_query(
    "dedupe_conflict",
    """select user_id, event_type, min(floor(value / 100)) as level, count(*) as n_rows, min(floor(value / 100)) is distinct from max(floor(value / 100)) as conflict from events group by 1, 2""",
)
def dedupe_conflict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 100).cast("double").alias("level"))
    return ag.conflicts(e, ["user_id", "event_type"], ["level"])


@_query("max_then_sum", "select l_suppkey, sum(q) as l_quantity from (select l_suppkey, l_returnflag, l_linenumber, max(l_quantity) as q from lineitem group by 1, 2, 3) group by 1")
def max_then_sum(spark: SparkSession, d: str) -> DataFrame:
    return ag.max_then_sum(table(spark, d, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linenumber"], "l_quantity")


@_query("mean_of_means", "select l_suppkey, round(avg(m), 6) as l_discount from (select l_suppkey, year(l_shipdate) as y, avg(l_discount) as m from lineitem group by 1, 2) group by 1")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_discount")
    return ag.mean_of_means(x, ["l_suppkey"], "y", "l_discount").withColumn("l_discount", F.round("l_discount", 6))


@_query("threshold_retention", "select p_brand, t as threshold, count(*) filter (p_retailprice >= t) as n_kept, round(coalesce(sum(p_size) filter (p_retailprice >= t), 0), 2)::double as weight_kept, round(count(*) filter (p_retailprice >= t) / cast(count(*) as double), 6) as share_kept from part, (values (900::double), (1000::double), (1100::double)) v(t) group by 1, 2")
def threshold_retention(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("w", F.col("p_size").cast("double"))
    out = ag.retention(p, ["p_brand"], "p_retailprice", "w", [900.0, 1000.0, 1100.0])
    return out.withColumns({"weight_kept": F.round("weight_kept", 2), "share_kept": F.round("share_kept", 6)})


@_query("quantile_table", " union all ".join(f"select l_returnflag, {q}::double as quantile, round(quantile_cont(l_extendedprice, {q}), 4) as value from lineitem group by 1" for q in (0.05, 0.5, 0.95)))
def quantile_table(spark: SparkSession, d: str) -> DataFrame:
    return ag.exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95]).withColumn("value", F.round("value", 4))


@_query(
    "minmax_composite_rank",
    """with m as (select l_suppkey, sum(l_quantity) as qty, avg(l_discount) as disc, max(l_tax) as tax from lineitem group by 1), e as (select min(qty) as ql, max(qty) as qh, min(disc) as dl, max(disc) as dh, min(tax) as tl, max(tax) as th from m),
    s as (select l_suppkey, round(0.5::double * (case when qh - ql <= 1e-12 then 1 else (qty - ql) / (qh - ql) end) + 0.3::double * (case when dh - dl <= 1e-12 then 1 else (dh - disc) / (dh - dl) end) + 0.2::double * (case when th - tl <= 1e-12 then 1 else (th - tax) / (th - tl) end), 6) as score from m, e)
    select l_suppkey, score, row_number() over (order by score desc, l_suppkey) as rank from s""",
)
def minmax_composite_rank(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.max("l_tax").alias("tax"))
    out = ag.composite_rank(m, "l_suppkey", {"qty": 0.5, "disc": 0.3, "tax": 0.2}, {"qty"}).select("l_suppkey", F.round("score", 6).alias("score"))
    return sh.ranked_nodes(out.withColumn("_g", F.lit(0)), "_g", [("score", True)], "l_suppkey").select("l_suppkey", "score", F.col("rank").cast("long").alias("rank"))


@_query(
    "nrmse_cosine",
    """with y as (select s_nationkey, extract(month from l_shipdate) as m, sum(l_extendedprice) filter (year(l_shipdate) = 1997) as t, sum(l_extendedprice) filter (year(l_shipdate) = 1998) as g from lineitem join supplier on l_suppkey = s_suppkey where year(l_shipdate) in (1997, 1998) group by 1, 2)
    select s_nationkey, round(sqrt(avg((g - t) * (g - t))) / sqrt(avg(t * t)), 6) as nrmse, round(sum(t * g) / (sqrt(sum(t * t)) * sqrt(sum(g * g))), 6) as cosine, round(corr(t, g), 6) as correlation, round(sum(abs(g - t) * abs(t)) / sum(t * t), 6) as wape, round(sum(abs(g - t)) / sum(abs(t)), 6) as wape_plain
    from (select s_nationkey, coalesce(t, 0) as t, coalesce(g, 0) as g from y) group by 1""",
)
def nrmse_cosine(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "lineitem").where(F.year("l_shipdate").isin(1997, 1998)).groupBy("l_suppkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.sum("l_extendedprice").alias("e"))
    y = y.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("s_nationkey", "m").agg(F.sum(F.when(F.col("y") == 1997, F.col("e"))).alias("t"), F.sum(F.when(F.col("y") == 1998, F.col("e"))).alias("g"))
    out = ag.agreement(y, ["s_nationkey"], "t", "g")
    return out.select("s_nationkey", *[F.round(c, 6).alias(c) for c in ("nrmse", "cosine", "correlation", "wape", "wape_plain")])


_KM = "2 * 6371.0::double * asin(least(1, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@_query("haversine_matrix", f"with n as (select n_nationkey as k, n_regionkey as r, {_lat('n_nationkey')} as lat, {_lon('n_nationkey')} as lon from nation) select a.k as from_key, b.k as to_key, round({_KM}, 6) as km from n a join n b on a.r = b.r")
def haversine_matrix(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.expr(_lat("n_nationkey")).alias("lat"), F.expr(_lon("n_nationkey")).alias("lon"))
    m = n.select("n_regionkey", F.col("n_nationkey").alias("to_key"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return n.join(m, "n_regionkey").select(F.col("n_nationkey").alias("from_key"), "to_key", F.round(fn.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@_query(
    "medoid",
    f"""with p as (select s_nationkey as g, s_suppkey as k, {_lat('s_suppkey')} as lat, {_lon('s_suppkey')} as lon from supplier),
    t as (select a.g, a.k, round(sum({_KM.replace('6371.0', '6371.0088')}), 6) as total_km from p a join p b on a.g = b.g group by 1, 2)
    select g as s_nationkey, (min({{'t': total_km, 'i': k}})).i as s_suppkey, min(total_km) as total_km from t group by 1""",
)
def medoid(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.expr(_lat("s_suppkey")).alias("lat"), F.expr(_lon("s_suppkey")).alias("lon"))
    return ag.medoid(p, "s_nationkey", "s_suppkey")


# ---- joins -------------------------------------------------------------------------------------------------------------------


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("country"), F.expr(_lat("c_custkey")).alias("lat"), F.expr(_lon("c_custkey")).alias("lon"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("country"), F.expr(_lat("s_suppkey")).alias("lat"), F.expr(_lon("s_suppkey")).alias("lon"))
    return c, s


_NEAR = f"""a as (select c_custkey, c_nationkey as g, {_lat('c_custkey')} as lat, {_lon('c_custkey')} as lon from customer), b as (select s_suppkey, s_nationkey as g, {_lat('s_suppkey')} as lat, {_lon('s_suppkey')} as lon from supplier)"""


@_query(
    "nearest_bus",
    f"""with {_NEAR}, own as (select c_custkey, min({{'km': {_KM}, 'n': s_suppkey}}) as m from a join b on a.g = b.g and b.g <> 3 group by 1),
    rest as (select c_custkey, min({{'km': {_KM}, 'n': s_suppkey}}) as m from a, b where b.g <> 3 and c_custkey not in (select c_custkey from own) group by 1)
    select c_custkey, m.n as s_suppkey, round(m.km, 6) as km, true as in_group from own union all select c_custkey, m.n, round(m.km, 6), false from rest""",
)
def nearest_bus(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sites(spark, d)
    out = jo.nearest_in_group_else_any(c, s.where("country <> 3"), "country")
    return out.select(F.col("point").alias("c_custkey"), F.col("node").alias("s_suppkey"), F.round("km", 6).alias("km"), "in_group")


@_query(
    "snap_quality",
    f"""with {_NEAR}, m as (select c_custkey, min({{'km': {_KM}, 'n': s_suppkey}}) as m from a, b where c_custkey % 50 <> 0 group by 1)
    select c_custkey, m.n as s_suppkey, case when m.km is null then 'missing' when m.km <= 10 then 'good' when m.km <= 20 then 'review' else 'poor' end as quality from a left join m using (c_custkey)""",
)
def snap_quality(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sites(spark, d)
    c = c.withColumn("lat", F.when(F.col("point") % 50 != 0, F.col("lat")))
    return jo.nearest(c, s).select(F.col("point").alias("c_custkey"), F.col("node").alias("s_suppkey"), jo.snap_quality(F.col("km")).alias("quality"))


@_query(
    "decision_table",
    """with f as (select year(o_orderdate) <= 2000 as t, year(o_orderdate) <= 1997 as b, ['good', 'review', 'poor', 'missing'][o_orderkey % 4 + 1] as s, o_orderkey % 3 = 0 as m, o_orderkey % 5 < 3 as x, o_orderstatus = 'F' as u, o_orderkey % 7 <> 0 as p from orders)
    select action, count(*) as n from (select case when t and s = 'good' and not p then 'manual_review_no_line_template' when t and s in ('good', 'review') and m and not x and not u then 'review_existing_corridor_voltage_mismatch'
      when t and s in ('good', 'review') and m and not x and u then 'review_voltage_upgrade_existing_corridor' when t and s in ('good', 'review') and m and x and not b and u then 'candidate_update_existing_line'
      when t and s in ('good', 'review') and m and x and not b and not u then 'review_existing_corridor_or_parallel_line' when t and s in ('good', 'review') and m and x and b then 'likely_already_in_base'
      when t and s in ('good', 'review') and not m and u then 'candidate_add_or_reroute_upgraded_line' when t and s in ('good', 'review') and not m and not u then 'candidate_add_new_line'
      when t and s not in ('good', 'review') then 'manual_review_snap_far' when not t then 'skip_after_target_year' else 'manual_review' end as action from f) group by 1""",
)
def decision_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    snap = F.array(*[F.lit(x) for x in ("good", "review", "poor", "missing")])[(k % 4).cast("int")]
    year = F.year("o_orderdate")
    action = jo.line_actions(year <= 2000, year <= 1997, snap, k % 3 == 0, k % 5 < 3, F.col("o_orderstatus") == "F", k % 7 != 0)
    return table(spark, d, "orders").select(action.alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "full_outer_recon",
    """with l as (select c_nationkey as nation, sum(c_acctbal) as v from customer where c_nationkey < 20 group by 1), r as (select s_nationkey as nation, sum(s_acctbal) as v from supplier where s_nationkey >= 5 group by 1)
    select nation, round(coalesce(l.v, 0), 2) as left_value, round(coalesce(r.v, 0), 2) as right_value, case when l.v is null then 'right_only' when r.v is null then 'left_only' else 'both' end as sides, round(coalesce(r.v, 0) - coalesce(l.v, 0), 2) as difference from l full join r using (nation)""",
)
def full_outer_recon(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("c_acctbal").alias("v"))
    r = table(spark, d, "supplier").where("s_nationkey >= 5").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("s_acctbal").alias("v"))
    return jo.reconcile(l, r, ["nation"], "v").withColumns({c: F.round(c, 2) for c in ("left_value", "right_value", "difference")})


@_query(
    "corridor_jaccard",
    f"""with {_FLOWS}, f as (select year(l_shipdate) as y, least(a, b) as a, greatest(a, b) as b, l_quantity as q from flows where a <> b and year(l_shipdate) in (1997, 1998)),
    l as (select a, b, sum(q) as v from f where y = 1997 group by 1, 2), r as (select a, b, sum(q) as v from f where y = 1998 group by 1, 2), j as (select l.v as t, r.v as g from l full join r using (a, b))
    select count(*) filter (t is not null and g is not null) as n_common, count(*) filter (g is null) as n_missing, count(*) filter (t is null) as n_extra, round(count(*) filter (t is not null and g is not null) / cast(count(*) filter (g is not null) as double), 6) as precision,
      round(count(*) filter (t is not null and g is not null) / cast(count(*) filter (t is not null) as double), 6) as recall, round(count(*) filter (t is not null and g is not null) / cast(count(*) as double), 6) as jaccard,
      round(sum(abs(coalesce(g, 0) - coalesce(t, 0)) * coalesce(t, 0)) / sum(coalesce(t, 0) * coalesce(t, 0)), 6) as wape, round(sum(abs(coalesce(g, 0) - coalesce(t, 0))) / sum(coalesce(t, 0)), 6) as wape_plain from j""",
)
def corridor_jaccard(spark: SparkSession, d: str) -> DataFrame:
    f = _flows(spark, d, "l_quantity", "l_shipdate").where("a <> b")
    f = f.groupBy(F.year("l_shipdate").alias("y"), F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.sum("l_quantity").alias("v"))
    out = jo.corridor_agreement(f.where("y = 1997"), f.where("y = 1998"), ["first", "second"], "v")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "jaccard", "wape", "wape_plain")})


@_query(
    "semi_anti_guard",
    """with h as (select distinct l_suppkey from lineitem where l_quantity >= 50 and l_discount >= 0.1 and l_tax >= 0.08)
    select s_nationkey, count(*) filter (l_suppkey is not null) as n_kept, count(*) filter (l_suppkey is null) as n_dropped from supplier left join h on l_suppkey = s_suppkey group by 1""",
)
def semi_anti_guard(spark: SparkSession, d: str) -> DataFrame:
    heavy = table(spark, d, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1 and l_tax >= 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    s = jo.keep_members(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), heavy, ["s_suppkey"])
    return s.groupBy("s_nationkey").agg(F.count(F.when(F.col("kept"), 1)).alias("n_kept"), F.count(F.when(~F.col("kept"), 1)).alias("n_dropped"))


# ---- series ------------------------------------------------------------------------------------------------------------------

_WEEK = "((dayofyear(o_orderdate) - 1) // 7 + 1)"


@_query(
    "week_calendar",
    f"""select year(o_orderdate)::int as year, {_WEEK}::int as week, (make_date(year(o_orderdate), 1, 1) + (({_WEEK} - 1) * 7)::int)::date as first_day, least((make_date(year(o_orderdate), 1, 1) + (({_WEEK} - 1) * 7 + 6)::int)::date, make_date(year(o_orderdate), 12, 31)) as last_day, count(*) as n
    from orders group by 1, 2, 3, 4""",
)
def week_calendar(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), fn.week_of_year(F.col("o_orderdate")).alias("week"))
    n = o.groupBy("year", "week").agg(F.count(F.lit(1)).alias("n"))
    return n.select("year", "week", fn.week_start(F.col("year"), F.col("week")).alias("first_day"), fn.week_end(F.col("year"), F.col("week")).alias("last_day"), "n")


@_query(
    "hourly_to_weekly",
    """select event_type, year(ts)::int as year, (((dayofyear(ts) - 1) * 24 + hour(ts)) // 168 + 1)::int as week, round(sum(value) * 1000, 2) as value from events where ((dayofyear(ts) - 1) * 24 + hour(ts)) // 168 < 52 group by 1, 2, 3""",
)
def hourly_to_weekly(spark: SparkSession, d: str) -> DataFrame:
    return se.hourly_to_weekly(table(spark, d, "events"), ["event_type"], "ts", "value").withColumn("value", F.round("value", 2))


_WEEKLY = f"""weekly as (select o_orderpriority as k, year(o_orderdate)::int as year, {_WEEK}::int as week, sum(o_totalprice) as value from orders group by 1, 2, 3)"""


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return se.calendar_weeks(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice").select(F.col("o_orderpriority").alias("k"), "year", "week", F.col("o_totalprice").alias("value"))


@_query(
    "week_gap_fill",
    f"""with {_WEEKLY}, kept as (select * from weekly where week <= 52 and (week * 7 + year) % 5 <> 0 and week not between 20 and 23),
    grid as (select k, year, w as week from (select distinct k, year from kept), range(1, 53) t(w)), g as (select k, year, week, value from grid left join kept using (k, year, week)),
    n as (select *, last_value(case when value is not null then week end ignore nulls) over (partition by k, year order by week rows between unbounded preceding and current row) as pw, last_value(value ignore nulls) over (partition by k, year order by week rows between unbounded preceding and current row) as pv,
      first_value(case when value is not null then week end ignore nulls) over (partition by k, year order by week rows between current row and unbounded following) as nw, first_value(value ignore nulls) over (partition by k, year order by week rows between current row and unbounded following) as nv from g)
    select k, year, week::int as week, value is null and (pv is not null or nv is not null) as filled, round(coalesce(value, case when pv is null then nv when nv is null then pv else pv + (nv - pv) / (nw - pw) * (week - pw) end), 6) as value from n""",
)
def week_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    kept = _weekly(spark, d).where("week <= 52 and (week * 7 + year) % 5 <> 0 and week not between 20 and 23")
    out = se.fill_gaps(se.complete_weeks(kept, ["k", "year"]), ["k", "year"], "week", "value")
    return out.select("k", "year", "week", "filled", F.round("value", 6).alias("value"))


@_query(
    "climatology_impute",
    f"""with {_WEEKLY}, v as (select k, year, week, case when k = '1-URGENT' and year = 1998 then null when k = '5-LOW' and year = 1999 then 0 else value end as value from weekly),
    st as (select k, year, count(*) filter (value <> 0) = 0 as miss from v group by 1, 2), m as (select v.k, week, avg(value) as mean from v join st using (k, year) where not miss group by 1, 2)
    select v.k, v.year, v.week, miss as year_missing, round(case when miss then coalesce(mean, value) else value end, 6) as value from v join st using (k, year) left join m on m.k = v.k and m.week = v.week""",
)
def climatology_impute(spark: SparkSession, d: str) -> DataFrame:
    gone = (F.col("k") == "1-URGENT") & (F.col("year") == 1998)
    zero = (F.col("k") == "5-LOW") & (F.col("year") == 1999)
    v = _weekly(spark, d).withColumn("value", F.when(gone, None).when(zero, 0.0).otherwise(F.col("value")))
    return se.climatology(v, ["k"], "year", "week", "value").select("k", "year", "week", "year_missing", F.round("value", 6).alias("value"))


# ---- cells, fuels, costs -----------------------------------------------------------------------------------------------------


@_query(
    "resource_class",
    """with e as (select p_brand, min(p_retailprice) filter (p_size >= 5) as lo, max(p_retailprice) filter (p_size >= 5) as hi from part group by 1)
    select p_brand, p_partkey, (case when p_size < 5 then -1 when hi <= lo then 0 else least(4, floor((p_retailprice - lo) / (hi - lo) * 5)) end)::int as resource_class from part join e using (p_brand)""",
)
def resource_class(spark: SparkSession, d: str) -> DataFrame:
    return classes(table(spark, d, "part"), ["p_brand"], "p_retailprice", F.col("p_size") >= 5, 5).select("p_brand", "p_partkey", "resource_class")


# Fuel names to be classified.
_FUELS = ("Natural Gas", "Brown coal / lignite", "Hard Coal", "Oil shale", "Heavy oil", "Nuclear", "Biomass", "Waste", "Geothermal", "Hydrogen", "Wind", "CCGT gas", "Biogas", "Biogas plant")
_FUEL_LIST = ", ".join(f"'{f}'" for f in _FUELS)


@_query(
    "fuel_classify",
    f"""with f as (select [{_FUEL_LIST}][p_partkey % 14 + 1] as fuel from part), c as (select fuel, case when fuel = 'Biogas' then 'B01' when lower(fuel) like '%hydrogen%' then 'B101' when lower(fuel) like '%nuclear%' then 'B14' when lower(fuel) like '%lignite%' or lower(fuel) like '%brown coal%' then 'B02'
      when lower(fuel) like '%coal%' then 'B05' when lower(fuel) like '%gas%' then 'B04' when lower(fuel) like '%oil shale%' then 'B07' when lower(fuel) like '%oil%' then 'B06' when lower(fuel) like '%bio%' then 'B01' when lower(fuel) like '%waste%' then 'B17' when lower(fuel) like '%geotherm%' then 'B09' else 'B20' end as code from f)
    select fuel, code, case code when 'B01' then 'bio' when 'B02' then 'lignite' when 'B04' then 'gas' when 'B05' then 'hard_coal' when 'B06' then 'oil' when 'B07' then 'oil_shale' when 'B09' then 'geothermal' when 'B14' then 'nuclear' when 'B17' then 'waste' else 'other' end as fuel_group, count(*) as n from c group by 1, 2, 3""",
)
def fuel_classify(spark: SparkSession, d: str) -> DataFrame:
    fuel = F.array(*[F.lit(f) for f in _FUELS])[(F.col("p_partkey") % 14).cast("int")]
    f = table(spark, d, "part").select(fuel.alias("fuel")).withColumn("code", fn.fuel_code(F.col("fuel")))
    return f.withColumn("fuel_group", fn.fuel_group(F.col("code"))).groupBy("fuel", "code", "fuel_group").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "marginal_cost",
    """with v as (select p_partkey, p_retailprice / 100 as fuel, case when p_size % 9 = 0 then null else p_size / cast(60 as double) end as eta, 70 + p_partkey % 20 as co2, 50 + p_partkey % 40 as kg, 2.5::double as om, p_type = 'PROMO' as free from part)
    select p_partkey, round(case when free then 0 when eta is null then 1e6 else fuel / eta + co2 * ((kg * 3.6::double / 1000) / eta) + om end, 6) as cost, case when free then 'fixed_zero' when eta is null then 'high_fallback' else 'formula' end as status from v""",
)
def marginal_cost(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cost, status = fn.marginal_cost(F.col("p_retailprice") / 100, F.when(F.col("p_size") % 9 != 0, F.col("p_size") / 60), (70 + k % 20).cast("double"), (50 + k % 40).cast("double"), F.lit(2.5), F.col("p_type") == "PROMO")
    return table(spark, d, "part").select("p_partkey", F.round(cost, 6).alias("cost"), status.alias("status"))


# ---- graphs ------------------------------------------------------------------------------------------------------------------


@_query(
    "pointer_jump",
    """with recursive m as (select p_partkey as s, case when p_partkey % 10 = 3 then p_partkey else p_partkey // 2 end as t from part), w(s, t, n) as (select s, t, 0 from m union all select w.s, m.t, n + 1 from w join m on w.t = m.s where m.t <> w.t and n < 60)
    select s as source, (max({'n': n, 't': t})).t as target from w group by 1""",
)
def pointer_jump(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return gr.pointer_jump(table(spark, d, "part").select(k.alias("source"), F.when(k % 10 == 3, k).otherwise(F.floor(k / 2)).alias("target")))


_EDGES = "edges as (select p.p_partkey as a, q.p_partkey as b from part p join part q on q.p_partkey = p.p_partkey + p.p_size)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size")).alias("b")).join(p.select(F.col("p_partkey").alias("b")), "b", "left_semi").select("a", "b")


@_query(
    "components",
    f"""with recursive {_EDGES}, sym as (select a, b from edges union select b, a from edges), r(n, m) as (select a, a from sym union select r.n, sym.b from r join sym on r.m = sym.a)
    select n as node, min(m) as component from r group by 1""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    return gr.components(_edges(spark, d))


@_query(
    "leaf_contract",
    f"""with {_EDGES}, near as (select distinct n, o from (select a as n, b as o from edges union all select b, a from edges) where n <> o), only_ as (select n, min(o) as t from near group by 1 having count(*) = 1),
    leaves as (select n, t from only_ join part on p_partkey = n where p_size * 10 <= 300), m as (select l.n, l.t from leaves l left join leaves k on k.n = l.t where k.t is null or (k.t = l.n and l.n > l.t))
    select n as node, t as target from m union all select p_partkey, p_partkey from part where p_partkey not in (select n from m)""",
)
def leaf_contract(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit(1).alias("members"), (F.col("p_size") * 10.0).alias("size"))
    return gr.contract_leaves(nodes, _edges(spark, d))


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as nodes, trade between them in a region as weights."""
    region = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey")
    nodes = region.select("n_regionkey", "node", F.lit(2).alias("k"), F.expr(_lon("node")).alias("x"), F.expr(_lat("node")).alias("y"), (F.col("node") % 5 - 2).cast("double").alias("p"))
    f = _flows(spark, d, "l_quantity").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.sum("l_quantity") / 1000).alias("w"))
    ends = lambda side: table(spark, d, "nation").select(F.col("n_nationkey").alias(side), F.col("n_regionkey").alias(f"_{side}"))
    edges = f.join(ends("a"), "a").join(ends("b"), "b").where("_a = _b").select(F.col("_a").alias("n_regionkey"), "a", "b", "w")
    return nodes, edges


@_query("effective_distance")
def effective_distance(spark: SparkSession, d: str) -> DataFrame:
    return ke.effective_distances(*_network(spark, d), "n_regionkey").withColumn("distance", F.round("distance", 9))


def _clustered(method: str, electrical: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return ke.cluster(*_network(spark, d), "n_regionkey", method, electrical)

    return run


for _name, _args in {"spectral_cluster": ("spectral", True), "kmeans_geo": ("kmeans",), "ward_hac": ("ward",), "mst_cut": ("mst", True)}.items():
    QUERIES[_name] = _clustered(*_args)


@_query("dc_flow")
def dc_flow(spark: SparkSession, d: str) -> DataFrame:
    return ke.dc_flows(*_network(spark, d), "n_regionkey").withColumn("flow", F.round("flow", 9))


@_query("network_indices")
def network_indices(spark: SparkSession, d: str) -> DataFrame:
    return ke.network_indices(*_network(spark, d), "n_regionkey")
