"""Problem 4 on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rescue import TargetField, ingest, promote, schema_changes
from ..session import table

# The target schemas of the two feeds and the other approved names of their fields.
_COUNTRY = TargetField("country", "string", ("country_code", "zone", "area"))
NONRES = [
    _COUNTRY,
    TargetField("year", "int", ("ref_year", "target_year")),
    TargetField("target_capacity_mw", "double", ("capacity_mw", "installed_capacity_mw", "mw")),
    TargetField("efficiency", "double", ("eta", "net_efficiency")),
    TargetField("variable_cost_eur_mwh", "double", ("variable_costs_eur_mwh", "var_cost_eur_mwh", "var_cost_om_eur_mwh", "variable_om_eur_mwh", "vom_eur_mwh"), "EUR/MWh"),
    TargetField("fuel_price_eur_gj", "double"),
    TargetField("co2_price_eur_t", "double"),
    TargetField("units", "int"),
    TargetField("revision_weeks", "int"),
    TargetField("must_run", "boolean"),
]
SITES = [
    _COUNTRY,
    TargetField("bus_id", "string", ("bus", "Bus", "assigned_bus")),
    TargetField("fuel_group", "string", ("fueltype", "Fueltype")),
    TargetField("decommissioned_capacity_mw", "double", ("capacity_mw", "Capacity")),
    TargetField("decommissioned_date_out", "int", ("date_out", "DateOut", "retirement_year")),
    TargetField("source_technologies", "string"),
    TargetField("source_names", "string"),
    TargetField("revision_weeks", "int"),
    TargetField("chp_flag", "boolean"),
]
FEEDS = {"nonres_attributes": NONRES, "decommissioned_sites": SITES}
KEEP = ["file_id", "line_no", "sender", "delivered_at"]


def _ingested(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    """Rows of a feed under its target schema, with the approved names promoted."""
    rows = table(spark, sf_dir, "delivery_rows").where(F.col("feed") == feed)
    return promote(ingest(rows, FEEDS[feed], ["feed", *KEEP]), FEEDS[feed])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = None
    for feed in FEEDS:
        # The report reads the names and kinds the ingestion has seen; rows of the feeds differ in their typed columns only.
        one = _ingested(spark, sf_dir, feed).select("feed", "sender", "file_id", "delivered_at", "_fields")
        both = one if both is None else both.unionByName(one)
    return schema_changes(both, FEEDS)


def _feed(feed: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The table of a feed; ``rescued`` names the fields whose values are in ``_rescued``."""
        out = _ingested(spark, sf_dir, feed).dropDuplicates(["file_id", "line_no"])
        names = F.array_join(F.array_sort(F.map_keys(F.from_json("_rescued", "map<string, string>"))), ",")
        return out.select(*KEEP, *[t.name for t in FEEDS[feed]], names.alias("rescued"))

    return query


def p4_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the target schema alone rescues, and what promotion replays: values per feed and name, before and after."""
    out = None
    for feed, targets in FEEDS.items():
        rows = ingest(table(spark, sf_dir, "delivery_rows").where(F.col("feed") == feed), targets, ["feed"])
        count = lambda df, n: df.select("feed", F.explode(F.map_keys(F.from_json("_rescued", "map<string, string>"))).alias("name")).groupBy("feed", "name").agg(F.count(F.lit(1)).alias(n))
        one = count(rows, "n_rescued").join(count(promote(rows, targets), "n_left"), ["feed", "name"], "left").fillna(0, ["n_left"])
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p4_found": p4_found, "p4_nonres_table": _feed("nonres_attributes"), "p4_sites_table": _feed("decommissioned_sites"), "p4_replay": p4_replay}

_APPROVED = ", ".join(f"('{feed}', '{n}', '{t.name}', {i}, '{t.kind}', '{(t.unit or '').lower()}')" for feed, targets in FEEDS.items() for t in targets for i, n in enumerate((t.name, *t.other_names)))
# Long form of the rows: each field with its type, what opens to one value, whether it casts, and whether it is its quantity's choice.
_LONG = f"""names(feed, name, q, pos, want, u) as (values {_APPROVED}),
raw as (select row_number() over () as rid, feed, sender, file_id, delivered_at, line_no, payload from (select %s * from delivery_rows)),
fields as (select rid, feed, unnest(json_keys(payload)) as name, payload from raw where json_valid(payload)),
cells as (select rid, feed, name, json_extract(payload, '$."' || name || '"') as j from fields),
opened as (select c.*, q, pos, want, json_type(j) as t, trim(case json_type(j) when 'ARRAY' then case when json_array_length(j) = 1 and json_type(j, '$[0]') not in ('ARRAY', 'OBJECT', 'NULL') then j ->> '$[0]' end
    when 'OBJECT' then case when len(list_filter(json_keys(j), lambda k: k not in ('value', 'unit'))) = 0 and coalesce(lower(trim(j ->> '$.unit')) = u, true) and json_type(j, '$.value') not in ('ARRAY', 'OBJECT', 'NULL') then j ->> '$.value' end
    else j ->> '$' end) as x from cells c left join names using (feed, name)),
typed as (select *, case want when 'string' then x when 'boolean' then case when lower(x) in ('true', 'yes', '1', 'y', 't') then 'true' when lower(x) in ('false', 'no', '0', 'n', 'f') then 'false' end
    when 'int' then case when try_cast(replace(x, ',', '.') as double) = floor(try_cast(replace(x, ',', '.') as double)) then try_cast(replace(x, ',', '.') as double)::int::varchar end
    else try_cast(replace(x, ',', '.') as double)::varchar end as v from opened),
chosen as (select *, v is not null and pos = min(case when v is not null then pos end) over (partition by rid, q) as taken, v is not null and pos = 0 as own from typed)"""


def _table_sql(feed: str) -> str:
    types = {"double": "double", "int": "int", "string": "varchar", "boolean": "boolean"}
    cols = ", ".join(f"max(v) filter (q = '{t.name}' and taken)::{types[t.kind]} as {t.name}" for t in FEEDS[feed])
    return f"""with {_LONG % 'distinct'}
select file_id, line_no, sender, delivered_at, {cols}, string_agg(name, ',' order by name) filter (t <> 'NULL' and not coalesce(taken, false)) as rescued
from raw left join chosen using (rid) where raw.feed = '{feed}' group by rid, file_id, line_no, sender, delivered_at"""


_NAMES = ", ".join(f"('{feed}', '{n}', '{t.name}')" for feed, targets in FEEDS.items() for t in targets for n in (t.name, *t.other_names))
SQL = {
    "p4_found": f"""with names(feed, name, q) as (values {_NAMES}),
files as (select feed, sender, file_id, delivered_at, row_number() over w as seq from (select distinct feed, sender, file_id, delivered_at from delivery_rows) window w as (partition by feed, sender order by delivered_at, file_id)),
ends as (select feed, sender, max(seq) as last_seq from files group by 1, 2),
raw as (select file_id, unnest(json_keys(payload)) as name, payload from delivery_rows where json_valid(payload)),
kinds as (select file_id, name, json_type(payload, '$."' || name || '"') as t from raw),
seen as (select k.file_id, k.name, max(case when t = 'VARCHAR' then 'text' when t = 'BOOLEAN' then 'boolean' when t = 'ARRAY' then 'list' when t = 'OBJECT' then 'object' when t = 'NULL' then null else 'number' end) as kind from kinds k group by 1, 2),
s as (select f.*, last_seq, seen.name, kind, coalesce(q, seen.name) as quantity from seen join files f using (file_id) join ends using (feed, sender) left join names on names.feed = f.feed and names.name = seen.name),
walked as (select *, lag(seq) over n as before, lead(seq) over n as after from s window n as (partition by feed, sender, quantity, name order by seq)),
moves as (select feed, sender, quantity, seq, name, 1 as sign from walked where seq > 1 and (before is null or before < seq - 1)
  union all select feed, sender, quantity, seq + 1, name, -1 from walked where seq < last_seq and (after is null or after > seq + 1)),
sets as (select feed, sender, quantity, seq, coalesce(list(name order by name) filter (sign = 1), []) as new, coalesce(list(name order by name) filter (sign = -1), []) as old from moves group by 1, 2, 3, 4),
named as (select feed, sender, seq, unnest(new[1:least(len(new), len(old))]) as field_name, 'renamed' as change_kind from sets
  union all select feed, sender, seq, unnest(new[least(len(new), len(old)) + 1:]), 'added' from sets
  union all select feed, sender, seq, unnest(old[least(len(new), len(old)) + 1:]), 'removed' from sets),
stays as (select *, seq - dense_rank() over (partition by feed, sender, quantity order by seq) as stay from s),
typed as (select *, last_value(kind ignore nulls) over (partition by feed, sender, quantity, stay order by seq range between unbounded preceding and 1 preceding) as old_kind from stays),
changes as (select * from named union all select feed, sender, seq, name, 'retyped' from typed where kind <> old_kind)
select distinct file_id, field_name, change_kind from changes join files using (feed, sender, seq)""",
    "p4_nonres_table": _table_sql("nonres_attributes"),
    "p4_sites_table": _table_sql("decommissioned_sites"),
    "p4_replay": f"with {_LONG % ''} select feed, name, count(*) as n_rescued, count(*) filter (not coalesce(taken, false)) as n_left from chosen where t <> 'NULL' and not coalesce(own, false) group by 1, 2",
}
