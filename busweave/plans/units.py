"""Problem 1 on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.units import Field, assign_scales, read_scales, stated
from ..session import table

FIELDS = [
    Field("efficiency", "efficiency_unit", r"\beta\b|efficienc|conversion|wirkungsgrad|heat rate|fuel use", "efficiency"),
    Field("fixed_cost_eur_mw_a", "fixed_cost_unit", r"fixed (?:cost|o&m|part)|\bfom\b|fixkosten|capacity fee", "cost_per_power"),
]
COMMON = {1, 11}


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nonres_targets").select("row_id", "efficiency", "efficiency_unit", "fixed_cost_eur_mw_a", "fixed_cost_unit", "remark", "source_file")
    said = stated(rows.dropDuplicates(["row_id"]), FIELDS, table(spark, sf_dir, "source_notes"), ["row_id"])
    return assign_scales(said, read_scales(table(spark, sf_dir, "unit_scales")), ["row_id"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_values(spark, sf_dir).where(f"scale_id not in ({', '.join(map(str, sorted(COMMON)))})").select("row_id", "field_name", "scale_id")


QUERIES = {"p1_found": p1_found, "p1_values": p1_values}


def _efficiency_scale(t: str) -> str:
    """Scale named by a lower-case text, in SQL."""
    energy, per = "(kj|mj|gj|kwh|mwh)", r"(?:[_ ][^/]*?)?\s*(?:/|\bper\b|\bje\b)\s*"
    return (
        rf"case when regexp_matches({t}, 'gj{per}mwh') then 14 when regexp_matches({t}, '(?:kj{per}kwh|mj{per}mwh)') then 15 when regexp_matches({t}, '{energy}{per}{energy}') then 16 "
        rf"when regexp_matches({t}, '%|per ?cent|\bpct\b|prozent') then 12 when regexp_matches({t}, '\bfraction\b|\bp\.?u\b|\[-\]') then 11 end"
    )


def _cost_scale(t: str) -> str:
    money = rf"case when regexp_matches({t}, '\bmeur|m€|\bmio\b|million') then 1000000 when regexp_matches({t}, '\bkeur|\bk€|t€|thousand|tausend') then 1000 when regexp_matches({t}, 'eur|€') then 1 end"
    power = rf"case when regexp_matches({t}, '\bkw([^h]|$)|kilowatt') then 1000 when regexp_matches({t}, '\bgw([^h]|$)') then 0.001 when regexp_matches({t}, '\bmw([^h]|$)|megawatt') then 1 end"
    time = rf"case when regexp_matches({t}, 'month|monat|\bmth\b|\bmtl\b') then 12 when regexp_matches({t}, 'quarter|quartal') then 4 when regexp_matches({t}, '/h\b|hour') then 8760 else 1 end"
    return f"case round(({money}) * ({power}) * ({time}))::int when 1 then 1 when 1000 then 2 when 1000000 then 3 when 12 then 4 when 12000 then 5 when 8760 then 6 when 4 then 7 end"


def _field_sql(f: Field, scale, size: str) -> str:
    said = lambda text: f"list_filter(regexp_split_to_array(replace(lower(coalesce({text}, '')), 'mio. ', 'mio '), ';| / |\\.\\s+'), lambda c: regexp_matches(c, '{f.words}'))[1]"
    return f"""select row_id, '{f.name}' as field_name, coalesce({scale('cell')}, {scale('unit')}, {scale('remark')}, {scale('note')}, {size}) as scale_id from (
      select *, try_cast(case when contains(n, ',') then replace(n, ',', '.') else n end as double) as x, lower(replace(raw, coalesce(nullif(figure, ''), '?'), ' ')) as cell from (
      select *, regexp_replace(figure, '[ \\x{{A0}}\\x{{2009}}\\x{{202F}}''\\x{{2019}}]', '', 'g') as n from (
      select row_id, {f.name} as raw, lower(coalesce({f.unit_column}, '')) as unit, {said('t.remark')} as remark, {said('s.note')} as note,
        rtrim(regexp_extract({f.name}, '([0-9][0-9.,  \\x{{A0}}\\x{{2009}}\\x{{202F}}''\\x{{2019}}]*(?:[eE][+-]?[0-9]+)?)', 1), ' .,' || chr(160) || chr(8201) || chr(8239)) as figure
      from t left join source_notes s using (source_file)))) where x is not null"""


SQL = {
    "p1_found": "with t as (select distinct row_id, efficiency, efficiency_unit, fixed_cost_eur_mw_a, fixed_cost_unit, remark, source_file from nonres_targets), "
    f"v as ({_field_sql(FIELDS[0], _efficiency_scale, 'case when x <= 1 then 11 when x >= 15 then 12 end')} union all {_field_sql(FIELDS[1], _cost_scale, 'case when x >= 3000 then 1 when x >= 5 then 2 else 3 end')}) "
    "select row_id, field_name, scale_id from v where scale_id not in (1, 11)"
}
