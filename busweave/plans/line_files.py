"""Problem 6 on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.reject import accepted, check_lines, rejected
from ..session import table

COLUMNS = {"country": "string", "tech": "string", "cap": "number", "year": "int", "scenario": "string"}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(check_lines(table(spark, sf_dir, "res_target_lines")))


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(check_lines(table(spark, sf_dir, "res_target_lines")), COLUMNS)


QUERIES = {"p6_found": p6_found, "p6_rows": p6_rows}

# Quoted stretches are masked by one character each; what a field of masks stands for is taken from the list of stretches.
_LINES = r"""
with heads as (select file_name, min(regexp_replace(raw_line, '^\x{FEFF}|[\r\n]+$', '', 'g')) as h from res_target_lines where line_no = 1 group by 1),
files as (select file_name, d, list_transform(string_split(h, d), lambda x: lower(trim(x, ' "'))) as names from (
  select *, case when n[1] = list_max(n) then ';' when n[2] = list_max(n) then ',' when n[3] = list_max(n) then chr(9) else '|' end as d
  from (select *, [len(string_split(h, ';')), len(string_split(h, ',')), len(string_split(h, chr(9))), len(string_split(h, '|'))] as n from heads))),
body as (select distinct line_id, file_name, line_no, regexp_replace(coalesce(raw_line, ''), '\r$', '') as t from res_target_lines where line_no is null or line_no <> 1),
masked as (select *, string_split(regexp_replace(t, '"[^"]*"', chr(1), 'g'), coalesce(d, ',')) as f, regexp_extract_all(t, '"[^"]*"') as q from body left join files using (file_name)),
fields as (select *, list_transform(range(1, len(f) + 1), lambda i: case when contains(f[i], chr(1)) then replace(array_to_string(list_transform(
    q[len(replace(array_to_string(f[1:i-1], ''), chr(1), chr(1))) - len(replace(array_to_string(f[1:i-1], ''), chr(1), '')) + 1 : len(array_to_string(f[1:i], '')) - len(replace(array_to_string(f[1:i], ''), chr(1), ''))],
    lambda x: substr(x, 2, len(x) - 2)), '"'), '""', '"') else f[i] end) as v from masked),
named as (select *, coalesce(v[list_position(names, 'country')], '') as country, trim(coalesce(v[list_position(names, 'cap')], ''), chr(32) || chr(9) || chr(160) || chr(8201) || chr(8239)) as cap from fields),
judged as (select *, case when len(list_filter(f, lambda x: contains(x, '"') or (contains(x, chr(1)) and not regexp_full_match(x, chr(1) || '+')))) > 0 then 'quoting'
  when names is null or len(f) <> len(names) then 'column_count'
  when not (regexp_matches(country, '\p{L}') and regexp_full_match(country, '[\p{L}\p{M}0-9 .,''()&/-]*')) then 'bad_country'
  when cap <> '' and not (regexp_full_match(cap, '\+?(?:[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:[ \x{A0}\x{2009}\x{202F}][0-9]{3})+(?:[.,][0-9]+)?|[0-9]{1,3}(?:[''\x{2019}][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?')
    and coalesce(try_cast(nullif(regexp_extract(cap, '[eE]([+-]?[0-9]+)$', 1), '') as int), 0) < 290) then 'bad_cap' end as reason from named)
"""
# A separator that comes twice, or before another one, groups thousands.
_NUMBER = r"""try_cast(case when contains(n, '.') and contains(n, ',') then case when len(regexp_extract(n, '[^.]*$')) < len(regexp_extract(n, '[^,]*$')) then replace(n, ',', '') else replace(replace(n, '.', ''), ',', '.') end
  when regexp_matches(n, '\..*\.') then replace(n, '.', '') when regexp_matches(n, ',.*,') then replace(n, ',', '') else replace(n, ',', '.') end as double)"""
SQL = {
    "p6_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p6_rows": _LINES
    + f"""select line_id, file_name, line_no, nullif(trim(country), '') as country, nullif(trim(v[list_position(names, 'tech')]), '') as tech, {_NUMBER} as cap, try_cast(trim(v[list_position(names, 'year')]) as int) as year, nullif(trim(v[list_position(names, 'scenario')]), '') as scenario
    from (select *, regexp_replace(cap, '[ \\x{{A0}}\\x{{2009}}\\x{{202F}}''\\x{{2019}}+]+([0-9.,])', '\\1', 'g') as n from judged where reason is null)""",
}
