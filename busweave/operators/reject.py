"""Rows that fail to parse: every column as nullable text, rules evaluated into an error array, rows split by it.

Everything is column arithmetic (no Python, no window): one join brings each line its file's header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import number_ok, parse_number, strip_blanks
from ..functions.scalar import let
from .skew import salted_join

DELIMITERS = [";", ",", "\t", "|"]
#: Stands for a delimiter inside quotes while a line is split.
_HELD = "\u0002"


def split_quoted(line: Column, delimiter: Column) -> Column:
    """Fields of a line: delimiters between double quotes don't split. Quotes stay in the fields."""
    at = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))

    def quoted(parts: Column) -> Column:
        held = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, delimiter, F.lit(_HELD))).otherwise(x))
        return F.transform(F.split(F.array_join(held, '"'), at, F.lit(-1)), lambda x: F.replace(x, F.lit(_HELD), delimiter))

    return F.when(line.contains('"'), let(F.split(F.replace(line, F.lit(_HELD), F.lit(" ")), '"'), quoted)).otherwise(F.split(line, at, F.lit(-1)))


def _bad_quotes(field: Column) -> Column:
    inner = F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit(""))
    whole = field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
    return field.contains('"') & ~(whole & ~inner.contains('"'))


def unquote(field: Column) -> Column:
    """A field without its quotes, doubled ones inside made single."""
    return F.when(field.startswith('"') & (F.length(field) >= 2), F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def read_headers(lines: DataFrame) -> DataFrame:
    """(file_name, delimiter, names) of each file from its line 1. The delimiter is the one that occurs most; a byte order mark and quotes are dropped."""
    head = F.regexp_replace("raw_line", "^﻿|[\r\n]+$", "")
    counted = F.array(*[F.struct(F.size(F.split(F.col("h"), F.concat(F.lit("\\Q"), F.lit(d), F.lit("\\E")), F.lit(-1))).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    one = lines.where("line_no = 1").groupBy("file_name").agg(F.min(head).alias("h"))
    one = one.withColumn("delimiter", F.array_max(counted)["d"])
    return one.select("file_name", "delimiter", F.transform(split_quoted(F.col("h"), F.col("delimiter")), lambda x: F.lower(F.trim(unquote(x)))).alias("names"))


def check_lines(lines: DataFrame, hot: list | None = None) -> DataFrame:
    """Each line but headers with ``fields`` (nullable text), ``names`` and ``errors``, an array of the rules it breaks in order.

    A file without a header gives ``column_count``; a null line has one empty field. An empty ``errors`` array means a valid row.
    Lines that arrive twice are still there twice; ``rejected`` and ``accepted`` count them once.
    """
    lines = lines.select("line_id", "file_name", "line_no", "raw_line")
    body = lines.where("line_no is null or line_no <> 1")
    joined = salted_join(body, read_headers(lines), "file_name", salt_by=["line_id"], hot=hot)
    text = F.regexp_replace(F.coalesce(F.col("raw_line"), F.lit("")), "\r$", "")
    place = lambda name: F.array_position("names", name).cast("int") - 1

    def country_ok(country: Column) -> Column:
        return F.coalesce(country.rlike(r"\p{L}") & country.rlike(r"^[\p{L}\p{M}0-9 .,'()&/-]*$"), F.lit(False))

    def cap_ok(cap: Column) -> Column:
        return (F.length(strip_blanks(F.coalesce(cap, F.lit("")))) == 0) | number_ok(cap)

    def judge(fields: Column) -> Column:
        shape = F.coalesce(F.size(fields) != F.size("names"), F.lit(True))
        rules = [("quoting", F.exists(fields, _bad_quotes)), ("column_count", shape), ("bad_country", ~let(unquote(F.get(fields, place("country"))), country_ok)), ("bad_cap", ~let(unquote(F.get(fields, place("cap"))), cap_ok))]
        errors = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
        return F.struct(fields.alias("fields"), errors.alias("errors"))

    # Fields are split once a line: as a column of their own they would be split again in every filter on the errors.
    judged = let(split_quoted(text, F.coalesce(F.col("delimiter"), F.lit(","))), judge)
    return joined.withColumn("_judged", judged).select("*", "_judged.fields", "_judged.errors").drop("_judged")


def rejected(checked: DataFrame) -> DataFrame:
    """(line_id, reason): rows with errors and the first rule each breaks."""
    return checked.where(F.size("errors") > 0).select("line_id", F.col("errors")[0].alias("reason")).distinct()


def accepted(checked: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows without errors as typed columns: ``columns`` maps a header name to ``string``, ``int`` or ``number``. Blank values are null."""
    out = [F.col("line_id"), F.col("file_name"), F.col("line_no")]
    for name, kind in columns.items():
        raw = F.nullif(strip_blanks(unquote(F.get("fields", F.array_position("names", name).cast("int") - 1))), F.lit(""))
        out.append((parse_number(raw) if kind == "number" else raw.try_cast(kind)).alias(name))
    return checked.where(F.size("errors") == 0).select(*out).dropDuplicates(["line_id"])
