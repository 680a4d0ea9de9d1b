"""Numbers as typed: decimal point or comma, thousands groups, exponents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import let

#: Characters that group thousands besides point and comma.
GROUPING = " \u00a0\u2009\u202f'\u2019"
BLANKS = "^[ \\t\u00a0\u2009\u202f]+|[ \\t\u00a0\u2009\u202f]+$"
_SPACED = "[0-9]{1,3}(?:[ \u00a0\u2009\u202f][0-9]{3})+(?:[.,][0-9]+)?"
_TICKED = "[0-9]{1,3}(?:['\u2019][0-9]{3})+(?:[.,][0-9]+)?"
NUMBER = (
    r"^\+?(?:[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|"
    + f"{_SPACED}|{_TICKED}"
    + r"|[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?$"
)


def strip_blanks(col: Column) -> Column:
    """Without blanks, tabs and no-break spaces around."""
    return F.regexp_replace(col, BLANKS, "")


def parse_number(col: Column) -> Column:
    """The number a text stands for (point, comma, thousands groups, exponent); null if it is none.

    A single separator is a decimal one (``1.234`` is 1.234), as nothing else says otherwise.
    """

    def read(t: Column) -> Column:
        many_dots, many_commas = t.rlike(r"\..*\."), t.rlike(",.*,")
        last_dot, last_comma = F.length(F.substring_index(t, ".", -1)), F.length(F.substring_index(t, ",", -1))
        both = t.contains(".") & t.contains(",")
        plain = (
            F.when(both & (last_dot < last_comma), F.replace(t, F.lit(","), F.lit("")))
            .when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(many_dots, F.replace(t, F.lit("."), F.lit("")))
            .when(many_commas, F.replace(t, F.lit(","), F.lit("")))
            .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        )
        return plain.try_cast("double")

    return let(F.regexp_replace(strip_blanks(col), f"[{GROUPING}+](?=[0-9.,])", ""), read)


def number_ok(col: Column) -> Column:
    """Whether a text is a finite number >= 0 in one of the known formats."""
    return strip_blanks(col).rlike(NUMBER) & F.coalesce(parse_number(col) < F.lit(float("inf")), F.lit(False))
