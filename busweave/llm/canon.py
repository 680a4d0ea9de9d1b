"""Mapping free-entered values to a canonical list.

Values are folded (case, accents, look-alike letters, punctuation) and looked up among the known names; what is left is matched by
a prefix-filter set-similarity join: tokens are ordered by rarity in the list, only rare prefixes are joined, length and positional
filters prune, Jaccard is verified exactly and the best entry is kept. Known names that mean no entry compete like the others.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import salted_join
from ..session import materialise

# Letters of other scripts that look like Latin ones, and Latin letters that no decomposition makes plain.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t",
}


def _plain_letters() -> tuple[str, str]:
    """Letters and what they become: accents dropped by decomposition, wide and look-alike letters made plain."""
    table = dict(LOOK_ALIKES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(c) == 1 and len(base) == 1 and base != c:
            table[c] = base
    return "".join(table), "".join(table.values())


def fold(text: Column) -> Column:
    """Lower case without accents, look-alikes, invisible characters and punctuation; blanks single. ß is ss, æ ae, œ oe."""
    old, new = _plain_letters()
    t = F.translate(F.lower(text), old, new)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[\p{Cf}\p{Mn}\p{Cc}&&[^\t\n\r]]", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


@dataclass(frozen=True)
class Names:
    """What is known of a field besides the list: more names of entries, names that mean none, words that only qualify."""

    other: dict[str, tuple[str, ...]] = field(default_factory=dict)
    none: tuple[str, ...] = ()
    qualifiers: tuple[str, ...] = ()
    code: str = ""  # a pattern whose first group is a short code inside a longer one


def tokens(folded: Column) -> Column:
    """Set of tokens of a folded text: letter pairs of each word with its ends marked, and its letters, numbered where they repeat."""
    pairs = F.flatten(F.transform(F.split(folded, " "), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("^"), w, F.lit("$")).substr(i, F.lit(2)))))
    letters = F.filter(F.split(folded, ""), lambda c: (c != "") & (c != " "))
    counted = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string"), F.lit("#")))
    return F.array_distinct(F.concat(pairs, counted))


def known_names(canon: DataFrame, names: dict[str, Names]) -> DataFrame:
    """(field_name, ref_id, name, origin): folded names of every entry; ref_id 0 for names that mean none. ``origin`` is 0 for canonical
    values, 1 for other names of the list, 2 for those of ``names``, 3 for names that mean none.

    A name of several origins stays with the first, of two entries with the smaller ref_id.
    """
    rows = canon.where("ref_id is not null and field_name is not null and canon_value is not null").distinct()
    listed = rows.select("field_name", "ref_id", F.explode(F.concat(F.array(F.struct(F.col("canon_value").alias("n"), F.lit(0).alias("c"))), F.transform(F.split(F.coalesce("other_names", F.lit("")), r"\|"), lambda x: F.struct(x.alias("n"), F.lit(1).alias("c"))))).alias("x")).select("field_name", "ref_id", fold(F.col("x.n")).alias("name"), F.col("x.c").alias("origin"))
    spark = canon.sparkSession
    extra = [(f, c, n) for f, k in names.items() for c, ns in k.other.items() for n in ns]
    if extra:
        more = spark.createDataFrame(extra, "field_name string, canon_value string, n string")
        listed = listed.unionByName(more.join(rows.select("field_name", "canon_value", "ref_id"), ["field_name", "canon_value"]).select("field_name", "ref_id", fold(F.col("n")).alias("name"), F.lit(2).alias("origin")))
    none = [(f, n) for f, k in names.items() for n in k.none]
    if none:
        listed = listed.unionByName(spark.createDataFrame(none, "field_name string, n string").select("field_name", F.lit(0).cast(rows.schema["ref_id"].dataType).alias("ref_id"), fold(F.col("n")).alias("name"), F.lit(3).alias("origin")))
    best = Window.partitionBy("field_name", "name").orderBy("origin", "ref_id")
    return listed.where("name <> ''").withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def _forms(values: DataFrame, names: dict[str, Names]) -> DataFrame:
    """Distinct values with their folded forms in the order they are tried: as typed, without qualifiers, the code inside."""
    bare = code = F.col("folded")
    for f, k in names.items():
        mine = F.col("field_name") == f
        words = F.split("folded", " ")
        kept = F.filter(words, lambda w: ~w.isin([fold_text(q) for q in k.qualifiers]) & ~w.rlike("^[0-9]$"))
        if k.qualifiers:
            bare = F.when(mine, F.array_join(kept, " ")).otherwise(bare)
        if k.code:
            code = F.when(mine, F.regexp_extract(F.replace(F.lower("value"), F.lit(" "), F.lit("")), k.code, 1)).otherwise(code)
    return values.withColumn("folded", fold(F.col("value"))).withColumn("forms", F.array_distinct(F.filter(F.array(F.col("folded"), bare, code), lambda x: x != "")))


def identity(*columns: str) -> Column:
    """What a combination of texts is known by: their SHA-256, short whatever their length."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def fold_text(text: str) -> str:
    """``fold`` for a parameter."""
    old, new = _plain_letters()
    t = text.lower().translate(str.maketrans(old, new)).replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return " ".join("".join(c if c.isalnum() else " " for c in t).split())


def _similar(wanted: DataFrame, listed: DataFrame, least: float) -> DataFrame:
    """(value_id, ref_id, origin, jaccard, edits): pairs of a wanted form and a name with Jaccard >= ``least``, found through rare prefixes."""
    rank = listed.select("field_name", F.explode("tokens").alias("token")).groupBy("field_name", "token").agg(F.count(F.lit(1)).alias("in_list"))

    def ordered(df: DataFrame, ident: str) -> DataFrame:
        """Tokens from rare to frequent; those of no name come first and find nothing."""
        long = df.select("field_name", ident, F.explode("tokens").alias("token")).join(rank, ["field_name", "token"], "left")
        return long.groupBy("field_name", ident).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("in_list", F.lit(0)).alias("n"), "token"))), lambda x: x["token"]).alias("sorted"))

    def prefixes(df: DataFrame, ident: str, size: str, at: str) -> DataFrame:
        n = F.size("sorted")
        length = n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1
        return df.select("field_name", ident, n.alias(size), F.posexplode(F.slice("sorted", 1, length)).alias(at, "token"))

    left = prefixes(ordered(wanted, "form_id"), "form_id", "n_x", "i")
    right = prefixes(ordered(listed, "name_id"), "name_id", "n_y", "j")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n_x") + F.col("n_y")) - 1e-9)
    met = left.join(right, ["field_name", "token"])
    met = met.where((F.col("n_y") >= F.col("n_x") * least - 1e-9) & (F.col("n_x") >= F.col("n_y") * least - 1e-9) & (1 + F.least(F.col("n_x") - F.col("i") - 1, F.col("n_y") - F.col("j") - 1) >= need))
    pairs = met.select("form_id", "name_id").distinct()
    x = wanted.select("form_id", "value_id", F.col("form"), F.col("tokens").alias("tx"))
    y = listed.select("name_id", "ref_id", "origin", "name", F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    full = pairs.join(x, "form_id").join(y, "name_id").withColumn("jaccard", both / (F.size("tx") + F.size("ty") - both))
    return full.where(F.col("jaccard") >= least).select("value_id", "ref_id", "origin", "jaccard", F.levenshtein("form", "name").alias("edits"))


def map_values(rows: DataFrame, canon: DataFrame, names: dict[str, Names], least: float = 0.5, handicap: float = 0.2) -> DataFrame:
    """(table_name, row_id, value, ref_id, how) for each value that is no canonical value byte for byte.

    ``rows`` has table_name, row_id, field_name, value; nulls, empty and blank values are no cases, repeated rows count once. ``how``
    is name, abbreviation, similar or none (ref_id 0: reported as unmatched). Only distinct values are matched; the list is joined
    by its rare tokens, so a frequent value or token never meets all values. A misspelt name that means no entry must be nearer by
    ``handicap``, one that isn't of the list by half of it, as entries and listed names are what people mean as a rule; names with digits are codes and match only exactly. Ties go to fewer edits, then the smaller ref_id.
    """
    exact = canon.select("field_name", F.col("canon_value").alias("value")).where("value is not null").distinct()
    cases = rows.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^\s*$")).select("table_name", "row_id", "field_name", "value").join(exact, ["field_name", "value"], "left_anti").distinct()
    values = cases.select("field_name", "value").distinct().withColumn("value_id", identity("field_name", "value"))
    # The list and the distinct values are each read several times below; written once, they are neither folded nor planned again.
    listed = materialise(known_names(canon, names).withColumn("name_id", identity("field_name", "name")).withColumn("tokens", tokens(F.col("name"))), "names")
    forms = materialise(_forms(values, names), "forms")

    tried = forms.select("field_name", "value", "value_id", F.posexplode("forms").alias("o", "name")).join(listed.select("field_name", "name", "ref_id"), ["field_name", "name"])
    by_name = tried.groupBy("field_name", "value", "value_id").agg(F.min_by("ref_id", "o").alias("ref_id"))
    # An abbreviation ends in a full stop and begins exactly one canonical value.
    short = forms.join(by_name, "value_id", "left_anti").where(F.rtrim("value").endswith(".") & (F.length("folded") >= 3))
    heads = listed.where("origin = 0").select("field_name", "ref_id", F.explode(F.transform(F.sequence(F.lit(3), F.length("name")), lambda n: F.col("name").substr(F.lit(1), n))).alias("folded"))
    heads = heads.groupBy("field_name", "folded").agg(F.min("ref_id").alias("ref_id"), F.count_distinct("ref_id").alias("n")).where("n = 1").drop("n")
    by_head = short.join(heads, ["field_name", "folded"]).select("value_id", "ref_id")

    by_name, by_head = materialise(by_name, "by-name"), materialise(by_head, "by-head")
    left = forms.join(by_name, "value_id", "left_anti").join(by_head, "value_id", "left_anti")
    # Every letter is a token, so a form with more letters than the largest name's tokens over ``least`` is similar to none; it needs none.
    largest = listed.agg(F.max(F.size("tokens"))).first()[0] or 0
    wanted = left.select("field_name", "value_id", F.explode("forms").alias("form"))
    wanted = wanted.where(F.length(F.replace(F.col("form"), F.lit(" "), F.lit(""))).between(1, int(largest / least))).withColumn("form_id", identity("value_id", "form"))
    wanted = materialise(wanted.withColumn("tokens", tokens(F.col("form"))), "wanted")
    near = F.struct(F.when(F.col("origin") == 3, F.lit(handicap)).when(F.col("origin") == 2, F.lit(handicap / 2)).otherwise(0.0) - F.col("jaccard"), "edits", "ref_id")
    best = _similar(wanted, listed.where(~F.col("name").rlike("[0-9]")), least).groupBy("value_id").agg(F.min_by("ref_id", near).alias("ref_id"))
    found = by_name.select("value_id", "ref_id", F.lit("name").alias("how")).unionByName(by_head.withColumn("how", F.lit("abbreviation"))).unionByName(best.withColumn("how", F.lit("similar")))
    answered = forms.select("value_id", "value", "field_name").join(found, "value_id", "left").select("value_id", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), F.when(F.coalesce("ref_id", F.lit(0)) == 0, "none").otherwise(F.col("how")).alias("how"))
    # One typed value may hold a third of the rows: those rows are spread over tasks.
    keyed = cases.withColumn("value_id", identity("field_name", "value"))
    return salted_join(keyed, answered, "value_id", "inner", salt_by=["table_name", "row_id"]).select("table_name", "row_id", "value", "ref_id", "how")
