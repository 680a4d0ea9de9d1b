"""Schemas that drift between files: ingestion with a rescue column.

A target schema is enforced on every row: a field whose name is that of a target column and whose value casts goes to the typed column,
everything else stays in ``_rescued`` as JSON. Names approved for a column are then promoted: their rescued values are replayed into it.
``_fields`` keeps what each row had (names and kinds of values, nulls too) and is the basis of the change report.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import let
from ..session import materialise


@dataclass(frozen=True)
class TargetField:
    """One column of the target schema: ``kind`` is double, int, string or boolean; ``other_names`` are approved for it; ``unit`` is the
    one its values are in."""

    name: str
    kind: str
    other_names: tuple[str, ...] = field(default_factory=tuple)
    unit: str | None = None


def read_fields(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``fields``: the payload's keys and values, values as variants so that their types stay. A null or broken payload has none."""
    return rows.withColumn("fields", F.expr(f"cast(try_parse_json({payload}) as map<string, variant>)"))


# The expressions below are SQL text: a schema has dozens of names, and a text is one call to the JVM where a tree of columns is hundreds.


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for the value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _kind(variant: str) -> str:
    """number, text, boolean, list or object; null for a JSON null. Whole and decimal numbers are one kind."""
    return _let(
        f"schema_of_variant({variant})", "s",
        "case when s is null or s = 'VOID' then null when startswith(s, 'ARRAY') then 'list' when startswith(s, 'OBJECT') then 'object' when s = 'STRING' then 'text' when s = 'BOOLEAN' then 'boolean' else 'number' end",
    )


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_kind(value: str) -> Column:
    """The kind of the variant that the SQL text ``value`` gives."""
    return F.expr(_kind(value))


def cast_value(value: str, target: TargetField) -> str:
    """SQL of a variant as the target's kind, null if all of it can't be: what this drops would be lost.

    A list is opened if it has one element, an object if it holds ``value`` and beside it at most the target's own ``unit``. A decimal comma is
    read; yes/no/1/0 are booleans.
    """
    text = lambda v: f"trim(try_variant_get({v}, '$', 'string'))"
    scalar = lambda v: _let(v, "x", f"case when {_kind('x')} in ('number', 'text', 'boolean') then {text('x')} end")
    said, inner = "m['unit']", "m['value']"
    unit = f"coalesce(lower({text(said)}) = {_literal((target.unit or '').lower())}, true)"
    named = f"case when forall(map_keys(m), k -> k in ('value', 'unit')) and {unit} then {scalar(inner)} end"
    listed = f"case when size(a) = 1 then {scalar('a[0]')} end"
    opened = f"case k when 'list' then {_let('try_cast(v as array<variant>)', 'a', listed)} when 'object' then {_let('try_cast(v as map<string, variant>)', 'm', named)} else {text('v')} end"
    number = "nullif(try_cast(replace(t, ',', '.') as double), double('NaN'))"
    typed = {
        "string": "t",
        "boolean": "case when lower(t) in ('true', 'yes', '1', 'y', 't') then true when lower(t) in ('false', 'no', '0', 'n', 'f') then false end",
        "double": number,
        "int": _let(number, "x", "case when x = floor(x) then try_cast(x as int) end"),
    }[target.kind]
    return _let(value, "v", _let(_let(_kind("v"), "k", opened), "t", typed))


def _as_json(fields: Column) -> Column:
    """A map of variants as JSON; null if it is empty."""
    return let(fields, lambda m: F.when(F.size(m) > 0, F.to_json(m)))


def ingest(rows: DataFrame, targets: list[TargetField], keep: list[str]) -> DataFrame:
    """One consistent table: ``keep`` columns, the target columns, ``_rescued`` and ``_fields``.

    Only fields of exactly a target's name are typed. ``_rescued`` is the JSON of all others and of values that don't cast (null if there
    are none; JSON nulls say nothing). ``_fields`` is an array of (name, kind), kind null for a JSON null. ``keep`` may not hold a
    target's name.
    """
    parsed = read_fields(rows).withColumns({f"_t_{t.name}": F.expr(cast_value(f"fields[{_literal(t.name)}]", t)) for t in targets})
    typed = F.expr("array_compact(array(" + ", ".join(f"if(`_t_{t.name}` is null, null, {_literal(t.name)})" for t in targets) + "))")
    rest = F.expr(f"map_filter(fields, (n, f) -> not array_contains(_typed, n) and {_kind('f')} is not null)")
    seen = F.expr(f"transform(map_entries(fields), e -> named_struct('name', e.key, 'kind', {_kind('e.value')}))")
    return parsed.withColumn("_typed", typed).select(*keep, *[F.col(f"_t_{t.name}").alias(t.name) for t in targets], _as_json(rest).alias("_rescued"), seen.alias("_fields"))


def promote(table: DataFrame, approved: list[TargetField]) -> DataFrame:
    """Replays rescued values of approved names: for each target (a new or existing column) that is null in a row, the first of its
    ``other_names`` whose rescued value casts fills it and leaves ``_rescued``. All others stay rescued.

    ``_rescued`` is parsed once for all targets, and not at all where it is null.
    """
    table = table.withColumn("_left", F.expr("cast(try_parse_json(_rescued) as map<string, variant>)"))
    picks, fills = [], {}
    for t in approved:
        if not t.other_names:
            if t.name not in table.columns:
                fills[t.name] = F.lit(None).cast(t.kind)
            continue
        names = ", ".join(map(_literal, t.other_names))
        pick = F.expr(f"get(filter(transform(array({names}), n -> named_struct('n', n, 'v', {cast_value('_left[n]', t)})), c -> c.v is not null), 0)")
        open_ = F.col("_left").isNotNull() & (F.col(t.name).isNull() if t.name in table.columns else F.lit(True))
        picks.append((t, F.when(open_, pick)))
    table = table.withColumns({f"_p_{t.name}": p for t, p in picks})
    for t, _ in picks:
        new = F.col(f"_p_{t.name}.v")
        fills[t.name] = F.coalesce(F.col(t.name), new) if t.name in table.columns else new
    used = F.array_compact(F.array(*[F.col(f"_p_{t.name}.n") for t, _ in picks])) if picks else F.array().cast("array<string>")
    rest = F.expr("map_filter(_left, (n, f) -> not array_contains(_used, n))")
    out = table.withColumn("_used", used).withColumns({**fills, "_rescued": F.when(F.size("_used") > 0, _as_json(rest)).otherwise(F.col("_rescued"))})
    return out.drop("_left", "_used", *[f"_p_{t.name}" for t, _ in picks])


def observed_fields(ingested: DataFrame, series: list[str]) -> DataFrame:
    """(series, file_id, delivered_at, name, kind): each field a file has, with the kind most of its values have; a row with a null name
    for files with rows without any.

    Kinds are counted before the shuffle; ties go to the first of boolean, list, number, object, text.
    """
    keys = [*series, "file_id", "delivered_at"]
    long = ingested.select(*keys, F.inline_outer("_fields"))
    counted = long.groupBy(*keys, "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.col("n"), F.translate("kind", "blnot", "vutsr").alias("o"), "kind")))
    return counted.groupBy(*keys, "name").agg(best["kind"].alias("kind"))


def _handovers(observed: DataFrame, files: DataFrame, series: list[str], approved: DataFrame, feed: str) -> DataFrame:
    """(feed, name, quantity) of names nobody approved: one that comes in a file in which a known name goes, and never stands in one file
    with that name at any sender, goes on with its quantity.

    Quantities that are both there would meet in some file. Of several known names the first stands. Pairs are those of one file's
    coming and going names only.
    """
    seen = observed.select(*series, "file_id", "name").join(files, [*series, "file_id"])
    unknown = seen.join(approved.select(feed, "name"), [feed, "name"], "left_anti")
    w = Window.partitionBy(*series, "name").orderBy("seq")
    came = unknown.withColumn("_b", F.lag("seq").over(w)).where("seq > 1 and (_b is null or _b < seq - 1)").select(*series, "seq", "name")
    # Known names are looked at only where an unknown one comes.
    at = came.select(*series, "seq").distinct()
    before = seen.withColumn("seq", F.col("seq") + 1).join(at, [*series, "seq"], "left_semi").select(*series, "seq", F.col("name").alias("old"))
    now = seen.join(at, [*series, "seq"], "left_semi").select(*series, "seq", F.col("name").alias("old"))
    went = before.join(now, [*series, "seq", "old"], "left_anti")
    pairs = came.join(went, [*series, "seq"]).select(feed, "name", "old").distinct().join(approved.select(feed, F.col("name").alias("old"), "quantity"), [feed, "old"])
    together = seen.select("file_id", F.col(feed), "name").join(pairs, [feed, "name"]).join(seen.select("file_id", F.col("name").alias("old")), ["file_id", "old"], "left_semi").select(feed, "name", "old").distinct()
    return pairs.join(together, [feed, "name", "old"], "left_anti").groupBy(feed, "name").agg(F.min_by("quantity", "old").alias("quantity"))


def schema_changes(ingested: DataFrame, targets_by_feed: dict[str, list[TargetField]], series: tuple[str, ...] = ("feed", "sender")) -> DataFrame:
    """(file_id, field_name, change_kind) of ingested rows against the file before of the same sender; ``series`` begins with the feed.

    Files are ordered by delivered_at, then file_id; a file with no field at all still counts as one. A quantity is what a name is
    approved for, else what it takes over (see ``_handovers``), else the name itself. Its type is compared with that of the last file that
    had one, as long as the quantity was never gone in between: one that appears again begins anew. Windows run over (sender, name)
    and (sender, quantity), on one row per file and field, never over raw rows.
    """
    series = list(series)
    feed, spark = series[0], ingested.sparkSession
    order = Window.partitionBy(*series).orderBy("delivered_at", "file_id")
    # One row per file and field, read many times below: the ingestion behind it runs once.
    observed = materialise(observed_fields(ingested, series), "fields")
    files = observed.select(*series, "file_id", "delivered_at").distinct().withColumn("seq", F.row_number().over(order))
    files = files.withColumn("last_seq", F.max("seq").over(Window.partitionBy(*series))).select(*series, "file_id", "seq", "last_seq")
    observed = observed.where("name is not null")
    approved = spark.createDataFrame([(f, n, t.name) for f, targets in targets_by_feed.items() for t in targets for n in (t.name, *t.other_names)], f"`{feed}` string, name string, quantity string")
    learned = _handovers(observed, files, series, approved, feed)
    seen = observed.join(files, [*series, "file_id"]).join(approved.unionByName(learned), [feed, "name"], "left").withColumn("quantity", F.coalesce("quantity", "name"))
    by_name = Window.partitionBy(*series, "quantity", "name").orderBy("seq")
    by_quantity = Window.partitionBy(*series, "quantity").orderBy("seq")
    walked = seen.withColumns({"before": F.lag("seq").over(by_name), "after": F.lead("seq").over(by_name), "stay": F.col("seq") - F.dense_rank().over(by_quantity)})
    came = walked.where("seq > 1 and (before is null or before < seq - 1)").select(*series, "quantity", "seq", F.lit(1).alias("sign"), "name")
    went = walked.where("seq < last_seq and (after is null or after > seq + 1)").select(*series, "quantity", (F.col("seq") + 1).alias("seq"), F.lit(-1).alias("sign"), "name")
    pick = lambda sign: F.array_sort(F.collect_set(F.when(F.col("sign") == sign, F.col("name"))))
    moves = came.unionByName(went).groupBy(*series, "quantity", "seq").agg(pick(1).alias("new"), pick(-1).alias("old"))
    both = F.least(F.size("new"), F.size("old"))
    tag = lambda names, kind: F.transform(names, lambda x: F.struct(x.alias("field_name"), F.lit(kind).alias("change_kind")))
    named = F.concat(tag(F.slice("new", 1, both), "renamed"), tag(F.slice("new", both + 1, F.size("new")), "added"), tag(F.slice("old", both + 1, F.size("old")), "removed"))
    moved = moves.select(*series, "seq", F.inline(named))
    unbroken = Window.partitionBy(*series, "quantity", "stay").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    retyped = walked.withColumn("old_kind", F.last("kind", ignorenulls=True).over(unbroken)).where("kind <> old_kind").select(*series, "seq", F.col("name").alias("field_name"), F.lit("retyped").alias("change_kind"))
    return moved.unionByName(retyped).join(files.select(*series, "seq", "file_id"), [*series, "seq"]).select("file_id", "field_name", "change_kind").distinct()
