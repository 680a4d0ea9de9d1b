"""References to records that do not exist (at the time of the reference).

Existence is kept as signed deltas: +1 when a key becomes valid, -1 when it ends. Their running sum per key is the existence
count over time, folded into a timeline of periods with a positive count. References are deltas too, +1 when recorded and -1 when
withdrawn: a report sums them per key and period and keeps the keys with references left but no existence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .skew import salted_join

#: Spaces, tabs and line ends are trimmed from references.
_EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"


def clean_reference(col):
    """The reference without blanks and tabs around it; null when nothing is left."""
    text = F.regexp_replace(col, _EDGES, "")
    return F.when(F.length(text) > 0, text)


def existence_deltas(records: DataFrame, key: str, valid_from: str, valid_to: str) -> DataFrame:
    """(key, at, delta): +1 at ``valid_from`` (null: since ever), -1 at ``valid_to`` (exclusive; null: still valid).

    Rows with a null key say nothing. Equal rows arriving twice count once. A period that ends before it begins is empty, but its key
    occurs: its two deltas cancel.
    """
    since = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    periods = records.select(F.col(key).alias("key"), F.coalesce(F.col(valid_from).cast("timestamp_ntz"), since).alias("a"), F.col(valid_to).cast("timestamp_ntz").alias("b"))
    periods = periods.where("key is not null").withColumn("b", F.when(F.col("b").isNotNull(), F.greatest("a", "b"))).distinct()
    both = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("delta")))
    return periods.select("key", F.inline(both)).where("at is not null")


def timelines(deltas: DataFrame) -> DataFrame:
    """(key, first_from, periods): merged periods with a positive existence count, as an array ordered by time; null if there is none.

    Deltas are summed per key and instant before the window, and only changes between zero and positive counts are kept, so the
    array holds one entry per real opening of the key.
    """
    w = Window.partitionBy("key").orderBy("at")
    level = deltas.groupBy("key", "at").agg(F.sum("delta").alias("delta")).withColumn("n", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = level.withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0))).where("(n > 0) != (before > 0)")
    spans = edges.withColumn("until", F.lead("at").over(w)).where("n > 0")
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "until"))).alias("periods"))
    return deltas.groupBy("key").agg(F.min("at").alias("first_from")).join(spans, "key", "left")


def reference_deltas(references: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """The references with ``delta`` +1 and those ``withdrawn`` with -1; these repeat the key and the time the reference was recorded with,
    as it counts in that period."""
    plus = references.withColumn("delta", F.lit(1))
    return plus if withdrawn is None else plus.unionByName(withdrawn.withColumn("delta", F.lit(-1)))


def orphan_references(references: DataFrame, existence: DataFrame, hot: list | None = None) -> DataFrame:
    """References (``key``, ``recorded_at``, any others) without existence at their time, with ``orphan_kind``.

    ``missing``: the key never exists; ``late``: recorded before it first exists; ``deleted``: in any other gap.
    A null key is no reference. A reference with a null time is an orphan only if its key never exists.
    """
    refs = references.drop("first_from", "periods", "orphan_kind").where(F.col("key").isNotNull()).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    at = F.col("recorded_at")
    seen = F.coalesce(F.exists("periods", lambda p: (p["at"] <= at) & (p["until"].isNull() | (at < p["until"]))), F.lit(False))
    kind = F.when(F.col("first_from").isNull(), "missing").when(at.isNull() | seen, None).when(at < F.col("first_from"), "late").otherwise("deleted")
    joined = salted_join(refs, timelines(existence), "key", salt_by=["table_name", "row_id"], hot=hot)
    return joined.withColumn("orphan_kind", kind).where("orphan_kind is not null").drop("first_from", "periods")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans left per table, month of recording and kind, with the number of distinct keys: the sum of ``delta`` per key where it is
    positive. Without that column every row is a reference."""
    signed = F.col("delta") if "delta" in orphans.columns else F.lit(1)
    return (
        orphans.groupBy("table_name", F.date_trunc("month", "recorded_at").cast("timestamp_ntz").alias("month"), "orphan_kind", "key")
        .agg(F.sum(signed).alias("n"))
        .where("n > 0")
        .groupBy("table_name", "month", "orphan_kind")
        .agg(F.sum("n").alias("n_references"), F.count("key").alias("n_keys"))
    )
