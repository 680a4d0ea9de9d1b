"""The same plans on streams: disaggregation is stateless, weekly sums take a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def disaggregate_stream(load: DataFrame, shares: DataFrame) -> DataFrame:
    """National values of a stream (country, time, load) over nodes by static shares (country, bus, share). Append only, no state."""
    return load.join(shares.select("country", "bus", "share"), "country").select("country", "time", "bus", (F.col("load") * F.col("share")).alias("allocated"))


def weekly_stream(rows: DataFrame, keys: list[str], time: str, value: str, late: str = "14 days", days: int = 7, start: str = "0 days") -> DataFrame:
    """(keys, first_day, value): sums over windows of a week; rows later than ``late`` behind the newest are dropped by the watermark.

    ``start`` shifts the windows, which lie on whole weeks since 1970 otherwise.
    """
    out = rows.withWatermark(time, late).groupBy(F.window(time, f"{days} days", f"{days} days", start), *keys).agg(F.sum(value).alias(value))
    return out.select(*keys, F.col("window.start").alias("first_day"), value)
