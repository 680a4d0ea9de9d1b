"""Weekly and hourly series: sums, gap filling, climatology, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import hour_of_year, week_days, week_of_year


def hourly_to_weekly(df: DataFrame, keys: list[str], time: str, value: str, factor: float = 1000.0, weeks: int = 52) -> DataFrame:
    """(keys, year, week, value): sums of 168 hours from 1 January; hours after the last whole week drop out."""
    wk = F.floor(hour_of_year(F.col(time)) / 168) + 1
    return df.select(*keys, F.year(time).alias("year"), wk.cast("int").alias("week"), F.col(value).alias("_v")).where(F.col("week") <= weeks).groupBy(*keys, "year", "week").agg((F.coalesce(F.sum("_v"), F.lit(0.0)) * factor).alias(value))


def calendar_weeks(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, year, week, value) by weeks of seven days from 1 January, the 53rd included."""
    return df.groupBy(*keys, F.year(time).alias("year"), week_of_year(F.col(time)).alias("week")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def complete_weeks(df: DataFrame, keys: list[str], weeks: int = 52) -> DataFrame:
    """Every week 1..weeks for each key that has any; missing ones with nulls."""
    grid = df.select(*keys).distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    return grid.join(df, [*keys, "week"], "left")


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str, out: str | None = None) -> DataFrame:
    """Unknown values between known ones by a straight line, before the first and after the last by the nearest; one known value is
    all; none known stays unknown. ``order`` is a whole number. Adds ``filled`` (bool)."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    df = df.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_n", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) / (F.col("_n.o") - F.col("_p.o")) * (F.col(order) - F.col("_p.o"))
    guess = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line)
    filled = F.coalesce(F.col(value), guess)
    return df.withColumn("filled", F.col(value).isNull() & filled.isNotNull()).withColumn(out or value, filled).drop("_p", "_n")


def climatology(df: DataFrame, keys: list[str], year: str, week: str, value: str) -> DataFrame:
    """Years that are missing (every value null, or every value 0) take each week's mean over the years that aren't.

    Adds ``year_missing``; where every year of a series is missing the values stay as they are. Means are aggregates joined back by
    key and week, not windows.
    """
    state = df.groupBy(*keys, year).agg((F.count(F.when(F.col(value) != 0, 1)) == 0).alias("year_missing"))
    marked = df.join(state, [*keys, year])
    means = marked.where("not year_missing").groupBy(*keys, week).agg(F.avg(value).alias("_mean"))
    out = marked.join(means, [*keys, week], "left")
    return out.withColumn(value, F.when(F.col("year_missing"), F.coalesce(F.col("_mean"), F.col(value))).otherwise(F.col(value))).drop("_mean")


def level_imputation(df: DataFrame, level_keys: list[str], capacity: str, value: str, default: Column) -> DataFrame:
    """Missing values as the mean level (value over capacity) of the level keys times the capacity, else ``default``; with a flag."""
    level = df.where((F.col(capacity) > 0) & F.col(value).isNotNull()).groupBy(*level_keys).agg(F.avg(F.least(F.greatest(F.col(value) / F.col(capacity), F.lit(0.0)), F.lit(1.0))).alias("_level"))
    out = df.join(level, level_keys, "left")
    guess = F.coalesce(F.col("_level") * F.col(capacity), default)
    return out.withColumn("imputed", F.when(F.col(value).isNotNull(), "no").when(F.col("_level").isNotNull(), "mean_level").otherwise("default")).withColumn(value, F.coalesce(F.col(value), guess)).drop("_level")


def weeks_to_days(df: DataFrame, year: str = "year", week: str = "week") -> DataFrame:
    """A row per day of each week; the last week of a year has its real days only."""
    return df.withColumn("day", F.explode(week_days(F.col(year), F.col(week))))


def replicate_single_week(df: DataFrame, keys: list[str], weeks: int = 52) -> DataFrame:
    """Series given only for week 1 repeated for every week; complete ones as they are; others fail the job. Week 53 is dropped."""
    kept = df.where(F.col("week") <= weeks)
    n = kept.groupBy(*keys).agg(F.count_distinct("week").alias("_n"), F.max("week").alias("_m"))
    joined = kept.join(n, keys)
    bad = ~((F.col("_n") == weeks) | ((F.col("_n") == 1) & (F.col("_m") == 1)))
    told = F.concat(F.lit("weeks are neither complete nor week 1 alone: "), F.to_json(F.struct(*keys)))
    span = F.when(bad, F.raise_error(told).cast("array<int>")).when(F.col("_n") == 1, F.sequence(F.lit(1), F.lit(weeks))).otherwise(F.array(F.col("week").cast("int")))
    return joined.withColumn("week", F.explode(span)).drop("_n", "_m")


def weekly_bounds_capped(energy_mwh_day: Column, power_mw: Column) -> Column:
    """Daily energy not above 24 hours of the power."""
    return F.least(energy_mwh_day, 24 * power_mw)
