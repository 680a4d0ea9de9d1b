"""Aggregations with the domain's rules: passthrough columns, parallel branches, directed pairs, fallback medians, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import haversine_km, joined_unique, loose_number, positive, safe_div
from .ranking import prefix_sum


def weighted_passthrough(df: DataFrame, keys: list[str], target: str, numeric: list[str], text: list[str], sources: str | None = None) -> DataFrame:
    """Target summed by keys; numeric columns as target-weighted means, others as sorted distinct lists.

    A null number adds 0 but its weight stays in the denominator. Where no weight is positive the plain mean of the known numbers
    stands; where no number is known, null. Negative and null targets weigh 0.
    """
    w = positive(F.col(target))
    total = F.sum(w)
    aggs: list[Column] = [F.coalesce(F.sum(target), F.lit(0.0)).alias(target)]
    for c in numeric:
        v = F.col(c).cast("double")
        mean = F.when(total > 0, F.sum(F.coalesce(v, F.lit(0.0)) * w) / total).otherwise(F.avg(v))
        aggs.append(F.when(F.count(v) > 0, mean).alias(c))
    aggs += [F.nullif(joined_unique(F.col(c)), F.lit("")).alias(c) for c in text]
    if sources:
        aggs.append(joined_unique(F.col(sources)).alias("sources"))
    return df.groupBy(*keys).agg(*aggs)


def loosely_numeric(df: DataFrame, columns: list[str]) -> list[str]:
    """Which text columns hold any readable number: one aggregate over all columns."""
    if not columns:
        return []
    row = df.agg(*[F.count(loose_number(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def directed_pairs(flows: DataFrame, a: str, b: str, forward: str, backward: str | None = None, kind: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """One row per unordered pair (first < second) with the sums of both directions; pairs within one place are dropped.

    ``backward`` is the value from b to a of the same row. ``kind`` adds the one kind of the pair, or ``mixed``.
    """
    keys = extra or []
    swap = F.col(a) > F.col(b)
    back = F.col(backward) if backward else F.lit(0.0)
    rows = flows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    rows = rows.select(*keys, F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.when(swap, back).otherwise(F.col(forward)).alias("_to"), F.when(swap, F.col(forward)).otherwise(back).alias("_from"), *([F.col(kind).alias("_kind")] if kind else []))
    aggs = [F.coalesce(F.sum("_to"), F.lit(0.0)).alias("to_mw"), F.coalesce(F.sum("_from"), F.lit(0.0)).alias("from_mw"), F.count(F.lit(1)).alias("n_rows")]
    if kind:
        aggs.append(F.when(F.min("_kind") == F.max("_kind"), F.min("_kind")).otherwise("mixed").alias("kind"))
    return rows.groupBy(*keys, "first", "second").agg(*aggs)


def parallel_branches(lines: DataFrame, keys: list[str], r: str = "r", x: str = "x", rating: str | None = None, length: str | None = None) -> DataFrame:
    """Parallel branches by their summed admittance: r and x of the equivalent, summed rating, rating-weighted length.

    A branch without impedance (r = x = 0, or null) adds nothing; a group of only such has null r and x.
    """
    z2 = F.col(r) * F.col(r) + F.col(x) * F.col(x)
    g, b = F.sum(F.when(z2 > 0, F.col(r) / z2)), F.sum(F.when(z2 > 0, -F.col(x) / z2))
    aggs = [g.alias("_pg"), b.alias("_pb"), F.count(F.lit(1)).alias("n_branches")]
    if rating:
        aggs.append(F.coalesce(F.sum(rating), F.lit(0.0)).alias("rating"))
    if rating and length:
        aggs.append(safe_div(F.sum(F.col(length) * F.col(rating)), F.sum(rating)).alias("length"))
    y2 = F.col("_pg") * F.col("_pg") + F.col("_pb") * F.col("_pb")
    return lines.groupBy(*keys).agg(*aggs).withColumns({"r": F.try_divide(F.col("_pg"), y2), "x": F.try_divide(-F.col("_pb"), y2)}).drop("_pg", "_pb")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys, quantile, value): exact linear quantiles of the known values.

    Rows are counted by distinct value before they are shuffled, ranks are prefix sums in two steps, and only the one or two values
    a quantile lies between are kept: no group's values are ever collected. NaN counts as unknown; a null key drops out.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = known.select(*keys, F.col(value).cast("double").alias("_eq_v")).groupBy(*keys, "_eq_v").agg(F.count(F.lit(1)).alias("_eq_c"))
    counted = counted.withColumn("_eq_coarse", F.floor("_eq_v"))
    group = keys or ["_eq_all"]
    if not keys:
        counted = counted.withColumn("_eq_all", F.lit(1))
    placed = prefix_sum(counted, group, "_eq_coarse", [F.col("_eq_v")], "_eq_c", "_eq_before")
    total = counted.groupBy(*group).agg(F.sum("_eq_c").alias("_eq_n"))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_eq_n") - 1)).alias("pos")) for q in at])
    hit = placed.join(total, group).withColumn("_eq_w", F.filter(wanted, lambda x: (F.floor(x["pos"]) < F.col("_eq_before") + F.col("_eq_c")) & (F.ceil(x["pos"]) >= F.col("_eq_before"))))
    hit = hit.select(*keys, "_eq_v", "_eq_before", "_eq_c", F.explode("_eq_w").alias("_eq_w"))
    low = F.max(F.when((F.floor("_eq_w.pos") >= F.col("_eq_before")) & (F.floor("_eq_w.pos") < F.col("_eq_before") + F.col("_eq_c")), F.col("_eq_v")))
    high = F.max(F.when((F.ceil("_eq_w.pos") >= F.col("_eq_before")) & (F.ceil("_eq_w.pos") < F.col("_eq_before") + F.col("_eq_c")), F.col("_eq_v")))
    out = hit.groupBy(*keys, F.col("_eq_w.q").alias("quantile"), F.col("_eq_w.pos").alias("_eq_pos")).agg(low.alias("_eq_low"), high.alias("_eq_high"))
    return out.select(*keys, "quantile", (F.col("_eq_low") + (F.col("_eq_high") - F.col("_eq_low")) * (F.col("_eq_pos") - F.floor("_eq_pos"))).alias("value"))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median by keys (mean of the middle two)."""
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("value").alias(out))


def median_imputation(df: DataFrame, value: str, levels: list[list[str]], default: float = 1.0) -> DataFrame:
    """Missing values by the median of the first level of keys that knows one; the level is named in ``source``.

    The empty level is the global median. Adds ``imputed`` and ``source`` (``given`` for known values, ``default`` for none).
    """
    known = df.where(F.col(value).isNotNull())
    source, amount = F.lit("default"), F.lit(default)
    out = df
    for i, keys in reversed(list(enumerate(levels))):
        m = f"_m{i}"
        if keys:
            out = out.join(exact_median(known, keys, value, m), keys, "left")
        else:
            only = exact_median(known, [], value, m).first()
            out = out.withColumn(m, F.lit(only[0] if only else None).cast("double"))
        amount = F.coalesce(F.col(m), amount)
        source = F.when(F.col(m).isNotNull(), "_".join(keys) or "global").otherwise(source)
    missing = F.col(value).isNull()
    return out.withColumns({"imputed": F.when(missing, amount).otherwise(F.col(value)), "source": F.when(missing, source).otherwise("given")}).drop(*[f"_m{i}" for i in range(len(levels))])


def border_imputation(edges: DataFrame, value: str, side_a: str, side_b: str, klass: str, default: float = 1.0) -> DataFrame:
    """Missing ratings of edges between countries: the mean of both sides' medians in the voltage class, else the one side that has
    one, else the class, else all, else ``default``."""
    inner = edges.where((F.col(side_a) == F.col(side_b)) & (F.col(value) > 0))
    by_side = exact_median(inner.select(F.col(side_a).alias("_c"), F.col(klass).alias("_k"), value), ["_c", "_k"], value, "_m")
    positive_ones = edges.where(F.col(value) > 0)
    by_class = exact_median(positive_ones, [klass], value, "_mk")
    all_ = (exact_median(positive_ones, [], value, "_m").first() or [None])[0]
    a = by_side.select(F.col("_c").alias(side_a), F.col("_k").alias(klass), F.col("_m").alias("_ma"))
    b = by_side.select(F.col("_c").alias(side_b), F.col("_k").alias(klass), F.col("_m").alias("_mb"))
    out = edges.join(a, [side_a, klass], "left").join(b, [side_b, klass], "left").join(by_class, klass, "left")
    both = F.when(F.col("_ma").isNotNull() & F.col("_mb").isNotNull(), (F.col("_ma") + F.col("_mb")) / 2)
    missing = F.coalesce(F.col(value), F.lit(0.0)) <= 0
    amount = F.coalesce(both, F.col("_ma"), F.col("_mb"), F.col("_mk"), F.lit(all_).cast("double"), F.lit(default))
    source = F.when(both.isNotNull(), "both_sides").when(F.coalesce("_ma", "_mb").isNotNull(), "one_side").when(F.col("_mk").isNotNull(), "class").when(F.lit(all_ is not None), "global").otherwise("default")
    return out.withColumns({"imputed": F.when(missing, amount).otherwise(F.col(value)), "source": F.when(missing, source).otherwise("given")}).drop("_ma", "_mb", "_mk")


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: its values (the least), how many rows there were, and whether they contradict each other."""
    aggs = [F.min(v).alias(v) for v in values]
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.min(v).eqNullSafe(F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))))
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_rows"), differ.alias("conflict"))


def require_no_conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Equal duplicates collapsed; the job fails on the first contradicting ones."""
    c = conflicts(df, keys, values)
    told = F.concat(F.lit("contradicting rows for "), F.to_json(F.struct(*keys)))
    return c.withColumn(values[0], F.when(F.col("conflict"), F.raise_error(told).cast(df.schema[values[0]].dataType)).otherwise(F.col(values[0]))).drop("n_rows", "conflict")


def max_then_sum(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """The largest value per inner key, summed by the outer key: the same store listed under several components counts once."""
    return df.groupBy(*outer, *inner).agg(F.max(value).alias(value)).groupBy(*outer).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def mean_of_means(df: DataFrame, keys: list[str], inner: str, value: str) -> DataFrame:
    """Mean over the inner key of its means, so that years with more rows weigh no more."""
    return df.groupBy(*keys, inner).agg(F.avg(value).alias(value)).groupBy(*keys).agg(F.avg(value).alias(value))


def energy_mean(df: DataFrame, keys: list[str], time: str, load: str, hours: str) -> DataFrame:
    """Mean load by energy: per key and time the mean load and the longest resolution, then energy over hours."""
    per = df.groupBy(*keys, time).agg(F.avg(load).alias("_l"), F.max(hours).alias("_h"))
    return per.groupBy(*keys).agg(safe_div(F.sum(F.col("_l") * F.col("_h")), F.sum("_h")).alias("mean_load"))


def retention(df: DataFrame, keys: list[str], value: str, weight: str, thresholds: list[float]) -> DataFrame:
    """(keys, threshold, n_kept, share_kept, weight_kept): what stays at or above each threshold, in one pass over the rows."""
    parts = []
    for t in thresholds:
        kept = F.col(value) >= t
        parts.append(F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(kept, 1)).alias("n_kept"), F.coalesce(F.sum(F.when(kept, F.col(weight))), F.lit(0.0)).alias("weight_kept")))
    out = df.groupBy(*keys).agg(F.array(*parts).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, "_n", F.inline("_p")).withColumn("share_kept", F.col("n_kept") / F.col("_n")).drop("_n")


def medoid(points: DataFrame, group: str, ident: str, lat: str = "lat", lon: str = "lon", radius: float = 6371.0088) -> DataFrame:
    """(group, id, total_km): the member of each group with the least summed distance to the others; ties to the smaller id.

    All distances within a group are the definition; groups are clusters of a reduced network (tens to hundreds of members).
    """
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(group, ident, lat, lon)
    q = p.select(group, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    total = p.join(q, group).groupBy(group, ident).agg(F.sum(haversine_km(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon"), radius)).alias("total_km"))
    best = F.min(F.struct(F.round("total_km", 6).alias("t"), F.col(ident).alias("i")))
    return total.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b.i").alias(ident), F.col("_b.t").alias("total_km"))


def composite_rank(df: DataFrame, ident: str, weights: dict[str, float], higher_is_better: set[str]) -> DataFrame:
    """Adds score and rank: metrics scaled to 0..1 (1 is best; a constant metric is 1), weighted and summed; null metrics add nothing.

    Least and largest are one aggregate; ranks are over runs of a benchmark, a short table.
    """
    ends = df.agg(*[f(m).alias(f"{n}_{m}") for m in weights for n, f in (("lo", F.min), ("hi", F.max))]).first()
    score = F.lit(0.0)
    for m, w in weights.items():
        lo, hi = ends[f"lo_{m}"], ends[f"hi_{m}"]
        if lo is None:
            continue
        if abs(hi - lo) <= 1e-12:
            part = F.when(F.col(m).isNotNull(), 1.0)
        else:
            part = ((F.col(m) - lo) if m in higher_is_better else (hi - F.col(m))) / F.lit(float(hi - lo))
        score = score + F.coalesce(part * F.lit(w), F.lit(0.0))
    scored = df.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(ident))))


def agreement(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """nrmse (by the root mean square of the truth), cosine, correlation and weighted absolute errors per key.

    ``wape`` weighs each error by its true value's size and so counts size twice, as the benchmark defines it; ``wape_plain`` does not.
    """
    t, g = F.coalesce(F.col(truth), F.lit(0.0)), F.coalesce(F.col(guess), F.lit(0.0))
    err = g - t
    return df.groupBy(*keys).agg(
        safe_div(F.sqrt(F.avg(err * err)), F.sqrt(F.avg(t * t))).alias("nrmse"),
        safe_div(F.sum(t * g), F.sqrt(F.sum(t * t)) * F.sqrt(F.sum(g * g))).alias("cosine"),
        F.corr(t, g).alias("correlation"),
        safe_div(F.sum(F.abs(err) * F.abs(t)), F.sum(t * t)).alias("wape"),
        safe_div(F.sum(F.abs(err)), F.sum(F.abs(t))).alias("wape_plain"),
    )


def islands(df: DataFrame, keys: list[str], order: str, label: str, values: list[str]) -> DataFrame:
    """Consecutive rows with one label merged into one: the mean of the values, first and last place. Runs of a label elsewhere stay apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    marked = df.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "island", label).agg(F.min(order).alias("first_place"), F.max(order).alias("last_place"), *[F.avg(v).alias(v) for v in values])
