"""Implausible readings in periodic series, judged by each series' own behaviour.

A robust autoregression predicts every week of a series (in logs) from the sound weeks before it and, run backwards, from those
after it. What sound weeks miss between the two predictions gives the series' residual scale. A week beyond both predictions by the
given factor, less what the level may be off by that scale, is an additive outlier; one that agrees with what follows or with what
went before is a level shift and normal. Outliers are taken out and predictions and scale made again, with ever nearer weeks. Runs of one value and physical
limits are tested apart. What recurs in the same weeks of every other year is normal.

Series are dealt by hash to groups of about ``ROWS_PER_GROUP`` rows; a group's series are worked on together as one matrix, so
Python sees a few large arrays instead of many small frames. A series is bounded by its calendar (years x weeks).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROWS_PER_GROUP, SERIES_AT_ONCE = 60_000, 1_000


@dataclass(frozen=True)
class Rules:
    """``factor``: how far beyond its surroundings a spike is; ``scales``: residual scales of the series by which the estimated level may be
    off, at most half the factor's logarithm; ``longest``: weeks a spike lasts at most; ``stuck``: weeks of one value from which on a changing series is stuck;
    ``over``: share by which a value may exceed its limit."""

    factor: float = 5.0
    scales: float = 2.0
    longest: int = 5
    stuck: int = 6
    over: float = 0.01


def _nearest_median(logs: np.ndarray, sound: np.ndarray, k: int) -> np.ndarray:
    """For each cell the median of the k nearest sound values before it in its row; NaN where there is none."""
    rows, width = logs.shape
    before = np.cumsum(sound, axis=1) - sound
    packed = np.take_along_axis(logs, np.argsort(~sound, axis=1, kind="stable"), axis=1)
    at = before[:, :, None] - 1 - np.arange(k)
    values = np.take_along_axis(packed, np.clip(at, 0, width - 1).reshape(rows, -1), axis=1).reshape(rows, width, k)
    values = np.sort(np.where(at >= 0, values, np.inf), axis=2)
    n = np.minimum(before, k)
    low, high = (np.take_along_axis(values, np.clip(i, 0, k - 1)[:, :, None], axis=2)[:, :, 0] for i in ((n - 1) // 2, n // 2))
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (low + high) / 2, np.nan)


def _row_median(a: np.ndarray) -> np.ndarray:
    """Median of each row without NaN, NaN for empty rows."""
    ordered, n = np.sort(a, axis=1), np.sum(~np.isnan(a), axis=1)
    pick = lambda i: np.take_along_axis(ordered, np.clip(i, 0, a.shape[1] - 1)[:, None], axis=1)[:, 0]
    return np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)


def _memory(logs: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Robust lag-1 coefficient of each row: 1 less the scale of the steps against that of the deviations; 1 for a constant row."""
    deviation = np.abs(logs - middle)
    step = np.abs(logs[:, 1:] - logs[:, :-1])
    wide, narrow = _row_median(deviation), _row_median(step)
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.where(wide > 0, 1 - (narrow / wide) ** 2 / 2, 1.0)
    return np.clip(np.nan_to_num(phi, nan=1.0), 0.5, 1.0)[:, None]


def _deviation(x: np.ndarray, usable: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signed log distance beyond the two predictions (0 between them), the lower and upper prediction, and for each series the distance
    from which on a week is an outlier."""
    middle = _row_median(np.where(usable & (x > 0), x, np.nan))
    floor = np.where(middle > 0, middle * 1e-4, 1e-9)[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        logs = np.where(usable, np.log(np.maximum(x, floor)), np.nan)
    most, sound = np.log(rules.factor), usable.copy()
    for k in (2 * rules.longest - 1, rules.longest + 2, rules.longest - 1, 3):
        centre = _row_median(np.where(sound, logs, np.nan))[:, None]
        phi = _memory(np.where(sound, logs, np.nan), centre)
        filled = np.where(sound, logs, 0.0)
        ahead = centre + phi * (_nearest_median(filled, sound, k) - centre)
        back = centre + phi * (_nearest_median(filled[:, ::-1], sound[:, ::-1], k)[:, ::-1] - centre)
        low, high = np.fmin(ahead, back), np.fmax(ahead, back)
        with np.errstate(invalid="ignore"):
            d = np.where(logs > high, logs - high, np.where(logs < low, logs - low, 0.0))
        d = np.nan_to_num(np.where(usable, d, 0.0))
        # Residual scale: the median distance of sound weeks from the middle of their predictions, as that of a normal error.
        scale = 1.4826 * _row_median(np.where(sound, np.abs(logs - (low + high) / 2), np.nan))
        limit = (most - np.minimum(rules.scales * np.nan_to_num(scale), most / 2))[:, None]
        sound = usable & (np.abs(d) < limit)
    return d, np.exp(low), np.exp(high), limit


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of runs of True in a vector."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _every_other_year(like: np.ndarray, known: np.ndarray, cells: np.ndarray, weeks: int) -> bool:
    """Whether in every other year with known weeks there at least half of them look alike, and there is such a year."""
    width = len(like)
    years = width // weeks
    own, seen = cells[0] // weeks, 0
    for shift in range(-years + 1, years):
        if shift == 0:
            continue
        at = cells + shift * weeks
        at = at[(at >= 0) & (at < width)]
        at = at[(at // weeks) != own]
        at = at[known[at]]
        if len(at) == 0 or len(at) * 2 < len(cells):
            continue
        seen += 1
        if like[at].mean() < 0.5:
            return False
    return seen > 0


def judge(x: np.ndarray, limits: np.ndarray | None, weeks: int, rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flags for a matrix of series (rows) over years x weeks (columns), NaN where nothing is recorded.

    Returns the kind of each cell (0 sound, 1 negative, 2 beyond its limit, 3 spike, 4 stuck), the predictions between which a cell would
    be sound, and the log distance from them from which on it isn't. Infinite values count as spikes.
    """
    known = ~np.isnan(x)
    kind = np.zeros(x.shape, dtype=np.int8)
    with np.errstate(invalid="ignore"):
        kind[known & (x < 0)] = 1
        if limits is not None:
            kind[known & (kind == 0) & (x > limits * (1 + rules.over) + 1e-9)] = 2
    kind[np.isposinf(x) & (kind == 0)] = 3

    # Runs of one value: an unknown week neither ends nor makes a run.
    index = np.where(known, np.arange(x.shape[1]), -1)
    last = np.maximum.accumulate(index, axis=1)
    previous = np.concatenate([np.full((len(x), 1), -1), last[:, :-1]], axis=1)
    same = known & (previous >= 0) & (np.take_along_axis(x, np.maximum(previous, 0), axis=1) == x)
    pairs = np.maximum(known.sum(axis=1) - 1, 1)
    in_stuck = np.zeros(x.shape, dtype=bool)
    for s in np.flatnonzero(same.sum(axis=1) >= rules.stuck - 2):
        cells = np.flatnonzero(known[s])
        starts, ends = _runs(same[s][cells])
        others = same[s].sum()
        for a, b in zip(starts, ends):
            run = cells[a - 1 : b]
            if run[-1] - run[0] + 1 < rules.stuck or len(run) < rules.stuck - 1:
                continue
            in_stuck[s, run] = True
            rest = pairs[s] - (b - a)
            changing = rest >= max(rules.stuck, pairs[s] / 4) and others - (b - a) < 0.5 * rest
            if changing and not _every_other_year(x[s] == x[s, run[0]], known[s], run, weeks):
                kind[s, run[kind[s, run] == 0]] = 4

    # A reading stuck at 0 says nothing of the level around it; one stuck at another value still stands where the level was.
    with np.errstate(invalid="ignore"):
        usable = known & ((kind == 0) | ((kind == 4) & (x > 0)))
    d, low, high, limit = _deviation(np.where(usable, x, np.nan), usable, rules)
    for sign in (1, -1):
        beyond = (d * sign >= limit) & usable & ~in_stuck
        alike = d * sign >= limit / 2
        for s in np.flatnonzero(beyond.any(axis=1)):
            cells = np.flatnonzero(known[s])
            starts, ends = _runs(beyond[s][cells])
            for a, b in zip(starts, ends):
                run = cells[a:b]
                if run[-1] - run[0] + 1 <= rules.longest and not _every_other_year(alike[s], known[s], run, weeks):
                    kind[s, run] = 3
    return kind, low, high, limit


KINDS = ("", "negative", "limit", "spike", "stuck")


def _judge_group(batch: pa.Table, rules: Rules) -> pa.Table:
    col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "year", "week", "value", "ceiling", "row_id")}
    order = np.lexsort((col["row_id"], col["week"], col["year"], col["h2"], col["h1"]))
    h1, h2, year, week, value, ceiling, row_id = (col[n][order] for n in ("h1", "h2", "year", "week", "value", "ceiling", "row_id"))
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    series = np.cumsum(new) - 1
    later_year = np.concatenate([[False], (year[1:] != year[:-1]) & ~new[1:]])
    rank = np.cumsum(later_year)
    rank = rank - rank[np.flatnonzero(new)][series]
    weeks = int(max(52, week.max()))
    column = rank * weeks + week.astype(int) - 1
    kinds = np.zeros(len(series), dtype=np.int8)
    for first in range(0, series[-1] + 1, SERIES_AT_ONCE):
        at = slice(*np.searchsorted(series, [first, first + SERIES_AT_ONCE]))
        s, c = series[at] - first, column[at]
        width = (int(rank[at].max()) + 1) * weeks
        x = np.full((s[-1] + 1, width), np.nan)
        x[s[::-1], c[::-1]] = value[at][::-1]  # of several records of one week the one with the smallest row_id stands
        top = np.full(x.shape, np.nan)
        top[s[::-1], c[::-1]] = ceiling[at][::-1]
        kind, low, high, limit = judge(x, top, weeks, rules)
        mine, stands = kind[s, c], x[s, c]
        v, most = value[at], ceiling[at]
        other = ~((v == stands) | np.isnan(v))
        f = np.exp(limit[s, 0])
        with np.errstate(invalid="ignore"):
            own = np.where(v < 0, 1, np.where(v > most * (1 + rules.over) + 1e-9, 2, np.where((v >= high[s, c] * f) | (v * f <= low[s, c]), 3, 0)))
        kinds[at] = np.where(np.isnan(v), 0, np.where(other, own, mine))
    hit = np.flatnonzero(kinds)
    ids, place = np.unique(row_id[hit], return_index=True)
    return pa.table({"row_id": pa.array(ids, pa.int64()), "kind": pa.array([KINDS[k] for k in kinds[hit][place]], pa.string())})


def implausible(rows: DataFrame, series: list[str], year: str, week: str, value: str, row_id: str = "row_id", limit: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """(row_id, kind): readings that can't be true for their series; kind is negative, limit, spike or stuck, the first that holds.

    Null values are no readings; NaN counts as null. Null series columns form a series of their own. A reading without year or
    week has no place in its series and is tested only against zero and its limit. Repeated rows count once, late rows stand where
    their week is. A series with no sound week, or a single one, has no spikes.
    """
    amount, ceiling = F.col(value).cast("double"), (F.col(limit).cast("double") if limit else F.lit(None).cast("double"))
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in series])
    slim = rows.select(
        F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"), F.col(year).cast("int").alias("year"), F.col(week).cast("int").alias("week"), amount.alias("value"), F.coalesce(ceiling, F.lit(float("inf"))).alias("ceiling"), F.col(row_id).cast("long").alias("row_id")
    ).where("value is not null and not isnan(value)")
    placed = F.col("year").isNotNull() & F.col("week").isNotNull() & (F.col("week") >= 1) & (F.col("week") <= 54)
    groups = max(1, -(-rows.count() // ROWS_PER_GROUP))
    dealt = slim.where(placed).withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.lit(groups)).cast("int"))
    judged = dealt.groupBy("part").applyInArrow(lambda t: _judge_group(t, rules), "row_id long, kind string")
    loose = slim.where(~F.coalesce(placed, F.lit(False))).select("row_id", F.when(F.col("value") < 0, "negative").when(F.col("value") > F.col("ceiling") * (1 + rules.over), "limit").alias("kind")).where("kind is not null").distinct()
    return judged.unionByName(loose)
