"""Quantities recorded in different units: readable values to a common unit, with the scale used and how it is known.

What is said nearest to a value decides: its own cell, its unit column, the row's remark on this field, the file's note. Where
nothing is said, a mixture on the log scale does: the common-unit distribution is learnt from the values whose unit is known, every
scale contributes the same shape moved by its known factor, weights come from EM over the unlabelled values (one set for all, then
one per file, drawn to the first by a Dirichlet prior; none is ever zero), and a value takes the scale of highest posterior, flagged
when that is uncertain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import GROUPING, parse_number
from ..functions.scalar import let
from ..session import materialise

_FIGURE = rf"([0-9][0-9.,{GROUPING}]*(?:[eE][+-]?[0-9]+(?![0-9A-Za-z]))?)"
_CLAUSE_END = r";| / |\.\s+(?=[\p{L}\p{N}])"
#: Bins a unit of log value, and the most scales a field may have: they bound what reaches the driver.
BINS_PER_LOG, MAX_SCALES = 50, 200


@dataclass(frozen=True)
class Field:
    """A measure to be converted: its cell and unit columns, the words by which notes speak of it, and how its units read."""

    name: str
    unit_column: str
    words: str
    kind: str  # "efficiency" or "cost_per_power"


def split_cell(cell: Column) -> Column:
    """Struct (number, unit) of a typed cell. Placeholders and other texts without a figure have no number; blank units are null."""

    def parts(text: Column, figure: Column) -> Column:
        at = F.position(figure, text)
        around = F.concat(text.substr(F.lit(1), at - 1), F.lit(" "), text.substr(at + F.length(figure), F.length(text)))
        unit = F.nullif(F.trim(F.regexp_replace(around, r"^(?:\s|[~≈+-]|(?i:ca\.|approx\.|about))+", "")), F.lit(""))
        number = let(parse_number(figure), lambda x: F.when(text.rlike(r"^[^0-9]*[-−][0-9]"), -x).otherwise(x))
        return F.when(F.length(figure) > 0, F.struct(number.alias("number"), unit.alias("unit")))

    whole = lambda text: let(F.regexp_replace(F.regexp_extract(text, _FIGURE, 1), rf"[.,{GROUPING}]+$", ""), lambda figure: parts(text, figure))
    return let(F.trim(cell), whole)


#: Fuel energy per unit of output, from the first unit to the second.
_ENERGY = r"(kj|mj|gj|tj|kwh|mwh|gwh)"
_HEAT_RATE = _ENERGY + r"(?:[_ ][^/]*?)?\s*(?:/|\bper\b|\bje\b|\bpro\b)\s*" + _ENERGY
_IN_MWH = {"kj": 1 / 3.6e6, "mj": 1 / 3600, "gj": 1 / 3.6, "tj": 1 / 0.0036, "kwh": 1e-3, "mwh": 1.0, "gwh": 1e3}


def read_efficiency_unit(text: Column) -> Column:
    """(how, factor) of a unit of conversion efficiency: a share, or fuel energy per unit of output; null if the text names none."""
    mwh = F.create_map(*[F.lit(x) for kv in _IN_MWH.items() for x in kv])
    share = lambda f: F.struct(F.lit("multiply").alias("how"), F.lit(f).alias("factor"))

    def heat(rate: Column) -> Column:
        fuel, output = F.regexp_extract(rate, _HEAT_RATE, 1), F.regexp_extract(rate, _HEAT_RATE, 2)
        return F.struct(F.lit("divide").alias("how"), F.round(F.try_element_at(mwh, output) / F.try_element_at(mwh, fuel), 6).alias("factor"))

    def read(t: Column) -> Column:
        other = F.when(t.rlike(r"‰|per mille?\b|promille"), share(0.001)).when(t.rlike(r"%|per ?cent|\bpct\b|prozent|pour ?cent"), share(0.01)).when(t.rlike(r"\bfraction\b|\bp\.?u\b|per unit\b|\[-\]|^-$|\bratio\b|\bdecimal\b|\banteil\b"), share(1.0))
        return let(F.regexp_extract(t, _HEAT_RATE, 0), lambda rate: F.when(F.length(rate) > 0, heat(rate)).otherwise(other))

    return F.when(text.isNotNull(), let(F.lower(text), read))


def read_cost_unit(text: Column) -> Column:
    """(how, factor) of a unit of money per power and time, against EUR per MW and year; null if the text names no money per power."""

    def read(t: Column) -> Column:
        money = F.when(t.rlike(r"\bmeur|m€|\bmio\b|million"), 1e6).when(t.rlike(r"\bkeur|\bk€|\bteur|\bt€|thousand|tausend"), 1e3).when(t.rlike(r"eur|€"), 1.0)
        power = F.when(t.rlike(r"\bkw(?!h)|kilowatt(?!-?(?:hour|stund))"), 1e3).when(t.rlike(r"\bgw(?!h)|gigawatt"), 1e-3).when(t.rlike(r"\bmw(?!h)|megawatt"), 1.0)
        time = F.when(t.rlike(r"month|monat|\bmth\b|\bmtl\b"), 12.0).when(t.rlike("quarter|quartal"), 4.0).when(t.rlike(r"/h\b|hour|stund"), 8760.0).otherwise(1.0)
        return let(money * power, lambda x: F.when(x.isNotNull(), F.struct(F.lit("multiply").alias("how"), F.round(x * time, 6).alias("factor"))))

    return F.when(text.isNotNull(), let(F.lower(text), read))


READERS = {"efficiency": read_efficiency_unit, "cost_per_power": read_cost_unit}


def statement_on(text: Column, words: str) -> Column:
    """The first clause of a free text that speaks of a field, from the word on and, if that is all, before it; null if none does."""
    return F.get(F.filter(F.split(text, _CLAUSE_END), lambda c: F.lower(c).rlike(words)), F.lit(0))


def _judge(f: Field):
    """What a split cell says with what is said about it, in order of nearness; the farther is read only where nothing nearer speaks."""
    read = READERS[f.kind]

    def named(unit: Column, name: str) -> Column:
        return let(unit, lambda u: F.when(u.isNotNull(), F.struct(u["how"].alias("how"), u["factor"].alias("factor"), F.lit(name).alias("said_by"))))

    def judge(cell: Column) -> Column:
        said = [("cell", cell["unit"]), ("unit", F.col(f.unit_column)), ("remark", statement_on(F.col("remark"), f.words)), ("note", statement_on(F.col("_note"), f.words))]
        by = F.coalesce(*[named(read(text), name) for name, text in said])
        return F.when(cell["number"].isNotNull(), F.struct(F.lit(f.name).alias("field_name"), cell["number"].alias("number"), by.alias("by")))

    return judge


def stated(rows: DataFrame, fields: list[Field], notes: DataFrame | None, keep: list[str], file_column: str = "source_file") -> DataFrame:
    """One row per record and field with a readable number: keep columns, file, field_name, number, how, factor, said_by (cell, unit, remark, note or null)."""
    rows = rows.select(*dict.fromkeys([*keep, file_column, "remark", *[c for f in fields for c in (f.name, f.unit_column)]]))
    if notes is not None:
        note = notes.where(F.col(file_column).isNotNull()).groupBy(file_column).agg(F.concat_ws("; ", F.sort_array(F.collect_set("note"))).alias("_note"))
        rows = rows.join(note, file_column, "left")
    else:
        rows = rows.withColumn("_note", F.lit(None).cast("string"))
    parts = [let(split_cell(F.col(f.name)), _judge(f)) for f in fields]
    long = rows.select(*keep, F.col(file_column).alias("_file"), F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return long.select(*keep, "_file", "x.field_name", "x.number", "x.by.how", "x.by.factor", "x.by.said_by")


def read_scales(scales: DataFrame) -> dict[str, list[tuple[int, str, float]]]:
    """Scales of each field from the reference table, on the driver; refused beyond MAX_SCALES rows."""
    found = scales.where("scale_id is not null").distinct().limit(MAX_SCALES + 1).collect()
    if len(found) > MAX_SCALES:
        raise ValueError(f"more than {MAX_SCALES} scales")
    out: dict[str, list[tuple[int, str, float]]] = {}
    for r in sorted(found, key=lambda r: r["scale_id"]):
        out.setdefault(r["field_name"], []).append((r["scale_id"], r["how"], r["factor"]))
    return out


def _moved(how: str, factor: float) -> tuple[int, float]:
    """log(common) = sign * log(number) + shift."""
    return (1, math.log(factor)) if how == "multiply" else (-1, math.log(factor))


@dataclass
class Shape:
    """Log density of the common log values: a table in bins from ``low`` on, and a wide normal beyond it."""

    mean: float
    deviation: float
    low: float
    table: np.ndarray

    #: Share of values that lie anywhere, so that no scale rules a value out.
    STRAY = 1e-3

    @staticmethod
    def learn(bins: np.ndarray, counts: np.ndarray, fallback: tuple[float, float]) -> Shape:
        """Smoothed histogram of the known log values; a normal by ``fallback`` (mean, deviation) if there are fewer than ten or all are alike."""
        n = counts.sum()
        mean, deviation = fallback
        learnt = n >= 10 and np.ptp(bins) > 0
        if learnt:
            order = np.argsort(bins)
            mean = float(bins[order][np.searchsorted(counts[order].cumsum(), n / 2)])
            deviation = float(np.sqrt(np.average((bins - np.average(bins, weights=counts)) ** 2, weights=counts)))
        half = int(np.ceil(8 * deviation * BINS_PER_LOG))
        at = (np.arange(-half, half) + 0.5) / BINS_PER_LOG
        density = np.exp(-0.5 * (at / deviation) ** 2) / (deviation * math.sqrt(2 * math.pi))
        low = math.floor(mean * BINS_PER_LOG) / BINS_PER_LOG - half / BINS_PER_LOG
        if learnt:
            place = np.floor((bins - low) * BINS_PER_LOG).astype(int)
            inside = (place >= 0) & (place < len(at))
            width = max(0.9 * deviation * n**-0.2, 1 / BINS_PER_LOG)
            kernel = np.exp(-0.5 * (at / width) ** 2)
            # The kernel's middle lies between two bins; both halves are used, so nothing is moved.
            seen = np.bincount(place[inside], weights=counts[inside], minlength=len(at)).astype(float)
            full = np.convolve(seen, kernel / kernel.sum())
            density = ((full[half - 1 : half - 1 + len(at)] + full[half : half + len(at)]) / 2) * BINS_PER_LOG / n
        shape = Shape(mean, deviation, low, np.zeros(0))
        centre = low + (np.arange(len(at)) + 0.5) / BINS_PER_LOG
        shape.table = np.log((1 - Shape.STRAY) * np.maximum(density, 0) + np.exp(shape._stray(centre)))
        return shape

    def _stray(self, x):
        return math.log(Shape.STRAY / (2 * self.deviation * math.sqrt(2 * math.pi))) - 0.5 * ((x - self.mean) / (2 * self.deviation)) ** 2

    def at(self, x: np.ndarray) -> np.ndarray:
        place = np.floor((x - self.low) * BINS_PER_LOG).astype(int)
        inside = (place >= 0) & (place < len(self.table))
        return np.where(inside, self.table[np.clip(place, 0, len(self.table) - 1)], self._stray(x))

    def column(self, x: Column) -> Column:
        table = F.split(F.lit(",".join(map(repr, self.table.tolist()))), ",").cast("array<double>")
        place = F.floor((x - F.lit(self.low)) * BINS_PER_LOG).cast("int")
        return F.coalesce(F.when(place >= 0, F.get(table, place)), self._stray(x))


def fit_mixture(like: np.ndarray, counts: np.ndarray, prior: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of the scales for unlabelled values, ``like`` being scales x bins log densities: EM with a Dirichlet prior of ``prior`` rows."""
    weights = prior / prior.sum()
    for _ in range(rounds):
        joint = like + np.log(weights)[:, None]
        share = np.exp(joint - joint.max(axis=0))
        share /= share.sum(axis=0)
        weights = (share * counts).sum(axis=1) + prior
        weights /= weights.sum()
    return weights


def assign_scales(said: DataFrame, scales: dict[str, list[tuple[int, str, float]]], key: list[str], file_prior: float = 20.0, sure: float = 0.9) -> DataFrame:
    """Adds scale_id, common value, said_by ``size`` where the mixture decided, posterior, and ``uncertain``.

    Only aggregates reach the driver: histograms of the labelled common logs and of the unlabelled logs per field, of bounded range and
    width. Numbers <= 0 without a statement get no scale. A field without labelled values takes the spread of its
    unlabelled ones around the common scale. A stated unit that is none of the scales gets no scale but is no guess either.
    """
    # The readings are counted three times below; written once, the texts are read once.
    said = materialise(said, "readings")
    log = F.log("number")
    scale_of = F.lit(None).cast("int")
    common = F.lit(None).cast("double")
    for field, options in scales.items():
        for sid, how, factor in options:
            here = (F.col("field_name") == field) & (F.col("how") == how) & (F.abs(F.col("factor") / F.lit(factor) - 1) < 1e-6)
            scale_of = F.when(here, sid).otherwise(scale_of)
    value = lambda how, factor: F.col("number") * F.lit(factor) if how == "multiply" else F.when(F.col("number") != 0, F.lit(factor) / F.col("number"))
    tagged = said.withColumn("_said", scale_of)
    for field, options in scales.items():
        for sid, how, factor in options:
            common = F.when(F.col("_said") == sid, value(how, factor)).otherwise(common)
    tagged = tagged.withColumn("_common", common)
    bin_of = lambda x: F.greatest(F.lit(-40 * BINS_PER_LOG), F.least(F.lit(40 * BINS_PER_LOG), F.floor(x * BINS_PER_LOG)))
    labelled = tagged.where("_common > 0").groupBy("field_name", bin_of(F.log("_common")).alias("bin")).count().collect()
    open_ = F.col("said_by").isNull() & (F.col("number") > 0)
    binned = tagged.where(open_).groupBy("_file", "field_name", bin_of(log).alias("bin")).count()
    histogram = binned.groupBy("field_name", "bin").agg(F.sum("count").alias("count")).collect()
    of = lambda rows, field: (np.array([r["bin"] for r in rows if r["field_name"] == field]) / BINS_PER_LOG + 0.5 / BINS_PER_LOG, np.array([r["count"] for r in rows if r["field_name"] == field], dtype=float))
    joint = F.lit(None)
    shapes: dict[str, Shape] = {}
    overall: dict[str, np.ndarray] = {}
    for field, options in scales.items():
        bins, counts = of(histogram, field)
        if not len(bins):
            continue
        shapes[field] = Shape.learn(*of(labelled, field), (float(np.average(bins, weights=counts)), 0.5))
        moves = [_moved(h, f) for _, h, f in options]
        overall[field] = fit_mixture(np.array([shapes[field].at(s * bins + shift) for s, shift in moves]), counts, np.ones(len(options)))
        like = [shapes[field].column(F.lit(s) * log + F.lit(shift)) for s, shift in moves]
        joint = F.when(F.col("field_name") == field, F.array(*[F.struct(x.alias("l"), F.lit(-sid).alias("o"), F.lit(sid).alias("id")) for x, (sid, _, _) in zip(like, options)])).otherwise(joint)
    if not histogram:
        return tagged.select(*key, "field_name", "number", F.col("_said").alias("scale_id"), F.col("_common").alias("common_value"), "said_by", F.lit(1.0).alias("posterior"), F.lit(False).alias("uncertain"))
    guessed = tagged.withColumn("_joint", F.when(open_, joint))

    def fit_file(key, rows: pd.DataFrame) -> pd.DataFrame:
        """A file's own weights, drawn to the overall ones by ``file_prior`` rows."""
        field = key[1]
        if field not in overall:
            return pd.DataFrame({"_file": [], "_field": [], "_ids": [], "_weights": []})
        bins = (rows["bin"].to_numpy(float) + 0.5) / BINS_PER_LOG
        like = np.array([shapes[field].at(s * bins + shift) for s, shift in (_moved(h, f) for _, h, f in scales[field])])
        weights = fit_mixture(like, rows["count"].to_numpy(float), file_prior * overall[field])
        return pd.DataFrame({"_file": [rows["_file"].iloc[0]], "_field": [field], "_ids": [[i for i, _, _ in scales[field]]], "_weights": [weights.tolist()]})

    by_file = binned.groupBy("_file", "field_name").applyInPandas(fit_file, "_file string, _field string, _ids array<int>, _weights array<double>")
    by_file = by_file.select("_file", "_field", F.map_from_arrays("_ids", "_weights").alias("_weights"))
    guessed = guessed.join(by_file, guessed["_file"].eqNullSafe(by_file["_file"]) & (guessed["field_name"] == F.col("_field")), "left").drop(by_file["_file"])
    again = F.transform("_joint", lambda x: F.struct((x["l"] + F.log(F.try_element_at("_weights", x["id"]))).alias("l"), x["o"].alias("o"), x["id"].alias("id")))
    guessed = guessed.withColumn("_joint", again).withColumn("_best", F.array_max("_joint"))
    posterior = 1 / F.aggregate("_joint", F.lit(0.0), lambda a, x: a + F.exp(x["l"] - F.col("_best.l")))
    sid = F.coalesce(F.col("_said"), F.col("_best.id"))
    final = F.col("_common")
    for options in scales.values():
        for i, how, factor in options:
            final = F.when(F.col("_said").isNull() & (sid == i), value(how, factor)).otherwise(final)
    chance = F.when(open_, posterior).when(F.col("_said").isNotNull(), 1.0)
    return guessed.select(
        *key, "field_name", "number", sid.alias("scale_id"), final.alias("common_value"), F.when(open_, "size").otherwise(F.col("said_by")).alias("said_by"), chance.alias("posterior"), F.coalesce(chance < sure, F.lit(True)).alias("uncertain")
    )
