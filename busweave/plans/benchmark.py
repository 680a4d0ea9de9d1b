"""How well a reduced network stands for the raw one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import EARTH_KM_IUGG, haversine_km
from ..operators.aggregate import composite_rank, exact_quantiles
from ..operators.joining import corridor_agreement
from ..operators.kernels import merged_edges, sparse_angles

# Fuels of plants that turn with the grid, and words of technologies that don't.
SYNCHRONOUS_FUELS = ("Hydro", "Hard Coal", "Natural Gas", "Lignite", "Oil", "Solid Biomass", "Waste", "Geothermal", "Nuclear", "Biogas", "Mechanical Storage")
NOT_SYNCHRONOUS = ("Battery", "Solar", "Wind", "PV", "Photovoltaic", "Hydrogen Storage", "Heat Storage")


def cluster_corridors(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """(first, second, b): susceptance between clusters of raw lines (a, b, x, circuits) with (bus_id, cluster_id)."""
    m = lambda s: mapping.select(F.col("bus_id").alias(s), F.col("cluster_id").alias(f"_{s}"))
    df = lines.join(m("a"), "a").join(m("b"), "b").where("_a <> _b")
    return df.select(F.least("_a", "_b").alias("first"), F.greatest("_a", "_b").alias("second"), F.try_divide(F.coalesce("circuits", F.lit(1.0)), F.abs("x")).alias("b")).groupBy("first", "second").agg(F.sum("b").alias("b"))


def corridor_metrics(raw: DataFrame, reduced: DataFrame) -> DataFrame:
    return corridor_agreement(raw, reduced, ["first", "second"], "b")


def compactness(nodes: DataFrame) -> DataFrame:
    """(cluster_id, n, radius95_km, diameter_km): distances of members to the centre, and the double of the largest as a bound of the
    diameter found by two sweeps. ``nodes`` has cluster_id, lat, lon."""
    mid = nodes.groupBy("cluster_id").agg(F.avg("lat").alias("_la"), F.avg("lon").alias("_lo"), F.count(F.lit(1)).alias("n"))
    d = nodes.join(mid, "cluster_id").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"), EARTH_KM_IUGG))
    far = d.groupBy("cluster_id").agg(F.max_by(F.struct("lat", "lon"), "km").alias("f"))
    sweep = nodes.join(far, "cluster_id").groupBy("cluster_id").agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("f.lat"), F.col("f.lon"), EARTH_KM_IUGG)).alias("diameter_km"))
    r95 = exact_quantiles(d, ["cluster_id"], "km", [0.95]).select("cluster_id", F.col("value").alias("radius95_km"))
    return mid.select("cluster_id", "n").join(r95, "cluster_id", "left").join(sweep, "cluster_id")


def transfer_fidelity(raw_nodes: DataFrame, raw_edges: DataFrame, reduced_edges: DataFrame, samples: int = 250, mw: float = 1000.0, seed: int = 42) -> DataFrame:
    """(sample, source, sink, nrmse, cosine): corridor flows of random transfers between clusters, raw against reduced.

    ``raw_nodes`` has group, node, cluster, weight (a cluster's injection is dealt by weight); ``raw_edges`` group, a, b, w;
    ``reduced_edges`` group, a, b, w between clusters. One sparse elimination serves all samples of a group as right-hand sides,
    whatever its size; a group of a single cluster has nothing to transfer and no rows.
    """

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        raw, red = e[e["kind"] == "raw"], e[e["kind"] == "reduced"]
        ids, clusters = np.sort(n["node"].to_numpy()), np.sort(n["cluster"].unique())
        if len(clusters) < 2:  # nothing to transfer between
            return pd.DataFrame(columns=["group", "sample", "source", "sink", "nrmse", "cosine"])
        at, ct = {v: i for i, v in enumerate(ids)}, {v: i for i, v in enumerate(clusters)}
        i, j, w = merged_edges(len(ids), raw["a"].map(at).to_numpy(int), raw["b"].map(at).to_numpy(int), raw["w"].to_numpy(float))
        first, second, v = merged_edges(len(clusters), red["a"].map(ct).to_numpy(int), red["b"].map(ct).to_numpy(int), red["w"].to_numpy(float))
        n = n.set_index("node").loc[ids]
        of, share = n["cluster"].map(ct).to_numpy(), n["weight"].clip(lower=0).to_numpy(float)
        total = np.bincount(of, weights=share, minlength=len(clusters))
        size = np.bincount(of, minlength=len(clusters))
        share = np.where(total[of] > 0, share / np.where(total[of] > 0, total[of], 1), 1 / size[of])
        rng = np.random.default_rng(seed)
        pick = np.array([rng.choice(len(clusters), 2, replace=False) for _ in range(samples)])
        inject = np.zeros((len(clusters), samples))
        inject[pick[:, 0], np.arange(samples)] = mw
        inject[pick[:, 1], np.arange(samples)] = -mw
        theta, phi = sparse_angles(len(ids), i, j, w, inject[of] * share[:, None]), sparse_angles(len(clusters), first, second, v, inject)
        pairs = {}
        for a, b, x in zip(i, j, w):
            if of[a] != of[b]:
                s = 1 if of[a] < of[b] else -1
                pairs.setdefault((min(of[a], of[b]), max(of[a], of[b])), np.zeros(samples))
                pairs[min(of[a], of[b]), max(of[a], of[b])] += s * x * (theta[a] - theta[b])
        reduced = {(a, b): x * (phi[a] - phi[b]) for a, b, x in zip(first, second, v)}
        keys = sorted(set(pairs) | set(reduced))
        t = np.array([pairs.get(k, np.zeros(samples)) for k in keys])
        g = np.array([reduced.get(k, np.zeros(samples)) for k in keys])
        scale = np.sqrt((t**2).mean(axis=0))
        norm = np.linalg.norm(t, axis=0) * np.linalg.norm(g, axis=0)
        return pd.DataFrame(
            {
                "group": [key[0]] * samples, "sample": np.arange(samples), "source": clusters[pick[:, 0]].astype(str), "sink": clusters[pick[:, 1]].astype(str),
                "nrmse": np.where(scale > 0, np.sqrt(((g - t) ** 2).mean(axis=0)) / np.where(scale > 0, scale, 1), np.nan), "cosine": np.where(norm > 0, (t * g).sum(axis=0) / np.where(norm > 0, norm, 1), np.nan),
            }
        )

    text = lambda df, kind: df.select(F.col("group").cast("string").alias("group"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "w", F.lit(kind).alias("kind"))
    nodes = raw_nodes.select(F.col("group").cast("string").alias("group"), F.col("node").cast("string").alias("node"), F.col("cluster").cast("string").alias("cluster"), F.col("weight").cast("double").alias("weight"))
    edges = text(raw_edges, "raw").unionByName(text(reduced_edges, "reduced"))
    return nodes.groupBy("group").cogroup(edges.groupBy("group")).applyInPandas(run, "group string, sample long, source string, sink string, nrmse double, cosine double")


def ranking(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Runs ranked by their weighted metrics; cosines and connectivity are better when higher."""
    return composite_rank(runs, "run", weights, {c for c in weights if "cosine" in c or "lambda" in c or "cycle" in c or "ratio" in c})
