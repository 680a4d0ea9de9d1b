"""Queries against all rows of their tables, worked out here without any filter."""

import os

import pandas as pd

from busweave.operators.joining import corridor_agreement
from busweave.plans.tables import QUERIES

from .conftest import rows


def _read(sf_dir, name):
    return pd.read_parquet(os.path.join(sf_dir, f"{name}.parquet"))


def test_dedupe_conflict_takes_every_event(spark, sf_dir):
    e = _read(sf_dir, "events")
    level = (e["value"] / 100).apply(lambda v: v // 1)
    g = level.groupby([e["user_id"], e["event_type"]])
    want = sorted(((u, t, lo, n, lo != hi) for (u, t), lo, hi, n in zip(g.groups, g.min(), g.max(), g.size())), key=repr)
    got = rows(QUERIES["dedupe_conflict"](spark, sf_dir), "user_id", "event_type", "level", "n_rows", "conflict")
    assert sum(r[3] for r in got) == len(e)
    assert got == want


def _union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        i, j = find(a), find(b)
        root[max(i, j)] = min(i, j)
    return {x: find(x) for x in root}


def _part_edges(sf_dir):
    p = _read(sf_dir, "part")
    known = set(p["p_partkey"])
    return p, [(int(k), int(k + s)) for k, s in zip(p["p_partkey"], p["p_size"]) if k + s in known]


def test_components_of_every_part(spark, sf_dir):
    _, edges = _part_edges(sf_dir)
    assert dict(rows(QUERIES["components"](spark, sf_dir), "node", "component")) == _union_find(edges)


def test_leaves_of_every_part(spark, sf_dir):
    p, edges = _part_edges(sf_dir)
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    leaf = {int(k): next(iter(near[k])) for k, s in zip(p["p_partkey"], p["p_size"]) if len(near.get(k, ())) == 1 and s * 10 <= 300}
    merged = {n: t for n, t in leaf.items() if t not in leaf or (leaf[t] == n and n > t)}
    want = {int(k): merged.get(int(k), int(k)) for k in p["p_partkey"]}
    assert dict(rows(QUERIES["leaf_contract"](spark, sf_dir), "node", "target")) == want


def test_corridors_of_all_flows(spark, sf_dir):
    t = {n: _read(sf_dir, n) for n in ("lineitem", "supplier", "orders", "customer")}
    f = t["lineitem"].merge(t["supplier"], left_on="l_suppkey", right_on="s_suppkey").merge(t["orders"], left_on="l_orderkey", right_on="o_orderkey").merge(t["customer"], left_on="o_custkey", right_on="c_custkey")
    f = f[f["s_nationkey"] != f["c_nationkey"]]
    ends = f[["s_nationkey", "c_nationkey"]]
    flow = f["l_quantity"].astype(float).groupby([pd.to_datetime(f["l_shipdate"]).dt.year.rename("y"), ends.min(axis=1).rename("a"), ends.max(axis=1).rename("b")]).sum()
    both = pd.concat([flow.loc[1997].rename("t"), flow.loc[1998].rename("g")], axis=1)
    common, known = both.dropna(), both.fillna(0)
    off = (known["g"] - known["t"]).abs()
    got = QUERIES["corridor_jaccard"](spark, sf_dir).first()
    assert (got.n_common, got.n_missing, got.n_extra) == (len(common), int(both["g"].isna().sum()), int(both["t"].isna().sum()))
    assert abs(got.jaccard - len(common) / len(both)) < 1e-5
    assert abs(got.wape - (off * known["t"]).sum() / (known["t"] ** 2).sum()) < 1e-5 and abs(got.wape_plain - off.sum() / known["t"].sum()) < 1e-5


def test_missing_and_extra_corridors(spark):
    raw = spark.createDataFrame([(1, 2, 10.0), (1, 3, 5.0), (2, 3, 5.0)], "first int, second int, v double")
    reduced = spark.createDataFrame([(1, 2, 8.0), (3, 4, 1.0)], "first int, second int, v double")
    got = corridor_agreement(raw, reduced, ["first", "second"], "v").first()
    assert (got.n_common, got.n_missing, got.n_extra, got.precision, got.jaccard) == (1, 2, 1, 0.5, 0.25)
    assert abs(got.recall - 1 / 3) < 1e-9 and abs(got.wape - 70 / 150) < 1e-9 and abs(got.wape_plain - 13 / 20) < 1e-9
