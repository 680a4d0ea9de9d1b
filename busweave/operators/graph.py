"""Graph operators on edge tables: pointer jumping, components, degrees, leaf contraction, DC collapse.

Iterations are cut by writing each round to the shared folder, so that lineage stays one round long and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise

#: Doubling needs as many rounds as the binary logarithm of the longest chain; more mean a cycle.
MAX_ROUNDS = 40


def pointer_jump(mapping: DataFrame, source: str = "source", target: str = "target", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Each source mapped to the end of its chain. A target that is no source, or maps to itself, is an end. Cycles fail.

    Every round doubles the length of the jumps. One target per source; repeated rows count once.
    """
    jump = materialise(mapping.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source).agg(F.min(target).alias(target)), "jump")
    for _ in range(max_rounds):
        nxt = jump.select(F.col(source).alias(target), F.col(target).alias("_next"))
        stepped = jump.join(nxt, target, "left").select(source, target, F.coalesce("_next", target).alias("_to"))
        stepped = materialise(stepped, "jump")
        moved = stepped.where(F.col("_to") != F.col(target)).limit(1).count()
        jump = stepped.select(source, F.col("_to").alias(target))
        if not moved:
            return jump
    raise ValueError("the mapping has a cycle")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): the least node id reachable from each node with an edge.

    Large-star/small-star: every round links neighbours to the smallest neighbour, first the larger ones, then the smaller ones; the
    rounds grow with the logarithm of the number of nodes, not with the diameter. Self-loops keep lone nodes.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = materialise(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        # Large star: for each node, its larger neighbours point to the smallest of all its neighbours and itself.
        sym = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(links.where("u = v")).distinct()
        # Small star: smaller neighbours and the node itself point to the smallest.
        down = large.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, "links")
        changed = new.exceptAll(links).limit(1).count() or links.exceptAll(new).limit(1).count()
        links = new
        if not changed:
            break
    else:
        raise ValueError("components did not settle")
    found = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree): number of different neighbours; self-loops don't count."""
    ends = edges.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))).alias("e")).select("e.*")
    return ends.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def contract_leaves(nodes: DataFrame, edges: DataFrame, max_members: int = 2, max_size: float = 300.0, protected: DataFrame | None = None) -> DataFrame:
    """(node, target): small nodes of degree 1 merged into their neighbour, one layer: a neighbour that would itself be merged keeps the
    leaf only if it stays; of two leaves that face each other the smaller id stays.

    ``nodes`` has node, members, size, and optionally country with ``keep_country`` semantics left to the caller; ``protected`` lists
    nodes that stay (ends of links and the like).
    """
    near = edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct()
    only = near.groupBy("node").agg(F.count(F.lit(1)).alias("_d"), F.min("other").alias("target")).where("_d = 1").drop("_d")
    small = nodes.where((F.coalesce("members", F.lit(1)) <= max_members) & (F.coalesce("size", F.lit(0.0)) <= max_size)).select("node")
    if protected is not None:
        small = small.join(protected.select("node").distinct(), "node", "left_anti")
    leaves = only.join(small, "node", "left_semi")
    # Two leaves that only have each other: the smaller id stays.
    facing = leaves.join(leaves.select(F.col("node").alias("target"), F.col("target").alias("_back")), "target", "left")
    merged = facing.where("_back is null or (_back = node and node > target)").select("node", "target")
    stay = nodes.select("node").join(merged.select("node"), "node", "left_anti").select("node", F.col("node").alias("target"))
    return merged.unionByName(stay)


def keep_one_per_country(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cross-border merges (node, target) but never the last node of a country: the largest id of those that would all go stays.

    ``nodes`` has node, country. The order of giving way is by node id, which the rule leaves open otherwise.
    """
    going = merges.where("node <> target").join(nodes, "node")
    total = nodes.groupBy("country").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("country").orderBy("node")
    kept = going.join(total, "country").withColumn("_i", F.row_number().over(w)).withColumn("target", F.when(F.col("_i") < F.col("_n"), F.col("target")).otherwise(F.col("node")))
    return kept.select("node", "target").unionByName(merges.where("node = target"))


def collapse_dc(links: DataFrame, converters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point-to-point DC systems as one AC-AC link: (links of collapsible systems, component summary).

    ``links`` has link_id, a, b (DC nodes), p_nom, length; ``converters`` ac, dc, p_nom. A DC component with exactly two AC ends becomes
    one link between them: rated at the lesser of the two ends' converter sums (or the links' least where there are none), as long as
    its links together. Others are listed with their numbers of ends.
    """
    comp = components(links.select("a", "b").unionByName(converters.select(F.col("dc").alias("a"), F.col("dc").alias("b"))))
    ends = converters.join(comp.withColumnRenamed("node", "dc"), "dc").groupBy("component", "ac").agg(F.sum("p_nom").alias("_side"))
    sides = ends.groupBy("component").agg(F.count(F.lit(1)).alias("n_ac"), F.min("ac").alias("first"), F.max("ac").alias("second"), F.min("_side").alias("_least_side"))
    inner = links.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("n_links"), F.min("p_nom").alias("_least_link"), F.sum("length").alias("length"))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n_dc"))
    summary = size.join(sides, "component", "left").join(inner, "component", "left").fillna(0, ["n_ac", "n_links"])
    made = summary.where("n_ac = 2").select("component", "first", "second", F.least(F.coalesce("_least_side", "_least_link"), F.coalesce("_least_link", "_least_side")).alias("p_nom"), F.coalesce("length", F.lit(0.0)).alias("length"))
    return made, summary.select("component", "n_dc", "n_ac", "n_links")


def relabel(edges: DataFrame, mapping: DataFrame, a: str = "a", b: str = "b", drop_inner: bool = True) -> DataFrame:
    """Edges with their ends mapped (node, target); edges within one target drop out."""
    m = mapping.select("node", "target")
    out = edges.join(m.select(F.col("node").alias(a), F.col("target").alias("_ta")), a, "left").join(m.select(F.col("node").alias(b), F.col("target").alias("_tb")), b, "left")
    out = out.withColumns({a: F.coalesce("_ta", a), b: F.coalesce("_tb", b)}).drop("_ta", "_tb")
    return out.where(F.col(a) != F.col(b)) if drop_inner else out


def unused_nodes(nodes: DataFrame, *edge_tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Nodes that no edge of any table touches."""
    used = None
    for df, a, b in edge_tables:
        ends = df.select(F.explode(F.array(a, b)).alias("node"))
        used = ends if used is None else used.unionByName(ends)
    return nodes.join(used.distinct(), "node", "left_anti")


def topology_summary(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, n_nodes, n_edges, n_isolated, n_leaves, mean_degree) of each sub-network; ``nodes`` has node and the key."""
    d = nodes.join(degrees(edges), "node", "left").fillna(0, ["degree"])
    return d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.count(F.when(F.col("degree") == 0, 1)).alias("n_isolated"), F.count(F.when(F.col("degree") == 1, 1)).alias("n_leaves"), F.avg("degree").alias("mean_degree")
    )
