"""Mixing sources to target weights.

Documents of each source are encoded and packed into blocks of a fixed number of tokens. The size of the mix is the largest at which
every source can give its target share without any document being used more often than its cap. Each output shard draws its source
counts from the multinomial distribution of the shares. The draws of all shards miss the exact totals a little: what a source drew
too much is taken from pseudorandom slots all over its shards and given to the sources that drew too little. Within a source, slot
numbers run through pseudorandom permutations of its blocks, a new one each time round, so that a block is used once before any is
used again. Blocks are joined by their index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import prefix_sum
from ..session import materialise
from .tokenize import encode_texts

#: Shards are numbered in runs of this many, so that no source's shards are numbered by one task.
SHARDS_PER_RUN = 20_000
#: Sources beyond this are refused: shares are worked out on the driver.
MAX_SOURCES = 10_000


def permute(index: np.ndarray, size: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1 for each (size, key), evaluated at ``index``: a four-round Feistel network on the
    next power of four, walked until it falls inside."""
    x = np.asarray(index, dtype=np.uint64).copy()
    size = np.broadcast_to(np.asarray(size, dtype=np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, dtype=np.uint64), x.shape)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size.astype(float), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(x.shape, dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> half[todo], x[todo] & mask[todo]
            for r in range(4):
                h = (right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(32)
                left, right = right, left ^ (h & mask[todo])
            x[todo] = (left << half[todo]) | right
            todo = x >= size
    return x.astype(np.int64)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc id, source, ids) with the task, and the tokens its earlier documents of the source have; empty ones left out."""
    part, before = TaskContext.get().partitionId(), {}
    for batch in batches:
        n = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
        sources, of = np.unique(batch.column(1).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        order = np.argsort(of, kind="stable")
        run = np.cumsum(n[order]) - n[order]
        first = np.searchsorted(of[order], np.arange(len(sources)))
        inside = np.empty_like(n)
        inside[order] = run - run[first][of[order]] + np.array([before.get(s, 0) for s in sources], dtype=np.int64)[of[order]]
        for s, total in zip(sources, np.bincount(of, weights=n, minlength=len(sources))):
            before[s] = before.get(s, 0) + int(total)
        some = pa.array(n > 0)
        cols = [batch.column(1), batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(inside), pa.array(n), batch.column(2)]
        yield pa.RecordBatch.from_arrays(cols, names=["source", "doc", "part", "inside", "n_tokens", "ids"]).filter(some)


def encoded_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", **encoding) -> DataFrame:
    """(source, doc_id, part, inside, n_tokens, ids) of documents of the target sources that have tokens, written once.

    ``part`` is the task that encoded a document, ``inside`` its first token's place among the source's tokens of that task.
    """
    named = targets.select("source").where("source is not null").distinct()
    wanted = docs.select(F.col(doc_id).alias("doc"), "source", "text").join(named, "source", "left_semi")
    kind = docs.schema[doc_id].dataType.simpleString()
    coded = encode_texts(wanted, ["doc", "source"], then=(_placed, f"source string, doc {kind}, part int, inside long, n_tokens long, ids array<int>"), **encoding)
    return materialise(coded.withColumnRenamed("doc", doc_id), "tokens")


def pack(coded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(source, doc_id, start, n_tokens, ids): ``start`` is the place of the document's first token in its source.

    The tasks' totals of a source are summed in order of the tasks; documents only look theirs up, so no token list moves.
    """
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = coded.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).select("source", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # Written, its size is known when the join is planned: the optimizer sends it to the tasks if it is small, and no document moves.
    totals = materialise(totals, "totals")
    return coded.join(totals, ["source", "part"]).select("source", doc_id, (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids")


def mix_plan(coded: DataFrame, targets: DataFrame, block: int, size_tokens: int | None = None) -> pd.DataFrame:
    """One row per source of the targets: tokens and blocks there are, share wanted, share among the sources that have documents, and
    the blocks the mix takes (``slots``). The largest mix that no cap forbids, or the one of ``size_tokens`` if that is smaller.

    Slots are apportioned by largest remainders, ties to the first name. Runs on one row per source.
    """
    want = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).toPandas()
    if len(want) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = coded.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).toPandas()
    plan = want.merge(have, on="source", how="left").fillna({"tokens": 0, "documents": 0, "target_share": 0.0, "max_repeats": 0}).sort_values("source", ignore_index=True)
    plan[["tokens", "documents", "max_repeats"]] = plan[["tokens", "documents", "max_repeats"]].astype("int64")
    plan["blocks"] = -(-plan["tokens"] // block)
    usable = (plan["tokens"] > 0) & (plan["max_repeats"] > 0) & (plan["target_share"] > 0)
    total = plan.loc[usable, "target_share"].sum()
    plan["mix_share"] = np.where(usable, plan["target_share"] / (total or 1.0), 0.0)
    if not usable.any():
        plan["slots"] = 0
        return plan
    whole = plan["tokens"] // block * plan["max_repeats"]  # full blocks only, so that a short last block can't bend the shares
    room = np.where(whole > 0, whole, plan["blocks"] * plan["max_repeats"])
    most = int(np.floor((room[usable] / plan.loc[usable, "mix_share"]).min()))
    slots = max(1, min(most, size_tokens // block if size_tokens is not None else most))
    exact = plan["mix_share"] * slots
    floor = np.floor(exact).astype("int64")
    order = np.lexsort((plan["source"], -(exact - floor)))
    give = np.zeros(len(plan), dtype="int64")
    give[order[: slots - int(floor.sum())]] = 1
    plan["slots"] = np.minimum(floor + give, plan["blocks"] * plan["max_repeats"])
    return plan


def draw_counts(spark, plan: pd.DataFrame, per_shard: int, seed: int = 42) -> DataFrame:
    """(shard, k, n, at): how many slots of each shard the k-th source of the plan drew, and where they begin among the shard's slots."""
    total = int(plan["slots"].sum())
    share = plan["slots"].to_numpy() / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shards = b["id"].to_numpy()
            n = np.stack([np.random.default_rng([seed, int(t)]).multinomial(min(per_shard, total - int(t) * per_shard), share) for t in shards])
            at = np.cumsum(n, axis=1) - n
            s, k = np.nonzero(n)
            yield pd.DataFrame({"shard": shards[s], "k": k.astype(np.int32), "n": n[s, k], "at": at[s, k]})

    return spark.range(-(-total // per_shard)).mapInPandas(draw, "shard long, k int, n long, at long")


def draw_slots(spark, plan: pd.DataFrame, per_shard: int, seed: int = 42) -> DataFrame:
    """(shard, slot, source, block, turn): which block of which source stands at each slot of each shard.

    Slots are numbered per source over all shards, and those numbers permuted: the first ``slots`` of them are the source's own, the
    others surplus. Surplus slots of all sources, permuted again, make up what other sources lack, whose numbers go on from what they
    drew. So every source has each number from 0 to ``slots`` exactly once.
    """
    schema = "shard long, slot long, source string, block long, turn long"
    total = int(plan["slots"].sum())
    if total == 0:
        return spark.createDataFrame([], schema)
    counts = materialise(draw_counts(spark, plan, per_shard, seed), "draws")
    drawn = np.zeros(len(plan), dtype=np.int64)
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():
        drawn[r["k"]] = r["n"]
    wanted, full, names = plan["slots"].to_numpy(), plan["blocks"].to_numpy(), plan["source"].to_numpy(object)
    surplus, lack = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    surplus_at, lack_end = np.cumsum(surplus) - surplus, np.cumsum(lack)
    placed = prefix_sum(counts.withColumn("run", F.floor(F.col("shard") / SHARDS_PER_RUN)), ["k"], "run", [F.col("shard")], "n", "first").select("shard", "k", "n", "at", "first")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = max(1, 2_000_000 // per_shard)
            for part in (b.iloc[i : i + step] for i in range(0, len(b), step)):
                n = part["n"].to_numpy()
                shard, k = np.repeat(part["shard"].to_numpy(), n), np.repeat(part["k"].to_numpy(), n)
                nth = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                slot = permute(np.repeat(part["at"].to_numpy(), n) + nth, np.minimum(per_shard, total - shard * per_shard), seed + 1 + shard)
                rank = permute(np.repeat(part["first"].to_numpy(), n) + nth, drawn[k], seed - 1 - k)
                over = np.flatnonzero(rank >= wanted[k])
                if len(over):
                    g = permute(surplus_at[k[over]] + rank[over] - wanted[k[over]], int(surplus.sum()), seed)
                    to = np.searchsorted(lack_end, g, side="right").astype(k.dtype)
                    rank[over] = drawn[to] + g - (lack_end - lack)[to]
                    k[over] = to
                turn = rank // full[k]
                yield pd.DataFrame({"shard": shard, "slot": slot, "source": names[k], "block": permute(rank % full[k], full[k], seed + 1 + turn * len(names) + k), "turn": turn})

    return placed.mapInPandas(fill, schema)


def blocks_of(packed: DataFrame, block: int, doc_id: str = "doc_id") -> DataFrame:
    """(source, block, n_tokens, ids, doc_ids): the packed blocks. A document longer than a block is spread over several."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    cut = packed.select("source", doc_id, "start", "n_tokens", "ids", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    hi = F.least(F.col("n_tokens"), (F.col("block") + 1) * block - F.col("start"))
    piece = cut.select("source", "block", F.struct((F.col("start") + lo).alias("at"), F.col(doc_id).alias("doc"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("ids")).alias("piece"))
    made = piece.groupBy("source", "block").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return made.select("source", "block", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.array_distinct(F.transform("p", lambda x: x["doc"])).alias("doc_ids")).withColumn("n_tokens", F.size("ids"))


def mix(docs: DataFrame, targets: DataFrame, block: int = 256, per_shard: int = 1024, size_tokens: int | None = None, seed: int = 42, doc_id: str = "doc_id", **encoding) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, source, block, turn, n_tokens, ids, doc_ids) and its report, one row per source of the targets.

    A document is used at most ``max_repeats`` times: each of its blocks once a turn, and no more turns than that. Sources without
    documents can't give their share; the others' shares keep their proportions, and the report shows target, mixed and reached
    shares, tokens, blocks, and turns. Documents of other or null sources and those without tokens take no part.
    """
    coded = encoded_sources(docs, targets, doc_id, **encoding)
    plan = mix_plan(coded, targets, block, size_tokens)
    spark = docs.sparkSession
    slots = draw_slots(spark, plan, per_shard, seed)
    mixed = slots.join(blocks_of(pack(coded, doc_id), block, doc_id), ["source", "block"]).select("shard", "slot", "source", "block", "turn", "n_tokens", "ids", "doc_ids")
    # Tokens of a slot are known without building blocks: all are full but the last of a source.
    facts = spark.createDataFrame(plan[["source", "target_share", "mix_share", "max_repeats", "documents", "tokens", "blocks"]])
    used = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    tail = F.col("tokens") - (F.col("blocks") - 1) * block
    used = used.join(facts.select("source", "tokens", "blocks"), "source").withColumn("n", F.col("times") * F.when(F.col("block") == F.col("blocks") - 1, tail).otherwise(F.lit(block)))
    used = used.groupBy("source").agg(F.sum("n").alias("mixed_tokens"), F.sum("times").alias("mixed_blocks"), F.max("times").alias("most_uses"))
    report = facts.join(used, "source", "left").fillna(0, ["mixed_tokens", "mixed_blocks", "most_uses"])
    all_ = Window.partitionBy()
    report = report.withColumn("reached_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(all_).cast("double")), F.lit(0.0)))
    return mixed, report
