"""Connected components of a links table, without ever bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import drop_stash, stash


def connected_components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); the root is the component's smallest node.

    Alternating large-star and small-star rounds: every node hands its larger (then its smaller)
    neighbours to the smallest node around it. Minima are plain aggregates (combined before the
    shuffle), and stars are joined back, which a hot node's rows survive because a skewed join is split.
    Each round is written to the shared folder, so the lineage stays short. Null nodes are ignored.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = stash(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _mark(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large = _star(edges, larger=True)
        after_large = stash(large, "large-star")
        drop_stash(edges)
        edges = stash(_star(after_large, larger=False), "small-star")
        drop_stash(after_large)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free sum over them; equal when a round changed nothing."""
    part = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    row = edges.agg(F.count("*").alias("n"), F.sum(part.cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round over links (u, v) with u > v."""
    if larger:  # each node links all its larger neighbours to the smallest node around it
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # each node links its smaller neighbours and itself to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()
