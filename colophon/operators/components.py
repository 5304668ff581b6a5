"""Connected components: contraction inside partitions, then large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release

MAX_ROUNDS = 60
# Nodes that a task holds at once while it contracts its part of the edges.
CONTRACT_NODES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition -> (node, smallest node it reaches here). Connectivity is kept, whatever lies together."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = root(u), root(v)
            low, high = (x, y) if x < y else (y, x)
            parent.setdefault(low, low)
            parent[high] = low
        if len(parent) > CONTRACT_NODES:
            yield stars()
            parent.clear()
    yield stars()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge (bigint); component is the smallest node id in it.

    The edges of one smaller end come together once and are contracted there, so most components are stars before the
    first round. A round is two aggregations and two sort-merge joins (nothing passes through the driver); what a
    node sees is reduced to a minimum by partial aggregation, so no neighbourhood is ever collected. Lineage is cut with a
    reliable checkpoint per round, and the round before is removed. Self-loops keep isolated nodes; NULL ends are ignored."""
    x = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    x = cut(x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = cut(x.where("u <> v").repartition("v").mapInArrow(_contract, "u bigint, v bigint").distinct())
    state = lambda d: d.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.hint("merge").join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, e = e, cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(before)
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    # in a star every node has one edge, to the smallest
    member = x.select(F.col("u").alias("node")).unionByName(x.select(F.col("v").alias("node"))).distinct()
    return member.hint("merge").join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
