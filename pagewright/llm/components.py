"""Connected components: distributed union-find by alternating large-star and small-star steps, and up to SMALL edges one
task's union-find.

Each round reads and writes written tables only, so a lost executor costs one round at most. No step gathers a
node's neighbours: minima are partial aggregates, and the joins on hub nodes read two exchanges that adaptive
execution may split. As soon as SMALL edges or fewer are left, one task closes them: the rounds' many plans cost the
driver more than that task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch


#: edges up to which one task closes them
SMALL = 300_000


def find(root: dict, x: object) -> object:
    """The representative of x, by the forest root (node -> a node nearer to it)."""
    while (up := root.setdefault(x, x)) != x:
        root[x] = x = root.setdefault(up, up)
    return x


def _closed(e: DataFrame) -> DataFrame:
    """(node, component) of a few edges (u, v), in one task."""
    kind = e.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                p, q = find(root, u), find(root, v)
                if p != q:
                    root[max(p, q)] = min(p, q)  # the smallest node stands for all
        nodes = [x for x in root if root[x] != x]
        for k in range(0, len(nodes), 10_000):
            own = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, to) for x in (own, [find(root, y) for y in own])], ["node", "component"])

    to = pa.binary() if kind.simpleString() == "binary" else pa.int64()
    return e.coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, component {kind.simpleString()}")


def _digest(edges: DataFrame) -> tuple:
    """Count and two hashes of a set of edges: equal for equal sets, and for others with a chance of 2^-128."""
    one, two = F.xxhash64("u", "v"), F.xxhash64(F.lit(7), "v", "u")
    return tuple(edges.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(two)).first())


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (a long, b long) -> (node long, component long), component being the smallest node reachable.

    A row for each node but the smallest of its component. Null ends and loops are ignored, repeats allowed.
    An empty input gives an empty result.
    """
    e = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _digest(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        if before[0] <= SMALL:
            out = scratch.table(_closed(e))
            scratch.drop(e)
            return out
        # each half writes its minima, which leaves both sides of a join exchanges that adaptive execution splits
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = scratch.table(
            both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: every smaller neighbour of a node, and the node, are linked to the smallest of them
        lower = scratch.table(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")))
        star = large.join(lower, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.table(star.union(lower.select("n", "m")).distinct())
        scratch.drop(e, least, large, lower)
        e, now = after, _digest(after)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
