"""Connected components of an edge table: local union-find, then alternating stars until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import cut

_EDGE = "a bigint, b bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one Arrow batch of edges: (smaller root, node) for every node that is not a root."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(find(x), x) for x in list(parent)]
        pairs = [(r, x) for r, x in pairs if r != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"]
        )


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, both.a == low.u).where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    low = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    hung = edges.join(low, edges.b == low.u)
    return (
        hung.select(F.col("m").alias("a"), F.col("a").alias("b"))
        .union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        .where("a < b")
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has two bigint columns. Union-find shrinks each batch to a forest first; the stars then need a number of
    rounds that grows with the logarithm of the longest chain. Only a count and a checksum reach the driver. Minima are
    combined map-side and the joins can be split, so a node with very many neighbours does not gather in one task.
    """
    a, b = edges.columns
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    e = cut(e.mapInArrow(_forest, _EDGE).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        e = cut(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
