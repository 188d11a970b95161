"""Connected components of a table of links, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import in_arrow, written


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task to links (node, smallest node that the task's links lead to)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    for at in range(0, len(pairs), 50_000):
        u, v = zip(*pairs[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node with a link, from links (u, v): root is the smallest node reachable.

    Each round joins every node's neighbours to its smallest one, first the larger and then the
    smaller neighbours, and is written to the shared folder. It ends when a round changes nothing.
    """

    def digest(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()

    # a task's links fit in its memory: pairs of numbers of one partition
    now = written(in_arrow(links.select("u", "v"), union_find, "u long, v long").distinct(), "links")
    before = digest(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.*").filter(F.col("u") != F.col("v")).distinct(), "links")
        after = digest(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"no end after {max_rounds} rounds")
