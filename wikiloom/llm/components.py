"""Connected components by alternating large-star and small-star, and the work on groups in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import attach, stage, unstage


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, mark


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node that links reach.

    Each round is two grouped minima with map-side sums, attached to the edges without piling a hub onto one task, and is
    written to shared storage. Rounds grow with the logarithm of the longest path. Self-links are ignored.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).withColumn("least", F.least("a", "least"))
        large = stage(attach(both.filter("b > a"), near, "a", "n", 2 * mark[0]).select(F.col("b").alias("u"), F.col("least").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
        moved = attach(large, low, "u", "n", 2 * mark[0]).filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        new = stage(moved.unionByName(low.select("u", F.col("least").alias("v"))).distinct(), "edges")
        unstage(now)
        unstage(large)
        now, last = new, mark
        mark = _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(rows: DataFrame, blocks: Column, member: Column) -> DataFrame:
    """rows dealt so that each two members of a group meet in exactly one task: adds block_a, block_b and own.

    A group of `blocks` blocks takes blocks * (blocks + 1) / 2 tasks; its members are dealt by hash. own is the member's
    block. Pairs within one block belong to the task where block_a = block_b.
    """
    own = F.pmod(F.xxhash64(member), F.greatest(blocks, F.lit(1))).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.greatest(blocks, F.lit(1)) - 1).cast("int"))))
    return dealt.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other")).drop("other")


def each_group(rows: DataFrame, keys: list[str], partitions: int, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work() on each group of rows as one Arrow table; keys are integers. Many small groups share a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            k = [t.column(c).to_numpy() for c in keys]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            bounds = [0, *cut.tolist(), t.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                at = tuple(int(x[a]) for x in k)
                if held and at != last:
                    if (out := work(pa.concat_tables(held).combine_chunks())) is not None:
                        yield out
                    held = []
                held.append(t.slice(a, b - a))
                last = at
        if held and (out := work(pa.concat_tables(held).combine_chunks())) is not None:
            yield out

    return rows.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


class Forest:
    """Union-find over 0..n-1 for one group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b
