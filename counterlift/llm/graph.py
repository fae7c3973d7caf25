"""Connected components as DataFrame rounds, and groups dealt to tasks in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlift.session import cut_lineage


def _pairs(df: DataFrame, u: Column, v: Column) -> DataFrame:
    return df.select(u.alias("u"), v.alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Alternates large-star and small-star steps until the edge set stands still, which takes a
    number of rounds that grows with the logarithm of the longest path. Each round is written
    to the shared folder. Nodes are longs; edges with a null end or two equal ends count for nothing.
    """
    ends = edges.filter(F.col(a) != F.col(b))
    now = cut_lineage(_pairs(ends, F.greatest(a, b), F.least(a, b)).distinct())
    seen = _fingerprint(now)
    while seen[0]:
        both = _pairs(now, F.col("u"), F.col("v")).union(_pairs(now, F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _pairs(both.join(low, "u").filter(F.col("v") > F.col("u")), F.col("v"), F.col("m")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").filter(F.col("v") != F.col("m"))
        small = _pairs(joined, F.col("v"), F.col("m")).union(_pairs(least, F.col("u"), F.col("m")))
        now = cut_lineage(small.distinct())
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def block_plan(rows: DataFrame, key: str, weight: Column, most_rows: int, most_weight: int) -> DataFrame:
    """(key, n_blocks) of the groups too large for one block, found with pre-aggregation."""
    total = rows.groupBy(key).agg(F.count("*").alias("_c"), F.sum(weight).alias("_w"))
    need = F.greatest(F.ceil(F.col("_c") / most_rows), F.ceil(F.col("_w") / most_weight)).cast("int")
    return total.select(key, need.alias("n_blocks")).filter("n_blocks > 1")


def with_part(rows: DataFrame, plan: DataFrame, key: str, node: str) -> DataFrame:
    """Adds n_blocks and the row's own block ``part``."""
    joined = rows.join(plan, key, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    return own_part(joined, node)


def own_part(rows: DataFrame, node: str) -> DataFrame:
    """Adds the row's own block ``part`` among its group's n_blocks."""
    return rows.withColumn("part", F.pmod(F.xxhash64(node), F.col("n_blocks").cast("long")).cast("int"))


def meet_blocks(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """Every two blocks of a group meet in one (key, bi, bj); rows arrive grouped by it.

    A row is repeated once per block of its group, so a task never holds more than two blocks.
    """
    other = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    meet = F.transform(other, lambda j: F.struct(F.least("part", j).alias("bi"), F.greatest("part", j).alias("bj")))
    dealt = rows.withColumn("_m", F.explode(meet)).select("*", "_m.bi", "_m.bj").drop("_m", "n_blocks")
    return dealt.repartition(partitions, key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str], limit: int = 20000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the groups' bounds, from batches sorted by ``keys``.

    Holds the groups of one batch and the one that runs on into the next.
    """
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, limit):
            piece = batch.slice(lo, limit)
            table = pa.Table.from_batches([*carry, piece]).combine_chunks()
            bounds = _bounds(table, keys)
            last = int(bounds[-2])
            if last:
                yield table.slice(0, last), bounds[:-1]
            carry = table.slice(last).to_batches()
    if carry:
        table = pa.Table.from_batches(carry).combine_chunks()
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def pair_indices(bounds: np.ndarray, limit: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j inside the groups, some at a time."""
    n = int(bounds[-1])
    group_end = np.repeat(bounds[1:], np.diff(bounds))
    follow = group_end - np.arange(n) - 1
    total = np.concatenate(([0], np.cumsum(follow)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        left = np.repeat(np.arange(lo, hi), follow[lo:hi])
        right = left + 1 + np.arange(len(left)) - (total[left] - total[lo])
        if len(left):
            yield left, right
        lo = hi


class Forest:
    """Union-find over the nodes seen by one task's chunk; its edges are stars to the smallest node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            for x, y in both.tolist():
                self.join(x, y)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = [x for x in self.parent if self.find(x) != x]
        return np.array(nodes, np.int64), np.array([self.find(x) for x in nodes], np.int64)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = 1_000_000) -> DataFrame:
    """Join that broadcasts ``small`` only while it has at most ``limit`` rows (about 100 MB)."""
    rows = small.count()
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)
