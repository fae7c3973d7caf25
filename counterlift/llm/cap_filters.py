"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

The rotated unit sphere is cut into two halves of the coordinates; each half has its own
random codebook, and every pair of codewords is one filter direction. A vector is decoded to
all directions whose inner product exceeds a threshold: both halves' products are sorted, so
the list is read off without scanning all pairs. The codebooks grow with the square root of
the rows, so that a filter's list stays short. Vectors that share a filter are compared by a sign
sketch inside the task; each distinct pair that passes is verified once by its exact
double-precision cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm import graph
from counterlift.llm.registry import query, table
from counterlift.session import cut_lineage

LEAST_CODEWORDS = 128  # of each half: 16,384 filter directions
TABLES = 3  # independent rotations and codebooks: a vector with few directions in one has more in another
MEAN_FILTERS = 12.0  # directions of a table that a random vector exceeds, on average
MEAN_LIST = 32.0  # vectors that exceed a direction, on average, beyond which the codebooks grow
SLACK = 0.02  # below its best product, for a vector that exceeds no direction
SKETCH_BITS = 128
SKETCH_RADIUS = 32  # a pair at cosine 0.95 differs in 13 +- 3.4 bits, unrelated ones in 64 +- 5.7
BLOCK_ROWS = 256


def codewords(rows: int) -> int:
    """Codewords of each half for so many vectors: MEAN_LIST vectors per direction at most, on average."""
    return max(LEAST_CODEWORDS, math.ceil(math.sqrt(rows * MEAN_FILTERS / MEAN_LIST)))


@lru_cache(maxsize=8)
def codes(dim: int, words: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """Rotation, both codebooks, threshold and sketch directions for ``dim`` coordinates.

    The threshold is that at which random vectors exceed MEAN_FILTERS directions on average.
    """
    rng = np.random.default_rng((dim, table))
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = (dim + 1) // 2
    books = []
    for size in (half, max(1, dim - half)):
        c = rng.standard_normal((words, size))
        books.append(np.unique(c / np.linalg.norm(c, axis=1, keepdims=True), axis=0))  # one coordinate has two codewords
    probe = rng.standard_normal((50, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    first, second = _products(probe @ rotation, *books)
    second = np.sort(second, axis=1)
    low, high = -2.0, 2.0
    for _ in range(40):
        middle = (low + high) / 2
        exceeded = sum(len(b) * len(a) - np.searchsorted(b, middle - a).sum() for a, b in zip(first, second, strict=True))
        low, high = (middle, high) if exceeded > MEAN_FILTERS * len(probe) else (low, middle)
    return rotation, books[0], books[1], high, rng.standard_normal((dim, SKETCH_BITS))


def _products(x: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = one.shape[1]
    rest = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))
    return x[:, :half] @ one.T, rest @ two.T


def decode(unit: np.ndarray, words: int, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter direction of a table that each unit vector exceeds.

    A vector that exceeds none, as one whose weight lies in one half may, has those close to its best.
    """
    rotation, one, two, threshold, _ = codes(unit.shape[1], words, table)
    a, b = _products(unit @ rotation, one, two)
    best = np.argsort(-b, axis=1)
    sorted_b = np.take_along_axis(b, best, 1)
    least = np.minimum(threshold, a.max(1) + sorted_b[:, 0] - SLACK)
    alive = a + sorted_b[:, :1] >= least[:, None]  # codewords that reach it with the best partner
    row, i = np.nonzero(alive)
    reach = (sorted_b[row] >= (least[row] - a[row, i])[:, None]).sum(1)
    out = np.repeat(np.arange(len(row)), reach)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(reach) - reach, reach)
    return row[out], i[out] * words + best[row[out], nth]


def _units(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) by number of coordinates."""
    col = batch.column("embedding")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values, offs = col.values.to_numpy(zero_copy_only=False).astype(np.float64), col.offsets.to_numpy()
    size = np.diff(offs)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = values[offs[at][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


_ENTRY = pa.schema([("filter", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])


def _decoded(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 256_000 // words)  # vectors at once: each has a product with every codeword
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                batch = pa.RecordBatch.from_pylist(batch.to_pylist(), schema=batch.schema)
                node = batch.column("node").to_numpy()
                for at, unit in _units(batch):
                    d = unit.shape[1]
                    sketch = [b.tobytes() for b in np.packbits(unit @ codes(d, words, 0)[4] > 0, axis=1)]
                    found = [decode(unit, words, t) for t in range(TABLES)]
                    row = np.concatenate([r for r, _ in found])
                    key = np.concatenate([f + (d * TABLES + t) * words * words for t, (_, f) in enumerate(found)])
                    yield pa.record_batch([pa.array(key, pa.int64()), pa.array(node[at[row]]), pa.array([sketch[r] for r in row.tolist()], pa.binary())], schema=_ENTRY)

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a < b of a filter whose sketches are close, each once per batch of filters."""
    for t, bounds in graph.runs(batches, ["filter", "bi", "bj"]):
        node, part = t.column("node").to_numpy(), t.column("part").to_numpy()
        cross = t.column("bi").to_numpy() != t.column("bj").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        for i, j in graph.pair_indices(bounds):
            ok = ~cross[i] | (part[i] != part[j])
            ok &= np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= SKETCH_RADIUS
            a, b = node[i[ok]], node[j[ok]]
            if len(a):
                both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
                yield graph.edge_batch(both[:, 0].copy(), both[:, 1].copy())


def _cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (F.col(f"{a}_norm") * F.col(f"{b}_norm"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Rows link when the cosine of their embeddings, in double precision, is at least ``least``;
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable.
    Equal embeddings are one node while searching and count as links of each other. Null, empty
    and zero vectors and vectors with a null or non-finite component link with nothing; so do
    vectors of different lengths, and rows without vec_id (their component and kept are null).
    Rows that repeat are rows of their own. Other columns are ignored.

    Filters find nearly all pairs, not provably all: tests measure the recall against brute force.
    """
    n_parts = graph.partitions_of(vectors)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    usable &= F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    keyed = v.withColumn("key", F.when(usable, F.struct(F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"))))
    ids = keyed.select("vec_id", "key")
    heads = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
    heads = cut_lineage(heads)
    scale = F.array_max(F.transform("embedding", F.abs))  # so that squares neither overflow nor vanish
    vector = F.transform("embedding", lambda x: x / scale)
    nodes = cut_lineage(v.join(heads.select(F.col("node").alias("vec_id"), "key", "size"), "vec_id").filter(
        (F.xxhash64("embedding") == F.col("key.h")) & (F.hash("embedding") == F.col("key.g"))
    ).select(F.col("vec_id").alias("node"), "size", "embedding", vector.alias("v")).dropDuplicates(["node"]))
    words = codewords(nodes.count())
    entries = cut_lineage(nodes.select("node", "embedding").mapInArrow(_decoded(words), "filter long, node long, sketch binary"))
    plan = graph.block_plan(entries, "filter", F.lit(1), BLOCK_ROWS, BLOCK_ROWS)
    dealt = graph.meet_blocks(graph.with_part(entries, plan, "filter", "node"), "filter", n_parts)
    pairs = cut_lineage(dealt.mapInArrow(_near, "a long, b long").distinct())
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    sides = [nodes.select(F.col("node").alias(c), F.col("v").alias(f"v{c}"), norm.alias(f"v{c}_norm"), F.col("size").alias(f"size_{c}")) for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").filter(F.size("va") == F.size("vb"))
    found = cut_lineage(met.filter(_cosine("va", "vb") >= least).select("a", "b", "size_a", "size_b"))
    final = graph.connected_components(found)
    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("size_b").alias("n")), F.struct(F.col("b").alias("node"), F.col("size_a").alias("n")))).alias("e"))
    linked = ends.groupBy("e.node").agg(F.sum("e.n").alias("links"))
    by_key = (
        heads.join(linked, "node", "left").join(final, "node", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    return ids.join(by_key, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


_ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id
), m AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, t.vec_id = m.component_id AS kept
FROM embeddings t JOIN m ON m.vec_id = t.vec_id LEFT JOIN n ON n.a = t.vec_id
"""


@query("op4_cap_filters", _ORACLE)
def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
