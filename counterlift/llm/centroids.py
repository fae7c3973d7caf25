"""Centroid clustering (Lloyd's rounds) in integer arithmetic with JVM expressions only.

A vector is an array column. ``zip_with`` and ``aggregate`` give its squared distance to every
literal centroid array, ``array_min`` over (distance, number) structs picks the cluster, and one
hash aggregate with a sum per component moves the centroids. Only the centroids, ``k`` rows of
``dim`` sums, come to the driver between rounds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.llm.registry import query, table
from counterlift.session import cut_lineage

SCALE = 256
LIMIT = 1 << 27  # components are held to +-LIMIT, so that 64 squared differences fit a long


def grid_vectors(vectors: DataFrame, dim: int = 64, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as longs, of the vectors with ``dim`` finite components.

    Null vectors, other lengths and vectors with a null, NaN or infinite component are left out.
    Components beyond +-LIMIT (an x beyond +-524,288) count as +-LIMIT.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # nested calls instead of a chain of ANDs: the lambda must not see a null array
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(F.size("embedding") == dim).filter(finite)
    held = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))
    return kept.select("vec_id", held.alias("v"))


def starting_centroids(grid: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Components of the ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order.

    Rows with equal vec_id go by their components; rows without vec_id never start a cluster.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = grid.filter("vec_id IS NOT NULL").select(order.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r.v) for r in first.collect()]


def literal(centroids: list[list[int]]) -> Column:
    """Array of arrays of longs, as one constant: thousands of single literals would each be a call into the JVM."""
    return F.expr(f"array({', '.join('array(' + ', '.join(f'{x}L' for x in c) + ')' for c in centroids)})")


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number wins a tie."""
    def measured(c: Column, i: Column) -> Column:
        squares = F.zip_with(v, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"), i.alias("cluster"))

    return F.array_min(F.transform(literal(centroids), measured))


def moved(grid: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids replaced by floor(sum / count) of their vectors; one without vectors stays."""
    dim = len(centroids[0])
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]
    placed = grid.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    out = [list(c) for c in centroids]
    for row in placed.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # at most k rows
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(dim)]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid of every vector kept by ``grid_vectors``.

    Runs ``rounds`` rounds and assigns once more. With fewer than ``k`` vectors that have an id there
    are as many clusters as those; with none, or with an empty table, the result is empty. Rows that
    repeat are rows of their own, a null vec_id is clustered as any other, columns besides vec_id
    and embedding are ignored. A sum of distances beyond a long is null.
    """
    spark = vectors.sparkSession
    grid = cut_lineage(grid_vectors(vectors, dim, scale))
    centroids = starting_centroids(grid, k, seed)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not centroids:
        return spark.createDataFrame([], shape)
    for _ in range(rounds):
        centroids = moved(grid, centroids)
    best = nearest(F.col("v"), centroids)
    placed = cut_lineage(grid.select("vec_id", best.alias("b")).select("vec_id", "b.cluster", "b.distance"))
    sums = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # at most k rows
    total = None if None in sums.values() else sum(sums.values())
    by_cluster = F.array(*[F.lit(sums.get(i)).cast("long") for i in range(len(centroids))])
    return placed.select(
        "vec_id", "cluster", "distance", F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(total if total is not None and total < 1 << 63 else None).cast("long").alias("inertia"),
        F.get(literal(centroids), F.col("cluster")).alias("centroid"),
    )


def _oracle(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    near = (
        "SELECT vec_id, v, arg_min(i, (d, i)) AS i, min(d) AS d FROM ("
        "SELECT g.vec_id, g.v, c.i, CAST(list_sum(list_transform(list_zip(g.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d "
        "FROM g CROSS JOIN {c} c) GROUP BY vec_id, v"
    )
    steps = [
        f"g AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS i, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM g ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        if r < rounds:
            sums = ", ".join(f"CAST((sum(v[{j}]) - ((sum(v[{j}]) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT)" for j in range(1, dim + 1))
            steps.append(f"m{r} AS (SELECT i, [{sums}] AS c FROM a{r} GROUP BY i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.i, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.i = o.i)")
    return (
        f"WITH {', '.join(steps)} SELECT a.vec_id, a.i AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.i = a.i"
    )


def centroid_digest(centroid: list[int]) -> str:
    """What ``centroid_sha256`` holds: the hash of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


@query("op11_centroids", _oracle())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")
