"""Centroid clustering by sort-means (operator 12).

Each round puts the other centroids in order of their distance from each centroid. A vector starts at the centroid
that it had and walks along that centroid's list; it stops at the first one that is strictly farther from its own
centroid than twice the vector is, as none from there on can be nearer or as near. Distances are integers; equally
near centroids go to the smaller number.

Spark holds the vectors: every round reads a staged table, writes the assigned one and adds up the vectors of each
centroid; the driver sees centroids and sums alone, ``clusters`` rows of a vector's length.

Defined results: only vectors of exactly ``dimensions`` components, none null, NaN or infinite, take part. Repeated
rows count each. Of equal ``vec_id``, which have equal hashes, the smaller vector is first; a null ``vec_id`` hashes as
an empty string. With fewer vectors than clusters there are fewer centroids. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, stage
from .lattice import finite, floor_means, lattice, rows_of, squares

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3:"


def walk(points: np.ndarray, centroids: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the centroid nearest to each point, walking from ``previous``."""
    k = len(centroids)
    between = squares(centroids[:, None], centroids[None])
    order = np.argsort(between, axis=1, kind="stable")
    start = squares(points, centroids[previous])
    best = start * k + previous  # ordered by distance, then by number
    walking = np.arange(len(points))
    for step in range(k):
        other = order[previous[walking], step]
        on = between[previous[walking], other] <= 4 * start[walking]  # twice the distance, in squares
        walking, other = walking[on], other[on]
        best[walking] = np.minimum(best[walking], squares(points[walking], centroids[other]) * k + other)
    return best % k, best // k


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (vec_id, v, cluster) with their nearest centroid and ``distance``, searched from the one they had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                previous = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                cluster, distance = walk(rows_of(batch.column("v")), centroids, previous)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<int>, cluster int, distance bigint")


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as the floored means of their vectors; empty ones stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
                np.add.at(sums, cluster, rows_of(batch.column("v")))
                counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), i)), pa.array(sums[used, i]), pa.array(counts[used])], names=["cluster", "place", "s", "n"])

    partial = assigned.select("v", "cluster").mapInArrow(run, "cluster bigint, place bigint, s bigint, n bigint")
    sums, counts = np.zeros((k, width), np.int64), np.zeros((k, width), np.int64)
    for r in partial.groupBy("cluster", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # a row for each component of a centroid
        sums[r["cluster"], r["place"]], counts[r["cluster"], r["place"]] = r["s"], r["n"]
    return floor_means(sums, counts, centroids)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of rows (vec_id, embedding), as a staged table."""
    kept = vectors.where(finite(F.col("embedding")) & (F.size("embedding") == dimensions)).select("vec_id", lattice(F.col("embedding"), scale).alias("v"))
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["v"] for r in kept.orderBy(drawn, "v").select("v").limit(clusters).collect()], np.int64).reshape(-1, dimensions)
    assigned = kept.withColumn("cluster", F.lit(0))
    for _ in range(rounds):
        before, assigned = assigned, stage(assign(assigned, centroids), "clusters")
        discard(before)
        centroids = moved(assigned, centroids)
    before, assigned = assigned, stage(assign(assigned, centroids), "clusters")
    discard(before)
    return assigned.select("vec_id", "cluster", "distance"), centroids


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(read_table(spark, sf_dir, "embeddings"))
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    inertia = sum(r["cluster_inertia"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(r["cluster"], r["cluster_inertia"], inertia, digests[r["cluster"]]) for r in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same by all distances, a round after the other."""
    text = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), spread AS MATERIALIZED (SELECT vec_id, i, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)
), c0 AS MATERIALIZED (SELECT i, e, x AS c FROM spread JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS e FROM kept ORDER BY e LIMIT {CLUSTERS}) USING (vec_id))"""
    for r in range(ROUNDS + 1):
        text += f""", near{r} AS MATERIALIZED (
  SELECT vec_id, min(d * {CLUSTERS} + e)::bigint AS k FROM (SELECT s.vec_id, b.e, sum((s.x - b.c) * (s.x - b.c)) AS d FROM spread s JOIN c{r} b USING (i) GROUP BY ALL) GROUP BY vec_id
), mean{r} AS (SELECT s.i, n.k % {CLUSTERS} AS e, floor(sum(s.x) / count(*)::double)::bigint AS m FROM spread s JOIN near{r} n USING (vec_id) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (SELECT b.i, b.e, coalesce(m.m, b.c) AS c FROM c{r} b LEFT JOIN mean{r} m ON m.i = b.i AND m.e = b.e)"""
    return text + f""", named AS (SELECT e, sha256(string_agg(c::varchar, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY e
), found AS (SELECT vec_id, (k % {CLUSTERS})::int AS cluster, k // {CLUSTERS} AS distance FROM near{ROUNDS})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::bigint AS cluster_inertia, sum(distance) OVER ()::bigint AS inertia, centroid_sha256
FROM found JOIN named ON named.e = found.cluster"""


OP12_SQL = _sql()
