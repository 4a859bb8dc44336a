"""Operator 13: centroid clustering with bounds that are loosened by less than the centroids' drift.

Vectors become whole numbers, floor(1024 * x). In every round each vector goes to its nearest centroid (ties: smaller
number) and each centroid that has vectors moves to the floor of their exact mean.

Each vector carries its cluster, an upper bound on the distance to that cluster's centroid and a lower bound on the distance
to all others. When centroids move, the upper bound grows by the own centroid's drift. For the lower bound a cluster is
seen as a sphere: its old centroid with the largest upper bound of its vectors as radius. Let another centroid move
from a to b, with midpoint m. For any point x, |x - a| - |x - b| <= |b - a| * cos(angle at m between x and b), since
the point's two distances sum to at least 2 |x - m|. The sphere's centre c, a and b span a plane; seen from m the
sphere covers an angle of asin(radius / |c - m|) on both sides of c, so no vector of the cluster comes nearer to that
centroid by more than |b - a| * cos(angle of c - that angle) - much less than the drift where the centroid moves sideways
or away, and nothing where the whole sphere lies behind it. The largest such value over the other centroids loosens
the cluster's lower bound.

Where the upper bound stays strictly below the lower bound (or below half the distance from the own centroid to the next
one) the vector keeps its cluster. Otherwise its own distance is computed exactly, and if that does not settle it, all centroids
are scanned with exact 64-bit squared distances. All bounds are rounded to the safe side, so the result is that of full scans.

On Spark: each round is one narrow pass that reads the vectors with their bounds and writes them again with the new ones; each task
adds one row per cluster (count, component sums, radius), which an aggregation sums. Only the centroids and these sums, a fixed
number, reach the driver. No vector is shuffled, and the table of the round before is deleted, so two copies exist at most.

Defined cases: rows whose vector is null, has null or non-finite components, components of 2**16 or more in size, or another
number of components than ``dim`` are left out. A null vec_id counts as empty text in the hash; rows that repeat a vec_id
or a vector are vectors of their own (equal hashes: by vector). With fewer vectors than clusters there are as many clusters as
vectors; an empty table gives no rows. Inertia is null where it leaves 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common, vectors

DIM, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3

_STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, n long, scanned long, sums array<long>"


@dataclass(frozen=True)
class Move:
    """What a round's move does to the bounds of each cluster's vectors."""

    drift: np.ndarray
    loosen: np.ndarray
    half: np.ndarray


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """At most so much nearer does a centroid that moves from old to new come to any point of the sphere."""
    step = (new - old).astype(np.float64)
    drift = float(np.sqrt((step * step).sum()))
    if drift == 0:
        return 0.0
    away = centre - (old + new) / 2
    distance = float(np.sqrt((away * away).sum()))
    safe = drift * (1 + 1e-9)
    if distance <= radius * (1 + 1e-9):
        return safe
    angle = math.acos(max(-1.0, min(1.0, float(away @ step) / (distance * drift)))) - math.asin(min(1.0, radius * (1 + 1e-9) / distance))
    if angle <= 0:
        return safe
    return min(safe, drift * max(0.0, math.cos(angle)) + drift * 1e-6)  # the margin covers the rounding of angles


def move(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    k = len(old)
    drift = vectors.above(((new - old).astype(np.float64) ** 2).sum(1))
    loosen = np.array([max([loosening(old[i].astype(np.float64), radius[i], old[j], new[j]) for j in range(k) if j != i], default=0.0) for i in range(k)])
    apart = vectors.below(vectors.squares(new, new)) / 2
    np.fill_diagonal(apart, np.inf)
    return Move(drift, loosen, apart.min(1) * (1 - vectors.MARGIN))


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Move | None) -> int:
    """Update cluster and bounds of the vectors in place; the number of vectors scanned against all centroids."""
    if moved is None:
        open_ = np.arange(len(x))
    else:
        upper[:] = (upper + moved.drift[cluster]) * (1 + vectors.MARGIN)
        lower[:] = lower - moved.loosen[cluster]
        lower -= np.abs(lower) * vectors.MARGIN
        open_ = np.flatnonzero(upper >= np.maximum(lower, moved.half[cluster]))
        if len(open_):
            away = x[open_].astype(np.int64) - centroids[cluster[open_]]
            upper[open_] = vectors.above((away * away).sum(1))
            open_ = open_[upper[open_] >= np.maximum(lower[open_], moved.half[cluster[open_]])]
    if len(open_):
        squared = vectors.squares(x[open_], centroids)
        cluster[open_] = squared.argmin(1)  # the first of equal ones
        ordered = np.partition(squared, min(1, len(centroids) - 1), axis=1)
        upper[open_] = vectors.above(ordered[:, 0])
        lower[open_] = vectors.below(ordered[:, 1]) if len(centroids) > 1 else np.inf
    return len(open_)


def _pass(centroids: np.ndarray, moved: Move | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        count, total, radius, scanned = np.zeros(k, np.int64), np.zeros((k, d), np.int64), np.zeros(k), 0
        names = [f.split()[0] for f in _STATE.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.matrix(batch)
            if moved is None:
                cluster, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
            else:
                cluster, upper, lower = (np.array(batch.column(c)) for c in ("cluster", "upper", "lower"))
            scanned += assign(x, centroids, cluster, upper, lower, moved)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x.astype(np.int64))
            np.maximum.at(radius, cluster, upper)
            n = len(x)
            yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), pa.array(cluster), pa.array(upper), pa.array(lower),
                                   pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        used = np.flatnonzero(count)
        n = len(used)
        once = [scanned if i == 0 else 0 for i in range(n)]
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(used.astype(np.int32)), pa.array(radius[used]), pa.nulls(n, pa.float64()),
                               pa.array(count[used]), pa.array(once, pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))], names)

    return run


def _distances(centroids: np.ndarray, moved: Move | None):
    """The last assignment: every vector's exact squared distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.matrix(batch)
            if moved is None:
                cluster, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
            else:
                cluster, upper, lower = (np.array(batch.column(c)) for c in ("cluster", "upper", "lower"))
            assign(x, centroids, cluster, upper, lower, moved)
            away = x.astype(np.int64) - centroids[cluster]
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster), pa.array((away * away).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose vec_ids have the smallest hashes: a fixed number of rows reaches the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64)


@dataclass
class Clusters:
    """Centroids, and the vectors with their bounds as of the last move (``moved`` is not yet applied to them)."""

    centroids: np.ndarray
    state: DataFrame
    moved: Move | None
    paths: list[str]
    scanned: list[int]


def fit(kept: DataFrame, kept_path: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clusters:
    spark = kept.sparkSession
    out = Clusters(first_centroids(kept, clusters, seed), kept, None, [kept_path], [])
    for _ in range(rounds if len(out.centroids) else 0):
        table, path = common.staged(out.state.mapInArrow(_pass(out.centroids, out.moved), _STATE), "cluster-bounds")
        common.discard(spark, *out.paths)
        d = out.centroids.shape[1]
        found = (
            table.where(F.col("n").isNotNull()).groupBy("cluster")
            .agg(F.sum("n").alias("n"), F.max("upper").alias("radius"), F.sum("scanned").alias("scanned"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)])
            .collect()
        )
        after, radius = out.centroids.copy(), np.zeros(len(out.centroids))
        for r in found:
            after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
            radius[r["cluster"]] = r["radius"]
        vectors_only = table.where(F.col("n").isNull()).select("vec_id", "vector", "cluster", "upper", "lower")
        out = Clusters(after, vectors_only, move(out.centroids, after, radius), [path], [*out.scanned, sum(r["scanned"] for r in found)])
    return out


def cluster(table: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Cluster, squared distance, inertia and centroid digest of every kept row of ``table(vec_id, embedding)``."""
    spark = table.sparkSession
    kept, path = common.staged(vectors.whole_numbers(table, dim, F.col("vec_id").cast("long").alias("vec_id")), "whole-vectors")
    found = fit(kept, path, clusters, rounds, seed)
    if not len(found.centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = common.stage_table(found.state.mapInArrow(_distances(found.centroids, found.moved), "vec_id long, cluster int, distance long"), "clusters")
    common.discard(spark, *found.paths)
    # one row per cluster, so few that they go into the projection
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    total = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in found.centroids]
    numbers = F.array(*[F.lit(inertia.get(i)).cast("long") for i in range(len(digests))])
    return rows.select("vec_id", "cluster", "distance", numbers[F.col("cluster")].alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
                       F.array(*[F.lit(x) for x in digests])[F.col("cluster")].alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    out = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS BIGINT) AS c, x FROM kept QUALIFY c < {CLUSTERS})"""
    ]
    for r in range(ROUNDS + 1):
        out.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, a.x, min(CAST(list_inner_product(a.x, a.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(a.x, b.x) AS BIGINT) * {CLUSTERS} + c) AS k
  FROM kept a, c{r} b GROUP BY ALL)""")
        if r < ROUNDS:
            out.append(f"""means{r} AS (
  SELECT k % {CLUSTERS} AS c, i, CAST(floor(sum(x[i]) / count(*)) AS DOUBLE) AS m FROM near{r}, range(1, {DIM + 1}) t(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT b.c, coalesce(m.x, b.x) AS x FROM c{r} b LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM means{r} GROUP BY ALL) m ON b.c = m.c)""")
    out.append(f"""digest AS (
  SELECT c, sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS}, range(1, {DIM + 1}) t(i) GROUP BY c)
SELECT vec_id, CAST(k % {CLUSTERS} AS INTEGER) AS cluster, k // {CLUSTERS} AS distance, CAST(sum(k // {CLUSTERS}) OVER (PARTITION BY k % {CLUSTERS}) AS BIGINT) AS cluster_inertia,
  CAST(sum(k // {CLUSTERS}) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM near{ROUNDS} JOIN digest ON c = k % {CLUSTERS}""")
    return ",\n".join(out)


ORACLE_SQL = _oracle()
