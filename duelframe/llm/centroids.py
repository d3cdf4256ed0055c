"""Centroid clustering by sort-means.

In each round the other centroids are ordered by their distance from each centroid. A vector's scan begins at the centroid of its last
assignment and follows that order; once a centroid lies strictly beyond twice the vector's distance to where it started, no later one can be as near, so
the scan stops. All distances are squared and integer, so the stop, the nearest centroid and its ties are exact.

Vectors are rows of Parquet tables that each round reads and writes with the new assignment; only the k centroids and their sums reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import checkpoint, discard, map_batches

SIZE = 64
SCALE = 64
K = 16
ROUNDS = 3
SEED = 1
#: Components beyond this are taken as this, so that squared distances of 64 components stay below 2**63.
MOST = 1 << 27


def scaled(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors with exactly ``size`` components, none null or non-finite, as integers floor(scale * x)."""
    x = F.col(col).cast("array<double>")
    good = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * scale))).cast("int"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; of rows that share an id the one with smaller components comes first, those without an id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def scan(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of every row of ``x``; of equally near centroids the smaller number."""
    between = np.stack([_squares(centroids, c) for c in centroids])
    cluster, distance, tried = last.astype(np.int64), np.empty(len(x), np.int64), len(x)
    for own in np.unique(last):
        rows = np.flatnonzero(last == own)
        first = _squares(x[rows], centroids[own])
        # the farthest rows first, so that those whose scan goes on are a prefix
        rank = np.argsort(-first, kind="stable")
        rows, first = rows[rank], first[rank]
        best, near = np.full(len(rows), own), first.copy()
        order = np.argsort(between[own], kind="stable")
        for other in order[order != own]:
            # strictly beyond twice the distance: between > 4 * first in squares
            n = int(np.searchsorted(-first, -between[own][other] // 4, "right"))
            if not n:
                break
            d = _squares(x[rows[:n]], centroids[other])
            tried += n
            better = (d < near[:n]) | ((d == near[:n]) & (other < best[:n]))
            near[:n][better], best[:n][better] = d[better], other
        cluster[rows], distance[rows] = best, near
    return cluster, distance, tried


def _assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    size = centroids.shape[1]

    def run(batch: pa.RecordBatch) -> dict:
        x = batch.column("v").flatten().to_numpy().reshape(-1, size).astype(np.int64)
        cluster, distance, _ = scan(x, batch.column("cluster").to_numpy(), centroids)
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": cluster.astype(np.int32), "distance": distance}

    return map_batches(rows, run, "vec_id long, v array<int>, cluster int, distance long")


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster with vectors; at most k rows come back."""
    sums = [F.sum(F.element_at("v", i + 1).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def sort_means(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, v (its integers).

    Vectors with another number of components, or with a null or non-finite one, take no part; components beyond 2**27 / scale count as that.
    Rows that share a vec_id, or have none, are vectors of their own. With fewer than ``k`` vectors each of them is a centroid. An empty cluster keeps its
    centroid. An inertia beyond a long is null. An empty table gives no rows; other columns are ignored.
    """
    now = checkpoint(scaled(vectors, id_col, col, size, scale))
    centroids = starts(now, k, seed)
    if not len(centroids):
        return now.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), "v")
    before, now = now, checkpoint(_assign(now.withColumn("cluster", F.lit(0)), centroids))
    discard(before)
    for _ in range(rounds):
        centroids = _means(now, centroids)
        before, now = now, checkpoint(_assign(now.drop("distance"), centroids))
        discard(before)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inner = now.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = now.agg(F.try_sum("distance").alias("inertia"))
    # k rows and one row
    facts = inner.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total))
    return now.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "v")


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    nearest = """SELECT rid, v, list_min(list_transform(cs, lambda c: {{'d': list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'n': c.n}})) AS b
      FROM kept, (SELECT list({{'n': n, 'c': c}} ORDER BY n) AS cs FROM c{r})"""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS n, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest.format(r=r)})",
            f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.n, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
      SELECT n, list(floor_mean ORDER BY i) AS c FROM (SELECT b.n AS n, i, ((sum(v[i]) - (((sum(v[i]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS floor_mean
        FROM a{r}, range(1, 65) t(i) GROUP BY b.n, i) GROUP BY n) m USING (n))""",
        ]
    steps.append(f"last AS MATERIALIZED ({nearest.format(r=rounds)})")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT vec_id, b.n AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.n))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM last JOIN kept USING (rid) JOIN c{rounds} ON c{rounds}.n = b.n"""


#: By plain scans over all centroids.
ORACLE_SQL = _oracle()
