"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by three rounds of random signs and a fast Hadamard transform; its bucket is the nearest signed axis. Every
vector is indexed in all tables, a query probes its nearest axes of each table, and candidates are reranked by exact distance on the
original vectors where bucket and query meet, so only a query's best few leave a task.
Buckets and their queries are cut into pieces of bounded size, so that no task holds a whole large bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import checkpoint, map_batches

TABLES = 8
PROBES = 16
PIECE_ROWS = 8192
PIECE_QUERIES = 2048
SEED = 11
_KEY = ["size", "part", "code", "piece", "q_piece"]


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotated rows, padded to a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    rnd = np.random.default_rng([seed, table, d])
    for _ in range(3):
        out = out * rnd.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            pairs = out.reshape(len(out), d // (2 * h), 2, h)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), d)
            h *= 2
        out /= np.sqrt(d)
    return out


def nearest_axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Codes of the ``probes`` nearest signed axes of each row, nearest first (axis a: a, opposite: a + d)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    turned = rotate(x / np.linalg.norm(x, axis=1, keepdims=True), table)
    return np.argsort(-np.concatenate([turned, -turned], axis=1), axis=1, kind="stable")[:, :probes]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one vector; where squares leave the range of doubles, of scaled differences."""
    with np.errstate(over="ignore"):
        plain = np.sqrt(((x - q) ** 2).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(plain) | (plain < 1e-150))
    for i in odd:
        d = np.abs(x[i] / 2 - q / 2)
        top = d.max()
        with np.errstate(over="ignore"):
            plain[i] = 2 * (top * np.sqrt(((d / top) ** 2).sum())) if top else 0.0
    return plain


def valid(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, v, size): vectors with an id whose components are all finite and not all zero."""
    v = F.col(col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("size")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False))
    )


def _codes(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """One row per vector, table and probe."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "v", "size", "part", "code")}
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            own = batch.filter(pa.array(sizes == size))
            ids, flat = own.column("id").to_numpy(), own.column("v").flatten().to_numpy()
            x = flat.reshape(-1, size)
            for t in range(tables):
                for code in nearest_axes(x, t, probes).T:
                    out["id"].append(ids)
                    out["v"].append(flat)
                    out["size"].append(np.full(len(ids), size))
                    out["part"].append(np.full(len(ids), t))
                    out["code"].append(code)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(out["size"]))]).astype(np.int32)
        flat = {k: np.concatenate(v) for k, v in out.items()}
        return flat | {"v": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat["v"]))}

    return map_batches(rows, run, "id long, v array<double>, size int, part int, code int")


def _meet(index: DataFrame, queries: DataFrame, k: int, piece_rows: int, piece_queries: int) -> DataFrame:
    """(query_id, vec_id, score): each query's best ``k`` in every piece of the buckets that it probes."""
    bucket = _KEY[:3]
    # at most size x table x code rows
    rows = index.groupBy(*bucket).agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("n_piece"))
    asks = queries.groupBy(*bucket).agg(F.ceil(F.count("*") / piece_queries).cast("int").alias("n_q"))
    grid = checkpoint(rows.join(asks, bucket))
    left = (
        index.join(F.broadcast(grid), bucket)
        .withColumn("piece", F.pmod(F.xxhash64("id", "v"), F.col("n_piece")).cast("int"))
        .withColumn("q_piece", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
        .select(*_KEY, "id", "v")
    )
    right = (
        queries.join(F.broadcast(grid), bucket)
        .withColumn("q_piece", F.pmod(F.xxhash64("id", "v"), F.col("n_q")).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_piece") - 1)))
        .select(*_KEY, "id", "v")
    )

    def best(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            size = key[0].as_py()
            ids, asked = a.column("id").to_numpy(), b.column("id").to_numpy()
            x = a.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            # an id's rows follow one another; they count once, at the nearest
            heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            q = b.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
            # the rough pass works on values below 1, so that nothing overflows; its rounding grows with the norms, not with the distances
            unit = max(float(np.abs(x).max()), float(np.abs(q).max()))
            small = x / unit
            norms = (small * small).sum(axis=1)
            for at in range(0, len(q), 256):
                block = q[at : at + 256] / unit
                own = (block * block).sum(axis=1)
                rough = norms - 2 * block @ small.T + own[:, None]
                for i, row in enumerate(rough):
                    row = np.where(ids == asked[at + i], np.inf, row)
                    low = row if len(heads) == len(row) else np.minimum.reduceat(row, heads)
                    cut = np.partition(low, k - 1)[k - 1] if len(low) > k else np.inf
                    # every row within rounding of the cut is measured exactly, so ties fall to the smaller id
                    slack = 1e-13 * size * (own[i] + norms)
                    near = np.flatnonzero(row - slack <= cut + slack.max() if np.isfinite(cut) else np.isfinite(row))
                    exact = distances(x[near], q[at + i])
                    order = np.lexsort((ids[near], exact))
                    if len(heads) < len(row):
                        order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
                    for j in order[:k]:
                        out["query_id"].append(asked[at + i])
                        out["vec_id"].append(ids[near[j]])
                        out["score"].append(exact[j])
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    met = left.groupBy(*_KEY).cogroup(right.groupBy(*_KEY)).applyInArrow(best, "query_id long, vec_id long, score double")
    pairs = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES,
    piece_rows: int = PIECE_ROWS, piece_queries: int = PIECE_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each query, itself excepted, by Euclidean distance.

    Null, zero and non-finite vectors take no part, nor do rows without an id; vectors of different lengths are not compared. Ties go to
    the smaller vec_id. Rows that share an id count once, at their nearest, also as queries; equal rows are one. A query that meets fewer than ``k`` candidates in its
    buckets is held against all rows in pieces, so it gets ``k`` or all there are. Empty tables give no rows; other columns are ignored.
    """
    rows, asked = valid(vectors).distinct(), valid(queries).distinct()
    found = checkpoint(_meet(_codes(rows, tables, 1), _codes(asked, tables, probes), k, piece_rows, piece_queries))
    short = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    whole = (F.lit(0).alias("part"), F.lit(0).alias("code"))
    if not short.limit(1).count():
        return found
    rest = _meet(rows.select("*", *whole), short.select("*", *whole), k, piece_rows, piece_queries)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
