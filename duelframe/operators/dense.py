"""Dense search of many queries at once, fusion by query, and the comparison of retrieval variants.

Vectors are dealt to pieces of rows and queries to blocks; every piece meets every block in one matrix product, and only each query's best few rows of a piece leave its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators import evaluation as ev
from duelframe.operators import retrieval as rt

PIECE_ROWS, PIECE_QUERIES = 8192, 1024
#: Scores are rounded to six digits; what lies this near the last place may tie with it.
SLACK = 1e-6


def _matrix(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    return t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)


def _valid(rows: DataFrame, id_col: str, col: str) -> DataFrame:
    v = F.col(col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("size")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding", piece_rows: int = PIECE_ROWS, piece_queries: int = PIECE_QUERIES) -> DataFrame:
    """(qid, rank, id, score): the ``k`` best rows of ``vectors`` by cosine for every row (qid, col) of ``queries``, ties by id; itself is not left out.

    Null, zero and non-finite vectors take no part, vectors of other lengths are not compared. How many pieces there are follows from the counts of rows.
    """
    rows, asked = _valid(vectors, id_col, col), _valid(queries, "qid", col)
    counts = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / piece_rows)).cast("int").alias("n")), asked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / piece_queries)).cast("int").alias("m"))
    grid = F.broadcast(counts[0].crossJoin(counts[1]))
    key = ["size", "piece", "q_piece"]
    left = rows.crossJoin(grid).withColumn("piece", F.pmod(F.xxhash64("id", "v"), F.col("n")).cast("int")).withColumn("q_piece", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    right = asked.crossJoin(grid).withColumn("q_piece", F.pmod(F.xxhash64("id", "v"), F.col("m")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def best(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"qid": [], "id": [], "score": []}
        if len(a) and len(b):
            (ids, x), (asked_ids, q) = _matrix(a, at[0].as_py()), _matrix(b, at[0].as_py())
            # lengths are taken out of rows scaled by their greatest component, so that no square overflows
            x, q = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, q))
            x, q = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, q))
            for i, row in enumerate(q @ x.T):
                near = np.flatnonzero(row >= (np.partition(row, -k)[-k] - SLACK if len(row) > k else -2.0))
                out["qid"].append(np.full(len(near), asked_ids[i]))
                out["id"].append(ids[near])
                out["score"].append(row[near])
        flat = {c: np.concatenate(v) if v else [] for c, v in out.items()}
        return pa.table({"qid": pa.array(flat["qid"], pa.int64()), "id": pa.array(flat["id"], pa.int64()), "score": pa.array(flat["score"], pa.float64())})

    met = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(best, "qid long, id long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def fused(first: DataFrame, second: DataFrame, top: int, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """(qid, rank, id, score): reciprocal rank fusion of two lists per query, the first list's order before the second's on ties."""
    a, b = first.select("qid", "id", F.col("rank").alias("r1")), second.select("qid", "id", F.col("rank").alias("r2"))
    part = F.coalesce(F.lit(alpha) / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(F.lit(1 - alpha) / (k + F.col("r2")), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("r1").asc_nulls_last(), "r2")
    both = a.join(b, ["qid", "id"], "full_outer").withColumn("score", F.round((k + 1) * part, 9)).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= top).select("qid", "rank", "id", "score")


def reranked(found: DataFrame, questions: DataFrame, docs: DataFrame, bonus: Column, top: int) -> DataFrame:
    """(qid, rank, id, score): results in the order of base score, lexical overlap with the question (qid, question) and ``bonus``, a column of ``docs`` (id, text and others)."""
    rows = found.join(questions, "qid").join(docs, "id")
    score = 0.55 * F.col("score") + 0.25 * rt.lexical_overlap(F.col("question"), F.col("text")) + 0.20 * F.least(bonus, F.lit(1.0))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return rows.select("qid", "id", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("qid", "rank", "id", "score")


def ablation(variants: dict[str, DataFrame], relevant: DataFrame, pairs: list[tuple[str, str]], k: int = 5) -> DataFrame:
    """(comparison, metric, cases, baseline_mean, treatment_mean, mean_delta, effect): recall@k and MRR@k of retrieval variants over the same cases, compared pair by pair.

    ``variants`` have (qid, rank, id), ``relevant`` has (qid, relevant); a case without results of a variant scores 0 there.
    """
    scores = {}
    for name, rows in variants.items():
        first = rows.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))
        cases = relevant.join(first, "qid", "left").select(F.col("qid").alias("case_id"), "relevant", F.coalesce("retrieved", F.array().cast("array<bigint>")).alias("retrieved"))
        scores[name] = ev.case_scores(cases, k)
    out = None
    for baseline, treatment in pairs:
        part = ev.paired_report(scores[baseline], scores[treatment]).withColumn("comparison", F.lit(f"{treatment}_vs_{baseline}"))
        out = part if out is None else out.unionByName(part)
    return out.select("comparison", *[c for c in out.columns if c != "comparison"])
