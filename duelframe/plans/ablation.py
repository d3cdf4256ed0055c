"""Search from the kept index, dense search of many queries, and the three-way ablation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators import dense, index
from duelframe.operators import retrieval as rt
from duelframe.plans.registry import query as register
from duelframe.plans.retrieval import BM25_SQL
from duelframe.session import settled, shared_folder
from duelframe.sources.matches import tables

SIMPLE = "[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]"
ABLATION_SQL = BM25_SQL + f""",
dq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 20),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r1 NULLS LAST, r2) AS rank FROM (SELECT qid, id, b.rank AS r1, d.rank AS r2, round(61 * (coalesce(0.5::DOUBLE / (60 + b.rank), 0.0) + coalesce(0.5::DOUBLE / (60 + d.rank), 0.0)), 9) AS score FROM bm b FULL JOIN dq d USING (qid, id))) WHERE rank <= 15),
re AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, hy.id, round(0.55::DOUBLE * score + 0.25::DOUBLE * (len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '{SIMPLE}')), regexp_extract_all(lower(d.text), '{SIMPLE}'))) / len(list_distinct(regexp_extract_all(lower(b.text), '{SIMPLE}')))::DOUBLE) + 0.2::DOUBLE * CASE WHEN d.source = 'src1' THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END, 9) AS score
  FROM hy JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = hy.id)),
rel AS (SELECT qid, id AS relevant FROM bm WHERE rank = 1 + qid % 7),
runs AS (SELECT 'bm25' AS v, qid, id, rank FROM bm UNION ALL SELECT 'hybrid', qid, id, rank FROM hy UNION ALL SELECT 'hybrid_rerank', qid, id, rank FROM re WHERE rank <= 8),
scored_runs AS (SELECT v, rel.qid, coalesce(max(CASE WHEN id = relevant AND rank <= 5 THEN 1 END), 0)::DOUBLE AS recall_at_k, coalesce(max(CASE WHEN id = relevant AND rank <= 5 THEN 1.0::DOUBLE / rank END), 0.0::DOUBLE) AS reciprocal_rank FROM runs JOIN rel USING (qid) GROUP BY v, rel.qid),
long_runs AS (SELECT v, qid, 'recall_at_k' AS metric, recall_at_k AS x FROM scored_runs UNION ALL SELECT v, qid, 'reciprocal_rank', reciprocal_rank FROM scored_runs)
"""


@register("r153_kept_index", "SELECT * FROM bm WHERE rank <= 10", BM25_SQL)
def kept_index(spark, sf_dir):
    """The benchmark's texts asked of an index of the documents; the second build finds it and keeps it."""
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.build(docs, root)
    if not index.build(docs, root)["reused"]:
        raise RuntimeError("the index was built twice")
    return index.search(spark, root, bench.select(F.col("item_id").alias("qid"), "text"), 10)


@register("r145_dense_batch", "SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, score FROM (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 20")
def dense_batch(spark, sf_dir):
    """Every hundredth vector asked of all."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    return dense.search(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), 20)


def variants(spark, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    docs, bench, vectors = tables(spark, sf_dir, "documents", "benchmark", "embeddings")
    questions = bench.select(F.col("item_id").alias("qid"), "text")
    lexical = settled(rt.bm25(docs, questions, 20))
    asked = vectors.join(questions.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "qid")
    near = dense.search(vectors, asked, 20)
    hybrid = settled(dense.fused(lexical, near, 15))
    texts = docs.select(F.col("doc_id").alias("id"), "text", "source")
    again = settled(dense.reranked(hybrid, questions.select("qid", F.col("text").alias("question")), texts, F.when(F.col("source") == "src1", 0.45).otherwise(0.0), 8))
    return {"bm25": lexical, "hybrid": hybrid, "hybrid_rerank": again}, lexical.where("rank = 1 + qid % 7").select("qid", F.col("id").alias("relevant"))


@register("r158_ablation", "SELECT t.v || '_vs_' || b.v AS comparison, metric, count(*) AS cases, round(avg(b.x), 6) AS baseline_mean, round(avg(t.x), 6) AS treatment_mean, round(avg(t.x - b.x), 6) AS mean_delta, round(CASE WHEN stddev_samp(t.x - b.x) > 0 THEN avg(t.x - b.x) / stddev_samp(t.x - b.x) WHEN avg(t.x - b.x) = 0 THEN 0.0 END, 6) AS effect FROM long_runs b JOIN long_runs t USING (qid, metric) WHERE (b.v, t.v) IN (('bm25', 'hybrid'), ('hybrid', 'hybrid_rerank'), ('bm25', 'hybrid_rerank')) GROUP BY ALL", ABLATION_SQL)
def ablation(spark, sf_dir):
    """BM25, hybrid and hybrid with rerank over the benchmark's texts, compared pair by pair."""
    runs, relevant = variants(spark, sf_dir)
    return dense.ablation(runs, relevant, [("bm25", "hybrid"), ("hybrid", "hybrid_rerank"), ("bm25", "hybrid_rerank")])
