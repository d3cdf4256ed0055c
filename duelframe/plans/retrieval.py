"""Retrieval queries: benchmark texts asked of the documents, and every hundredth vector of the embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.operators import dense as dn
from duelframe.operators import retrieval as rt
from duelframe.plans.registry import query as register
from duelframe.sources.matches import tables

BM25_SQL = """
dt AS (SELECT doc_id AS id, source, list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}._-]+'), regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS toks FROM documents),
shape AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY ALL),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), shape),
mean AS (SELECT avg(r) AS m FROM raw),
asked AS (SELECT qid, term, count(*) AS qn FROM (SELECT item_id AS qid, unnest(list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}._-]+'), regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT qid, term, qn * CASE WHEN r < 0 THEN 0.25::DOUBLE * m ELSE r END AS weight FROM asked JOIN raw USING (term), mean),
scored AS (SELECT qid, id, round(sum(weight * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM post JOIN weights USING (term), shape GROUP BY qid, id),
bm AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, score FROM scored) WHERE rank <= 20),
cs AS (SELECT q.vec_id AS qid, q.label AS asked, e.vec_id AS id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 OR q.vec_id IN (SELECT item_id FROM benchmark)),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM cs) WHERE rank <= 20),
fused AS (SELECT qid, id, b.rank AS rank_first, d.rank AS rank_second, round(61 * (coalesce(0.5::DOUBLE / (60 + b.rank), 0.0) + coalesce(0.5::DOUBLE / (60 + d.rank), 0.0)), 9) AS score FROM bm b FULL JOIN (SELECT * FROM dn WHERE qid IN (SELECT item_id FROM benchmark)) d USING (qid, id))
"""


def sql(name: str, text: str):
    return register(name, text, BM25_SQL)


def _bm25(spark, sf_dir, k=20):
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    return rt.bm25(docs, bench.select(F.col("item_id").alias("qid"), "text"), k)


def _dense(spark, sf_dir, k=20):
    """The best ``k`` of every hundredth vector."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    return dn.search(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), k)


@sql("r144_bm25", "SELECT * FROM bm WHERE rank <= 10")
def bm25(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@sql("r145_dense", "SELECT qid, rank, id, score FROM dn WHERE qid % 100 = 0")
def dense(spark, sf_dir):
    return _dense(spark, sf_dir)


@sql("r146_dense_post_filter", "SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, score FROM dn WHERE qid % 100 = 0 AND (label IS NULL OR label = asked)) WHERE rank <= 5")
def dense_filtered(spark, sf_dir):
    """The label filter applies after the cut to 20, so fewer than 5 may be left."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    rows = _dense(spark, sf_dir).join(labels, "id").join(labels.select(F.col("id").alias("qid"), F.col("label").alias("asked")), "qid")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return rows.where("label IS NULL OR label = asked").withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("qid", "rank", "id", "score")


@sql("r125_min_max", "SELECT qid, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normalised FROM bm WINDOW w AS (PARTITION BY qid)")
def min_max(spark, sf_dir):
    return rt.min_max(_bm25(spark, sf_dir), "qid").select("qid", "id", "score", F.col("normalised"))


@sql("r147_fusion", "SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank_first NULLS LAST, rank_second)::INT AS rank, id, score FROM fused) WHERE rank <= 15")
def fusion(spark, sf_dir):
    """Every text of the benchmark with the vector of its number."""
    vectors, bench = tables(spark, sf_dir, "embeddings", "benchmark")
    asked = vectors.join(bench.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "qid")
    return dn.fused(_bm25(spark, sf_dir), dn.search(vectors, asked, 20), 15)


@sql("r122_lexical_overlap", "SELECT b.item_id, d.doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]')), regexp_extract_all(lower(d.text), '[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]'))) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]')))::DOUBLE, 9) AS overlap FROM bm JOIN benchmark b ON b.item_id = bm.qid JOIN documents d ON d.doc_id = bm.id")
def lexical_overlap(spark, sf_dir):
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    rows = _bm25(spark, sf_dir).join(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("question")), "qid").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), F.round(rt.lexical_overlap(F.col("question"), F.col("text")), 9).alias("overlap"))


@sql("r149_diverse", "SELECT qid, id, pick FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (k > 1), score DESC, id)::INT AS pick FROM (SELECT bm.*, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) AS k FROM bm JOIN dt USING (id)) WHERE k <= 3) WHERE pick <= 8")
def diverse(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    rows = _bm25(spark, sf_dir).join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return rt.diverse(rows, 8).select("qid", "id", "pick")


@sql("r148_lanes", "SELECT qid, id, max(score) AS score, array_to_string(list_sort(list_distinct(list(lane))), ',') AS lanes FROM (SELECT qid, id, score, 0 AS lane FROM bm UNION ALL SELECT qid, id, score, 1 FROM bm WHERE rank <= 5 UNION ALL SELECT qid, bm.id, score * 0.5::DOUBLE, 2 FROM bm JOIN dt USING (id) WHERE source = 'src1') GROUP BY qid, id")
def lanes(spark, sf_dir):
    rows = _bm25(spark, sf_dir)
    (docs,) = tables(spark, sf_dir, "documents")
    typed = rows.join(docs.where("source = 'src1'").select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("score", F.col("score") * 0.5)
    cols = ("qid", "id", "score")
    found = rt.lanes(rows.select(*cols), rows.where("rank <= 5").select(*cols), typed.select(*cols))
    return found.withColumn("lanes", F.array_join(F.transform("lanes", lambda x: x.cast("string")), ","))


@sql("r150_compress", """SELECT qid, o.id AS id, o.rank AS rank, o.chars AS chars FROM (SELECT qid, unnest(list_reduce(list({'used': length(d.text), 'ids': [bm.id], 'texts': [d.text], 'out': [{'id': bm.id, 'rank': rank, 'chars': length(d.text)}]} ORDER BY rank),
  lambda a, x: CASE WHEN len(a.ids) = 6 OR list_contains(a.ids, x.ids[1]) OR list_contains(a.texts, x.texts[1]) OR (len(a.ids) > 0 AND a.used + x.used > 4200) THEN a
    ELSE {'used': a.used + x.used, 'ids': a.ids || x.ids, 'texts': a.texts || x.texts, 'out': a.out || x.out} END,
  {'used': 0::BIGINT, 'ids': []::BIGINT[], 'texts': []::VARCHAR[], 'out': []::STRUCT(id BIGINT, rank INT, chars BIGINT)[]}).out) AS o FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY qid)""")
def compress(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return rt.compress(_bm25(spark, sf_dir).join(docs.select(F.col("doc_id").alias("id"), "text"), "id"), max_items=6, budget=4200)


@sql("r224_diagnostics", "SELECT qid, count(*) AS results, count(DISTINCT source) AS sources, max(score) AS best, min(score) AS worst FROM bm JOIN dt USING (id) GROUP BY qid")
def diagnostics(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    rows = _bm25(spark, sf_dir).join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return rows.groupBy("qid").agg(F.count("*").alias("results"), F.countDistinct("source").alias("sources"), F.max("score").alias("best"), F.min("score").alias("worst"))
