"""Evaluation queries over events, orders and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.operators import evaluation as ev
from duelframe.plans.registry import query as register
from duelframe.sources.matches import tables

RANKING_SQL = """
ranked AS (SELECT l_orderkey AS case_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem),
cases AS (SELECT case_id, min(l_partkey) AS relevant, list(l_partkey ORDER BY rn) AS retrieved FROM ranked GROUP BY case_id),
scored AS (SELECT case_id, coalesce(list_position(retrieved[1:5], relevant), 0) AS pos FROM cases),
scores AS (SELECT case_id, CASE WHEN pos > 0 THEN 1 ELSE 0 END AS recall_at_k, CASE WHEN pos > 0 THEN 1.0::DOUBLE / pos ELSE 0.0::DOUBLE END AS reciprocal_rank FROM scored),
halves AS (SELECT user_id, avg(value) FILTER (WHERE event_id % 2 = 0) AS b, avg(value) FILTER (WHERE event_id % 2 = 1) AS t FROM events GROUP BY user_id)
"""


def _cases(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.min("l_partkey").alias("relevant"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), F.col("l_partkey").alias("k")))), lambda x: x["k"]).alias("retrieved"),
    )


@register("r91_latency", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY event_type")
def latency(spark, sf_dir):
    return ev.latency(*tables(spark, sf_dir, "events"), "value", "event_type")


@register("r94_case_scores", "SELECT * FROM scores", RANKING_SQL)
def case_scores(spark, sf_dir):
    return ev.case_scores(_cases(spark, sf_dir), 5)


@register("r94_ranking_summary", "SELECT count(*) AS cases, sum(recall_at_k)::BIGINT AS hits, round(avg(recall_at_k), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr FROM scores", RANKING_SQL)
def ranking_summary(spark, sf_dir):
    return ev.ranking_summary(ev.case_scores(_cases(spark, sf_dir), 5))


@register("r93_paired_effect", "SELECT count(*) AS pairs, round(avg(t - b), 6) AS mean_difference, round(avg(t - b) / stddev_samp(t - b), 6) AS effect FROM halves WHERE b IS NOT NULL AND t IS NOT NULL", RANKING_SQL)
def paired_effect(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    halves = events.groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("b"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("t"))
    return ev.paired_effect(halves.where("b IS NOT NULL AND t IS NOT NULL"), "b", "t")


@register("r57_alignment", "SELECT l_orderkey AS case_id, 'left' AS side FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) UNION ALL SELECT l_orderkey, 'right' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def alignment(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    keys = [lines.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("case_id")).distinct() for f in ("R", "A")]
    return ev.misaligned(*keys)


@register("r89_category_ratios", "SELECT lang, count(*) AS cases, round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 6) AS success_rate, round(count(*) FILTER (WHERE toxic = 1) / count(*)::DOUBLE, 6) AS failure_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def category_ratios(spark, sf_dir):
    labels, docs = tables(spark, sf_dir, "labels", "documents")
    return labels.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count("*").alias("cases"), F.round(ev.ratio(F.col("quality") == 1), 6).alias("success_rate"), F.round(ev.ratio(F.col("toxic") == 1), 6).alias("failure_rate")
    )


@register("r90_scorecard", "SELECT count(*) AS cases, round(avg(value), 6) AS mean_value, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate, round(count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) / count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE, 6) AS large_purchase_rate, CASE WHEN count(DISTINCT event_type) > 1 THEN 'mixed' ELSE min(event_type) END AS kind FROM events")
def scorecard(spark, sf_dir):
    """Flag rates count only the rows that report the flag."""
    (events,) = tables(spark, sf_dir, "events")
    return events.agg(
        F.count("*").alias("cases"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(ev.ratio(F.col("event_type") == "error"), 6).alias("error_rate"),
        F.round(ev.ratio(F.col("value") > 10, F.col("event_type") == "purchase"), 6).alias("large_purchase_rate"),
        F.when(F.countDistinct("event_type") > 1, "mixed").otherwise(F.min("event_type")).alias("kind"),
    )


@register("r92_bootstrap")
def bootstrap(spark, sf_dir):
    (labels,) = tables(spark, sf_dir, "labels")
    return ev.bootstrap_mean(labels, "quality")


@register("r107_even_picks", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i IN (0, n - 1) OR list_contains([round_even(1 * (n - 1) / 4.0, 0)::BIGINT, round_even(2 * (n - 1) / 4.0, 0)::BIGINT, round_even(3 * (n - 1) / 4.0, 0)::BIGINT], i)")
def even_picks(spark, sf_dir):
    """Five evenly spaced rows of each type, indices rounded half to even."""
    (events,) = tables(spark, sf_dir, "events")
    own = Window.partitionBy("event_type")
    rows = events.select("event_type", "event_id", (F.row_number().over(own.orderBy("event_id")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.bround(k * (F.col("n") - 1) / 4.0, 0).cast("long"))
    return rows.where(F.array_contains(picks, F.col("i").cast("long"))).select("event_type", "event_id")
