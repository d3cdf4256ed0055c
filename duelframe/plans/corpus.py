"""Corpus queries; orders and events stand in for facts, observations, requests and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.operators import corpus as co
from duelframe.plans.registry import query as register
from duelframe.sources.matches import tables

FACTS = """
old AS (SELECT o_orderkey AS k, md5(o_orderstatus || '|' || o_custkey) AS h FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_custkey) AS h FROM orders WHERE o_orderkey % 2 = 0)
"""
BUDGETS = {"src0": 10, "src1": 60, "src2": 25}


def _facts(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.md5(F.concat_ws("|", "o_orderstatus", "o_custkey")).alias("h"))
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return old, orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.md5(F.concat_ws("|", status, "o_custkey")).alias("h"))


@register("r186_insert_or_conflict", "SELECT new.k, new.h, CASE WHEN old.h IS NULL THEN 'insert' WHEN old.h = new.h THEN 'same' ELSE 'conflict' END AS action FROM new LEFT JOIN old USING (k)", FACTS)
def insert_or_conflict(spark, sf_dir):
    old, new = _facts(spark, sf_dir)
    return co.insert_or_conflict(old, new, "k", "h").select("k", "h", "action")


@register("r187_observation_upsert", "SELECT o_custkey, o_orderpriority, min(r) AS observer_rank FROM (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 1000 END AS r FROM orders) GROUP BY ALL")
def observation_upsert(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    rows = orders.select("o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 1000).alias("observer_rank"), "o_orderkey")
    parts = [rows.where(F.col("o_orderkey") % 2 == i).drop("o_orderkey") for i in (0, 1)]
    return co.upsert_observations(*parts, ["o_custkey", "o_orderpriority"])


@register("r188_loadout_merge", "SELECT k, CASE WHEN oh IS NULL THEN 'insert' WHEN h = oh THEN 'same' WHEN c AND oc THEN CASE WHEN f = of_ THEN 'refresh' ELSE 'conflict' END WHEN q > oq THEN 'replace' ELSE 'keep' END AS action FROM (SELECT n.o_orderkey AS k, n.o_orderstatus || n.o_custkey % 5 AS h, n.o_custkey % 3 AS f, n.o_custkey % 4 > 0 AS c, n.o_custkey % 6 AS q, o.o_orderstatus || o.o_custkey % 5 AS oh, o.o_custkey % 3 AS of_, o.o_custkey % 4 > 0 AS oc, o.o_custkey % 6 AS oq FROM orders n LEFT JOIN orders o ON o.o_orderkey = n.o_orderkey + 1 AND o.o_orderkey % 5 > 0)")
def loadout_merge(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("k"), F.concat("o_orderstatus", (F.col("o_custkey") % 5).cast("string")).alias("hash"), (F.col("o_custkey") % 3).alias("fact"),
        (F.col("o_custkey") % 4 > 0).alias("complete"), (F.col("o_custkey") % 6).alias("quality"),
    )
    old = rows.where("k % 5 > 0").withColumn("k", F.col("k") - 1)
    return co.merge_loadouts(old, rows, "k").select("k", "action")


@register("r189_request_upsert", "SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS attempts FROM events GROUP BY user_id")
def request_upsert(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return co.request_upsert(events.withColumnRenamed("event_type", "status"), "user_id", "event_id")


@register("r104_latest_feedback", "SELECT event_id, user_id, event_type FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def latest_feedback(spark, sf_dir):
    return co.latest(tables(spark, sf_dir, "events")[0], "user_id", "event_id").select("event_id", "user_id", "event_type")


@register("r105_newest_alive", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY ORDER BY event_id DESC LIMIT 500")
def newest_alive(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    return co.newest(events, [F.desc("event_id")], 500, F.col("ts") >= F.lit(last) - F.expr("INTERVAL 3 DAY")).select("event_id", "ts")


@register("r84_feedback_stats", "SELECT count(*) FILTER (WHERE value >= 10) AS positive, count(*) FILTER (WHERE value < 10) AS negative, count(*) AS total FROM events")
def feedback_stats(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.agg(F.count(F.when(F.col("value") >= 10, 1)).alias("positive"), F.count(F.when(F.col("value") < 10, 1)).alias("negative"), F.count("*").alias("total"))


@register("r195_insert_missing", "SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 10) WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value < 1)")
def insert_missing(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    keys = ["user_id", "event_type"]
    return co.insert_missing(events.where("value < 1"), events.where("value >= 10").select(*keys), keys)


@register("r218_correction_candidates", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 5 ORDER BY ts, event_id LIMIT 40")
def correction_candidates(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.where("event_type = 'error' AND value > 5").orderBy("ts", "event_id").limit(40).select("event_id", "user_id", "value")


@register("r196_reviewed_export", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def reviewed_export(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return co.reviewed_export(docs.select("doc_id", F.lit(-1).alias("quality")), labels, "doc_id", ["quality"])


@register("r83_document_counts", "SELECT lang AS scope, source AS source_type, count(*) AS documents, coalesce(count(*) >= CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 60 WHEN 'src2' THEN 25 END, false) AS saturated FROM documents GROUP BY lang, source")
def document_counts(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")[0].select(F.col("lang").alias("scope"), F.col("source").alias("source_type"))
    return co.document_counts(docs, BUDGETS)


@register("r114_document_budget", "SELECT doc_id, lang AS scope, source AS source_type FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 60 WHEN 'src2' THEN 25 ELSE rn END")
def document_budget(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")[0].select("doc_id", "n_chars", F.col("lang").alias("scope"), F.col("source").alias("source_type"))
    return co.within_budget(docs, BUDGETS, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "scope", "source_type")


@register("r58_document_diff", "SELECT k AS doc_id, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' ELSE 'changed' END AS issue FROM (SELECT coalesce(x.doc_id, y.doc_id) AS k, x.doc_id AS a, y.doc_id AS b, x.v AS v, y.v AS w FROM (SELECT doc_id, n_chars AS v FROM documents WHERE doc_id % 5 > 0) x FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN NULL ELSE n_chars END AS v FROM documents WHERE doc_id % 4 > 0) y ON x.doc_id = y.doc_id) WHERE a IS NULL OR b IS NULL OR v IS DISTINCT FROM w")
def document_diff(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    changed = docs.where("doc_id % 4 > 0").select("doc_id", F.when(F.col("doc_id") % 11 != 3, F.col("n_chars")).alias("n_chars"))
    return co.compare_documents(docs.where("doc_id % 5 > 0"), changed, "doc_id", "n_chars")


@register("r56_merge_live_items", "SELECT p_name AS name, 'live' AS origin FROM (SELECT DISTINCT p_name FROM part WHERE p_size > 25) UNION ALL SELECT DISTINCT p_name, 'fallback' FROM part WHERE p_size <= 25 AND lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 25)")
def merge_live_items(spark, sf_dir):
    """Live items, then fallback items that are not among them, whatever their case."""
    (part,) = tables(spark, sf_dir, "part")
    live, rest = part.where("p_size > 25").select("p_name").distinct(), part.where("p_size <= 25").select("p_name").distinct()
    key = F.lower(F.trim("p_name"))
    extra = rest.withColumn("k", key).join(live.select(key.alias("k")).distinct(), "k", "left_anti").select(F.col("p_name").alias("name"), F.lit("fallback").alias("origin"))
    return live.select(F.col("p_name").alias("name"), F.lit("live").alias("origin")).unionByName(extra)


@register("r220_seed_merge", "SELECT tag, origin FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY o, pos) AS rn FROM (SELECT s_nationkey AS tag, 'global' AS origin, 0 AS o, s_suppkey AS pos FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_nationkey, 'location', 1, c_custkey FROM customer WHERE c_acctbal > 0)) WHERE rn = 1")
def seed_merge(spark, sf_dir):
    """First by source order, then by position."""
    supplier, customer = tables(spark, sf_dir, "supplier", "customer")
    rows = supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("tag"), F.lit("global").alias("origin"), F.lit(0).alias("o"), F.col("s_suppkey").alias("pos")).unionByName(
        customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("tag"), F.lit("location").alias("origin"), F.lit(1).alias("o"), F.col("c_custkey").alias("pos"))
    )
    return co.first_facts(rows, "tag", [F.col("o"), F.col("pos")]).select("tag", "origin")
