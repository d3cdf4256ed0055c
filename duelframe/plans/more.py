"""Further queries: moving windows, reranking, probes, payloads, gate policies and configuration matchups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.operators import dense
from duelframe.operators import documents as dc
from duelframe.operators import evaluation as ev
from duelframe.operators import loadouts as lo
from duelframe.operators import retrieval as rt
from duelframe.operators import stats
from duelframe.plans.items import BASE
from duelframe.plans.loadouts import LOADOUTS, full_sides
from duelframe.plans.registry import query as register
from duelframe.plans.retrieval import BM25_SQL, _bm25
from duelframe.plans.scopes import SCOPED
from duelframe.sources import matches as src
from duelframe.sources import observations as ob
from duelframe.sources.matches import tables


@register("r88_dedupe_baseline", "SELECT count(*) AS before, count(DISTINCT (user_id, event_type)) AS after, count(*) - count(DISTINCT (user_id, event_type)) AS duplicates FROM events")
def dedupe_baseline(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    keys = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").cast("long").alias("before"), F.count("*").alias("after"), (F.sum("n") - F.count("*")).cast("long").alias("duplicates"))


@register("r108_moving_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS last_minute FROM events")
def moving_rate(spark, sf_dir):
    """Requests of a client in the twelve hours and in the minute up to each one."""
    (events,) = tables(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id").orderBy("_at")
    within = {name: F.count("*").over(own.rangeBetween(-seconds * 1_000_000, 0)).alias(name) for name, seconds in (("recent", 12 * 3600), ("last_minute", 60))}
    return events.withColumn("_at", at).select("event_id", *within.values())


@register(
    "r124_rerank",
    "SELECT qid, id, rank, round(s, 6) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id)::INT AS rank FROM (SELECT qid, bm.id, round(0.55::DOUBLE * (score / 100.0::DOUBLE) + 0.25::DOUBLE * (len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]')), regexp_extract_all(lower(d.text), '[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]'))) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_.-]+|[\\x{4e00}-\\x{9fff}]')))::DOUBLE) + 0.20::DOUBLE * CASE WHEN d.source = 'src1' THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END, 9) AS s FROM bm JOIN benchmark b ON b.item_id = bm.qid JOIN documents d ON d.doc_id = bm.id)) WHERE rank <= 8",
    BM25_SQL,
)
def rerank(spark, sf_dir):
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    found = _bm25(spark, sf_dir).withColumn("score", F.col("score") / 100.0)
    questions = bench.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    texts = docs.select(F.col("doc_id").alias("id"), "text", "source")
    best = dense.reranked(found, questions, texts, F.when(F.col("source") == "src1", 0.45).otherwise(0.0), 8)
    return best.select("qid", "id", "rank", F.round("score", 6).alias("rerank_score"))


@register("r157_retrieval_cases", "SELECT 'case:' || source || ':' || rn AS case_id, doc_id AS relevant_doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 12")
def retrieval_cases(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    rows = docs.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 12")
    return rows.select(F.concat_ws(":", F.lit("case"), "source", F.col("rn").cast("string")).alias("case_id"), F.col("doc_id").alias("relevant_doc_id"))


@register("r154_probe_recall")
def probe_recall(spark, sf_dir):
    """Every evidence document asked for by its own probe: recall at 5 and mean reciprocal rank per source type."""
    sides = src.sides(src.valid(src.matches(spark, sf_dir)))
    docs = dc.all_documents(dc.item_documents(stats.item_stats(sides)), dc.deck_documents(stats.deck_stats(sides)), dc.pair_documents(stats.teammates(sides)))
    asked = docs.select(F.xxhash64("doc_id").alias("qid"), F.xxhash64("doc_id").alias("id"), "source_type", dc.probe(F.col("text")).alias("question"))
    found = rt.bm25(docs.select(F.xxhash64("doc_id").alias("doc_id"), "text"), asked.select("qid", F.col("question").alias("text")), 5)
    lists = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))
    scored = ev.case_scores(asked.join(lists, "qid", "left").select(F.col("qid").alias("case_id"), F.col("id").alias("relevant"), F.coalesce("retrieved", F.array().cast("array<bigint>")).alias("retrieved")), 5)
    return scored.join(asked.select(F.col("qid").alias("case_id"), "source_type"), "case_id").groupBy("source_type").agg(
        F.count("*").alias("probes"), F.round(F.avg("recall_at_k"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr")
    )


@register("r173_answer_payload", "SELECT row_number() OVER (ORDER BY usage_rate DESC, item)::INT AS rank, item, usage_rate, clean_win_rate AS win_rate FROM item_stats", BASE)
def answer_payload(spark, sf_dir):
    items = stats.item_stats(src.sides(src.valid(src.matches(spark, sf_dir))))
    return items.select(F.row_number().over(Window.orderBy(F.desc("usage_rate"), "item")).alias("rank"), "item", "usage_rate", F.col("clean_win_rate").alias("win_rate"))


@register("r219_gate_policy", "SELECT batch_id, least(1000, count(DISTINCT observer_tag) FILTER (WHERE observer_rank IS NOT NULL)) AS ranked_target, least(100, count(DISTINCT observer_tag) FILTER (WHERE observer_rank <= 100)) AS top_rank_target FROM obs GROUP BY batch_id", SCOPED)
def gate_policy(spark, sf_dir):
    """Targets of a batch never above what its leaderboard gave: 1,000 ranked observers, 100 of the first hundred ranks."""
    seen = ob.load(spark, sf_dir)[1]
    ranked, top = (F.countDistinct(F.when(test, F.col("observer_tag"))) for test in (F.col("observer_rank").isNotNull(), F.col("observer_rank") <= 100))
    return seen.groupBy("batch_id").agg(F.least(F.lit(1000), ranked).alias("ranked_target"), F.least(F.lit(100), top).alias("top_rank_target"))


@register("r172_loadout_catalog", "SELECT x.id AS item, count(*) FILTER (WHERE x.evolution > 0) > 0 AS evolves, count(*) FILTER (WHERE x.elite) > 0 AS elite FROM (SELECT unnest(items) AS x FROM fs) GROUP BY x.id", LOADOUTS)
def loadout_catalog(spark, sf_dir):
    return lo.item_catalog(full_sides(spark, sf_dir)).select("item", (F.col("evolution_appearances") > 0).alias("evolves"), (F.col("elite_appearances") > 0).alias("elite"))


@register(
    "r169_full_loadout_matchups",
    "SELECT deck_a, deck_b, count(*) AS games, count(*) FILTER (WHERE sa > sb) AS wins_a, count(*) FILTER (WHERE sa < sb) AS wins_b FROM (SELECT least(t.sig2, o.sig2) AS deck_a, greatest(t.sig2, o.sig2) AS deck_b, CASE WHEN t.sig2 <= o.sig2 THEN t.s ELSE t.os END AS sa, CASE WHEN t.sig2 <= o.sig2 THEN t.os ELSE t.s END AS sb FROM fs t JOIN fs o ON o.match_id = t.match_id AND o.side = 'opponent' WHERE t.side = 'team') GROUP BY ALL",
    LOADOUTS,
)
def full_loadout_matchups(spark, sf_dir):
    rows = full_sides(spark, sf_dir).withColumn("sig", lo.signature(F.col("leader"), F.col("items")))

    def of(side: str, c: str):
        return F.max(F.when(F.col("side") == side, F.col(c)))

    both = rows.groupBy("match_id").agg(of("team", "sig").alias("t"), of("opponent", "sig").alias("o"), of("team", "s").alias("team_score"), of("team", "os").alias("opponent_score"), F.max("match_time").alias("match_time"))
    return stats.matchups(both, team=F.col("t"), opponent=F.col("o")).select("deck_a", "deck_b", "games", "wins_a", "wins_b")


@register("r141_display_names", "SELECT DISTINCT entity_id, CASE WHEN entity_id LIKE '%:elite' THEN 'Elite ' WHEN entity_id LIKE '%:evolution' THEN 'Evolved ' ELSE '' END || split_part(entity_id, ':', 2) AS display_name FROM ent", LOADOUTS)
def display_names(spark, sf_dir):
    rows = lo.entity_counts(full_sides(spark, sf_dir)).select("entity_id")
    form = F.when(F.col("entity_id").endswith(":elite"), "Elite ").when(F.col("entity_id").endswith(":evolution"), "Evolved ").otherwise("")
    return rows.select("entity_id", F.concat(form, F.split_part("entity_id", F.lit(":"), F.lit(2))).alias("display_name"))


@register("r90_flag_coverage", "SELECT source, count(*) AS rows, count(quality) AS flagged, round(coalesce(avg(quality), 0), 6) AS quality_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def flag_coverage(spark, sf_dir):
    """Flag rates over the rows that report the flag, beside how many do."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    rows = docs.select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count("quality").alias("flagged"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("quality_rate"))
