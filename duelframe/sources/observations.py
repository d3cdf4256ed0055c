"""Observation and batch records, adapted from the matches: weekly batches, observers ranked by balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators.queries import numbered
from duelframe.sources import matches as src

#: Days of the adapter per day of a scope window, since its orders span years.
UNIT_DAYS = 20


def now_of(batches: DataFrame) -> Column:
    """The reference time as a column: the day after the last completion, a scalar subquery of the plan that uses it."""
    return batches.agg((F.max("completed_at") + F.expr("INTERVAL 1 DAY")).alias("t")).scalar()


def observations(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """(batch_id, match_id, observer_tag, observer_rank, observer_source, week): every third match lacks a rank."""
    ranked = numbered(customers.select("c_acctbal", F.col("c_custkey").alias("cust")), F.desc("c_acctbal"), F.col("cust"), name="rank").select("cust", F.col("rank").cast("int").alias("rank"))
    direct = F.pmod(F.substring("match_id", 2, 20).cast("long"), F.lit(3)) != 0
    return rows.join(ranked, "cust").select(
        F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd").alias("batch_id"), "match_id", F.col("cust").alias("observer_tag"),
        F.when(direct, F.col("rank")).alias("observer_rank"), F.when(direct, "ranked_direct").otherwise("expansion").alias("observer_source"),
        F.date_trunc("week", "ts").alias("week"),
    )


def batches(observed: DataFrame) -> DataFrame:
    """One batch per week with the counters that the gate reads."""
    by_week = observed.groupBy("batch_id", "week").agg(
        F.countDistinct("match_id").alias("unique_matches"), F.count("observer_rank").alias("ranked_successes"), F.count(F.when(F.col("observer_rank") <= 100, 1)).alias("top_rank_successes")
    )
    number = F.datediff("week", F.lit("1990-01-01")) / 7
    return by_week.select(
        "batch_id", (F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("completed_at"), F.when(number % 4 == 0, "weekly").otherwise("daily").alias("batch_type"),
        "unique_matches", "ranked_successes", F.col("ranked_successes").alias("ranked_target"), "top_rank_successes",
        (F.col("top_rank_successes") + F.when(number % 9 == 2, 1).otherwise(0)).alias("top_rank_target"), F.when(number % 11 == 3, 1).otherwise(0).alias("rate_limited"),
        F.when(number % 13 == 5, 2).otherwise(0).alias("conflicts"), F.when(number % 7 == 1, F.lit(0.5)).otherwise(F.lit(1.0)).alias("coverage"),
    )


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid matches, observations, batches without a status)."""
    rows = src.valid(src.matches(spark, sf_dir))
    seen = observations(rows, *src.tables(spark, sf_dir, "customer"))
    return rows, seen, batches(seen)


BASE_SQL = src.BASE_SQL + """,
ranked AS (SELECT c_custkey AS cust, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
obs AS (SELECT strftime(date_trunc('week', ts), '%Y%m%d') AS batch_id, match_id, v.cust AS observer_tag,
   CASE WHEN substr(match_id, 2)::BIGINT % 3 <> 0 THEN rank::INT END AS observer_rank, CASE WHEN substr(match_id, 2)::BIGINT % 3 <> 0 THEN 'ranked_direct' ELSE 'expansion' END AS observer_source,
   date_trunc('week', ts) AS week FROM valid v JOIN ranked USING (cust)),
raw_batches AS (SELECT batch_id, week + INTERVAL 7 DAYS AS completed_at, CASE WHEN num % 4 = 0 THEN 'weekly' ELSE 'daily' END AS batch_type, unique_matches, ranked_successes, ranked_successes AS ranked_target,
   top_rank_successes, top_rank_successes + CASE WHEN num % 9 = 2 THEN 1 ELSE 0 END AS top_rank_target, CASE WHEN num % 11 = 3 THEN 1 ELSE 0 END AS rate_limited, CASE WHEN num % 13 = 5 THEN 2 ELSE 0 END AS conflicts,
   CASE WHEN num % 7 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS coverage
   FROM (SELECT batch_id, week, date_diff('day', DATE '1990-01-01', week::DATE) / 7 AS num, count(DISTINCT match_id) AS unique_matches, count(observer_rank) AS ranked_successes, count(*) FILTER (WHERE observer_rank <= 100) AS top_rank_successes FROM obs GROUP BY batch_id, week)),
gated AS (SELECT *, CASE WHEN len(failures) = 0 THEN 'accepted' ELSE 'rejected' END AS status FROM (SELECT *, list_filter([
   CASE WHEN top_rank_successes < top_rank_target THEN 'top_rank_incomplete' END, CASE WHEN coalesce(ranked_successes::DOUBLE / nullif(ranked_target, 0), 0.0) < 0.99 THEN 'ranked_coverage' END,
   CASE WHEN rate_limited > 0 THEN 'rate_limited' END, CASE WHEN conflicts > 0 THEN 'conflicts' END, CASE WHEN coverage < 0.99 AND unique_matches < 200000 THEN 'expansion_coverage' END], lambda x: x IS NOT NULL) AS failures FROM raw_batches)),
clock AS (SELECT max(completed_at) + INTERVAL 1 DAY AS now FROM raw_batches),
windows AS (SELECT * FROM (VALUES ('7d', 0, 7), ('35d', 0, 35), ('d7_14', 7, 14), ('d14_21', 14, 21), ('d21_28', 21, 28), ('d28_35', 28, 35)) t(w, s, e)),
levels AS (SELECT * FROM (VALUES ('top_100', 100), ('top_200', 200), ('top_500', 500), ('top_1000', 1000), ('all', NULL)) t(lv, lim)),
members AS (SELECT DISTINCT w || '_' || lv AS dataset_scope, match_id FROM obs JOIN gated USING (batch_id), clock, windows, levels
   WHERE status = 'accepted' AND completed_at > now - to_days(e * 20) AND completed_at <= now - to_days(s * 20) AND (lim IS NULL OR (observer_source = 'ranked_direct' AND observer_rank <= lim)))
"""
