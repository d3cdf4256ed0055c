"""Scope, batch and delta queries over the adapter's observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.operators import scopes as sc
from duelframe.operators import stats
from duelframe.plans.registry import query as register
from duelframe.sources import matches as src
from duelframe.sources import observations as ob

SCOPED = ob.BASE_SQL + """,
sside AS (SELECT m.dataset_scope, s.* FROM members m JOIN sides s USING (match_id)),
sn AS (SELECT dataset_scope, count(*) AS n FROM sside GROUP BY 1),
scount AS (SELECT dataset_scope, item, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws FROM (SELECT dataset_scope, unnest(deck) AS item, w, l, d FROM sside) GROUP BY ALL),
sitem AS (SELECT dataset_scope, item, games, wins, losses, draws, round(games * 100.0::DOUBLE / n, 6) AS usage_rate, CASE WHEN wins + losses = 0 THEN 0.0 ELSE round(wins * 100.0::DOUBLE / (wins + losses), 6) END AS clean_win_rate FROM scount JOIN sn USING (dataset_scope)),
wi AS (SELECT *, CASE WHEN wins + losses > 0 THEN wins::DOUBLE / (wins + losses) END AS p, (wins + losses)::DOUBLE AS nn FROM sitem),
ci AS (SELECT *, coalesce(CASE WHEN nn > 0 THEN greatest(0.0, (p + 3.8416 / (2 * nn) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * nn)) / nn)) / (1 + 3.8416 / nn)) END, 0.0) * 100 AS lo,
  coalesce(CASE WHEN nn > 0 THEN least(1.0, (p + 3.8416 / (2 * nn) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * nn)) / nn)) / (1 + 3.8416 / nn)) END, 0.0) * 100 AS hi FROM wi),
period AS (SELECT * FROM (VALUES ('7d', 'd7_14'), ('d7_14', 'd14_21'), ('d14_21', 'd21_28'), ('d21_28', 'd28_35')) t(cw, bw)),
pairs AS (SELECT cw || '_' || lv AS cs, bw || '_' || lv AS bs FROM period, levels),
ready AS (SELECT cs, bs FROM pairs WHERE cs IN (SELECT dataset_scope FROM sn) AND bs IN (SELECT dataset_scope FROM sn)),
keys AS (SELECT DISTINCT cs, bs, item FROM ready JOIN sitem ON dataset_scope IN (cs, bs)),
delta AS (SELECT k.cs AS current_scope, k.bs AS baseline_scope, k.item, coalesce(c.games, 0) AS current_games, coalesce(b.games, 0) AS baseline_games,
  coalesce(c.usage_rate, 0) - coalesce(b.usage_rate, 0) AS ud, coalesce(c.clean_win_rate, 0) - coalesce(b.clean_win_rate, 0) AS cd, coalesce(c.lo, 0) AS clo, coalesce(c.hi, 0) AS chi, coalesce(b.lo, 0) AS blo, coalesce(b.hi, 0) AS bhi
  FROM keys k LEFT JOIN ci c ON c.dataset_scope = k.cs AND c.item = k.item LEFT JOIN ci b ON b.dataset_scope = k.bs AND b.item = k.item),
deltas AS (SELECT current_scope, baseline_scope, item, current_games, baseline_games, round(ud, 6) AS usage_delta, round(cd, 6) AS clean_win_delta,
  CASE WHEN baseline_games = 0 AND current_games >= 10 THEN 'appeared' WHEN current_games = 0 AND baseline_games >= 10 THEN 'disappeared' ELSE 'changed' END AS kind,
  (baseline_games = 0 AND current_games >= 10) OR (current_games = 0 AND baseline_games >= 10) OR (current_games >= 10 AND baseline_games >= 10 AND (clo > bhi OR blo > chi) AND (abs(ud) >= 0.5 OR abs(cd) >= 3.0)) AS significant FROM delta)
"""


def sql(name: str, text: str):
    return register(name, text, SCOPED)


def _scoped(spark, sf_dir):
    rows, seen, raw = ob.load(spark, sf_dir)
    batches = sc.gate(raw)
    now = ob.now_of(raw)
    return rows, seen, batches, now, sc.membership(seen, batches, now, ob.UNIT_DAYS)


def _item_rates(spark, sf_dir):
    rows, _, _, _, members = _scoped(spark, sf_dir)
    sides = src.sides(rows.join(members, "match_id"))
    return stats.deck_rates(stats.item_counts(sides, ("dataset_scope",)), stats.side_total(sides, ("dataset_scope",)), ("dataset_scope",))


@sql("r40_scope_membership", "SELECT * FROM members")
def scope_membership(spark, sf_dir):
    return _scoped(spark, sf_dir)[4].select("dataset_scope", "match_id")


@sql("r41_scope_matches", "SELECT match_id, match_time, to_json(team_deck)::VARCHAR AS team_deck FROM valid WHERE match_id IN (SELECT match_id FROM members WHERE dataset_scope = '35d_top_500')")
def scope_matches(spark, sf_dir):
    rows, _, _, _, members = _scoped(spark, sf_dir)
    return rows.join(members.where("dataset_scope = '35d_top_500'"), "match_id", "left_semi").select("match_id", "match_time", stats.signature(F.col("team_deck")).alias("team_deck"))


@sql("r42_scope_counts", "SELECT dataset_scope, count(*) AS matches FROM members GROUP BY dataset_scope")
def scope_counts(spark, sf_dir):
    return _scoped(spark, sf_dir)[4].groupBy("dataset_scope").agg(F.count("*").alias("matches"))


@sql("r43_minimum_rank", "SELECT match_id, min(observer_rank) AS minimum_rank FROM obs JOIN gated USING (batch_id), clock WHERE status = 'accepted' AND completed_at > now - to_days(700) AND completed_at <= now GROUP BY match_id")
def minimum_rank(spark, sf_dir):
    _, seen, batches, now, _ = _scoped(spark, sf_dir)
    return sc.minimum_rank(seen, batches, now, 35, ob.UNIT_DAYS)


@sql("r44_surviving_matches", "SELECT match_id FROM valid WHERE EXISTS (SELECT 1 FROM obs WHERE obs.match_id = valid.match_id AND observer_rank <= 300)")
def surviving(spark, sf_dir):
    rows, seen, _ = ob.load(spark, sf_dir)
    return sc.survivors(rows.select("match_id"), seen.where("observer_rank <= 300"))


@sql("r77_scope_summary", "SELECT dataset_scope, count(DISTINCT match_id) AS unique_matches, count(DISTINCT cust) AS observers, max(match_time) AS latest FROM members JOIN valid USING (match_id) GROUP BY dataset_scope")
def scope_summary(spark, sf_dir):
    rows, _, _, _, members = _scoped(spark, sf_dir)
    return members.join(rows, "match_id").groupBy("dataset_scope").agg(F.countDistinct("match_id").alias("unique_matches"), F.countDistinct("cust").alias("observers"), F.max("match_time").alias("latest"))


@sql("r77_missing_dates", "SELECT day FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-03-31', INTERVAL 1 DAY))::DATE AS day) WHERE day NOT IN (SELECT completed_at::DATE FROM raw_batches)")
def missing_dates(spark, sf_dir):
    _, _, raw = ob.load(spark, sf_dir)
    return sc.missing_dates(raw, F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-03-31")))


@sql("r78_batch_gate", "SELECT batch_id, status, array_to_string(failures, ',') AS failures FROM gated")
def batch_gate(spark, sf_dir):
    return sc.gate(ob.load(spark, sf_dir)[2]).select("batch_id", "status", F.array_join("failures", ",").alias("failures"))


@sql("r106_retained_batches", "SELECT batch_id, batch_type FROM (SELECT *, row_number() OVER (PARTITION BY batch_type ORDER BY completed_at DESC, batch_id DESC) AS rn FROM gated, clock WHERE status = 'accepted' AND completed_at > now - to_days(700)) WHERE batch_type <> 'daily' OR rn <= 35")
def retained_batches(spark, sf_dir):
    _, _, batches, now, _ = _scoped(spark, sf_dir)
    return sc.retained(batches, now, 35, 35, ob.UNIT_DAYS).select("batch_id", "batch_type")


@sql("r191_expired_prune", "SELECT count(*) AS matches FROM valid WHERE match_id IN (SELECT match_id FROM obs WHERE batch_id IN (SELECT batch_id FROM gated, clock WHERE status = 'accepted' AND completed_at > now - to_days(700)))")
def expire_and_prune(spark, sf_dir):
    rows, seen, batches, now, _ = _scoped(spark, sf_dir)
    live = seen.join(sc.retained(batches, now, 35, 10_000, ob.UNIT_DAYS), "batch_id", "left_semi")
    return sc.survivors(rows, live).agg(F.count("*").alias("matches"))


@sql("r97_distinct_matches", "SELECT batch_id, count(DISTINCT match_id) AS unique_matches FROM obs GROUP BY batch_id")
def distinct_matches(spark, sf_dir):
    return ob.load(spark, sf_dir)[1].groupBy("batch_id").agg(F.countDistinct("match_id").alias("unique_matches"))


@sql("r67_scope_item_rates", "SELECT * FROM sitem")
def scope_item_rates(spark, sf_dir):
    return _item_rates(spark, sf_dir).drop("net_win_rate")


def _deltas(spark, sf_dir):
    pairs = [(f"{c}_{lv}", f"{b}_{lv}") for c, b in sc.DELTA_WINDOWS for lv in sc.LEVELS]
    return sc.adjacent_deltas(_item_rates(spark, sf_dir), pairs, "item", threshold=10)


@sql("r75_period_delta", "SELECT * FROM deltas")
def period_delta(spark, sf_dir):
    return _deltas(spark, sf_dir)


@sql("r115_delta_order", "SELECT current_scope, item, significant, usage_delta FROM deltas ORDER BY significant DESC, abs(usage_delta) DESC, abs(clean_win_delta) DESC, current_scope, item LIMIT 300")
def delta_order(spark, sf_dir):
    rows = _deltas(spark, sf_dir)
    return rows.orderBy(F.desc("significant"), F.desc(F.abs("usage_delta")), F.desc(F.abs("clean_win_delta")), "current_scope", "item").limit(300).select("current_scope", "item", "significant", "usage_delta")


@sql("r174_dataset_catalog", "SELECT w || '_' || lv AS dataset_scope, coalesce(matches, 0) AS matches, coalesce(matches, 0) > 0 AS available FROM windows CROSS JOIN levels LEFT JOIN (SELECT dataset_scope, count(*) AS matches FROM members GROUP BY 1) c ON c.dataset_scope = w || '_' || lv")
def dataset_catalog(spark, sf_dir):
    counts = _scoped(spark, sf_dir)[4].groupBy("dataset_scope").agg(F.count("*").alias("matches"))
    dim = spark.createDataFrame([(name,) for name, *_ in sc.SCOPES], "dataset_scope string")
    return dim.join(counts, "dataset_scope", "left").select("dataset_scope", F.coalesce("matches", F.lit(0)).alias("matches"), (F.coalesce("matches", F.lit(0)) > 0).alias("available"))
