"""The card rule set over eight-card decks, selection and canonical form of records, scorecards, paired reports, merged scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.functions.archetype_rules import ANCHORS, CARDS, GROUPS, RULES
from duelframe.operators import evaluation as ev
from duelframe.operators import loadouts as lo
from duelframe.operators import queries as q
from duelframe.operators import scopes as sc
from duelframe.operators import stats
from duelframe.plans.evaluation import RANKING_SQL
from duelframe.plans.items import BASE
from duelframe.plans.loadouts import LOADOUTS, _rule_sql, full_sides
from duelframe.plans.registry import query as register
from duelframe.sources import matches as src
from duelframe.sources import raw

#: All card names that a rule reads, in code-point order.
NAMES = sorted(set(ANCHORS).union(*GROUPS.values(), *[{*r.anchors, *r.required_all, *r.required_any, *r.supports, *r.blockers} for r in RULES]))
_STEPS = (len(NAMES) - 1) // 7

DECKS_SQL = f"""
names AS (SELECT {NAMES!r} AS names),
udeck AS (SELECT DISTINCT sig, list_transform(range(0, 8), lambda i: names[((a + i * b) % {len(NAMES)} + 1)::BIGINT]) AS deck
  FROM (SELECT o_orderkey % {len(NAMES)} AS a, 1 + o_custkey % {_STEPS} AS b, (o_orderkey % {len(NAMES)}) || '+' || (1 + o_custkey % {_STEPS}) AS sig FROM orders), names),
cand AS ({_rule_sql(CARDS)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY score DESC, priority DESC, at_rule) AS rn FROM cand),
best AS (SELECT a.*, a.score - coalesce(b.score, 0) AS margin, b.family AS second FROM rk a LEFT JOIN rk b ON b.sig = a.sig AND b.rn = 2 WHERE a.rn = 1),
named AS (SELECT u.sig, CASE WHEN ok THEN name ELSE 'other' END AS archetype, CASE WHEN ok THEN family ELSE 'other' END AS family,
  CASE WHEN ok THEN round(least(0.99::DOUBLE, 0.58::DOUBLE + greatest(0.0, score - 5.5) * 0.045::DOUBLE + least(4.0, margin) * 0.055::DOUBLE), 3) ELSE 0.0 END AS confidence, CASE WHEN ok THEN round(score, 3) ELSE 0.0 END AS score
  FROM udeck u LEFT JOIN (SELECT *, seen < 4 AND NOT coalesce(seen >= 3 AND margin < 0.65 AND second <> family, false) AS ok FROM best) b USING (sig))
"""


def _card_decks(spark, sf_dir):
    """Decks of eight different names: every b-th name from a place that the order's key gives."""
    (orders,) = src.tables(spark, sf_dir, "orders")
    keys = orders.select((F.col("o_orderkey") % len(NAMES)).alias("a"), (1 + F.col("o_custkey") % _STEPS).alias("b")).distinct()
    names = F.array(*map(F.lit, NAMES))
    deck = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at(names, ((F.col("a") + i * F.col("b")) % len(NAMES) + 1).cast("int")))
    return keys.select(F.concat_ws("+", "a", "b").alias("sig"), deck.alias("deck"))


@register("r118_card_archetypes", "SELECT sig, archetype, family, confidence, score FROM named", DECKS_SQL)
def card_archetypes(spark, sf_dir):
    """All 22 rules, decks without a rule and those with too many anchors included."""
    return _card_decks(spark, sf_dir).select("sig", CARDS.classify(F.col("deck")).alias("c")).select("sig", F.col("c.name").alias("archetype"), "c.family", "c.confidence", "c.score")


@register("r119_families", "SELECT archetype, family, count(*) AS decks FROM named GROUP BY ALL", DECKS_SQL)
def families(spark, sf_dir):
    """Families looked up by an archetype's name."""
    named = _card_decks(spark, sf_dir).select(CARDS.classify(F.col("deck"))["name"].alias("archetype")).groupBy("archetype").agg(F.count("*").alias("decks"))
    return named.select("archetype", CARDS.family_of(F.col("archetype")).alias("family"), "decks")


def _both_views(spark, sf_dir):
    """Every match as both of its players logged it."""
    rows = src.matches(spark, sf_dir)
    turned = {c: F.col({"team": "opponent", "oppo": "team"}[c[:4]] + c[c.index("_"):]) if c.startswith(("team_", "opponent_")) else F.col(c) for c in rows.columns}
    return rows.unionByName(rows.select(*[v.alias(c) for c, v in turned.items()]))


@register("r24_usable_matches", "SELECT match_id, least(team_tag, opponent_tag) AS team_tag, greatest(team_tag, opponent_tag) AS opponent_tag FROM valid", BASE)
def usable_matches(spark, sf_dir):
    return raw.usable(_both_views(spark, sf_dir), src.SIZE).select("match_id", "team_tag", "opponent_tag")


@register("r24_selection_counters", "SELECT 2 * count(*) AS inspected, 2 * count(*) - 2 * (SELECT count(*) FROM valid) AS incomplete, (SELECT count(*) FROM valid) AS duplicates, (SELECT count(*) FROM valid) AS usable FROM matches", BASE)
def selection_counters(spark, sf_dir):
    return raw.selection_counters(_both_views(spark, sf_dir), src.SIZE)


@register("r26_canonical_matches", "SELECT match_id, least(team_tag, opponent_tag) AS team_tag, greatest(team_tag, opponent_tag) AS opponent_tag, CASE WHEN team_tag <= opponent_tag THEN team_score ELSE opponent_score END AS team_score, CASE WHEN team_tag <= opponent_tag THEN opponent_score ELSE team_score END AS opponent_score, to_json(CASE WHEN team_tag <= opponent_tag THEN team_deck ELSE opponent_deck END)::VARCHAR AS team_deck FROM matches", BASE)
def canonical_matches(spark, sf_dir):
    """Both views of a match have one canonical form."""
    return raw.canonical(_both_views(spark, sf_dir)).select("match_id", "team_tag", "opponent_tag", "team_score", "opponent_score", F.to_json("team_deck").alias("team_deck")).distinct()


@register("r54_opponent_loadouts", "SELECT a.match_id, a.tag, a.leader, b.leader AS opponent_leader, b.sig2 AS opponent_signature FROM fs a LEFT JOIN fs b ON b.match_id = a.match_id AND b.tag <> a.tag", LOADOUTS)
def opponent_loadouts(spark, sf_dir):
    """Every side with its opponent's configuration, by one join."""
    rows = full_sides(spark, sf_dir)
    other = rows.select(F.col("match_id").alias("_match"), F.col("tag").alias("_tag"), F.col("leader").alias("opponent_leader"), lo.signature(F.col("leader"), F.col("items")).alias("opponent_signature"))
    return rows.join(other, F.expr("match_id = _match AND tag <> _tag"), "left").select("match_id", "tag", "leader", "opponent_leader", "opponent_signature")


@register("r15_merged_scopes", "SELECT 'items' AS dataset_scope, item, NULL AS deck_signature, appearances AS games, wins FROM item_stats UNION ALL SELECT 'decks', NULL, deck_signature, games, wins FROM decks", BASE)
def merged_scopes(spark, sf_dir):
    sides = src.sides(src.valid(src.matches(spark, sf_dir)))
    items = stats.item_stats(sides).select("item", F.col("appearances").alias("games"), "wins")
    return sc.merged({"items": items, "decks": stats.deck_stats(sides).select("deck_signature", "games", "wins")})


@register("r209_next_round", "SELECT round, o_orderkey FROM (SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS round FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-15') WHERE round = (SELECT min(year(o_orderdate) * 100 + month(o_orderdate)) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-15')")
def upcoming(spark, sf_dir):
    (orders,) = src.tables(spark, sf_dir, "orders")
    rows = orders.where("o_orderdate >= TIMESTAMP '1996-06-15'").select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("round"), "o_orderkey")
    return q.next_round(rows)


@register("r221_generation_id", "SELECT 'gen-' || strftime(max(latest)::DATE, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(string_agg(line, ',' ORDER BY line)), 1, 12) AS generation_id FROM (SELECT o_orderstatus || ':' || count(*) || ':' || strftime(max(o_orderdate), '%Y-%m-%d') AS line, max(o_orderdate) AS latest FROM orders GROUP BY o_orderstatus)")
def generation(spark, sf_dir):
    (orders,) = src.tables(spark, sf_dir, "orders")
    rows = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))
    stamp = F.max(F.to_timestamp("latest"))
    return sc.generation_id(rows, stamp)


_REPORT_SQL = """
reports AS (SELECT event_type, event_id % 10 = 9 AS skipped,
  CASE WHEN event_type = 'view' THEN event_id % 4 END AS retrieval_relevant, CASE WHEN event_type = 'view' THEN 4 END AS retrieval_expected,
  CASE WHEN event_type = 'click' THEN event_id % 3 END AS assertions_supported, CASE WHEN event_type = 'click' THEN 3 END AS assertions_total,
  CASE WHEN event_id % 2 = 0 THEN 1 END AS citations_correct, CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 3 END AS citations_total,
  CASE WHEN event_id % 5 = 0 THEN event_id % 7 > 1 END AS refusal_correct, CASE WHEN event_id % 3 = 0 THEN event_id % 4 - 1 END AS boundary_violations,
  CASE WHEN event_id % 6 > 1 THEN value END AS first_token_latency_ms, value AS total_latency_ms, CASE WHEN event_id % 4 = 1 THEN event_id % 11 = 0 END AS timed_out,
  CASE WHEN event_id % 4 = 2 THEN event_id % 5 = 0 END AS fallback_used, event_id % 1000 - 10 AS token_count, (event_id % 100)::DOUBLE / 1000 AS estimated_cost FROM events)
"""


def _metric_sql() -> str:
    def part(a: str, b: str) -> str:
        return f"coalesce(sum(greatest({a}, 0))::DOUBLE / nullif(sum(greatest({b}, 0)), 0), 0.0)"

    def rate(test: str, over: str) -> str:
        return f"coalesce(count(*) FILTER (WHERE {test})::DOUBLE / nullif(count({over}), 0), 0.0)"

    made = {
        "retrieval_recall": part("retrieval_relevant", "retrieval_expected"), "assertion_support_rate": part("assertions_supported", "assertions_total"),
        "citation_precision": part("citations_correct", "citations_total"), "refusal_accuracy": rate("refusal_correct", "refusal_correct"),
        "boundary_violation_rate": rate("boundary_violations > 0", "boundary_violations"), "first_token_latency_ms": "coalesce(avg(first_token_latency_ms), 0.0)",
        "total_latency_ms": "coalesce(avg(total_latency_ms), 0.0)", "timeout_rate": rate("timed_out", "timed_out"), "fallback_rate": rate("fallback_used", "fallback_used"),
        "token_count": "sum(greatest(token_count, 0))::BIGINT", "estimated_cost": "coalesce(sum(greatest(estimated_cost, 0.0)), 0.0)",
    }
    values = ", ".join(f"{v} AS {m}" if m == "token_count" else f"round({v}, 8) AS {m}" for m, v in made.items())
    rows = ", ".join(f"count(*) FILTER (WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)}) AS {m}_rows" for m, cols in ev.METRIC_FIELDS.items())
    return f"SELECT event_type, count(*) AS case_count, {values}, {rows} FROM reports WHERE NOT skipped GROUP BY event_type"


@register("r90_metrics", _metric_sql(), _REPORT_SQL)
def metrics(spark, sf_dir):
    """Eleven metrics of report rows, made from events so that each reports some of the fields."""
    (events,) = src.tables(spark, sf_dir, "events")
    rows = events.selectExpr(
        "event_type", "event_id % 10 = 9 AS skipped", "CASE WHEN event_type = 'view' THEN event_id % 4 END AS retrieval_relevant", "CASE WHEN event_type = 'view' THEN 4 END AS retrieval_expected",
        "CASE WHEN event_type = 'click' THEN event_id % 3 END AS assertions_supported", "CASE WHEN event_type = 'click' THEN 3 END AS assertions_total",
        "CASE WHEN event_id % 2 = 0 THEN 1 END AS citations_correct", "CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 3 END AS citations_total",
        "CASE WHEN event_id % 5 = 0 THEN event_id % 7 > 1 END AS refusal_correct", "CASE WHEN event_id % 3 = 0 THEN event_id % 4 - 1 END AS boundary_violations",
        "CASE WHEN event_id % 6 > 1 THEN value END AS first_token_latency_ms", "value AS total_latency_ms", "CASE WHEN event_id % 4 = 1 THEN event_id % 11 = 0 END AS timed_out",
        "CASE WHEN event_id % 4 = 2 THEN event_id % 5 = 0 END AS fallback_used", "event_id % 1000 - 10 AS token_count", "CAST(event_id % 100 AS DOUBLE) / 1000 AS estimated_cost",
    )
    return ev.scorecard(rows, "event_type")


_PAIRED_SQL = RANKING_SQL.strip() + """,
ranked2 AS (SELECT l_orderkey AS case_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS rn FROM lineitem),
cases2 AS (SELECT case_id, min(l_partkey) AS relevant, list(l_partkey ORDER BY rn) AS retrieved FROM ranked2 GROUP BY case_id),
scores2 AS (SELECT case_id, CASE WHEN pos > 0 THEN 1 ELSE 0 END AS recall_at_k, CASE WHEN pos > 0 THEN 1.0::DOUBLE / pos ELSE 0.0::DOUBLE END AS reciprocal_rank FROM (SELECT case_id, coalesce(list_position(retrieved[1:5], relevant), 0) AS pos FROM cases2)),
both_runs AS (SELECT 'recall_at_k' AS metric, a.recall_at_k::DOUBLE AS b, c.recall_at_k::DOUBLE AS t FROM scores a JOIN scores2 c USING (case_id) UNION ALL SELECT 'reciprocal_rank', a.reciprocal_rank, c.reciprocal_rank FROM scores a JOIN scores2 c USING (case_id))
"""


@register("r95_paired_report", "SELECT metric, count(*) AS cases, round(avg(b), 6) AS baseline_mean, round(avg(t), 6) AS treatment_mean, round(avg(t - b), 6) AS mean_delta, round(avg(t - b) / stddev_samp(t - b), 6) AS effect FROM both_runs GROUP BY metric", _PAIRED_SQL)
def paired(spark, sf_dir):
    """Lines of an order ranked by price against by quantity."""
    (lines,) = src.tables(spark, sf_dir, "lineitem")

    def run(by: str):
        order = F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("p"), F.col("l_partkey").alias("k"))))
        return ev.case_scores(lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min("l_partkey").alias("relevant"), F.transform(order, lambda x: x["k"]).alias("retrieved")), 5)

    return ev.paired_report(run("l_extendedprice"), run("l_quantity"))
