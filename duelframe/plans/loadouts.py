"""Configuration, entity and archetype queries; forms are adapted from the lines' tax and discount, leaders from order priorities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.functions import rates
from duelframe.functions.archetype_rules import PARTS
from duelframe.operators import loadouts as lo
from duelframe.operators import scopes as sc
from duelframe.operators import stats
from duelframe.plans.items import BASE
from duelframe.plans.registry import query as register
from duelframe.sources import matches as src


def _rule_sql(rules) -> str:
    """The rule set as SQL: one scored row per basket and rule."""
    def names(xs) -> str:
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]"

    def hits(xs) -> str:
        return f"len(list_intersect(deck, {names(xs)}))"

    parts = []
    for i, r in enumerate(rules.rules):
        total, test = f"5.5::DOUBLE + 0.4::DOUBLE * ({hits(r.anchors)} - 1)", f"{hits(r.anchors)} > 0"
        if r.required_all:
            total, test = f"{total} + 1.5::DOUBLE", f"{test} AND {hits(r.required_all)} = {len(r.required_all)}"
        if r.required_any:
            total, test = f"{total} + 0.8::DOUBLE", f"{test} AND {hits(r.required_any)} > 0"
        total += "".join(f" + CASE WHEN list_contains(deck, '{n}') THEN {w}::DOUBLE ELSE 0 END" for n, w in r.supports.items())
        total += "".join(f" - CASE WHEN list_contains(deck, '{n}') THEN {w}::DOUBLE ELSE 0 END" for n, w in r.blockers.items())
        total += "".join(f" + least({hits(rules.features[n])}, 4) * {w}::DOUBLE" for n, w in r.features.items())
        parts.append(f"SELECT sig, deck, {hits(rules.strategic)} AS seen, '{r.name}' AS name, '{r.family}' AS family, {r.priority} AS priority, {i} AS at_rule, {total} AS score FROM udeck WHERE {test} AND {total} >= {r.least}")
    return " UNION ALL ".join(parts)


ARCHETYPES = BASE + f""",
udeck AS (SELECT DISTINCT sig, deck FROM sides),
cand AS ({_rule_sql(PARTS)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY score DESC, priority DESC, at_rule) AS rn FROM cand),
best AS (SELECT a.sig, a.name, a.family, a.score, a.seen, a.score - coalesce(b.score, 0) AS margin, b.family AS second FROM rk a LEFT JOIN rk b ON b.sig = a.sig AND b.rn = 2 WHERE a.rn = 1),
arch AS (SELECT u.sig, u.deck, CASE WHEN ok THEN name ELSE 'other' END AS archetype, CASE WHEN ok THEN family ELSE 'other' END AS family,
  CASE WHEN ok THEN round(least(0.99::DOUBLE, 0.58::DOUBLE + greatest(0.0, score - 5.5) * 0.045::DOUBLE + least(4.0, margin) * 0.055::DOUBLE), 3) ELSE 0.0 END AS confidence, CASE WHEN ok THEN round(score, 3) ELSE 0.0 END AS score
  FROM udeck u LEFT JOIN (SELECT *, NOT coalesce(seen >= 3 AND margin < 0.65 AND second <> family, false) AS ok FROM best) b USING (sig)),
aside AS (SELECT s.*, x.archetype, y.archetype AS oarchetype FROM sides s JOIN arch x ON x.sig = s.sig JOIN arch y ON y.sig = s.osig)
"""

LOADOUTS = BASE + """,
forms AS (SELECT l_orderkey AS ok, p_type AS id, (max(l_tax) >= 0.07)::INT AS evolution, max(l_discount) >= 0.09 AS elite FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
config AS (SELECT ok, o_orderpriority AS leader, list({'id': id, 'evolution': evolution, 'elite': elite} ORDER BY id) AS items, sum(evolution)::INT AS ne, count(*) FILTER (WHERE elite) AS nl, count(*) AS n,
  string_agg('["' || id || '",' || evolution || ',' || CASE WHEN elite THEN 'true' ELSE 'false' END || ']', ',' ORDER BY id) AS body FROM forms JOIN orders ON o_orderkey = ok GROUP BY ok, o_orderpriority),
good AS (SELECT *, 'loadout-v1:' || sha256('{"cards":[' || body || '],"leader":"' || leader || '"}') AS sig2 FROM config WHERE n = 3 AND ne <= 2 AND nl <= 2 AND ne + nl <= 3),
fs AS (SELECT s.*, g.leader, g.items, g.sig2 FROM sides s JOIN good g ON '#' || g.ok = s.tag WHERE s.match_id IN (SELECT match_id FROM sides x JOIN good h ON '#' || h.ok = x.tag GROUP BY match_id HAVING count(*) = 2)),
fn AS (SELECT count(*) AS n FROM fs),
ent AS (SELECT 'leader:' || leader AS entity_id, w, l, d FROM fs UNION ALL SELECT 'item:' || x.id || ':' || CASE WHEN x.elite THEN 'elite' WHEN x.evolution > 0 THEN 'evolution' ELSE 'ordinary' END, w, l, d FROM (SELECT unnest(items) AS x, w, l, d FROM fs)),
ec AS (SELECT entity_id, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws FROM ent GROUP BY entity_id),
er AS (SELECT *, CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END AS clean, cume_dist() OVER (ORDER BY games) AS pct FROM ec),
lstat AS (SELECT sig2 AS loadout_signature, sig AS base_deck_signature, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws, sum(s)::BIGINT AS score FROM fs GROUP BY ALL)
"""


def _sides(spark, sf_dir):
    return src.sides(src.valid(src.matches(spark, sf_dir)))


def full_sides(spark, sf_dir):
    """Sides of matches both of whose configurations are complete."""
    orders, lines, part = src.tables(spark, sf_dir, "orders", "lineitem", "part")
    forms = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("ok"), F.col("p_type").alias("id")).agg(
        (F.max("l_tax") >= 0.07).cast("int").alias("evolution"), (F.max("l_discount") >= 0.09).alias("elite")
    )
    config = forms.groupBy("ok").agg(F.array_sort(F.collect_list(F.struct("id", "evolution", "elite"))).alias("items")).join(orders, F.col("ok") == F.col("o_orderkey"))
    good = config.where(lo.complete(F.col("o_orderpriority"), F.col("items"), src.SIZE)).select(F.concat(F.lit("#"), F.col("ok").cast("string")).alias("tag"), F.col("o_orderpriority").alias("leader"), "items")
    rows = _sides(spark, sf_dir).join(good, "tag")
    return rows.withColumn("_both", F.count("*").over(Window.partitionBy("match_id"))).where("_both = 2").drop("_both")


@register("r118_archetypes", "SELECT sig AS deck_signature, archetype, family, confidence, score FROM arch", ARCHETYPES)
def archetypes(spark, sf_dir):
    decks = _sides(spark, sf_dir).select("deck").distinct()
    return decks.select(stats.signature(F.col("deck")).alias("deck_signature"), PARTS.classify(F.col("deck")).alias("c")).select("deck_signature", F.col("c.name").alias("archetype"), "c.family", "c.confidence", "c.score")


@register("r71_archetype_stats", "SELECT archetype, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sides), 6) AS usage_rate FROM aside GROUP BY archetype", ARCHETYPES)
def archetype_stats(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    named = stats.with_outcomes(sides).withColumn("archetype", PARTS.classify(F.col("deck"))["name"])
    return stats.deck_rates(stats.count_outcomes(named, "archetype"), stats.side_total(sides)).drop("clean_win_rate", "net_win_rate")


@register("r71_archetype_matchups", "SELECT archetype, oarchetype AS opponent_archetype, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws FROM aside GROUP BY ALL", ARCHETYPES)
def archetype_matchups(spark, sf_dir):
    rows = stats.with_outcomes(_sides(spark, sf_dir)).withColumn("archetype", PARTS.classify(F.col("deck"))["name"]).withColumn("opponent_archetype", PARTS.classify(F.col("opp"))["name"])
    return stats.count_outcomes(rows, "archetype", "opponent_archetype")


@register("r46_archetype_decks", "SELECT archetype, deck_signature, games, rank FROM (SELECT archetype, sig AS deck_signature, count(*) AS games, row_number() OVER (PARTITION BY archetype ORDER BY count(*) DESC, sig)::INT AS rank FROM aside GROUP BY archetype, sig) WHERE rank <= 3", ARCHETYPES)
def archetype_decks(spark, sf_dir):
    counts = _sides(spark, sf_dir).groupBy("deck").agg(F.count("*").alias("games"))
    named = counts.select(PARTS.classify(F.col("deck"))["name"].alias("archetype"), stats.signature(F.col("deck")).alias("deck_signature"), "games")
    order = Window.partitionBy("archetype").orderBy(F.desc("games"), "deck_signature")
    return named.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


@register("r87_core_items", "SELECT archetype, item, games, round(games * 100.0::DOUBLE / sum(games) OVER (PARTITION BY archetype), 6) AS share FROM (SELECT archetype, item, count(*) AS games FROM (SELECT archetype, unnest(deck) AS item FROM aside) GROUP BY ALL)", ARCHETYPES)
def core_items(spark, sf_dir):
    rows = _sides(spark, sf_dir).withColumn("archetype", PARTS.classify(F.col("deck"))["name"]).select("archetype", F.explode("deck").alias("item")).groupBy("archetype", "item").agg(F.count("*").alias("games"))
    return rows.withColumn("share", rates.rnd(rates.share(F.col("games"), F.sum("games").over(Window.partitionBy("archetype")))))


@register("r65_full_loadouts", "SELECT *, round(games * 100.0::DOUBLE / n, 6) AS usage_rate, round(CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END, 6) AS clean_win_rate, round(CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END - 50, 6) AS net_win_rate FROM lstat, fn".replace("SELECT *,", "SELECT lstat.*,"), LOADOUTS)
def full_loadouts(spark, sf_dir):
    return lo.loadout_stats(full_sides(spark, sf_dir))


@register("r66_item_catalog", "SELECT x.id AS item, count(*) AS appearances, count(*) FILTER (WHERE x.evolution > 0) AS evolution_appearances, count(*) FILTER (WHERE x.elite) AS elite_appearances FROM (SELECT unnest(items) AS x FROM fs) GROUP BY x.id", LOADOUTS)
def item_catalog(spark, sf_dir):
    return lo.item_catalog(full_sides(spark, sf_dir))


@register("r72_entities", "SELECT entity_id, games AS appearances, wins, losses, draws, round(games * 100.0::DOUBLE / n, 6) AS usage_rate, round(clean, 6) AS clean_win_rate, round(pct * 100, 6) AS usage_percentile FROM er, fn", LOADOUTS)
def entities(spark, sf_dir):
    return lo.entity_stats(full_sides(spark, sf_dir)).select("entity_id", "appearances", "wins", "losses", "draws", "usage_rate", "clean_win_rate", "usage_percentile")


@register("r171_entity_rankings", "SELECT rank() OVER (ORDER BY round(games * 100.0::DOUBLE / n, 6) DESC)::INT AS rank, entity_id, round(games * 100.0::DOUBLE / n, 6) AS usage_rate FROM er, fn", LOADOUTS)
def entity_rankings(spark, sf_dir):
    rows = lo.entity_stats(full_sides(spark, sf_dir))
    return rows.select(F.rank().over(Window.orderBy(F.desc("usage_rate"))).alias("rank"), "entity_id", "usage_rate")


@register("r73_leaders", "SELECT leader, count(*) AS appearances, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws, round(count(*) * 100.0::DOUBLE / (SELECT n FROM fn), 6) AS usage_rate, round(CASE WHEN sum(w) + sum(l) = 0 THEN 0.0 ELSE sum(w) * 100.0::DOUBLE / (sum(w) + sum(l)) END, 6) AS clean_win_rate FROM fs GROUP BY leader", LOADOUTS)
def leaders(spark, sf_dir):
    return lo.feature_stats(full_sides(spark, sf_dir), "leader")


@register("r73_elites", "SELECT item, count(*) AS appearances, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws, round(count(*) * 100.0::DOUBLE / (SELECT n FROM fn), 6) AS usage_rate, round(CASE WHEN sum(w) + sum(l) = 0 THEN 0.0 ELSE sum(w) * 100.0::DOUBLE / (sum(w) + sum(l)) END, 6) AS clean_win_rate FROM (SELECT x.id AS item, w, l, d FROM (SELECT unnest(items) AS x, w, l, d FROM fs) WHERE x.elite) GROUP BY item", LOADOUTS)
def elites(spark, sf_dir):
    return lo.feature_stats(full_sides(spark, sf_dir), "elite")


@register("r76_divergence", "SELECT coalesce(a.sig, b.deck_signature) AS deck_signature, coalesce(a.games, 0) AS current_games, b.games AS baseline_games, round(coalesce(a.u, 0) - b.usage_rate, 6) AS usage_delta FROM decks b LEFT JOIN (SELECT base_deck_signature AS sig, sum(games)::BIGINT AS games, round(sum(games) * 100.0::DOUBLE / (SELECT n FROM fn), 6) AS u FROM lstat GROUP BY 1) a ON a.sig = b.deck_signature", LOADOUTS)
def divergence(spark, sf_dir):
    full = full_sides(spark, sf_dir)
    rolled = stats.deck_rates(lo.rolled_up(lo.loadout_stats(full)), stats.side_total(full))
    return sc.period_delta(rolled, stats.deck_stats(_sides(spark, sf_dir)), ["deck_signature"], 30).select("deck_signature", "current_games", "baseline_games", "usage_delta")
