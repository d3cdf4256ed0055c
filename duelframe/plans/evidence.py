"""Evidence document queries: every source type over all matches as one scope, deltas over the adapter's scopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.functions import text as tx
from duelframe.functions.archetype_rules import PARTS
from duelframe.operators import evidence as ev
from duelframe.operators import loadouts as lo
from duelframe.operators import stats
from duelframe.plans.items import BASE
from duelframe.plans.loadouts import ARCHETYPES, LOADOUTS, full_sides
from duelframe.plans.registry import query as register
from duelframe.plans.scopes import SCOPED, _deltas
from duelframe.sources import matches as src

COLUMNS = ("doc_id", "source_type", "rank", "text")
RATE = "CASE WHEN wins + losses = 0 THEN 0.0 ELSE round(wins * 100.0::DOUBLE / (wins + losses), 6) END"


def _matches(spark, sf_dir):
    return src.valid(src.matches(spark, sf_dir))


def _sides(spark, sf_dir):
    return src.sides(_matches(spark, sf_dir))


def _all(rows):
    return rows.withColumn("dataset_scope", F.lit("all"))


@register("r142_overview", "SELECT 'all:snapshot:overview' AS doc_id, 'snapshot' AS source_type, 1 AS rank, 'Rolling dataset all contains ' || count(*) || ' unique battles from ' || min(match_time) || ' through ' || max(match_time) || '.' AS text FROM valid", BASE)
def overview(spark, sf_dir):
    rows = _matches(spark, sf_dir).agg(F.count("*").alias("unique_battles"), F.min("match_time").alias("window_started_at"), F.max("match_time").alias("window_ended_at"))
    return ev.overview_documents(_all(rows)).select(*COLUMNS)


@register("r142_cards", "SELECT 'all:card:' || item AS doc_id, 'card' AS source_type, rank, 'Card evidence for ' || item || ': rank ' || rank || ', usage ' || usage_rate || '%, clean win rate ' || clean_win_rate || '%, ' || appearances || ' appearances.' AS text FROM (SELECT *, row_number() OVER (ORDER BY usage_rate DESC, item)::INT AS rank FROM item_stats)", BASE)
def cards(spark, sf_dir):
    return ev.card_documents(_all(stats.item_stats(_sides(spark, sf_dir)))).select(*COLUMNS)


@register("r142_card_profiles", "SELECT 'all:card-profile:' || item AS doc_id, 'card_profile' AS source_type, rank, 'Card profile for ' || item || ': ' || appearances || ' appearances and ' || clean_win_rate || '% win rate.' AS text FROM (SELECT *, row_number() OVER (ORDER BY appearances DESC, item)::INT AS rank FROM item_stats) WHERE rank <= 180", BASE)
def card_profiles(spark, sf_dir):
    return ev.card_profile_documents(_all(stats.item_stats(_sides(spark, sf_dir)))).select(*COLUMNS)


DECKS = "SELECT *, array_to_string(from_json(deck_signature, '[\"VARCHAR\"]'), ' / ') AS names, row_number() OVER (ORDER BY games DESC, deck_signature)::INT AS rank FROM decks"


@register("r142_decks", f"SELECT 'all:deck:' || deck_signature AS doc_id, 'deck' AS source_type, rank, 'Deck evidence: ' || names || '; ' || games || ' games, ' || clean_win_rate || '% win rate.' AS text FROM ({DECKS}) WHERE rank <= 150", BASE)
def decks(spark, sf_dir):
    return ev.deck_documents(_all(stats.deck_stats(_sides(spark, sf_dir)))).select(*COLUMNS)


@register("r142_deck_profiles", f"SELECT 'all:deck-profile:' || deck_signature AS doc_id, 'deck_profile' AS source_type, rank, 'Deck profile: ' || names || '; observed ' || games || ' times in all.' AS text FROM ({DECKS}) WHERE rank <= 150", BASE)
def deck_profiles(spark, sf_dir):
    return ev.deck_documents(_all(stats.deck_stats(_sides(spark, sf_dir))), "deck_profile").select(*COLUMNS)


@register("r142_matchups", "SELECT 'all:matchup:' || deck_a || '::' || deck_b AS doc_id, 'matchup' AS source_type, rank, 'Exact deck matchup evidence: ' || deck_a || ' versus ' || deck_b || '; ' || games || ' games, first deck won ' || wins_a || ' times.' AS text FROM (SELECT *, row_number() OVER (ORDER BY games DESC, deck_a, deck_b)::INT AS rank FROM matchups) WHERE rank <= 500", BASE)
def matchups(spark, sf_dir):
    return ev.matchup_documents(_all(stats.matchups(_matches(spark, sf_dir)))).select(*COLUMNS)


@register("r142_card_pairs", f"SELECT 'all:card-pair:' || item || '::' || teammate AS doc_id, 'card_pair' AS source_type, rank, 'Card pair ' || item || ' and ' || teammate || ' appeared in ' || games || ' side records.' AS text, sample_win_rate FROM (SELECT *, {RATE} AS sample_win_rate, row_number() OVER (ORDER BY games DESC, item, teammate)::INT AS rank FROM teammates WHERE item < teammate) WHERE rank <= 365", BASE)
def card_pairs(spark, sf_dir):
    return ev.pair_documents(_all(stats.teammates(_sides(spark, sf_dir)))).select(*COLUMNS, F.col("metadata")["sample_win_rate"].cast("double").alias("sample_win_rate"))


@register("r142_counters", f"SELECT 'all:counter:' || item || '::' || opponent AS doc_id, 'counter' AS source_type, rank, 'Observed matchup evidence for ' || item || ' against ' || opponent || ' in ' || games || ' side records.' AS text, win_rate FROM (SELECT *, {RATE} AS win_rate, row_number() OVER (ORDER BY games DESC, item, opponent)::INT AS rank FROM opponents) WHERE rank <= 300", BASE)
def counters(spark, sf_dir):
    return ev.counter_documents(_all(stats.opponents(_sides(spark, sf_dir)))).select(*COLUMNS, F.col("metadata")["win_rate"].cast("double").alias("win_rate"))


@register("r142_archetypes", f"SELECT 'all:archetype:' || archetype AS doc_id, 'archetype' AS source_type, row_number() OVER (ORDER BY games DESC, archetype)::INT AS rank, 'Archetype evidence for ' || archetype || ': ' || games || ' side records, usage ' || usage_rate || '%, win rate ' || win_rate || '%.' AS text FROM (SELECT archetype, games, round(games * 100.0::DOUBLE / (SELECT count(*) FROM sides), 6) AS usage_rate, {RATE} AS win_rate FROM (SELECT archetype, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses FROM aside GROUP BY archetype))", ARCHETYPES)
def archetypes(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    named = stats.with_outcomes(sides).withColumn("archetype", PARTS.classify(F.col("deck"))["name"])
    return ev.archetype_documents(_all(stats.deck_rates(stats.count_outcomes(named, "archetype"), stats.side_total(sides)))).select(*COLUMNS)


@register("r142_entities", "SELECT 'all:entity:' || entity_id AS doc_id, CASE WHEN entity_id LIKE 'item:%' THEN 'card_variant' ELSE 'tower' END AS source_type, rank, '完整配置实体证据：' || split_part(entity_id, ':', 2) || '，排名 ' || rank || '，使用率 ' || u || '%，胜率 ' || c || '%，样本 ' || games || ' 次。' AS text FROM (SELECT *, row_number() OVER (ORDER BY u DESC, entity_id)::INT AS rank FROM (SELECT entity_id, games, round(games * 100.0::DOUBLE / n, 6) AS u, round(clean, 6) AS c FROM er, fn))", LOADOUTS)
def entities(spark, sf_dir):
    rows = lo.entity_stats(full_sides(spark, sf_dir))
    kind = F.when(F.col("entity_id").startswith("item:"), "card").otherwise("tower")
    return ev.entity_documents(_all(rows.withColumn("entity_type", kind).withColumn("display_name", F.split_part("entity_id", F.lit(":"), F.lit(2))))).select(*COLUMNS)


@register("r142_full_loadouts", f"SELECT 'all:full-loadout:' || sig2 AS doc_id, 'full_loadout' AS source_type, rank, 'Complete loadout evidence: tower ' || leader || '; cards ' || names || '; ' || ne || ' evolved and ' || nl || ' elite cards; ' || games || ' games, ' || win_rate || '% win rate.' AS text FROM (SELECT *, {RATE} AS win_rate, row_number() OVER (ORDER BY games DESC, sig2)::INT AS rank FROM (SELECT sig2, any_value(leader) AS leader, any_value(array_to_string(list_transform(items, lambda x: x.id), ' / ')) AS names, any_value(len(list_filter(items, lambda x: x.evolution = 1))) AS ne, any_value(len(list_filter(items, lambda x: x.elite))) AS nl, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses FROM fs GROUP BY sig2)) WHERE rank <= 150", LOADOUTS)
def full_loadouts(spark, sf_dir):
    full = full_sides(spark, sf_dir)
    named = stats.with_outcomes(full).withColumn("loadout_signature", lo.signature(F.col("leader"), F.col("items")))
    rows = named.groupBy("loadout_signature").agg(F.first("leader").alias("leader"), F.first("items").alias("items"), F.count("*").alias("games"), F.sum("w").alias("wins"), F.sum("l").alias("losses"))
    return ev.loadout_documents(_all(rows.withColumn("clean_win_rate", ev.pair_rate(F.col("wins"), F.col("losses"))))).select(*COLUMNS)


@register("r142_full_matchups", "SELECT 'all:full-matchup:' || deck_a || '::' || deck_b AS doc_id, 'full_loadout_matchup' AS source_type, rank, 'Exact complete-loadout matchup: ' || games || ' games; first configuration won ' || wins_a || ' and second won ' || wins_b || '.' AS text FROM (SELECT *, row_number() OVER (ORDER BY games DESC, deck_a, deck_b)::INT AS rank FROM (SELECT deck_a, deck_b, count(*) AS games, count(*) FILTER (WHERE sa > sb) AS wins_a, count(*) FILTER (WHERE sa < sb) AS wins_b FROM (SELECT least(t.sig2, o.sig2) AS deck_a, greatest(t.sig2, o.sig2) AS deck_b, CASE WHEN t.sig2 <= o.sig2 THEN t.s ELSE t.os END AS sa, CASE WHEN t.sig2 <= o.sig2 THEN t.os ELSE t.s END AS sb FROM fs t JOIN fs o ON o.match_id = t.match_id AND o.side = 'opponent' WHERE t.side = 'team') GROUP BY ALL)) WHERE rank <= 500", LOADOUTS)
def full_matchups(spark, sf_dir):
    from duelframe.plans.more import full_loadout_matchups

    return ev.matchup_documents(_all(full_loadout_matchups(spark, sf_dir)), "full_loadout_matchup").select(*COLUMNS)


@register("r142_deltas", "SELECT current_scope || ':meta-delta:item:' || substr(sha256(item), 1, 16) AS doc_id, 'meta_delta' AS source_type, 'item ' || item || '：使用率变化 ' || usage_delta || ' 个百分点，胜率变化 ' || clean_win_delta || ' 个百分点；当前样本 ' || current_games || '，对照样本 ' || baseline_games || '，' || CASE WHEN significant THEN '达到显著阈值' ELSE '仅为观察结果' END || '。' AS text FROM deltas UNION ALL SELECT current_scope || ':meta-delta:overview', 'meta_delta', '环境变化证据：' || current_scope || ' 与 ' || baseline_scope || ' 比较，共物化 ' || count(*) || ' 项变化，其中 ' || count(*) FILTER (WHERE significant) || ' 项达到显著阈值。' FROM deltas GROUP BY current_scope, baseline_scope", SCOPED)
def deltas(spark, sf_dir):
    rows = _deltas(spark, sf_dir).select(
        F.col("current_scope").alias("dataset_scope"), "baseline_scope", F.lit("item").alias("delta_category"), F.col("item").alias("item_id"), "usage_delta",
        F.col("clean_win_delta").alias("win_delta"), F.col("current_games").alias("current_sample"), F.col("baseline_games").alias("baseline_sample"), "significant",
    )
    return ev.delta_documents(rows).select("doc_id", "source_type", "text")


def _some(spark, sf_dir):
    """Cards, decks, pairs and counters together."""
    sides = _sides(spark, sf_dir)
    parts = [ev.card_documents(_all(stats.item_stats(sides))), ev.deck_documents(_all(stats.deck_stats(sides))), ev.pair_documents(_all(stats.teammates(sides)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("r143_short_texts", f"SELECT 'all:card:' || item AS doc_id, 'Card: ' || item || '; rank: ' || rank || '; usage rate: ' || usage_rate || '%; win rate: ' || clean_win_rate || '%; clean win rate: ' || clean_win_rate || '%; ' || appearances || ' appearances' AS short FROM (SELECT *, row_number() OVER (ORDER BY usage_rate DESC, item) AS rank FROM item_stats) UNION ALL SELECT 'all:deck:' || deck_signature, 'Deck: rank ' || rank || '; ' || names || '; ' || games || ' games; win rate: ' || clean_win_rate || '%; cards: ' || replace(names, ' / ', ', ') FROM ({DECKS}) WHERE rank <= 150 UNION ALL SELECT 'all:card-pair:' || item || '::' || teammate, 'Card pair ' || item || ' and ' || teammate || ' appeared in ' || games || ' side records.' FROM (SELECT *, row_number() OVER (ORDER BY games DESC, item, teammate) AS rank FROM teammates WHERE item < teammate) WHERE rank <= 365", BASE)
def short_texts(spark, sf_dir):
    return _some(spark, sf_dir).select("doc_id", ev.short_text(F.col("text")).alias("short"))


@register("r199_probes", f"SELECT 'all:card:' || item AS doc_id, item || ' usage rate win rate sample appearances' AS probe FROM item_stats UNION ALL SELECT 'all:deck:' || deck_signature, names || ' deck cards sample games win rate' FROM ({DECKS}) WHERE rank <= 150 UNION ALL SELECT 'all:card-pair:' || item || '::' || teammate, item || ' and ' || teammate || ' synergy win rate' FROM (SELECT *, row_number() OVER (ORDER BY games DESC, item, teammate) AS rank FROM teammates WHERE item < teammate) WHERE rank <= 365", BASE)
def probes(spark, sf_dir):
    return _some(spark, sf_dir).select("doc_id", ev.probe().alias("probe"))


@register("r123_metadata_bonus", "SELECT 'all:card:' || item AS doc_id, asked, least(1.0::DOUBLE, CASE WHEN rank = asked THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN item = 'PROMO' THEN 0.6::DOUBLE ELSE 0 END) AS bonus FROM (SELECT *, row_number() OVER (ORDER BY usage_rate DESC, item) AS rank FROM item_stats), (SELECT unnest([1, 2, 3]) AS asked)", BASE)
def bonus(spark, sf_dir):
    """Cards against questions for the first three ranks that name one card."""
    docs = ev.card_documents(_all(stats.item_stats(_sides(spark, sf_dir)))).withColumn("asked", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    asked = F.struct(F.col("asked").alias("rank"), F.lit(None).cast("int").alias("round"), F.lit("promo").alias("card_name"), F.lit(True).alias("ask_players"))
    return docs.select("doc_id", "asked", ev.metadata_bonus(asked, F.col("metadata"), F.col("source_type")).alias("bonus"))


@register("r151_context", "SELECT deck AS qid, string_agg('[' || rank || '] source_type: matchup' || chr(10) || 'doc_id: ' || opponent_deck || chr(10) || 'rerank_score: ' || printf('%.4f', rate) || chr(10) || 'text: ' || games || ' games', chr(10) || chr(10) ORDER BY rank) AS context, string_agg('[' || rank || '] matchup | ' || opponent_deck || ' | corpus', chr(10) ORDER BY rank) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY games DESC, opponent_deck) AS rank FROM dclean) WHERE rank <= 3 GROUP BY deck", BASE)
def contexts(spark, sf_dir):
    directed = stats.directional(stats.matchups(_matches(spark, sf_dir)))
    order = Window.partitionBy("deck").orderBy(F.desc("games"), "opponent_deck")
    rate = F.when(F.col("wins") + F.col("losses") == 0, 0.0).otherwise(F.col("wins") * 100.0 / (F.col("wins") + F.col("losses")))
    rows = directed.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select(
        F.col("deck").alias("qid"), "rank", F.lit("matchup").alias("source_type"), F.col("opponent_deck").alias("doc_id"), rate.alias("score"), F.concat(F.col("games").cast("string"), F.lit(" games")).alias("text"), F.lit("corpus").alias("source")
    )
    return ev.context(rows)


@register("r160_validated_documents", "SELECT (SELECT count(*) FROM item_stats) + (SELECT count(*) FROM (SELECT * FROM decks LIMIT 150)) + (SELECT count(*) FROM (SELECT * FROM teammates WHERE item < teammate LIMIT 365)) AS document_count, '' AS failures", BASE)
def validated(spark, sf_dir):
    return ev.validate(_some(spark, sf_dir), spark.createDataFrame([("all",)], "dataset_scope string"))


_ASKED = ("给我 90% 胜率的卡组", "下个 版本", "精确 概率", "换成火球会让胜率", "最近三周", "必胜", "预测", "近7天使用率", "下周吃什么", "TOP 10")
_ASKED_MORE = ("环境怎么样", "提高多少", "使用率走势", "保证大家都能赢", "的准确胜率", "排名", "导致 胜率变化", "曲线", "", "?")


def _rule(*patterns: str) -> str:
    return " AND ".join(f"regexp_matches(t, '{p}')" for p in patterns)


_BOUNDARY_SQL = f"CASE WHEN {_rule(tx.GUARANTEED)} THEN 'guaranteed_outcome' WHEN {_rule(tx.FORECAST)} OR ({_rule(tx.FUTURE, tx.TARGET)}) THEN 'future_forecast' WHEN {_rule(tx.EXACT)} THEN 'exact_probability' WHEN {_rule(tx.CAUSE)} OR {_rule(tx.SWAP)} THEN 'causal_effect' WHEN {_rule(tx.PAST, tx.TREND)} THEN 'historical_trend' END"


@register("r136_boundaries", f"SELECT event_id, {_BOUNDARY_SQL} AS code FROM (SELECT event_id, lower(regexp_replace({list(_ASKED)!r}[event_id % 10 + 1] || {list(_ASKED_MORE)!r}[event_id // 10 % 10 + 1], '\\s+', '', 'g')) AS t FROM events)")
def boundaries(spark, sf_dir):
    """A hundred questions of two parts each."""
    (events,) = src.tables(spark, sf_dir, "events")
    at = [(F.col("event_id") % 10 + 1).cast("int"), (F.floor(F.col("event_id") / 10) % 10 + 1).cast("int")]
    text = F.concat(*[F.element_at(F.array(*map(F.lit, parts)), i) for parts, i in zip((_ASKED, _ASKED_MORE), at)])
    return events.select("event_id", tx.unsupported_analysis(text).alias("code"))
