"""Evidence documents of every scope: one select per source type, ranked and limited inside its scope; then probes, short forms and context.

All frames have a column ``dataset_scope``. A document is (doc_id, dataset_scope, source_type, rank, text, metadata).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import rates

# The texts of evidence documents by source type, their short forms, the probes that ask for them, and most documents of a type in one scope.
TEXTS = {
    "snapshot": "Rolling dataset {dataset_scope} contains {unique_battles} unique battles from {window_started_at} through {window_ended_at}.",
    "card": "Card evidence for {card_name}: rank {rank}, usage {usage_rate}%, clean win rate {clean_win_rate}%, {appearance_count} appearances.",
    "entity": "完整配置实体证据：{display_name}，排名 {rank}，使用率 {usage_rate}%，胜率 {win_rate}%，样本 {appearance_count} 次。",
    "deck": "Deck evidence: {deck_name}; {games} games, {sample_win_rate}% win rate.",
    "deck_profile": "Deck profile: {deck_name}; observed {games} times in {dataset_scope}.",
    "archetype": "Archetype evidence for {archetype}: {games} side records, usage {usage_rate}%, win rate {win_rate}%.",
    "delta_overview": "环境变化证据：{dataset_scope} 与 {baseline_scope} 比较，共物化 {delta_count} 项变化，其中 {significant_count} 项达到显著阈值。",
    "meta_delta": "{delta_category} {item_id}：使用率变化 {usage_delta} 个百分点，胜率变化 {win_delta} 个百分点；当前样本 {current_sample}，对照样本 {baseline_sample}，{verdict}。",
    "full_loadout": "Complete loadout evidence: tower {tower}; cards {deck_name}; {evolved} evolved and {elite} elite cards; {games} games, {win_rate}% win rate.",
    "full_loadout_matchup": "Exact complete-loadout matchup: {games} games; first configuration won {wins} and second won {losses}.",
    "matchup": "Exact deck matchup evidence: {deck_name} versus {opponent_deck_name}; {games} games, first deck won {wins} times.",
    "card_pair": "Card pair {card_name} and {teammate} appeared in {games} side records.",
    "counter": "Observed matchup evidence for {card_name} against {opponent_card_name} in {games} side records.",
    "card_profile": "Card profile for {card_name}: {games} appearances and {win_rate}% win rate.",
}
VERDICTS = ("达到显著阈值", "仅为观察结果")
SHORT = {
    "deck": "Deck: rank {rank}; {deck_name}; {games} games; win rate: {sample_win_rate}%; cards: {cards}",
    "card": "Card: {card_name}; rank: {rank}; usage rate: {usage_rate}%; win rate: {win_rate}%; clean win rate: {clean_win_rate}%; {appearance_count} appearances",
    "archetype": "体系：{archetype}；出现次数：{games} 次（卡组侧记录）；使用率：{usage_rate}%；干净胜率：{win_rate}%",
}
PROBES = {
    "snapshot": "current environment official sample overview",
    "card": "{card_name} usage rate win rate sample appearances",
    "deck": "{deck_name} deck cards sample games win rate",
    "matchup": "{deck_name} versus {opponent_deck_name} matchup win rate",
    "card_profile": "{card_name} common teammates opponents card profile",
    "deck_profile": "{deck_name} common opposing decks performance",
    "archetype": "{archetype} archetype usage win rate matchups",
    "card_pair": "{card_name} and {teammate} synergy win rate",
    "counter": "{card_name} against {opponent_card_name} counter matchup",
}
LIMITS = {"deck": 150, "deck_profile": 150, "meta_delta": 300, "full_loadout": 150, "full_loadout_matchup": 500, "matchup": 500, "card_pair": 365, "counter": 300, "card_profile": 180}


def filled(template: str, value=F.col) -> Column:
    """The template with its {names} replaced by columns; null where one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[value(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def documents(rows: DataFrame, kind: str, key: Column, order: list[Column], source_type: Column | None = None, path: str | None = None) -> DataFrame:
    """Documents of one kind; every column of ``rows`` goes to the metadata."""
    at = F.row_number().over(Window.partitionBy("dataset_scope").orderBy(*order))
    ranked = rows.withColumn("rank", at)
    if kind in LIMITS:
        ranked = ranked.where(F.col("rank") <= LIMITS[kind])
    pairs = [x for c in ranked.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return ranked.select(
        F.concat_ws(":", "dataset_scope", F.lit(path or kind), key).alias("doc_id"), "dataset_scope", (F.lit(kind) if source_type is None else source_type).alias("source_type"),
        "rank", filled(TEXTS[kind]).alias("text"), F.create_map(*pairs).alias("metadata"),
    )


def pair_rate(wins: Column, losses: Column) -> Column:
    """Share of decided games in percent, 0 without any."""
    return rates.rnd(rates.clean_rate(wins, losses))


def overview_documents(scopes: DataFrame) -> DataFrame:
    """One per scope: unique_battles, window_started_at, window_ended_at."""
    return documents(scopes, "snapshot", F.lit("overview"), [F.lit(1)], path="snapshot")


def card_documents(items: DataFrame) -> DataFrame:
    rows = items.select("dataset_scope", F.col("item").alias("card_name"), "usage_rate", F.col("clean_win_rate").alias("win_rate"), "clean_win_rate", F.col("appearances").alias("appearance_count"))
    return documents(rows, "card", F.col("card_name"), [F.desc("usage_rate"), F.col("card_name")])


def card_profile_documents(items: DataFrame) -> DataFrame:
    rows = items.select("dataset_scope", F.col("item").alias("card_name"), F.col("appearances").alias("games"), F.col("clean_win_rate").alias("win_rate"))
    return documents(rows, "card_profile", F.col("card_name"), [F.desc("games"), F.col("card_name")], path="card-profile")


def entity_documents(entities: DataFrame) -> DataFrame:
    """Variants of cards and towers: entity_id, entity_type, display_name and rates."""
    rows = entities.select("dataset_scope", "entity_id", "entity_type", "display_name", "usage_rate", F.col("clean_win_rate").alias("win_rate"), F.col("appearances").alias("appearance_count"))
    return documents(rows, "entity", F.col("entity_id"), [F.desc("usage_rate"), F.col("entity_id")], F.when(F.col("entity_type") == "card", "card_variant").otherwise("tower"))


def deck_documents(decks: DataFrame, kind: str = "deck") -> DataFrame:
    """``deck`` or ``deck_profile`` documents of the most played baskets."""
    names = F.from_json("deck_signature", "array<string>")
    rows = decks.select(
        "dataset_scope", "deck_signature", F.array_join(names, " / ").alias("deck_name"), F.array_join(F.slice(names, 1, 8), ", ").alias("cards"), "games",
        F.col("clean_win_rate").alias("sample_win_rate"),
    )
    return documents(rows, kind, F.col("deck_signature"), [F.desc("games"), F.col("deck_signature")], path=kind.replace("_", "-"))


def archetype_documents(archetypes: DataFrame) -> DataFrame:
    rows = archetypes.select("dataset_scope", "archetype", "games", "usage_rate", F.col("clean_win_rate").alias("win_rate"))
    return documents(rows, "archetype", F.col("archetype"), [F.desc("games"), F.col("archetype")])


def delta_documents(deltas: DataFrame) -> DataFrame:
    """The strongest changes of each scope, and an overview that counts them."""
    order = [F.desc("significant"), F.desc(F.abs("usage_delta")), F.desc(F.abs("win_delta")), F.col("item_id")]
    chosen = deltas.withColumn("at", F.row_number().over(Window.partitionBy("dataset_scope").orderBy(*order))).where(F.col("at") <= LIMITS["meta_delta"]).drop("at")
    rows = chosen.withColumn("verdict", F.when(F.col("significant"), VERDICTS[0]).otherwise(VERDICTS[1]))
    each = documents(rows, "meta_delta", F.concat_ws(":", "delta_category", F.substring(F.sha2(F.col("item_id"), 256), 1, 16)), order, path="meta-delta")
    counted = chosen.groupBy("dataset_scope", "baseline_scope").agg(F.count("*").alias("delta_count"), F.count(F.when(F.col("significant"), 1)).alias("significant_count"))
    return documents(counted, "delta_overview", F.lit("overview"), [F.col("baseline_scope")], F.lit("meta_delta"), path="meta-delta").unionByName(each)


def loadout_documents(loadouts: DataFrame) -> DataFrame:
    """Complete configurations: loadout_signature, leader, items (id, evolution, elite), games and rate."""
    rows = loadouts.select(
        "dataset_scope", "loadout_signature", F.col("leader").alias("tower"), F.array_join(F.transform("items", lambda x: x["id"]), " / ").alias("deck_name"),
        F.size(F.filter("items", lambda x: x["evolution"] == 1)).alias("evolved"), F.size(F.filter("items", lambda x: x["elite"])).alias("elite"), "games",
        F.col("clean_win_rate").alias("win_rate"),
    )
    return documents(rows, "full_loadout", F.col("loadout_signature"), [F.desc("games"), F.col("loadout_signature")], path="full-loadout")


def matchup_documents(matchups: DataFrame, kind: str = "matchup") -> DataFrame:
    """``matchup`` or ``full_loadout_matchup`` documents of the most played pairs."""
    rows = matchups.select(
        "dataset_scope", F.col("deck_a").alias("deck_name"), F.col("deck_b").alias("opponent_deck_name"), "games", F.col("wins_a").alias("wins"), F.col("wins_b").alias("losses"),
        pair_rate(F.col("wins_a"), F.col("wins_b")).alias("win_rate"),
    )
    path = "matchup" if kind == "matchup" else "full-matchup"
    return documents(rows, kind, F.concat_ws("::", "deck_name", "opponent_deck_name"), [F.desc("games"), F.col("deck_name"), F.col("opponent_deck_name")], path=path)


def pair_documents(teammates: DataFrame) -> DataFrame:
    rows = teammates.where("item < teammate").select("dataset_scope", F.col("item").alias("card_name"), "teammate", "games", pair_rate(F.col("wins"), F.col("losses")).alias("sample_win_rate"))
    return documents(rows, "card_pair", F.concat_ws("::", "card_name", "teammate"), [F.desc("games"), F.col("card_name"), F.col("teammate")], path="card-pair")


def counter_documents(opponents: DataFrame) -> DataFrame:
    rows = opponents.select("dataset_scope", F.col("item").alias("card_name"), F.col("opponent").alias("opponent_card_name"), "games", pair_rate(F.col("wins"), F.col("losses")).alias("win_rate"))
    return documents(rows, "counter", F.concat_ws("::", "card_name", "opponent_card_name"), [F.desc("games"), F.col("card_name"), F.col("opponent_card_name")])


def _by_type(templates: dict[str, str], otherwise: Column) -> Column:
    """The template of the row's source type filled from its metadata, ``otherwise`` where it has none or lacks a value."""
    found = F.lit(None).cast("string")
    for kind, template in templates.items():
        found = F.when(F.col("source_type") == kind, filled(template, lambda name: F.try_element_at("metadata", F.lit(name)))).otherwise(found)
    return F.coalesce(found, otherwise)


def short_text(text: Column) -> Column:
    """The form in which a document enters a context; types without a short form keep their text."""
    return _by_type(SHORT, text)


def probe() -> Column:
    """The question by which a document should be found: its type's, or else the names that it carries."""
    names = [F.try_element_at("metadata", F.lit(n)) for n in ("card_name", "deck_name", "opponent_deck_name", "archetype")]
    return _by_type(PROBES, F.coalesce(F.nullif(F.concat_ws(" ", *names), F.lit("")), F.col("source_type")))


def metadata_bonus(asked: Column, metadata: Column, source_type: Column) -> Column:
    """How well a document's metadata fits what a question names: rank, round, card and, for schedules, players; at most 1.

    ``asked`` is a struct of rank, round, card_name and ask_players; ``metadata`` a map of strings.
    """
    def has(name: str) -> Column:
        return F.try_element_at(metadata, F.lit(name))

    def known(name: str) -> Column:
        return (source_type == "schedule") & asked["ask_players"] & (F.upper(has(name)) != "TBD") & (has(name) != "")

    parts = (
        (has("rank") == asked["rank"].cast("string"), 0.45), (has("round") == asked["round"].cast("string"), 0.45),
        (F.lower(has("card_name")) == F.lower(asked["card_name"]), 0.60), (known("player_name"), 0.15), (known("opponent_player"), 0.15),
    )
    total = F.lit(0.0)
    for test, weight in parts:
        total = total + F.when(test, weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def context(rows: DataFrame, by: str = "qid", score: str = "score") -> DataFrame:
    """(by, context, refs): each question's documents in rank order as one numbered text, and the list of their sources."""
    line = F.format_string("[%d] source_type: %s\ndoc_id: %s\nrerank_score: %.4f\ntext: %s", "rank", "source_type", "doc_id", score, "text")
    ref = F.concat(F.format_string("[%d] %s | %s | ", "rank", "source_type", "doc_id"), F.col("source"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), ref.alias("ref")))).alias("x"))
    return lists.select(by, F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("context"), F.array_join(F.transform("x", lambda x: x["ref"]), "\n").alias("refs"))


def validate(docs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(document_count, failures): missing or repeated ids and scopes that do not agree with ``scopes``."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n").cast("long").alias("n"), F.count(F.when((F.col("n") > 1) | F.col("doc_id").isNull() | (F.col("doc_id") == ""), 1)).alias("bad"))
    have, want = docs.select("dataset_scope").distinct().withColumn("a", F.lit(1)), scopes.select("dataset_scope").distinct().withColumn("b", F.lit(1))
    apart = have.join(want, "dataset_scope", "full_outer").where("a IS NULL OR b IS NULL").agg(F.count("*").alias("apart"))
    checks = F.array(F.when((F.col("n") == 0) | F.col("n").isNull() | (F.col("bad") > 0), "invalid_or_duplicate_doc_ids"), F.when(F.col("apart") > 0, "dataset_scope_coverage_mismatch"))
    return ids.crossJoin(F.broadcast(apart)).select(F.coalesce("n", F.lit(0)).alias("document_count"), F.array_join(F.array_compact(checks), ",").alias("failures"))
