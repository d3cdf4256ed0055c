"""Full configurations of a side: a leader and items with their forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions import rates
from duelframe.operators import stats


def state(evolution: Column, elite: Column) -> Column:
    """Form of an item; elite comes before evolution, evolution before ordinary."""
    return F.when(elite, "elite").when(evolution > 0, "evolution").otherwise("ordinary")


def complete(leader: Column, items: Column, size: int) -> Column:
    """Slot contract: a leader, ``size`` different items, at most two evolutions, two elites and three of both."""
    evolved = F.size(F.filter(items, lambda x: x["evolution"] > 0))
    elites = F.size(F.filter(items, lambda x: x["elite"]))
    return leader.isNotNull() & (F.size(F.array_distinct(F.transform(items, lambda x: x["id"]))) == size) & (F.size(items) == size) & (evolved <= 2) & (elites <= 2) & (evolved + elites <= 3)


def quality(leader: Column, items: Column, size: int) -> Column:
    """Lexicographic quality: completeness, leader, number of items, items with a form."""
    return F.struct(
        complete(leader, items, size).cast("int").alias("complete"), leader.isNotNull().cast("int").alias("leader"), F.size(items).alias("items"),
        F.size(F.filter(items, lambda x: (x["evolution"] > 0) | x["elite"])).alias("forms"),
    )


def _body(leader: Column, items: Column, level: bool) -> Column:
    def one(x: Column) -> Column:
        parts = [F.lit('["'), x["id"], F.lit('",'), x["evolution"].cast("string"), F.lit(","), F.when(x["elite"], "true").otherwise("false")]
        return F.concat(*parts, *([F.lit(","), x["level"].cast("string")] if level else []), F.lit("]"))

    return F.concat(F.lit('{"cards":['), F.array_join(F.transform(F.array_sort(items), one), ","), F.lit('],"leader":"'), leader, F.lit('"}'))


def signature(leader: Column, items: Column) -> Column:
    return F.concat(F.lit("loadout-v1:"), F.sha2(_body(leader, items, False), 256))


def fact_signature(leader: Column, items: Column) -> Column:
    """As ``signature``, with the items' levels."""
    return F.concat(F.lit("loadout-v1:"), F.sha2(_body(leader, items, True), 256))


def loadout_stats(sides: DataFrame) -> DataFrame:
    """Counters and rates per configuration; ``sides`` has leader, items, deck, s and os of complete matches only."""
    rows = stats.with_outcomes(sides).withColumn("loadout_signature", signature(F.col("leader"), F.col("items"))).withColumn("base_deck_signature", stats.signature(F.col("deck")))
    counts = rows.groupBy("loadout_signature", "base_deck_signature").agg(
        F.count("*").alias("games"), F.sum("w").cast("long").alias("wins"), F.sum("l").cast("long").alias("losses"), F.sum("d").cast("long").alias("draws"), F.sum("s").cast("long").alias("score")
    )
    return stats.deck_rates(counts, stats.side_total(sides))


def entity_counts(sides: DataFrame) -> DataFrame:
    """One key per leader and per item form; the form's place is in the key, so all entities share one ranking."""
    forms = F.transform("items", lambda x: F.concat_ws(":", F.lit("item"), x["id"], state(x["evolution"], x["elite"])))
    rows = stats.with_outcomes(sides).select(F.explode(F.concat(F.array(F.concat(F.lit("leader:"), F.col("leader"))), forms)).alias("entity_id"), "w", "l", "d")
    return stats.count_outcomes(rows, "entity_id")


def entity_stats(sides: DataFrame) -> DataFrame:
    return stats.finish_items(entity_counts(sides), stats.side_total(sides), key="entity_id")


def item_catalog(sides: DataFrame) -> DataFrame:
    rows = sides.select(F.explode("items").alias("x"))
    return rows.groupBy(F.col("x.id").alias("item")).agg(
        F.count("*").alias("appearances"), F.count(F.when(F.col("x.evolution") > 0, 1)).alias("evolution_appearances"), F.count(F.when(F.col("x.elite"), 1)).alias("elite_appearances")
    )


def feature_stats(sides: DataFrame, kind: str) -> DataFrame:
    """Appearances and rates of leaders, evolutions (by level) or elites."""
    rows = stats.with_outcomes(sides)
    if kind == "leader":
        keyed, keys = rows.select("leader", "w", "l", "d"), ["leader"]
    else:
        own = F.col("x.evolution") > 0 if kind == "evolution" else F.col("x.elite")
        keyed = rows.select(F.explode("items").alias("x"), "w", "l", "d").where(own).select(F.col("x.id").alias("item"), F.col("x.evolution").alias("level"), "w", "l", "d")
        keys = ["item", "level"] if kind == "evolution" else ["item"]
    counts = stats.count_outcomes(keyed, *keys).crossJoin(F.broadcast(stats.side_total(sides)))
    return counts.select(
        *keys, F.col("games").alias("appearances"), "wins", "losses", "draws", rates.rnd(rates.share(F.col("games"), F.col("n"))).alias("usage_rate"),
        rates.rnd(rates.clean_rate(F.col("wins"), F.col("losses"))).alias("clean_win_rate"),
    )


def rolled_up(loadouts: DataFrame) -> DataFrame:
    """Configurations summed back to their baskets."""
    return loadouts.groupBy(F.col("base_deck_signature").alias("deck_signature")).agg(*[F.sum(c).cast("long").alias(c) for c in ("games", "wins", "losses", "draws")])
