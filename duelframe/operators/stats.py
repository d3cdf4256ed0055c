"""Aggregates over sides: items, pairs, baskets and matchups. ``scope`` columns, if given, are kept as leading keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import rates

COUNTERS = ("games", "wins", "losses", "draws")


def signature(deck: Column) -> Column:
    """Compact JSON of the sorted basket."""
    return F.to_json(F.array_sort(deck))


def with_outcomes(sides: DataFrame) -> DataFrame:
    return sides.select("*", *rates.outcome(F.col("s"), F.col("os")))


def count_outcomes(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """games, wins, losses, draws per key; partial sums are formed before the shuffle."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("games"), F.sum("w").cast("long").alias("wins"), F.sum("l").cast("long").alias("losses"), F.sum("d").cast("long").alias("draws")
    )


def item_counts(sides: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return count_outcomes(with_outcomes(sides).select(*scope, F.explode("deck").alias("item"), "w", "l", "d"), *scope, "item")


def finish_items(counts: DataFrame, side_records: DataFrame, scope: tuple[str, ...] = (), key: str = "item") -> DataFrame:
    """Usage, clean and net rates, Wilson bound, percentile, confidence and rating of counted items.

    ``side_records`` holds column n (per scope, if any): the sides that usage is a share of. The percentile is the share of items
    with no more games, so it is a cumulative distribution over the (few) items of a scope.
    """
    w, l = F.col("wins"), F.col("losses")
    wilson, sure = rates.wilson_lower(w, l), rates.confidence(w, l)
    ranked = counts.withColumn("_pct", F.cume_dist().over(Window.partitionBy(*scope).orderBy("games")))
    joined = ranked.join(F.broadcast(side_records), list(scope)) if scope else ranked.crossJoin(F.broadcast(side_records))
    return joined.select(
        *scope, key, F.col("games").alias("appearances"), "wins", "losses", "draws",
        rates.rnd(rates.share(F.col("games"), F.col("n"))).alias("usage_rate"),
        rates.rnd(rates.clean_rate(w, l)).alias("clean_win_rate"),
        rates.rnd(rates.net_rate(w, l)).alias("net_win_rate"),
        rates.rnd(wilson * 100).alias("wilson_lower_bound"),
        rates.rnd(F.col("_pct") * 100).alias("usage_percentile"),
        rates.rnd(sure * 100).alias("sample_confidence"),
        rates.rnd(rates.rating(wilson, F.col("_pct"), sure)).alias("rating"),
    )


def side_total(sides: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return sides.groupBy(*scope).agg(F.count("*").alias("n"))


def item_stats(sides: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return finish_items(item_counts(sides, scope), side_total(sides, scope), scope)


def teammates(sides: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of different items of one basket; made row by row, so no join and no shuffle but the count's."""
    rows = with_outcomes(sides).select(*scope, F.explode("deck").alias("item"), "deck", "w", "l", "d")
    pairs = rows.select(*scope, "item", F.explode(F.array_remove("deck", F.col("item"))).alias("teammate"), "w", "l", "d")
    return count_outcomes(pairs, *scope, "item", "teammate")


def opponents(sides: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of an item and an item of the opposing basket."""
    rows = with_outcomes(sides).select(*scope, F.explode("deck").alias("item"), "opp", "w", "l", "d")
    return count_outcomes(rows.select(*scope, "item", F.explode("opp").alias("opponent"), "w", "l", "d"), *scope, "item", "opponent")


def deck_rates(counts: DataFrame, side_records: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    w, l = F.col("wins"), F.col("losses")
    joined = counts.join(F.broadcast(side_records), list(scope)) if scope else counts.crossJoin(F.broadcast(side_records))
    return joined.select(
        *counts.columns,
        rates.rnd(rates.share(F.col("games"), F.col("n"))).alias("usage_rate"),
        rates.rnd(rates.clean_rate(w, l)).alias("clean_win_rate"), rates.rnd(rates.net_rate(w, l)).alias("net_win_rate"),
    )


def deck_stats(sides: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    rows = with_outcomes(sides).withColumn("deck_signature", signature(F.col("deck")))
    counts = rows.groupBy(*scope, "deck_signature").agg(
        F.count("*").alias("games"), F.sum("w").cast("long").alias("wins"), F.sum("l").cast("long").alias("losses"), F.sum("d").cast("long").alias("draws"),
        F.sum("s").cast("long").alias("score"),
    )
    return deck_rates(counts, side_total(sides, scope), scope)


def matchups(matches: DataFrame, scope: tuple[str, ...] = (), team: Column | None = None, opponent: Column | None = None) -> DataFrame:
    """One row per unordered pair of baskets, the smaller signature as a; a mirror match keeps its team as a.

    The latest time is the largest non-empty text.
    """
    own = signature(F.col("team_deck")) if team is None else team
    other = signature(F.col("opponent_deck")) if opponent is None else opponent
    ts, os = F.coalesce("team_score", F.lit(0)), F.coalesce("opponent_score", F.lit(0))
    first = own <= other
    rows = matches.select(
        *scope, F.least(own, other).alias("deck_a"), F.greatest(own, other).alias("deck_b"),
        F.when(first, ts).otherwise(os).alias("sa"), F.when(first, os).otherwise(ts).alias("sb"), F.nullif("match_time", F.lit("")).alias("t"),
    )
    return rows.groupBy(*scope, "deck_a", "deck_b").agg(
        F.count("*").alias("games"), F.count(F.when(F.col("sa") > F.col("sb"), 1)).alias("wins_a"), F.count(F.when(F.col("sa") < F.col("sb"), 1)).alias("wins_b"),
        F.count(F.when(F.col("sa") == F.col("sb"), 1)).alias("draws"), F.sum("sa").cast("long").alias("score_a"), F.sum("sb").cast("long").alias("score_b"),
        F.max("t").alias("latest_match_time"),
    )


def directional(matchup: DataFrame) -> DataFrame:
    """Matchups from either side, so that a basket's opponents are one equality filter; mirrors appear once."""
    def view(own: str, other: str):
        return F.struct(
            F.col(f"deck_{own}").alias("deck"), F.col(f"deck_{other}").alias("opponent_deck"), F.col(f"wins_{own}").alias("wins"), F.col(f"wins_{other}").alias("losses"),
            F.col(f"score_{own}").alias("score"), F.col(f"score_{other}").alias("opponent_score"), "games", "draws", "deck_a", "deck_b",
        )

    both = F.when(F.col("deck_a") == F.col("deck_b"), F.array(view("a", "b"))).otherwise(F.array(view("a", "b"), view("b", "a")))
    return matchup.select(F.explode(both).alias("v")).select("v.*")


def build_counters(matches: DataFrame, size: int) -> DataFrame:
    """Source, included and excluded matches and side records of one build."""
    def exact(c: str):
        return (F.size(c) == size) & (F.size(F.array_distinct(c)) == size)

    ok = exact("team_deck") & exact("opponent_deck")
    return matches.agg(
        F.count("*").alias("source_matches"), F.count(F.when(ok, 1)).alias("included_matches"), F.count(F.when(~ok, 1)).alias("excluded_matches"),
        (F.count(F.when(ok, 1)) * 2).alias("side_records"),
    )
