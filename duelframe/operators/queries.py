"""Read operators over the aggregates: rankings, profiles, comparisons, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import rates
from duelframe.session import settled


class QueryError(ValueError):
    """A rejected request; ``code`` says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


METRICS = ("usage_rate", "clean_win_rate", "rating")


def item_rankings(items: DataFrame, metric: str, key: str = "item", display: str | None = None) -> DataFrame:
    """Competition ranks (1, 1, 3) by a metric, listed by metric, appearances, display name and key."""
    if metric not in METRICS:
        raise QueryError("INVALID_ITEM_RANKING_METRIC", metric)
    order = [F.desc(metric), F.desc("appearances"), F.col(display or key), F.col(key)]
    return items.select(
        F.rank().over(Window.orderBy(F.desc(metric))).alias("rank"), "*", rates.low_sample(F.col("appearances")).alias("warning")
    ).orderBy(*order)


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows numbered from 1 in a total order, without a task that holds them all.

    Rows are dealt and sorted by range and written once with their place in their partition: dealing them a second time could draw other
    bounds. The partitions' running counts, one row for each, are broadcast and added.
    """
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.expr("_before + (_at & 8589934591L) + 1")).drop("_p", "_at", "_before")


def positions(rows: DataFrame, *order: Column) -> DataFrame:
    return numbered(rows, *order)


def position_of(items: DataFrame, metric: str, item: str, key: str = "item") -> DataFrame:
    return positions(items, F.desc(metric), F.col(key)).where(F.col(key) == item)


def nth(items: DataFrame, metric: str, n: int, key: str = "item") -> DataFrame:
    if n < 1:
        raise QueryError("INVALID_RANK", str(n))
    return positions(items, F.desc(metric), F.col(key)).where(F.col("position") == n)


def item_detail(teammates: DataFrame, opponents: DataFrame, item: str, top: int = 10) -> DataFrame:
    def best(rows: DataFrame, other: str) -> DataFrame:
        own = rows.where(F.col("item") == item).orderBy(F.desc("games"), other).limit(top)
        return own.select(F.lit(other).alias("kind"), F.col(other).alias("other"), "games", "wins", "losses", "draws")

    return best(teammates, "teammate").unionByName(best(opponents, "opponent"))


def teammate_ranking(teammates: DataFrame, item: str, top: int) -> DataFrame:
    if not 1 <= top <= 30:
        raise QueryError("INVALID_TOP_N", str(top))
    rows = teammates.where(F.col("item") == item).orderBy(F.desc("games"), "teammate").limit(top)
    return rows.select(
        F.row_number().over(Window.orderBy(F.desc("games"), "teammate")).alias("rank"), "teammate", "games",
        rates.rnd(rates.clean_rate(F.col("wins"), F.col("losses"))).alias("clean_win_rate"), F.sum("games").over(Window.partitionBy()).alias("matched_sample_count"),
    )


def deck_opponents(directed: DataFrame, top: int = 10) -> DataFrame:
    """Each basket's best opponents by its own win rate (0 when undecided), then games, then the pair."""
    rate = rates.clean_rate(F.col("wins"), F.col("losses"))
    order = Window.partitionBy("deck").orderBy(F.desc("_rate"), F.desc("games"), "deck_a", "deck_b")
    ranked = directed.withColumn("_rate", rate).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("rank", "deck", "opponent_deck", "games", "wins", "losses", "draws", rates.rnd(F.col("_rate")).alias("win_rate"))


def matchup_view(directed: DataFrame) -> DataFrame:
    """Matchups from the first basket's side; the other's rate is what is left of 100."""
    decided, rate_a = F.col("wins") + F.col("losses") > 0, rates.rnd(rates.clean_rate(F.col("wins"), F.col("losses")))
    return directed.select(
        "deck", "opponent_deck", "games", "wins", "losses", "draws", rate_a.alias("win_rate_a"), F.when(decided, rates.rnd(100 - rate_a)).otherwise(F.lit(0.0)).alias("win_rate_b"),
        rates.rnd(F.col("score") / F.col("games")).alias("avg_score_a"), rates.rnd(F.col("opponent_score") / F.col("games")).alias("avg_score_b"),
    )


def top_decks(decks: DataFrame, top: int = 150) -> DataFrame:
    return decks.orderBy(F.desc("games"), "deck_signature").limit(top).select("deck_signature", "games", F.col("clean_win_rate").alias("win_rate"))


def item_variants(decks: DataFrame, pool: int | None = 150, per_item: int = 10) -> DataFrame:
    """Most played baskets of each item among the ``pool`` most played of all; an item outside the pool has none."""
    chosen = decks.orderBy(F.desc("games"), "deck_signature").limit(pool) if pool else decks
    rows = chosen.select(F.explode(F.from_json("deck_signature", "array<string>")).alias("item"), "deck_signature", "games")
    order = Window.partitionBy("item").orderBy(F.desc("games"), "deck_signature")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_item)


def compare(items: DataFrame, a: str, b: str, key: str = "item") -> DataFrame:
    """Differences of two items' metrics; one pass over the aggregate, no join."""
    if a == b:
        raise QueryError("INVALID_ITEM_COMPARISON", a)

    def of(item: str, c: str) -> Column:
        return F.max(F.when(F.col(key) == item, F.col(c)))

    rate = ("usage_rate", "clean_win_rate", "net_win_rate", "rating")
    both = items.where(F.col(key).isin(a, b)).agg(F.count("*").alias("_n"), *[(rates.rnd(of(a, c) - of(b, c))).alias(f"{c}_diff") for c in rate], (of(a, "appearances") - of(b, "appearances")).alias("appearances_diff"))
    return both.where("_n = 2").select(F.lit(a).alias(f"{key}_a"), F.lit(b).alias(f"{key}_b"), *[f"{c}_diff" for c in rate], "appearances_diff")


def pair_stats(teammates: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    if a == b:
        raise QueryError("INVALID_ITEM_PAIR", a)
    own = counts.where(F.col("item") == a).select("item", F.col("games").alias("_all"))
    rows = teammates.where((F.col("item") == a) & (F.col("teammate") == b)).join(F.broadcast(own), "item")
    return rows.select(
        "item", "teammate", "games", "wins", "losses", "draws", rates.rnd(rates.clean_rate(F.col("wins"), F.col("losses"))).alias("clean_win_rate"),
        rates.rnd(rates.share(F.col("games"), F.col("_all"))).alias("share_of_item"),
    )


def one_sided_items(team_sides: DataFrame) -> DataFrame:
    """Observer-side statistics: usage is a share of matches, wins a share of games, both to one digit."""
    rows = team_sides.select(F.explode("deck").alias("item"), F.when(F.col("s") > F.col("os"), 1).otherwise(0).alias("w"))
    total = team_sides.agg(F.count("*").alias("n"))
    return rows.groupBy("item").agg(F.count("*").alias("games"), F.sum("w").cast("long").alias("wins")).crossJoin(F.broadcast(total)).select(
        "item", "games", "wins", rates.rnd(rates.share(F.col("games"), F.col("n")), 1).alias("usage_rate"), rates.rnd(rates.share(F.col("wins"), F.col("games")), 1).alias("win_rate")
    )


def evidence_pairs(sides: DataFrame) -> DataFrame:
    rows = sides.select("deck", F.when(F.col("s") > F.col("os"), 1).otherwise(0).alias("w"))
    first = rows.select(F.explode("deck").alias("item_a"), "deck", "w")
    pairs = first.select("item_a", F.explode("deck").alias("item_b"), "w").where("item_a < item_b")
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("games"), F.sum("w").cast("long").alias("wins")).withColumn("win_share", F.col("wins") / F.col("games"))


def component_frequency(decks: DataFrame, pool: int, top: int) -> DataFrame:
    chosen = decks.orderBy(F.desc("games"), "deck_signature").limit(pool)
    return chosen.select(F.explode(F.from_json("deck_signature", "array<string>")).alias("item")).groupBy("item").agg(F.count("*").alias("decks")).orderBy(F.desc("decks"), "item").limit(top)


def most_common(rows: DataFrame, key: str, at: str, top: int) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("cnt"), F.min(at).alias("_first"))
    return counts.orderBy(F.desc("cnt"), "_first").limit(top).select(key, "cnt")


def frontier(seen: DataFrame, known: DataFrame, key: str = "tag", at: str = "pos") -> DataFrame:
    return seen.groupBy(key).agg(F.min(at).alias("first_seen")).join(known, key, "left_anti")


def sampled(rows: DataFrame, key: str, ends: int, step: int, offset: int) -> DataFrame:
    """The first and last ``ends`` rows in key order and every ``step``-th one: a deterministic validation sample."""
    placed = numbered(rows, F.col(key)).crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    wanted = (F.col("position") <= ends) | (F.col("position") > F.col("_n") - ends) | (F.col("position") % step == offset)
    return placed.where(wanted).withColumn("position", F.col("position").cast("int")).drop("_n")


def content_digest(rows: DataFrame, key: str, counted: str, digits: int = 3) -> DataFrame:
    """Count and SHA-256 of a scope's ids in two levels: ids are dealt to 16 ** ``digits`` buckets by the beginning of their MD5, the
    ordered ids of each are hashed, and then the ordered bucket digests; so a task holds one bucket's ids only."""
    buckets = rows.groupBy(F.substring(F.md5(key), 1, digits).alias("bucket")).agg(
        F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(key))), 256).alias("digest")
    )
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest")))
    return buckets.agg(F.sum("n").cast("long").alias(counted), F.sha2(F.concat_ws("\n", lines), 256).alias("digest"))


def next_round(rows: DataFrame, round_col: str = "round") -> DataFrame:
    """The rows of the earliest round among ``rows``; the minimum is one row and is broadcast."""
    return rows.join(F.broadcast(rows.agg(F.min(round_col).alias(round_col))), round_col)
