"""Item, pair, basket and matchup queries over the order adapter (one build, no scopes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import rates
from duelframe.operators import queries as q
from duelframe.operators import stats
from duelframe.plans.registry import query as register
from duelframe.sources import matches as src

BASE = src.BASE_SQL + """,
n AS (SELECT count(*) AS n FROM sides),
item_counts AS (SELECT item, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws
  FROM (SELECT unnest(deck) AS item, w, l, d FROM sides) GROUP BY item),
item_r AS (SELECT *, CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END AS clean,
  coalesce(CASE WHEN wins + losses > 0 THEN round(greatest(0.0, ((wins::DOUBLE / (wins + losses)) + 1.96*1.96 / (2.0 * (wins + losses))
    - 1.96 * sqrt(((wins::DOUBLE / (wins + losses)) * (1 - (wins::DOUBLE / (wins + losses))) + 1.96*1.96 / (4.0 * (wins + losses))) / (wins + losses))) / (1 + 1.96*1.96 / (wins + losses))), 6) END, 0.0) AS wl,
  cume_dist() OVER (ORDER BY games) AS pct, least(1.0, sqrt((wins + losses) / 5000.0)) AS conf FROM item_counts),
item_stats AS (SELECT item, games AS appearances, wins, losses, draws, round(games * 100.0::DOUBLE / n, 6) AS usage_rate, round(clean, 6) AS clean_win_rate, round(clean - 50, 6) AS net_win_rate,
  round(wl * 100, 6) AS wilson_lower_bound, round(pct * 100, 6) AS usage_percentile, round(conf * 100, 6) AS sample_confidence,
  round(100 * (0.65::DOUBLE * wl + 0.20::DOUBLE * pct + 0.15::DOUBLE * conf), 6) AS rating FROM item_r, n),
teammates AS (SELECT item, teammate, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws
  FROM (SELECT item, unnest(deck) AS teammate, w, l, d FROM (SELECT unnest(deck) AS item, deck, w, l, d FROM sides)) WHERE item <> teammate GROUP BY ALL),
opponents AS (SELECT item, opponent, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws
  FROM (SELECT item, unnest(opp) AS opponent, w, l, d FROM (SELECT unnest(deck) AS item, opp, w, l, d FROM sides)) GROUP BY ALL),
decks AS (SELECT sig AS deck_signature, games, wins, losses, draws, score, round(games * 100.0::DOUBLE / n, 6) AS usage_rate, round(clean, 6) AS clean_win_rate, round(clean - 50, 6) AS net_win_rate
  FROM (SELECT *, CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END AS clean FROM (
    SELECT sig, count(*) AS games, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws, sum(s)::BIGINT AS score FROM sides GROUP BY sig)), n),
matchups AS (SELECT deck_a, deck_b, count(*) AS games, count(*) FILTER (WHERE sa > sb) AS wins_a, count(*) FILTER (WHERE sa < sb) AS wins_b, count(*) FILTER (WHERE sa = sb) AS draws,
  sum(sa)::BIGINT AS score_a, sum(sb)::BIGINT AS score_b, max(match_time) AS latest_match_time FROM (
    SELECT least(a, b) AS deck_a, greatest(a, b) AS deck_b, CASE WHEN a <= b THEN team_score ELSE opponent_score END AS sa, CASE WHEN a <= b THEN opponent_score ELSE team_score END AS sb, match_time
    FROM (SELECT *, to_json(team_deck)::VARCHAR AS a, to_json(opponent_deck)::VARCHAR AS b FROM valid)) GROUP BY deck_a, deck_b),
directed AS (SELECT deck_a AS deck, deck_b AS opponent_deck, wins_a AS wins, wins_b AS losses, score_a AS score, score_b AS opponent_score, games, draws, deck_a, deck_b FROM matchups
  UNION ALL SELECT deck_b, deck_a, wins_b, wins_a, score_b, score_a, games, draws, deck_a, deck_b FROM matchups WHERE deck_a <> deck_b),
dclean AS (SELECT *, CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END AS rate FROM directed)
"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.sides(src.valid(src.matches(spark, sf_dir)))


def sql(name: str, text: str):
    return register(name, text, BASE)


@sql("r39_side_records", "SELECT match_id, side, tag, sig AS deck, s AS score, CASE WHEN s > os THEN 'win' WHEN s < os THEN 'loss' ELSE 'draw' END AS result FROM sides")
def side_records(spark, sf_dir):
    return _sides(spark, sf_dir).select("match_id", "side", "tag", stats.signature(F.col("deck")).alias("deck"), F.col("s").alias("score"), rates.result(F.col("s"), F.col("os")).alias("result"))


@sql("r60_item_stats", "SELECT * FROM item_stats")
def item_stats(spark, sf_dir):
    return stats.item_stats(_sides(spark, sf_dir))


@sql("r61_teammates", "SELECT * FROM teammates")
def teammates(spark, sf_dir):
    return stats.teammates(_sides(spark, sf_dir))


@sql("r62_opponents", "SELECT * FROM opponents")
def opponents(spark, sf_dir):
    return stats.opponents(_sides(spark, sf_dir))


@sql("r63_deck_stats", "SELECT * FROM decks")
def deck_stats(spark, sf_dir):
    return stats.deck_stats(_sides(spark, sf_dir))


@sql("r64_matchups", "SELECT * FROM matchups")
def matchups(spark, sf_dir):
    return stats.matchups(src.valid(src.matches(spark, sf_dir)))


@sql("r74_build_counters", "SELECT count(*) AS source_matches, count(*) FILTER (WHERE ok) AS included_matches, count(*) FILTER (WHERE NOT ok) AS excluded_matches, count(*) FILTER (WHERE ok) * 2 AS side_records FROM (SELECT len(team_deck) = 3 AND len(opponent_deck) = 3 AS ok FROM matches)")
def build_counters(spark, sf_dir):
    return stats.build_counters(src.matches(spark, sf_dir), src.SIZE)


@sql("r162_item_rankings", "SELECT rank() OVER (ORDER BY rating DESC)::INT AS rank, item, rating, appearances, CASE WHEN appearances < 20 THEN 'LOW_SAMPLE_WARNING' END AS warning FROM item_stats")
def item_rankings(spark, sf_dir):
    return q.item_rankings(stats.item_stats(_sides(spark, sf_dir)), "rating").select("rank", "item", "rating", "appearances", "warning")


@sql("r99_positions", "SELECT row_number() OVER (ORDER BY games DESC, deck_signature)::INT AS position, deck_signature, games FROM decks")
def positions(spark, sf_dir):
    return q.positions(stats.deck_stats(_sides(spark, sf_dir)), F.col("games").desc(), F.col("deck_signature")).select("position", "deck_signature", "games")


@sql("r102_position_lookup", "SELECT * FROM (SELECT row_number() OVER (ORDER BY usage_rate DESC, item)::INT AS position, item, usage_rate FROM item_stats) WHERE item = 'PROMO'")
def position_lookup(spark, sf_dir):
    return q.position_of(stats.item_stats(_sides(spark, sf_dir)), "usage_rate", "PROMO").select("position", "item", "usage_rate")


@sql("r103_nth_item", "SELECT position, item, clean_win_rate FROM (SELECT row_number() OVER (ORDER BY clean_win_rate DESC, item)::INT AS position, * FROM item_stats) WHERE position = 2")
def nth_item(spark, sf_dir):
    return q.nth(stats.item_stats(_sides(spark, sf_dir)), "clean_win_rate", 2).select("position", "item", "clean_win_rate")


@sql("r109_item_detail", "SELECT 'teammate' AS kind, teammate AS other, games, wins, losses, draws FROM (SELECT * FROM teammates WHERE item = 'PROMO' ORDER BY games DESC, teammate LIMIT 10) UNION ALL SELECT 'opponent', opponent, games, wins, losses, draws FROM (SELECT * FROM opponents WHERE item = 'PROMO' ORDER BY games DESC, opponent LIMIT 10)")
def item_detail(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    return q.item_detail(stats.teammates(sides), stats.opponents(sides), "PROMO")


@sql("r110_teammate_ranking", "SELECT row_number() OVER (ORDER BY games DESC, teammate)::INT AS rank, teammate, games, clean_win_rate, sum(games) OVER ()::BIGINT AS matched_sample_count FROM (SELECT teammate, games, round(CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END, 6) AS clean_win_rate FROM teammates WHERE item = 'PROMO' ORDER BY games DESC, teammate LIMIT 10)")
def teammate_ranking(spark, sf_dir):
    return q.teammate_ranking(stats.teammates(_sides(spark, sf_dir)), "PROMO", 10)


@sql("r111_deck_profile", "SELECT * FROM (SELECT row_number() OVER (PARTITION BY deck ORDER BY rate DESC, games DESC, deck_a, deck_b)::INT AS rank, deck, opponent_deck, games, wins, losses, draws, round(rate, 6) AS win_rate FROM dclean) WHERE rank <= 10")
def deck_profile(spark, sf_dir):
    return q.deck_opponents(stats.directional(stats.matchups(src.valid(src.matches(spark, sf_dir)))))


@sql("r112_top_decks", "SELECT deck_signature, games, clean_win_rate AS win_rate FROM decks ORDER BY games DESC, deck_signature LIMIT 150")
def top_decks(spark, sf_dir):
    return q.top_decks(stats.deck_stats(_sides(spark, sf_dir)))


@sql("r113_item_variants", "SELECT item, deck_signature, games, rank FROM (SELECT item, deck_signature, games, row_number() OVER (PARTITION BY item ORDER BY games DESC, deck_signature)::INT AS rank FROM (SELECT unnest(from_json(deck_signature, '[\"VARCHAR\"]')) AS item, deck_signature, games FROM (SELECT * FROM decks ORDER BY games DESC, deck_signature LIMIT 150))) WHERE rank <= 10")
def item_variants(spark, sf_dir):
    return q.item_variants(stats.deck_stats(_sides(spark, sf_dir)))


@sql("r164_compare_items", "SELECT a.item AS item_a, b.item AS item_b, round(a.usage_rate - b.usage_rate, 6) AS usage_rate_diff, round(a.clean_win_rate - b.clean_win_rate, 6) AS clean_win_rate_diff, round(a.net_win_rate - b.net_win_rate, 6) AS net_win_rate_diff, round(a.rating - b.rating, 6) AS rating_diff, (a.appearances - b.appearances)::BIGINT AS appearances_diff FROM item_stats a, item_stats b WHERE a.item = 'PROMO' AND b.item = 'SMALL'")
def compare_items(spark, sf_dir):
    return q.compare(stats.item_stats(_sides(spark, sf_dir)), "PROMO", "SMALL")


@sql("r165_pair_stats", "SELECT item, teammate, games, wins, losses, draws, round(CASE WHEN wins + losses = 0 THEN 0.0 ELSE wins * 100.0::DOUBLE / (wins + losses) END, 6) AS clean_win_rate, round(games * 100.0::DOUBLE / (SELECT appearances FROM item_stats WHERE item_stats.item = teammates.item), 6) AS share_of_item FROM teammates WHERE item = 'PROMO' AND teammate = 'SMALL'")
def pair_stats(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    return q.pair_stats(stats.teammates(sides), stats.item_counts(sides), "PROMO", "SMALL")


@sql("r168_deck_matchup", "SELECT deck, opponent_deck, games, wins, losses, draws, round(rate, 6) AS win_rate_a, CASE WHEN wins + losses > 0 THEN round(100 - round(rate, 6), 6) ELSE 0.0 END AS win_rate_b, round(score::DOUBLE / games, 6) AS avg_score_a, round(opponent_score::DOUBLE / games, 6) AS avg_score_b FROM dclean")
def deck_matchup(spark, sf_dir):
    return q.matchup_view(stats.directional(stats.matchups(src.valid(src.matches(spark, sf_dir)))))


@sql("r79_one_sided_snapshot", "SELECT item, count(*) AS games, sum(w)::BIGINT AS wins, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM valid), 1) AS usage_rate, round(sum(w) * 100.0::DOUBLE / count(*), 1) AS win_rate FROM (SELECT unnest(deck) AS item, w FROM sides WHERE side = 'team') GROUP BY item")
def one_sided(spark, sf_dir):
    return q.one_sided_items(_sides(spark, sf_dir).where("side = 'team'"))


@sql("r48_item_top_decks", "SELECT item, deck_signature, games, rank FROM (SELECT item, deck_signature, games, row_number() OVER (PARTITION BY item ORDER BY games DESC, deck_signature)::INT AS rank FROM (SELECT unnest(from_json(deck_signature, '[\"VARCHAR\"]')) AS item, deck_signature, games FROM decks)) WHERE rank <= 20")
def item_top_decks(spark, sf_dir):
    return q.item_variants(stats.deck_stats(_sides(spark, sf_dir)), None, 20)


@sql("r49_matchup_decks", "SELECT m.deck_a, m.deck_b, m.games, a.games AS games_a, b.games AS games_b FROM matchups m JOIN decks a ON a.deck_signature = m.deck_a JOIN decks b ON b.deck_signature = m.deck_b ORDER BY m.games DESC, m.deck_a, m.deck_b LIMIT 20000")
def matchup_decks(spark, sf_dir):
    rows = src.valid(src.matches(spark, sf_dir))
    decks = stats.deck_stats(src.sides(rows)).select("deck_signature", "games")
    a, b = decks.toDF("deck_a", "games_a"), decks.toDF("deck_b", "games_b")
    return stats.matchups(rows).join(a, "deck_a").join(b, "deck_b").select("deck_a", "deck_b", "games", "games_a", "games_b").orderBy(F.desc("games"), "deck_a", "deck_b").limit(20_000)


@sql("r81_evidence_pairs", "SELECT item_a, item_b, count(*) AS games, sum(w)::BIGINT AS wins, sum(w) * 1.0::DOUBLE / count(*) AS win_share FROM (SELECT x.item AS item_a, y.item AS item_b, x.w FROM (SELECT match_id, side, w, unnest(deck) AS item FROM sides) x JOIN (SELECT match_id, side, unnest(deck) AS item FROM sides) y USING (match_id, side) WHERE x.item < y.item) GROUP BY ALL")
def evidence_pairs(spark, sf_dir):
    """Unordered pairs of a basket; a draw counts as not won."""
    return q.evidence_pairs(_sides(spark, sf_dir))


@sql("r85_component_frequency", "SELECT item, count(*) AS decks FROM (SELECT unnest(from_json(deck_signature, '[\"VARCHAR\"]')) AS item FROM (SELECT * FROM decks ORDER BY games DESC, deck_signature LIMIT 10)) GROUP BY item ORDER BY decks DESC, item LIMIT 10")
def component_frequency(spark, sf_dir):
    return q.component_frequency(stats.deck_stats(_sides(spark, sf_dir)), 10, 10)


@sql("r82_most_common", "SELECT item, cnt FROM (SELECT unnest(deck) AS item, min(match_time || match_id || side) AS first_seen, count(*) AS cnt FROM (SELECT deck, match_time, match_id, side FROM sides) GROUP BY 1) ORDER BY cnt DESC, first_seen LIMIT 4" .replace("SELECT unnest(deck) AS item, min(match_time || match_id || side) AS first_seen, count(*) AS cnt FROM (SELECT deck, match_time, match_id, side FROM sides) GROUP BY 1", "SELECT item, min(match_time || match_id || side) AS first_seen, count(*) AS cnt FROM (SELECT unnest(deck) AS item, match_time, match_id, side FROM sides) GROUP BY item"))
def most_common(spark, sf_dir):
    """Ties go to the item that is seen first."""
    rows = _sides(spark, sf_dir).select(F.explode("deck").alias("item"), F.concat("match_time", "match_id", "side").alias("at"))
    return q.most_common(rows, "item", "at", 4)


@sql("r25_opponent_frontier", "SELECT tag, min(pos) AS first_seen FROM (SELECT opponent_tag AS tag, match_time || match_id AS pos FROM matches) WHERE tag NOT IN (SELECT team_tag FROM matches WHERE team_score = 0) GROUP BY tag")
def opponent_frontier(spark, sf_dir):
    """Opponents in the order first seen, without tags that are already known."""
    rows = src.matches(spark, sf_dir)
    seen = rows.select(F.col("opponent_tag").alias("tag"), F.concat("match_time", "match_id").alias("pos"))
    return q.frontier(seen, rows.where("team_score = 0").select(F.col("team_tag").alias("tag")))


@sql("r37_sample_rows", "SELECT match_id, position, len(team_deck) = 3 AND len(opponent_deck) = 3 AS decks_ok, team_score >= 0 AND opponent_score >= 0 AS scores_ok FROM (SELECT *, row_number() OVER (ORDER BY match_id)::INT AS position, count(*) OVER () AS n FROM matches) WHERE position <= 5 OR position > n - 5 OR position % 101 = 7")
def sample_rows(spark, sf_dir):
    return q.sampled(src.matches(spark, sf_dir), "match_id", ends=5, step=101, offset=7).select(
        "match_id", "position", ((F.size("team_deck") == 3) & (F.size("opponent_deck") == 3)).alias("decks_ok"), ((F.col("team_score") >= 0) & (F.col("opponent_score") >= 0)).alias("scores_ok")
    )


@sql("r117_offset_row", "SELECT match_id, match_time FROM valid ORDER BY match_id LIMIT 1 OFFSET 17")
def offset_row(spark, sf_dir):
    return src.valid(src.matches(spark, sf_dir)).select("match_id", "match_time").orderBy("match_id").offset(17).limit(1)


@sql("r139_scope_digest", "SELECT sum(n)::BIGINT AS matches, sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS digest FROM (SELECT substr(md5(match_id), 1, 3) AS bucket, count(*) AS n, sha256(string_agg(match_id, chr(10) ORDER BY match_id)) AS digest FROM valid GROUP BY 1)")
def digest(spark, sf_dir):
    """Content digest of all valid matches: the hash of the ordered digests of their buckets."""
    return q.content_digest(src.valid(src.matches(spark, sf_dir)), "match_id", "matches")


@sql("r86_month_buckets", "SELECT month, count(*) AS matches, month = (SELECT max(month) FROM (SELECT substr(match_time, 1, 6) AS month, count(*) AS c FROM valid GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM valid GROUP BY substr(match_time, 1, 6)))) AS busiest FROM (SELECT substr(match_time, 1, 6) AS month FROM valid) GROUP BY month")
def month_buckets(spark, sf_dir):
    months = src.valid(src.matches(spark, sf_dir)).groupBy(F.substring("match_time", 1, 6).alias("month")).agg(F.count("*").alias("matches"))
    top = Window.orderBy(F.desc("matches"), F.desc("month"))
    return months.select("month", "matches", (F.row_number().over(top) == 1).alias("busiest"))
