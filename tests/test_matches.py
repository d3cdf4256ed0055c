"""Hand-computed goldens and invariants of the match operators."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from duelframe.functions import rates
from duelframe.functions.archetype_rules import CARDS
from duelframe.operators import loadouts as lo
from duelframe.operators import queries as q
from duelframe.operators import scopes as sc
from duelframe.operators import stats
from duelframe.sources import matches as src
from duelframe.sources import raw

A = ["Earthquake", "Hog Rider", "A2", "A3", "A4", "A5", "A6", "A7"]
B = ["Goblin Barrel", "B1", "B2", "B3", "B4", "B5", "B6", "B7"]
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def four(spark):
    rows = [
        ("m1", "20260728T010000.000Z", "#A", "#B", A, B, 2, 1), ("m2", "20260728T010100.000Z", "#C", "#D", A, B, 0, 1),
        ("m3", "20260728T010200.000Z", "#E", "#F", A, B, 1, 1), ("bad", "20260728T010300.000Z", None, None, A[:7], B, 1, 0),
    ]
    return spark.createDataFrame(rows, "match_id string, match_time string, team_tag string, opponent_tag string, team_deck array<string>, opponent_deck array<string>, team_score long, opponent_score long")


def test_four_match_goldens(four):
    c = stats.build_counters(four, 8).first()
    assert tuple(c) == (4, 3, 1, 6)
    ok = src.valid(four, 8)
    sides = src.sides(ok)
    hog = stats.item_stats(sides).where("item = 'Hog Rider'").first()
    assert (hog.appearances, hog.wins, hog.losses, hog.draws, hog.usage_rate, hog.clean_win_rate, hog.net_win_rate) == (3, 1, 1, 1, 50.0, 50.0, 0.0)
    assert 0 <= hog.rating <= 100
    deck = stats.deck_stats(sides).where(F.col("deck_signature").contains("Hog")).first()
    assert (deck.games, deck.wins, deck.losses, deck.draws, deck.usage_rate, deck.clean_win_rate) == (3, 1, 1, 1, 50.0, 50.0)
    m = stats.matchups(ok).first()
    assert (m.games, m.wins_a, m.wins_b, m.draws, m.score_a, m.score_b, m.latest_match_time) == (3, 1, 1, 1, 3, 3, "20260728T010200.000Z")
    named = sides.select("deck", CARDS.classify(F.col("deck")).alias("c")).groupBy("c.name").count().collect()
    assert {(r["name"], r["count"]) for r in named} == {("野猪地震", 3), ("诱导消耗", 3)}


def test_matchups_from_either_side_and_mirrors(spark):
    rows = [("x", "1", A, B, 3, 0), ("y", "2", B, A, 2, 1), ("z", "", A, A, 1, 0)]
    df = spark.createDataFrame(rows, "match_id string, match_time string, team_deck array<string>, opponent_deck array<string>, team_score long, opponent_score long")
    got = {r.games: r for r in stats.matchups(df).collect()}
    assert (got[2].wins_a + got[2].wins_b, got[2].score_a + got[2].score_b, got[2].latest_match_time) == (2, 6, "2")
    assert (got[1].wins_a, got[1].wins_b, got[1].latest_match_time) == (1, 0, None)
    assert stats.directional(stats.matchups(df)).count() == 3


def test_ranks_tie_and_errors(spark):
    rows = [("Hog", 60.0, 5), ("Earth", 60.0, 5), ("Barrel", 40.0, 50)]
    items = spark.createDataFrame(rows, "item string, usage_rate double, appearances long")
    got = q.item_rankings(items, "usage_rate").collect()
    assert [(r.rank, r.item, r.warning) for r in got] == [(1, "Earth", "LOW_SAMPLE_WARNING"), (1, "Hog", "LOW_SAMPLE_WARNING"), (3, "Barrel", None)]
    for call in (lambda: q.item_rankings(items, "nope"), lambda: q.teammate_ranking(items, "x", 31), lambda: q.compare(items, "a", "a"), lambda: q.nth(items, "usage_rate", 0)):
        with pytest.raises(q.QueryError):
            call()


def test_rates_of_nothing(spark):
    row = spark.range(1).select(
        rates.clean_rate(F.lit(0), F.lit(0)).alias("c"), rates.net_rate(F.lit(0), F.lit(0)).alias("n"), rates.wilson_lower(F.lit(0), F.lit(0)).alias("w"),
        rates.wilson_lower(F.lit(10), F.lit(0)).alias("w10"), *[x.alias(f"i{k}") for k, x in enumerate(rates.wilson_interval(F.lit(0), F.lit(0)))],
    ).first()
    assert tuple(row) == (0.0, -50.0, 0.0, 0.722460, 0.0, 0.0)


def test_invariants_of_the_adapter(spark):
    sides = src.sides(src.valid(src.matches(spark, SF)))
    w = stats.with_outcomes(sides).agg(F.sum("w"), F.sum("l"), F.count("*")).first()
    assert w[0] == w[1]
    items = stats.item_stats(sides)
    assert items.agg(F.sum("appearances")).first()[0] == src.SIZE * w[2] and items.agg(F.max("usage_percentile")).first()[0] == 100
    opp = stats.opponents(sides)
    mirrored = opp.select(F.col("item").alias("opponent"), F.col("opponent").alias("item"), F.col("wins").alias("losses"))
    assert opp.join(mirrored, ["item", "opponent", "losses"], "left_anti").count() == 0


def _at(days):
    return dt.datetime(2026, 7, 30) - dt.timedelta(days=days)


def test_scopes_are_nested_and_half_open(spark):
    batches = spark.createDataFrame([("old", _at(8), "accepted"), ("new", _at(1), "accepted"), ("edge", _at(7), "accepted"), ("no", _at(1), "rejected")], "batch_id string, completed_at timestamp, status string")
    seen = spark.createDataFrame(
        [("old", "m1", 50, "ranked_direct"), ("new", "m1", 180, "ranked_direct"), ("new", "m2", None, "expansion"), ("edge", "m3", 10, "ranked_direct"), ("no", "m4", 1, "ranked_direct")],
        "batch_id string, match_id string, observer_rank int, observer_source string",
    )
    now = F.lit(dt.datetime(2026, 7, 30))
    got = {}
    for r in sc.membership(seen, batches, now).collect():
        got.setdefault(r.dataset_scope, set()).add(r.match_id)
    assert got.get("7d_top_100") is None and got["7d_top_200"] == {"m1"} and got["7d_all"] == {"m1", "m2"} and got["35d_all"] == {"m1", "m2", "m3"}
    assert got["d7_14_top_100"] == {"m1", "m3"} and len(sc.SCOPES) == 30
    for w in sc.WINDOWS:
        levels = [got.get(f"{w}_{lv}", set()) for lv in sc.LEVELS]
        assert all(a <= b for a, b in itertools.pairwise(levels))
    ranks = {d: {r.match_id: r.minimum_rank for r in sc.minimum_rank(seen, batches, now, d).collect()} for d in (7, 35)}
    assert ranks[7]["m1"] == 180 and ranks[35]["m1"] == 50


def test_retention_keeps_the_newest(spark):
    rows = [(f"w{i}", _at(6 * i), "accepted", "weekly") for i in range(7)] + [(f"d{i}", _at(i / 4), "accepted", "daily") for i in range(5)]
    batches = spark.createDataFrame(rows, "batch_id string, completed_at timestamp, status string, batch_type string")
    got = {r.batch_id for r in sc.retained(batches, F.lit(dt.datetime(2026, 7, 30)), 35, most_daily=3).collect()}
    assert got == {f"w{i}" for i in range(6)} | {"d0", "d1", "d2"}


def test_period_delta_flags(spark):
    schema = "item string, games long, wins long, losses long, usage_rate double, clean_win_rate double"
    now = spark.createDataFrame([("new", 300, 150, 150, 5.0, 50.0), ("up", 1000, 700, 300, 9.0, 70.0), ("same", 1000, 500, 500, 9.0, 50.0)], schema)
    old = spark.createDataFrame([("gone", 300, 150, 150, 5.0, 50.0), ("up", 1000, 500, 500, 9.0, 50.0), ("same", 1000, 500, 500, 9.0, 50.0)], schema)
    got = {r.item: (r.kind, r.significant) for r in sc.period_delta(now, old, ["item"], 200).collect()}
    assert got == {"new": ("appeared", True), "gone": ("disappeared", True), "up": ("changed", True), "same": ("changed", False)}


def test_raw_logs_in_every_shape(spark):
    one = '{"tag":"#1","crowns":3,"cards":[{"name":"Zap","id":1},{"name":" Electro Giant "}]}'
    two = '{"tag":"#2","crowns":1,"deck":["Hog Rider","Fireball",""]}'
    lines = [f'{{"type":"pathOfLegend","battleTime":"t1","team":{one},"opponent":[{two}]}}', f'{{"type":"pathOfLegend","battleTime":"t1","team":[{two}],"opponent":{one}}}', f'{{"type":"x","team":{one},"opponent":{two}}}', "broken"]
    records = raw.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert raw.of_type(records, "pathoflegend").count() == 2
    got = raw.normalise(records).collect()
    assert got[0].match_id == got[1].match_id and len(got[0].match_id) == 24 and got[2].match_id is None
    assert got[0].team_deck == ["Electro Giant", "Zap"] and got[0].opponent_deck == ["Fireball", "Hog Rider"] and got[0].won and not got[1].won
    assert raw.usable(raw.canonical(raw.normalise(records)), 2).count() == 2
    assert raw.selection_counters(raw.normalise(records), 2).first().asDict() == {"inspected": 4, "incomplete": 1, "duplicates": 1, "usable": 2}


def test_long_lines_are_listed(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type":"a"}\n{"type":"' + "x" * 100 + '"}\n')
    assert raw.read_lines(spark, str(tmp_path), 50).count() == 1
    assert [(r.bytes, r.code) for r in raw.rejected_lines(spark, str(tmp_path), 50).collect()] == [(111, "LINE_TOO_LONG")]


def test_loadout_forms_and_contract(spark):
    items = [("1", 1, False), ("2", 0, True), ("3", 0, False)]
    df = spark.createDataFrame([("T", items), ("T", items[::-1]), (None, items), ("T", items[:2])], "leader string, items array<struct<id:string,evolution:int,elite:boolean>>")
    got = df.select(lo.complete(F.col("leader"), F.col("items"), 3).alias("ok"), lo.signature(F.col("leader"), F.col("items")).alias("sig"), lo.quality(F.col("leader"), F.col("items"), 3).alias("q")).collect()
    assert [r.ok for r in got] == [True, True, False, False] and got[0].sig == got[1].sig and got[0].q > got[2].q
