"""Match records: the schema that the operators read, and an adapter from order tables.

A match has two sides; a side has a tag, a basket of distinct items and a score. The adapter makes the baskets of two consecutive orders of
a customer the two sides, the item being a part's type and the score the number of returned lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 3
COLUMNS = ("match_id", "match_time", "cust", "ts", "team_tag", "opponent_tag", "team_deck", "opponent_deck", "team_score", "opponent_score")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def order_baskets(lineitem: DataFrame, part: DataFrame, item: str = "p_type") -> DataFrame:
    """(ok, deck, score): distinct items of each order in code-point order, number of returned lines."""
    lines = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    return lines.groupBy(F.col("l_orderkey").alias("ok")).agg(
        F.array_sort(F.collect_set(item)).alias("deck"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("score")
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of consecutive orders, whatever their baskets' size."""
    orders, lineitem, part = tables(spark, sf_dir, "orders", "lineitem", "part")
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = (
        orders.select("o_custkey", "o_orderkey", "o_orderdate", F.row_number().over(turn).alias("rn"), F.lead("o_orderkey").over(turn).alias("o"), F.lead("o_orderdate").over(turn).alias("ts"))
        .where("rn % 2 = 1 AND o IS NOT NULL")
        .select(F.col("o_orderkey").alias("t"), "o", F.col("o_custkey").alias("cust"), "ts")
    )
    baskets = order_baskets(lineitem, part)
    team = baskets.select(F.col("ok").alias("t"), F.col("deck").alias("team_deck"), F.col("score").alias("team_score"))
    other = baskets.select(F.col("ok").alias("o"), F.col("deck").alias("opponent_deck"), F.col("score").alias("opponent_score"))
    return pairs.join(team, "t").join(other, "o").select(
        F.concat(F.lit("m"), F.col("t").cast("string")).alias("match_id"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'.000Z'").alias("match_time"), "cust", "ts",
        F.concat(F.lit("#"), F.col("t").cast("string")).alias("team_tag"), F.concat(F.lit("#"), F.col("o").cast("string")).alias("opponent_tag"),
        "team_deck", "opponent_deck", "team_score", "opponent_score",
    )


def valid(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Matches both of whose baskets hold exactly ``size`` items, all different."""
    def exact(c: str):
        return (F.size(c) == size) & (F.size(F.array_distinct(c)) == size)

    return rows.where(exact("team_deck") & exact("opponent_deck"))


def sides(rows: DataFrame) -> DataFrame:
    """Both perspectives of every match."""
    def side(own: str, other: str):
        return F.struct(
            F.lit(own).alias("side"), F.col(f"{own}_tag").alias("tag"), F.col(f"{own}_deck").alias("deck"), F.col(f"{other}_deck").alias("opp"),
            F.coalesce(F.col(f"{own}_score"), F.lit(0)).alias("s"), F.coalesce(F.col(f"{other}_score"), F.lit(0)).alias("os"),
        )

    keep = [c for c in rows.columns if not c.startswith(("team_", "opponent_"))]
    return rows.select(*keep, F.explode(F.array(side("team", "opponent"), side("opponent", "team"))).alias("x")).select(*keep, "x.*")


#: The same records as common table expressions, for the SQL counterparts of the queries.
BASE_SQL = """
lines AS (SELECT l_orderkey AS ok, p_type AS item, l_returnflag AS rf FROM lineitem JOIN part ON l_partkey = p_partkey),
baskets AS (SELECT ok, list_sort(list_distinct(list(item))) AS deck, count(*) FILTER (WHERE rf = 'R') AS score FROM lines GROUP BY ok),
turns AS (SELECT o_orderkey AS ok, o_custkey AS cust, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
matches AS (SELECT 'm' || a.ok AS match_id, strftime(b.ts, '%Y%m%dT%H%M%S.000Z') AS match_time, a.cust, b.ts, '#' || a.ok AS team_tag, '#' || b.ok AS opponent_tag,
   x.deck AS team_deck, y.deck AS opponent_deck, x.score AS team_score, y.score AS opponent_score
   FROM turns a JOIN turns b ON a.cust = b.cust AND b.rn = a.rn + 1 AND a.rn % 2 = 1 JOIN baskets x ON x.ok = a.ok JOIN baskets y ON y.ok = b.ok),
valid AS (SELECT * FROM matches WHERE len(team_deck) = 3 AND len(opponent_deck) = 3),
sides AS (SELECT *, (s > os)::BIGINT AS w, (s < os)::BIGINT AS l, (s = os)::BIGINT AS d, to_json(deck)::VARCHAR AS sig, to_json(opp)::VARCHAR AS osig FROM (
   SELECT match_id, match_time, cust, ts, 'team' AS side, team_tag AS tag, team_deck AS deck, opponent_deck AS opp, team_score AS s, opponent_score AS os FROM valid
   UNION ALL SELECT match_id, match_time, cust, ts, 'opponent', opponent_tag, opponent_deck, team_deck, opponent_score, team_score FROM valid))
"""
