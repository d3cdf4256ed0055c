"""Raw match logs: JSON lines whose sides are an object or a list of objects and whose cards are objects or names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = "struct<tag:string,crowns:long,cards:array<string>,deck:array<string>>"
RECORD = "type string, battleTime string, team string, opponent string"


def read_lines(spark: SparkSession, path: str, longest: int = 4 << 20) -> DataFrame:
    """Records of JSON lines of at most ``longest`` bytes; a broken one becomes nulls. ``rejected_lines`` lists the others."""
    return parse(spark.read.text(path).where(F.octet_length("value") <= longest))


def rejected_lines(spark: SparkSession, path: str, longest: int = 4 << 20) -> DataFrame:
    """(file, bytes, code) of the lines that ``read_lines`` leaves out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.octet_length("value").alias("bytes"))
    return lines.where(F.col("bytes") > longest).withColumn("code", F.lit("LINE_TOO_LONG"))


def parse(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def side(raw: Column) -> Column:
    """One side, whether it is written as an object or as the first of a list."""
    return F.try_element_at(F.from_json(raw, f"array<{SIDE}>"), F.lit(1))


def names(of: Column) -> Column:
    """Sorted, trimmed, non-empty card names of a side, from ``cards`` or else ``deck``."""
    cards = F.coalesce(F.when(F.size(of["cards"]) > 0, of["cards"]), of["deck"], F.array().cast("array<string>"))
    plain = F.transform(cards, lambda c: F.trim(F.coalesce(F.get_json_object(c, "$.name"), c)))
    return F.array_sort(F.filter(plain, lambda n: n != ""))


def of_type(records: DataFrame, wanted: str) -> DataFrame:
    return records.where(F.lower(F.trim("type")) == wanted.lower())


def normalise(records: DataFrame) -> DataFrame:
    """match_id, match_time, tags, decks, scores, won. The id does not depend on the order of the sides; without a time it is null."""
    both = records.select("battleTime", side(F.col("team")).alias("t"), side(F.col("opponent")).alias("o"))
    flat = both.select(
        F.col("battleTime").alias("match_time"), F.col("t.tag").alias("team_tag"), F.col("o.tag").alias("opponent_tag"), names(F.col("t")).alias("team_deck"), names(F.col("o")).alias("opponent_deck"),
        F.coalesce("t.crowns", F.lit(0)).alias("team_score"), F.coalesce("o.crowns", F.lit(0)).alias("opponent_score"),
    )
    one = F.to_json(F.struct(F.col("team_tag").alias("tag"), F.col("team_deck").alias("deck"), F.col("team_score").alias("score")))
    two = F.to_json(F.struct(F.col("opponent_tag").alias("tag"), F.col("opponent_deck").alias("deck"), F.col("opponent_score").alias("score")))
    key = F.substring(F.sha2(F.concat_ws("|", F.col("match_time"), F.array_join(F.array_sort(F.array(one, two)), "|")), 256), 1, 24)
    return flat.select(F.when(F.col("match_time").isNotNull(), key).alias("match_id"), "*", (F.col("team_score") > F.col("opponent_score")).alias("won"))


def canonical(rows: DataFrame) -> DataFrame:
    """Sides in the order of (tag, deck, score), so that both observers' views of a match are one record."""
    def of(own: str) -> Column:
        return F.struct(F.col(f"{own}_tag").alias("tag"), F.col(f"{own}_deck").alias("deck"), F.col(f"{own}_score").alias("score"))

    ordered = rows.withColumn("_s", F.array_sort(F.array(of("team"), of("opponent"))))
    for i, own in enumerate(("team", "opponent")):
        for c in ("tag", "deck", "score"):
            ordered = ordered.withColumn(f"{own}_{c}", F.col("_s")[i][c])
    return ordered.withColumn("won", F.col("team_score") > F.col("opponent_score")).drop("_s")


def _complete(size: int) -> Column:
    def exact(c: str) -> Column:
        return (F.size(c) == size) & (F.size(F.array_distinct(c)) == size)

    return F.coalesce(exact("team_deck") & exact("opponent_deck"), F.lit(False))


def usable(rows: DataFrame, size: int) -> DataFrame:
    """Matches with two complete decks, each id once: of rows that share one, the smallest by their other columns in order (rows without an id are all kept)."""
    good, others = rows.where(_complete(size)), [c for c in rows.columns if c != "match_id"]
    once = good.where("match_id IS NOT NULL").groupBy("match_id").agg(F.min(F.struct(*others)).alias("r")).select("match_id", "r.*")
    return once.unionByName(good.where("match_id IS NULL").select("match_id", *others)).select(*rows.columns)


def selection_counters(rows: DataFrame, size: int) -> DataFrame:
    """One row: inspected, incomplete, duplicates and usable records."""
    good = _complete(size)
    one = rows.agg(
        F.count("*").alias("inspected"), F.count(F.when(~good, 1)).alias("incomplete"), F.count(F.when(good & F.col("match_id").isNotNull(), 1)).alias("_named"),
        F.countDistinct(F.when(good, F.col("match_id"))).alias("_once"), F.count(F.when(good & F.col("match_id").isNull(), 1)).alias("_plain"),
    )
    return one.select("inspected", "incomplete", F.expr("_named - _once").alias("duplicates"), F.expr("_once + _plain").alias("usable"))
