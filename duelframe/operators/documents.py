"""Evidence documents made from aggregates, and the checks that they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions import text as tx

COLUMNS = ("doc_id", "source_type", "text", "metadata")


def _document(rows: DataFrame, kind: str, key: Column, text: Column, **metadata: Column) -> DataFrame:
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return rows.select(F.concat(F.lit(f"snapshot:{kind}:"), key).alias("doc_id"), F.lit(kind).alias("source_type"), text.alias("text"), F.create_map(*pairs).alias("metadata"))


def item_documents(items: DataFrame) -> DataFrame:
    text = F.format_string(
        "Item: %s; usage rate %.2f%%; clean win rate %.2f%%; %d appearances.", "item", "usage_rate", "clean_win_rate", "appearances"
    )
    return _document(items, "item", F.col("item"), text, usage_rate=F.col("usage_rate"), win_rate=F.col("clean_win_rate"), appearance_count=F.col("appearances"))


def deck_documents(decks: DataFrame) -> DataFrame:
    cards = F.array_join(F.from_json("deck_signature", "array<string>"), ", ")
    text = F.format_string("Deck: %s; %d games; clean win rate %.2f%%.", cards, F.col("games"), F.col("clean_win_rate"))
    return _document(decks, "deck", F.md5("deck_signature"), text, cards=cards, battles=F.col("games"), sample_win_rate=F.col("clean_win_rate"))


def pair_documents(teammates: DataFrame) -> DataFrame:
    text = F.format_string("Pair: %s with %s; %d games.", "item", "teammate", "games")
    return _document(teammates.where("item < teammate"), "pair", F.concat_ws("+", "item", "teammate"), text, games=F.col("games"))


def all_documents(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def malformed(docs: DataFrame) -> DataFrame:
    """Documents without text, with a broken percentage, or whose type's numbers are missing."""
    def number(name: str) -> Column:
        return F.try_element_at("metadata", F.lit(name)).try_cast("double").isNotNull()

    bad = (F.trim("text") == "") | F.col("text").isNull() | tx.has_broken_percent(F.col("text"))
    item = (F.col("source_type") == "item") & ~(number("usage_rate") & number("win_rate") & number("appearance_count"))
    deck = (F.col("source_type") == "deck") & ~(number("battles") & number("sample_win_rate") & (F.try_element_at("metadata", F.lit("cards")) != ""))
    return docs.where(F.coalesce(bad, F.lit(True)) | F.coalesce(item, F.lit(False)) | F.coalesce(deck, F.lit(False)))


def repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


def probe(docs: DataFrame) -> Column:
    """The question by which a document should be found."""
    return (
        F.when(F.col("source_type") == "item", F.concat(F.lit("usage rate of "), F.substring_index(F.col("text"), ";", 1)))
        .when(F.col("source_type") == "deck", F.concat(F.lit("win rate of "), F.substring_index(F.col("text"), ";", 1))).otherwise(F.substring_index(F.col("text"), ";", 1))
    )
