"""Corpus mutation expressed as set operations: insert-or-conflict, upserts, latest rows, retention, queues, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload_hash(*cols: str) -> Column:
    """SHA-256 of the compact JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def first_facts(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of every key; later ones with another hash are conflicts."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def insert_or_conflict(existing: DataFrame, incoming: DataFrame, key: str, digest: str = "payload_hash") -> DataFrame:
    """Incoming rows with action: ``insert`` (new key), ``same`` or ``conflict`` (known key, other hash)."""
    known = existing.select(F.col(key), F.col(digest).alias("existing_hash"))
    action = F.when(F.col("existing_hash").isNull(), "insert").when(F.col("existing_hash") == F.col(digest), "same").otherwise("conflict")
    return incoming.join(known, key, "left").withColumn("action", action)


def upsert_observations(existing: DataFrame, incoming: DataFrame, keys: list[str], rank: str = "observer_rank") -> DataFrame:
    """One row per key with the smallest rank known; null ranks lose to any rank."""
    return existing.unionByName(incoming).groupBy(*keys).agg(F.min(rank).alias(rank))


def merge_loadouts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Action per incoming configuration (columns hash, fact, complete, quality).

    Equal hashes are no-ops; two complete ones with one fact refresh, with different facts conflict; else the higher quality replaces.
    """
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in ("hash", "fact", "complete", "quality")])
    action = (
        F.when(F.col("old_hash").isNull(), "insert").when(F.col("hash") == F.col("old_hash"), "same")
        .when(F.col("complete") & F.col("old_complete"), F.when(F.col("fact") == F.col("old_fact"), "refresh").otherwise("conflict"))
        .when(F.col("quality") > F.col("old_quality"), "replace").otherwise("keep")
    )
    return incoming.join(old, key, "left").withColumn("action", action)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def newest(rows: DataFrame, order: list[Column], most: int, alive: Column) -> DataFrame:
    """At most ``most`` newest rows that are alive; a top-k, so only each task's best leave it."""
    return rows.where(alive).orderBy(*order).limit(most)


def request_upsert(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Last status and number of attempts of every key."""
    return attempts.groupBy(key).agg(F.max_by("status", order).alias("status"), F.count("*").alias("attempts"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent insert: rows whose key is not there yet, each key once."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def reviewed_export(candidates: DataFrame, reviews: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Candidates with earlier reviews' columns kept where they exist."""
    old = reviews.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    joined = candidates.join(old, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in candidates.columns])


def document_counts(docs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Documents per scope and source type, and whether the type's budget is used up."""
    budget = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return docs.groupBy("scope", "source_type").agg(F.count("*").alias("documents")).withColumn("saturated", F.coalesce(F.col("documents") >= F.try_element_at(budget, F.col("source_type")), F.lit(False)))


def within_budget(docs: DataFrame, limits: dict[str, int], order: list[Column]) -> DataFrame:
    """At most a source type's budget of documents in every scope."""
    budget = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    ranked = docs.withColumn("_rn", F.row_number().over(Window.partitionBy("scope", "source_type").orderBy(*order)))
    return ranked.where(F.col("_rn") <= F.coalesce(F.try_element_at(budget, F.col("source_type")), F.col("_rn"))).drop("_rn")


def compare_documents(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, issue) of missing, unexpected and changed documents; nulls compare as values."""
    both = expected.select(key, F.col(value).alias("_e"), F.lit(True).alias("_in_e")).join(actual.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), key, "full_outer")
    issue = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "unexpected").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return both.select(key, issue.alias("issue")).where(F.col("issue").isNotNull())
