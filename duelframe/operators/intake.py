"""Batches of observed matches: import with conflicts, coverage counters, archives without ranks, the publication queue, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def observed(observations: DataFrame, battles: DataFrame, key: str = "match_id") -> DataFrame:
    """Observations with the columns of the match that they saw; those of unknown matches go."""
    return observations.join(battles, key)


def import_actions(known: DataFrame, observations: DataFrame, key: str = "match_id", digest: str = "payload_hash") -> DataFrame:
    """Observations with an ``action``: ``insert`` (the first that sees a new match), ``same`` or ``conflict``.

    ``known`` has key and digest. Observations have batch_id and observer_tag besides, one row for each of (batch, observer, match). A match
    that is not known takes the digest of its first readable observation by (batch, observer); another digest conflicts, as does a null
    one, which stands for an unreadable record. The first observation is found by a minimum, so a match that everyone saw is merged
    before the shuffle.
    """
    rank = F.struct(F.col("batch_id").alias("_b"), F.col("observer_tag").alias("_o"), F.col(digest).alias("_first"))
    first = observations.where(F.col(digest).isNotNull()).groupBy(key).agg(F.min(rank).alias("_f"))
    held = first.join(known.select(key, F.col(digest).alias("_known")), key, "left").select(key, "_f", "_known")
    own = (F.col("_f._b") == F.col("batch_id")) & (F.col("_f._o") == F.col("observer_tag"))
    action = (
        F.when(F.col(digest).isNull(), "conflict")
        .when(F.col(digest) != F.coalesce("_known", F.col("_f._first")), "conflict")
        .when(F.col("_known").isNull() & own, "insert")
        .otherwise("same")
    )
    return observations.join(held, key, "left").withColumn("action", action).drop("_f", "_known")


def batch_reports(actions: DataFrame) -> DataFrame:
    """(batch_id, facts_inserted, observations_imported, conflicts, status) of ``import_actions``."""
    def count(*of: str) -> Column:
        return F.count(F.when(F.col("action").isin(*of), 1))

    made = actions.groupBy("batch_id").agg(count("insert").alias("facts_inserted"), count("insert", "same").alias("observations_imported"), count("conflict").alias("conflicts"))
    return made.withColumn("status", F.when(F.col("conflicts") > 0, "conflicted").otherwise("imported"))


def import_archive(observations: DataFrame, archive: DataFrame, key: str = "match_id", source: str = "legacy_full") -> DataFrame:
    """Observations and one row for every archived match that nobody has observed. Archived matches have no rank and so join no ranked scope."""
    new = archive.select(key).where(F.col(key).isNotNull()).distinct().join(observations.select(key), key, "left_anti")
    return observations.unionByName(new.withColumn("observer_source", F.lit(source)), allowMissingColumns=True)


def loadout_coverage(sides: DataFrame, complete: Column, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Counters of configurations: ``sides`` has the keys, match_id, leader and items; a match is complete if both of its sides are."""
    evolved, elite = F.size(F.filter("items", lambda x: (x["evolution"] > 0) & ~x["elite"])), F.size(F.filter("items", lambda x: x["elite"]))
    by_match = sides.groupBy(*keys, "match_id").agg(
        F.sum(complete.cast("int")).alias("c"), F.sum(evolved).alias("ev"), F.sum(elite).alias("el"), F.sum((~complete).cast("int")).alias("failed"), F.count("*").alias("n")
    )
    return by_match.groupBy(*keys).agg(
        F.count("*").alias("observed_battle_rows"), F.count(F.when((F.col("c") == 2) & (F.col("n") == 2), 1)).alias("complete_battle_rows"), F.sum("ev").cast("long").alias("evolution_slots"),
        F.sum("el").cast("long").alias("elite_slots"), F.sum("failed").cast("long").alias("slot_contract_failures"),
    )


def enqueue(queue: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("mode", "batch_id"), at: str = "queued_at") -> DataFrame:
    """The queue with the entries that it lacks; an entry that is there keeps its time, repeated new ones take the earliest."""
    new = entries.groupBy(*keys).agg(F.min(at).alias(at)).join(queue.select(*keys), list(keys), "left_anti")
    return queue.select(*keys, at).unionByName(new)


def dequeue(queue: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("mode", "batch_id")) -> DataFrame:
    return queue.join(done.select(*keys), list(keys), "left_anti")


def append_trace(rows: DataFrame, path: str) -> None:
    """Trace records, one folder for each day, so that old ones can be removed as folders."""
    rows.withColumn("day", F.to_date("at")).write.partitionBy("day").mode("append").json(path)


def read_trace(spark: SparkSession, path: str, trace_id: str, schema: str) -> DataFrame:
    """The records of one trace in order of time."""
    return spark.read.schema(schema).json(path).where(F.col("trace_id") == trace_id).orderBy("at")
