"""Manifests of exported parts and their verification, the state of snapshots, provenance, redaction and display names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions import rates

# Fields whose names are sensitive, what replaces their values, and what stands for a path that is not given.
SENSITIVE = "(?i)(?:api[_-]?key|token|authorization|secret|password)"
REDACTED = "[redacted]"
NO_PATH = "<missing-path>"


def manifest(rows: DataFrame, scope: str, key: str, line: Column, digits: int = 2) -> DataFrame:
    """(scope, part, records, sha256): every scope's lines in 16 ** ``digits`` parts by the beginning of the key's MD5, each hashed in key order."""
    lines = rows.select(scope, F.substring(F.md5(key), 1, digits).alias("part"), F.struct(F.col(key).alias("k"), line.alias("v")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), "\n")
    return lines.groupBy(scope, "part").agg(F.count("*").alias("records"), F.sha2(text, 256).alias("sha256"))


def resolved_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it is absolute or leaves its folder."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up, none = part == "..", F.size(acc["kept"]) == 0
        kept = F.when(up, F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).when(part.isin("", "."), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & none)).alias("out"))

    walked = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~walked["out"] & ~path.startswith("/"), F.array_join(walked["kept"], "/"))


def mismatches(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of ``listed`` (path, sha256) that leave the folder, are not among ``files`` (path, sha256) or have another digest."""
    named = listed.select(F.coalesce("path", F.lit("")).alias("path"), "sha256", resolved_path(F.coalesce("path", F.lit(""))).alias("_at"))
    there = files.select(F.col("path").alias("_at"), F.col("sha256").alias("_actual"))
    wrong = named.join(there, "_at", "left").where(~F.coalesce(F.col("_actual") == F.col("sha256"), F.lit(False)))
    return wrong.select(F.when(F.col("path") == "", NO_PATH).otherwise(F.col("path")).alias("path"))


def snapshot_state(rows: DataFrame, now: Column, target: int, scope: str, contract: str, refresh_seconds: int) -> DataFrame:
    """Snapshots with complete, age_seconds and refresh_due.

    Rows have sample_battles, target_battles, shortfall_battles, collection_scope, scope_contract, record_count (null: not declared),
    published_at, fetched_at, rate_limited and refresh_budget_exhausted. A snapshot without a scope is held to no contract; ages are of the
    publication, else of the fetch, not below 0, and null without either; what is incomplete or has no time is due.
    """
    exact = F.col("sample_battles").eqNullSafe(F.lit(target)) & F.col("target_battles").eqNullSafe(F.lit(target)) & (F.coalesce("shortfall_battles", F.lit(0)) == 0)
    agreed = F.col("collection_scope").isNull() | (F.col("collection_scope").eqNullSafe(F.lit(scope)) & F.col("scope_contract").eqNullSafe(F.lit(contract)))
    declared = F.col("record_count").isNull() | (F.col("record_count") == F.col("sample_battles"))
    clean = ~F.coalesce("rate_limited", F.lit(False)) & ~F.coalesce("refresh_budget_exhausted", F.lit(False))
    seconds = now.cast("timestamp").cast("double") - F.coalesce("published_at", "fetched_at").cast("timestamp").cast("double")
    done = rows.withColumn("complete", exact & agreed & F.coalesce(declared, F.lit(False)) & clean)
    return done.withColumn("age_seconds", F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))).withColumn("refresh_due", ~F.col("complete") | seconds.isNull() | (seconds >= refresh_seconds))


def with_provenance(rows: DataFrame, matches: DataFrame, valid: DataFrame, games: str, source: str, contract: str) -> DataFrame:
    """Rows with where they come from, a single row that is broadcast, and the warning of small samples."""
    origin = matches.agg(F.count("*").alias("total_sample_battles"), F.min("match_time").alias("window_started_at"), F.max("match_time").alias("window_ended_at")).crossJoin(valid.agg(F.count("*").alias("included_battles")))
    facts = origin.select("*", F.expr("total_sample_battles - included_battles").alias("excluded_incomplete_decks"), F.expr("2 * included_battles").alias("side_records"), F.lit(source).alias("source"), F.lit(contract).alias("deck_contract"))
    return rows.withColumn("warning", rates.low_sample(F.col(games))).crossJoin(F.broadcast(facts))


def citation_rates(cases: DataFrame, snapshot: str | None = None) -> DataFrame:
    """One row over cases (snapshot_id, passed, grounded, invalid_citation): counts, rates, whether all are of one snapshot, and the verdict.

    A blank or null snapshot_id names none. With a ``snapshot`` asked for, cases of another one count as failed, ungrounded and not as
    invalid citations.
    """
    own = F.nullif(F.trim("snapshot_id"), F.lit(""))
    foreign = F.coalesce(own != snapshot, F.lit(False)) if snapshot else F.lit(False)

    def count(of: Column) -> Column:
        return F.count(F.when(~foreign & F.coalesce(of, F.lit(False)), 1))

    made = cases.agg(
        F.count("*").alias("case_count"), count(F.col("grounded")).alias("grounded_count"), count(F.col("invalid_citation")).alias("invalid_citation_count"), count(F.col("passed")).alias("_passed"),
        F.min(own).alias("_low"), F.max(own).alias("_high"),
    )
    one = F.col("_low").eqNullSafe(F.col("_high")) & (F.coalesce(F.col("_low") == snapshot, F.lit(True)) if snapshot else F.col("_low").isNotNull())
    rate = [F.coalesce(F.try_divide(f"{c}_count", "case_count"), F.lit(0.0)).alias(f"{n}_rate") for c, n in (("grounded", "grounding"), ("invalid_citation", "invalid_citation"))]
    return made.select(
        "case_count", "grounded_count", "invalid_citation_count", *rate, one.alias("snapshot_consistent"),
        (one & (F.col("case_count") > 0) & (F.col("_passed") == F.col("case_count"))).alias("passed"),
    )


def redacted(of: Column, kind: T.DataType) -> Column:
    """The value with every sensitive field replaced, at any depth of structs, arrays and maps with text keys."""
    def field(f: T.StructField) -> Column:
        return (F.lit(REDACTED) if re.search(SENSITIVE, f.name) else redacted(of[f.name], f.dataType)).alias(f.name)

    if isinstance(kind, T.StructType):
        return F.when(of.isNotNull(), F.struct(*map(field, kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(of, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(of, lambda k, v: F.when(k.rlike(SENSITIVE), REDACTED).otherwise(v))
        # values of another type cannot hold the mark, so they become null
        return F.transform_values(of, lambda k, v: F.when(~k.rlike(SENSITIVE), redacted(v, kind.valueType)))
    return of


def displayed(items: Column, names: dict[str, str]) -> Column:
    """Items with ``display_name``: their id's name, else the id."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return F.transform(items, lambda x: x.withField("display_name", F.coalesce(F.try_element_at(lookup, x["id"]), x["id"])))


def decorated(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Rows with ``display_name`` from aliases (key, display_name), one row for each key; a key without one shows itself."""
    return rows.join(aliases.select(key, "display_name"), key, "left").withColumn("display_name", F.coalesce("display_name", key))


def document_stats(published: DataFrame, documents: DataFrame, scope: str = "dataset_scope") -> DataFrame:
    """(scope, documents, origin): the published count of a scope, else the one derived from its documents."""
    derived = documents.groupBy(scope).agg(F.count("*").alias("_derived"))
    both = published.select(scope, F.col("documents").alias("_told")).join(derived, scope, "full_outer")
    return both.select(scope, F.coalesce("_told", "_derived").alias("documents"), F.when(F.col("_told").isNotNull(), "published").otherwise("derived").alias("origin"))
