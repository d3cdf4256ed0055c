"""Scope-partitioned statistics that are rebuilt only where their content changed.

A generation's tables lie in folders ``tables/<table>/generation=<g>/dataset_scope=<s>``. Its manifest names, for every scope, the digest of the
content that the scope's statistics were made from, and, for every table and scope, the generation whose folder holds them. A scope with the
last manifest's digest is carried into the next one by that reference: nothing of it is read or written again. A reader follows one pointer to one
manifest and opens the folders of the scopes that it asks for, so it sees one generation whole, whatever is published meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelframe.operators import lease as ls
from duelframe.session import settled

#: Layout of folders and manifests; another one makes every scope be rebuilt.
LAYOUT = 1
SCOPES = "dataset_scope string, action string, matches long, digest string, rules string"
PARTS = "table string, dataset_scope string, generation string, rows long, check string, fields string"
PARTITIONS = ("generation", "dataset_scope")
Build = Callable[[DataFrame], dict[str, DataFrame]]


def scope_digests(members: DataFrame, line: Column, scope: str = "dataset_scope", digits: int = 2) -> DataFrame:
    """(dataset_scope, matches, digest): SHA-256 of each scope's content, one ``line`` for each row, whatever their order.

    In two levels: lines are dealt to 16 ** ``digits`` buckets by their MD5, so a task holds one bucket of one scope.
    """
    lines = members.select(scope, line.alias("_line"))
    buckets = lines.groupBy(scope, F.substring(F.md5("_line"), 1, digits).alias("_bucket")).agg(
        F.count("*").alias("_n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("_line"))), 256).alias("_digest")
    )
    ordered = F.array_sort(F.collect_list(F.concat_ws(":", "_bucket", "_digest")))
    return buckets.groupBy(F.col(scope).alias("dataset_scope")).agg(F.sum("_n").alias("matches"), F.sha2(F.concat_ws("\n", ordered), 256).alias("digest"))


def part_checks(rows: DataFrame, table: str, generation: str) -> DataFrame:
    """(table, dataset_scope, generation, rows, check, fields): number of rows and sum of their hashes for each scope, so that no task holds a scope's rows, and the columns' names and types."""
    kept = [f for f in rows.schema if f.name not in PARTITIONS]
    names = sorted(f.name for f in kept)
    total = F.sum(F.xxhash64(*names).cast("decimal(38,0)"))
    return rows.groupBy("dataset_scope").agg(F.count("*").alias("rows"), total.alias("_sum")).select(
        F.lit(table).alias("table"), "dataset_scope", F.lit(generation).alias("generation"), "rows", F.sha2(F.concat_ws("|", "rows", "_sum"), 256).alias("check"),
        F.lit(StructType(kept).json()).alias("fields"),
    )


def manifest(spark: SparkSession, root: str, generation: str | None = None) -> tuple[str, DataFrame, DataFrame] | None:
    """(generation, scopes, parts) of a generation, the one pointed at if none is given; None before the first."""
    if generation is None:
        now = ls.pointed(spark, root)
        if now is None:
            return None
        generation = now["generation"]
    folder = f"{root}/manifests/{generation}"
    return generation, spark.read.schema(SCOPES).json(f"{folder}/scopes"), spark.read.schema(PARTS).json(f"{folder}/parts")


def _folder(root: str, part: Row) -> str:
    return f"{root}/tables/{part['table']}/generation={part['generation']}/dataset_scope={part['dataset_scope']}"


def _read(spark: SparkSession, root: str, parts: list[Row], **options: str) -> DataFrame:
    """Parts of one table, with the columns that the newest of them was written with."""
    newest = max(parts, key=lambda r: r["generation"])
    schema = StructType([*StructType.fromJson(json.loads(newest["fields"])), *[StructField(c, StringType()) for c in PARTITIONS]])
    return spark.read.schema(schema).options(basePath=f"{root}/tables/{newest['table']}", **options).parquet(*[_folder(root, r) for r in parts])


def load(spark: SparkSession, root: str, table: str, scope: str | None = None, generation: str | None = None) -> DataFrame:
    """A published table, or one scope of it; only the folders of that scope are opened.

    A scope that has no rows, or is not there, gives none. A manifest has one line for each table and scope.
    """
    found = manifest(spark, root, generation)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    held = found[2].where(F.col("table") == table).collect()
    if not held:
        raise KeyError(f"{found[0]} has no table {table}")
    rows = _read(spark, root, held).drop("generation")
    return rows if scope is None else rows.where(F.col("dataset_scope") == scope)


def damaged(spark: SparkSession, root: str, generation: str | None = None) -> DataFrame:
    """(table, dataset_scope): parts of a generation whose files are gone, unreadable or other than published."""
    found = manifest(spark, root, generation)
    if found is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    now, held = None, found[2].collect()
    there = [r for r in held if ls.exists(spark, _folder(root, r))]
    for table in sorted({r["table"] for r in there}):
        rows = _read(spark, root, [r for r in there if r["table"] == table], ignoreCorruptFiles="true", ignoreMissingFiles="true")
        checks = part_checks(rows, table, "")
        now = checks if now is None else now.unionByName(checks)
    lost = found[2].select("table", "dataset_scope", "check")
    if now is None:
        return lost.select("table", "dataset_scope")
    return lost.join(now.select("table", "dataset_scope", F.col("check").alias("_now")), ["table", "dataset_scope"], "left").where(~F.col("check").eqNullSafe(F.col("_now"))).select("table", "dataset_scope")


def planned(digests: DataFrame, last: DataFrame | None, rules: str, broken: DataFrame | None = None) -> DataFrame:
    """(dataset_scope, action, matches, digest, rules): ``reuse`` where the last manifest has this digest under the same rules, ``repair`` where parts of such a scope are broken, else ``build``.

    Scopes that are no longer there are left out. Frames have one row for each scope.
    """
    rows = digests.select("dataset_scope", "matches", "digest", F.lit(f"{LAYOUT}:{rules}").alias("rules"))
    if last is None:
        return rows.select("dataset_scope", F.lit("build").alias("action"), "matches", "digest", "rules")
    before = last.select("dataset_scope", F.col("digest").alias("_digest"), F.col("rules").alias("_rules"))
    rows = rows.join(before, "dataset_scope", "left").withColumn("_same", F.coalesce((F.col("digest") == F.col("_digest")) & (F.col("rules") == F.col("_rules")), F.lit(False)))
    lost = F.lit(False)
    if broken is not None:
        rows = rows.join(broken.select("dataset_scope", F.lit(True).alias("_broken")).distinct(), "dataset_scope", "left")
        lost = F.coalesce("_broken", F.lit(False))
    return rows.select("dataset_scope", F.when(F.col("_same") & ~lost, "reuse").when(F.col("_same"), "repair").otherwise("build").alias("action"), "matches", "digest", "rules")


def refresh(root: str, generation: str, digests: DataFrame, build: Build, rules: str = "", owner: str = "refresh", verify: bool = False, lease: ls.Lease | None = None) -> DataFrame:
    """Publish a generation and return its scopes: (dataset_scope, action, matches, digest, rules).

    ``build`` gets the scopes to make (one column, dataset_scope) and returns tables with a column dataset_scope; it is not called if nothing changed. ``rules`` names what
    else the statistics depend on (versions of classifiers, say). With ``verify`` the last generation's parts are read and compared
    first, and scopes with a damaged one are made again. The pointer moves last: a failure, or a writer overtaken by another, leaves readers where they
    were, and a call again with the same generation writes over what the failed one left, scope by scope.
    """
    spark = digests.sparkSession
    own = lease or ls.acquire(spark, root, owner)
    try:
        last = manifest(spark, root)
        broken = settled(damaged(spark, root)) if verify and last else None
        steps = settled(planned(digests, last[1] if last else None, rules, broken))
        todo = steps.where("action <> 'reuse'").select("dataset_scope")
        parts = None
        if todo.limit(1).count():
            for table, rows in build(todo).items():
                target = f"{root}/tables/{table}/generation={generation}"
                # a scope goes to as many files as its size asks for
                rows.hint("rebalance", "dataset_scope").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_scope").parquet(target)
                made = part_checks(spark.read.schema(rows.schema).parquet(target).join(F.broadcast(todo), "dataset_scope", "left_semi"), table, generation)
                parts = made if parts is None else parts.unionByName(made)
        if last:
            kept = last[2].join(F.broadcast(steps.where("action = 'reuse'").select("dataset_scope")), "dataset_scope", "left_semi").select(*[f.name for f in StructType.fromDDL(PARTS)])
            parts = kept if parts is None else parts.unionByName(kept)
        folder = f"{root}/manifests/{generation}"
        steps.coalesce(1).write.mode("overwrite").json(f"{folder}/scopes")
        (spark.createDataFrame([], PARTS) if parts is None else parts).coalesce(1).write.mode("overwrite").json(f"{folder}/parts")
        own.point({"generation": generation})
        return spark.read.schema(SCOPES).json(f"{folder}/scopes")
    finally:
        if lease is None:
            own.release()


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the manifests of all generations but the ``keep`` pointed at last, and the folders that no kept manifest refers to; returns the folders."""
    live = list(dict.fromkeys(p["generation"] for p in ls.all_pointed(spark, root)))[:keep]
    used = {_folder(root, r) for g in live for r in manifest(spark, root, g)[2].collect()}
    fs, base = ls.file_system(spark, f"{root}/tables")
    gone: list[str] = []
    for table in [s.getPath() for s in fs.listStatus(base)] if fs.exists(base) else []:
        for generation in [s.getPath() for s in fs.listStatus(table)]:
            if not fs.getFileStatus(generation).isDirectory():
                continue
            scopes = [s.getPath() for s in fs.listStatus(generation) if s.isDirectory()]
            names = [f"{root}/tables/{table.getName()}/{generation.getName()}/{s.getName()}" for s in scopes]
            old = [(s, n) for s, n in zip(scopes, names) if n not in used]
            for s, n in old:
                fs.delete(s, True)
                gone.append(n.removeprefix(f"{root}/tables/"))
            if len(old) == len(scopes):
                fs.delete(generation, True)
    fs, manifests = ls.file_system(spark, f"{root}/manifests")
    for s in fs.listStatus(manifests):
        if s.getPath().getName() not in live:
            fs.delete(s.getPath(), True)
    return sorted(gone)
