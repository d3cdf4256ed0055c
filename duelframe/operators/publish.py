"""Versioned publication: a table is written whole, counted, then named by a pointer; older versions are pruned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, key: str) -> str:
    """SHA-256 over the number of rows and the sum of row hashes, so that no task holds all keys."""
    wide = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    got = rows.agg(F.sha2(F.concat_ws("|", F.count(key).cast("string"), F.coalesce(F.sum(wide), F.lit(0)).cast("string")), 256).alias("h")).first()
    return got["h"]


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def publish(rows: DataFrame, root: str, version: str, key: str, per_file: int = 50_000) -> dict:
    """Write a version, check its count, write its manifest and name it by a new pointer; a failure leaves the last pointer alone.

    Pointers are numbered folders. A new one is written aside and renamed into place, which is one step of the file system, so a reader finds the old one or the new one.
    One publisher is at work at a time.
    """
    spark, target = rows.sparkSession, f"{root}/versions/{version}"
    rows.write.option("maxRecordsPerFile", per_file).mode("errorifexists").parquet(target)
    written = spark.read.parquet(target)
    manifest = {"version": version, "rows": written.count(), "fingerprint": fingerprint(written, key)}
    spark.createDataFrame([manifest]).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{version}")
    aside = f"{root}/staged/{uuid.uuid4().hex}"
    spark.createDataFrame([{"version": version}]).coalesce(1).write.json(aside)
    number = int((_pointers(spark, root) or ["0"])[-1]) + 1
    fs, folder = _fs(spark, f"{root}/pointers")
    fs.mkdirs(folder)
    if not fs.rename(_fs(spark, aside)[1], _fs(spark, f"{root}/pointers/{number:012d}")[1]):
        raise OSError(f"pointer {number} of {root} could not be put in place")
    return manifest


def _pointers(spark: SparkSession, root: str) -> list[str]:
    fs, folder = _fs(spark, f"{root}/pointers")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def active(spark: SparkSession, root: str) -> str | None:
    names = _pointers(spark, root)
    return spark.read.schema("version string").json(f"{root}/pointers/{names[-1]}").first()["version"] if names else None


def load(spark: SparkSession, root: str) -> DataFrame:
    version = active(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/versions/{version}")


def unchanged(rows: DataFrame, root: str, key: str) -> bool:
    """Whether the active version has the same content, so that a rebuild can be skipped."""
    spark, version = rows.sparkSession, active(rows.sparkSession, root)
    if version is None:
        return False
    return spark.read.json(f"{root}/manifests/{version}").first()["fingerprint"] == fingerprint(rows.select(*load(spark, root).columns), key)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all versions but the newest ``keep`` by name and the active one."""
    fs, path = _fs(spark, f"{root}/versions")
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    gone = [n for n in names[: max(0, len(names) - keep)] if n != active(spark, root)]
    for name in gone:
        for folder in ("versions", "manifests"):
            store, old = _fs(spark, f"{root}/{folder}/{name}")
            store.delete(old, True)
    return gone


def export_jsonl(rows: DataFrame, path: str, order: str, per_file: int = 50_000) -> int:
    """JSON lines in the order of a column, a bounded number to a file; returns the count read back."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", per_file).mode("errorifexists").json(path)
    return rows.sparkSession.read.text(path).count()
