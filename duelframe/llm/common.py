"""Helpers shared by the operators: table access, checkpoints, hashing and skew handling."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word of the dealt operators: a run of characters outside space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Entries of a task's word caches, and rows that it turns into Python objects at a time.
CACHE_LIMIT = 200_000
BATCH_ROWS = 500
#: Bytes of rows that Spark hands to Python at a time.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` with all its columns inside one struct ``row``, so that no name of theirs clashes with those of ``more``; ``row.*`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def with_row(df: DataFrame, more: str) -> StructType:
    """Schema of a frame that keeps ``row`` of ``whole_rows`` and has the columns ``more``."""
    return StructType([StructField("row", df.schema["row"].dataType), *StructType.fromDDL(more)])


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder and read it back.

    Lineage is cut, an executor's loss costs nothing already written, and the planner sees the table's true size; a chain of
    checkpointed frames would carry size estimates that multiply with every join. The driver then drops what refers to finished shuffles, so
    that Spark removes their files.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a checkpointed frame that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/stage-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """No more than ``BATCH_BYTES`` go to Python at a time from now on, unless the session asks for less.

    Spark's own limit is 64 MB, and a batch is there up to four times outside the heap: as vectors, which grow by doubling, as the buffer that is sent, which does
    too, and in Python. With two tasks that is as much as an executor has beside a full heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, setup: Callable[[], object] | None = None
) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns a batch (and what ``setup`` made once per task) into columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            if batch.num_rows:
                cols = fn(batch, state) if setup else fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else cols[f.name].cast(f.type) for f in target],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def arrow_lists(table: pa.Table, name: str) -> list[np.ndarray]:
    """Rows of a list column as views of one array, without a Python object per element."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


class WordHash(dict):
    """word bytes -> 64-bit hash, kept for words seen lately so that repeated words cost one look-up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_ids(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; a shorter sequence is one shingle, an empty one has none."""
    if not len(ids):
        return ids
    width = min(width, len(ids))
    out = np.zeros(len(ids) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ ids[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
            out ^= out >> np.uint64(29)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def split_by_hash(key: str | Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string")) % F.lit(modulus)


def hot_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys with more than a thousandth of the rows (and over 1,000), of which there are fewer than 1,000 at any size."""
    return hot_counts(rows.where(F.col(key[0]).isNotNull()).groupBy(*key).agg(F.count("*").alias("_n")), rows).select(*key)


def hot_counts(counts: DataFrame, rows: DataFrame, n: str = "_n") -> DataFrame:
    """Those of ``counts`` (one row for each key of ``rows``) with more than a thousandth of the rows, and over 1,000."""
    total = rows.agg((F.count("*") / 1000).alias("_cut"))
    return counts.join(F.broadcast(total), F.col(n) > F.greatest(F.col("_cut"), F.lit(1000.0))).drop("_cut")


def salted_join(many: DataFrame, one: DataFrame, key: str | list[str], how: str = "left", pieces: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """Join where a key may hold a large share of ``many`` and is unique in ``one``.

    The ``hot_keys`` of ``many`` (or those given) are broadcast; their rows of ``many`` are dealt over ``pieces`` and their row of ``one`` is copied to each piece.
    """
    on = [key] if isinstance(key, str) else key
    hot = F.broadcast((hot_keys(many, *on) if hot is None else hot).select(*on, F.lit(True).alias("_hot")))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c in many.columns if c not in on][:2]), F.lit(pieces)).cast("int")).otherwise(0)
    left = many.join(hot, on, "left").withColumn("_salt", deal).drop("_hot")
    right = one.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component being the smallest node reachable.

    Each round every node takes its smallest neighbour, then that one's, and the edges are written anew between what their ends have taken, each once and
    without loops. So a group's edges are joined about once, however many it has, and rounds stop when none is left. Nodes without an edge do not appear.
    """
    left = checkpoint(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    found = None
    while left.limit(1).count():
        ends = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")).select("w.u", "w.v")
        near = checkpoint(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        step = checkpoint(near.join(near.select(F.col("u").alias("m"), F.col("m").alias("c")), "m").select("u", "c"))
        discard(near)
        half = left.join(step.select("u", F.col("c").alias("x")), "u").join(step.select(F.col("u").alias("v"), F.col("c").alias("y")), "v")
        after = checkpoint(half.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        if found is None:
            found = step
        else:
            was, found = found, checkpoint(found.join(step.select(F.col("u").alias("c"), F.col("c").alias("d")), "c", "left").select("u", F.coalesce("d", "c").alias("c")))
            discard(was)
            discard(step)
        discard(left)
        left = after
    return (left.withColumnRenamed("v", "c") if found is None else found).select(F.col("u").alias("node"), F.col("c").alias("component"))
