"""Near-duplicate documents by SetSketch registers.

A register keeps max(0, min(q + 1, floor(1 - log_b h))) of the smallest exponential hash value h over a document's shingles: a truncated,
exponentially spaced minimum, which merges by maximum and agrees between two documents about as often as their
sets do. Bands of registers give candidate buckets; candidates are estimated jointly by likelihood from the registers and the exact set
sizes, and those not clearly below the threshold are verified on full sets.

Equal sets are one class with one node, so copies are never compared. In a bucket every member is held against one centre: the member that meets
most others in all its buckets, which in a group of edited copies is the text that they were made of. A bucket whose other members then still
belong to several components has pairs that no centre has tried; all members of such buckets go to an exact similarity join over the rarest
shingles of each set (prefix and position bounds, so only pairs that may reach the threshold are made), and its pairs are verified on full sets too.
So every pair of nodes that shares a bucket is decided, without all pairs of a bucket being made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import (
    WordHash, checkpoint, components, discard, hot_keys, map_batches, mix, salted_join, shingles, signed, texts, whole_rows, word_ids,
)

BANDS = 48
ROWS = 7
REGISTERS = BANDS * ROWS
BASE = 1.1
RATE = 20.0
TOP = 255
#: Estimates below this go unverified; it lies more than six standard errors under the threshold of 0.8.
LEAST_ESTIMATE = 0.65

with np.errstate(over="ignore"):
    _A = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _B = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_set(text: bytes, width: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct shingles of the text's words, A-Z lower-cased."""
    return np.unique(shingles(word_ids(text.lower().split(), cache), width))


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers (one byte each) of a set of 64-bit hashes; of two sets' union, the maximum of theirs."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 128):
            low = np.minimum(low, (elements[at : at + 128, None] * _A + _B).min(axis=0))
    h = -np.log1p(-np.minimum(low / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint8)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of every sketch (rows)."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), BANDS)).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) whose set sizes are known.

    The counts of registers that are larger in a, larger in b and equal follow p(u - vJ), p(v - uJ) and the rest, where
    p(x) = -log_b(1 - x (b - 1) / b) and u, v are the sizes over their sum.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    pa_, pb_ = p(u - v * j), p(v - u * j)
    logs = [np.log(np.maximum(x, 1e-12)) for x in (pa_, pb_, 1 - pa_ - pb_)]
    return np.take_along_axis(j, (more * logs[0] + less * logs[1] + same * logs[2]).argmax(axis=1)[:, None], 1)[:, 0]


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    whole = xxhash.xxh3_128_intdigest(elements.tobytes())
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, regs) of every row: set size, 128-bit digest of the set, registers (null for an empty set)."""

    def run(batch: pa.RecordBatch, cache: WordHash) -> dict:
        out: dict[str, list] = {"n": [], "d1": [], "d2": [], "regs": []}
        for text in texts(batch):
            own = shingle_set(text, width, cache)
            d1, d2 = digest(own)
            out["n"].append(len(own))
            out["d1"].append(d1)
            out["d2"].append(d2)
            out["regs"].append(registers(own).tobytes() if len(own) else None)
        return out | {"doc_id": batch.column("doc_id")}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n long, d1 long, d2 long, regs binary", setup=WordHash)


def _keys(batch: pa.RecordBatch) -> dict:
    sketches = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    keys = signed(band_keys(sketches))
    return {"node": batch.column("node"), "n": batch.column("n"), "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))}


def _may_reach(n_a: str, n_b: str, percent: int) -> Column:
    """Sizes alone allow the similarity."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose joint estimate is at least ``least``; ``a`` may be in very many of them."""
    with_b = pairs.join(nodes.select(F.col("node").alias("b"), F.col("regs").alias("regs_b"), F.col("n").alias("n_b")), "b")
    with_a = salted_join(with_b, nodes.select(F.col("node").alias("a"), F.col("regs").alias("regs_a"), F.col("n").alias("n_a")), "a", "inner", hot=hot_keys(pairs, "a"))

    def run(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
        return {"a": batch.column("a"), "b": batch.column("b"), "j": estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())}

    return map_batches(with_a.select("a", "b", "regs_a", "regs_b", "n_a", "n_b"), run, "a long, b long, j double").where(F.col("j") >= least).select("a", "b")


def full_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, elements): the whole shingle set of each node in ``ids``, as sorted 64-bit hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    named = ids.join(nodes.select("node", "rep", "d1", "d2"), "node").join(rows, "rep")

    def run(batch: pa.RecordBatch, cache: WordHash) -> dict:
        out: dict[str, list] = {"node": [], "elements": []}
        for node, d1, d2, text in zip(*(batch.column(c).to_pylist() for c in ("node", "d1", "d2")), texts(batch)):
            own = shingle_set(text, width, cache)
            # a doc_id may have several texts
            if digest(own) == (d1, d2):
                out["node"].append(node)
                out["elements"].append(own.tobytes())
        return out

    return map_batches(named.select("node", "d1", "d2", "text"), run, "node long, elements binary", setup=WordHash).groupBy("node").agg(F.first("elements").alias("elements"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets; ``a`` may be in very many of them."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b")), "b")
    with_a = salted_join(with_b, sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a")), "a", "inner", hot=hot_keys(pairs, "a"))

    def run(batch: pa.RecordBatch) -> dict:
        links = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            own, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(own, other, assume_unique=True))
            links.append(100 * shared >= percent * (len(own) + len(other) - shared))
        return {"a": batch.column("a"), "b": batch.column("b"), "linked": links}

    return map_batches(with_a.select("a", "b", "set_a", "set_b"), run, "a long, b long, linked boolean").where("linked").select("a", "b")


def rare_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that share one of their rarest shingles and may reach the similarity.

    Shingles are ordered by how many of ``sets`` have them. Two sets at the threshold share a shingle among the first n - ceil(n * percent / 100) + 1 of
    either, and behind the first one that they share both must still have enough. Of a shingle's holders only those outside its most frequent label are paired.
    """
    def spread(batch: pa.RecordBatch) -> dict:
        rows = [signed(np.frombuffer(x, np.uint64)) for x in batch.column("elements").to_pylist()]
        sizes = np.array([len(x) for x in rows], np.int64)
        return {"node": np.repeat(batch.column("node").to_numpy(), sizes), "n": np.repeat(sizes, sizes), "g": np.concatenate(rows)}

    elements = checkpoint(map_batches(sets, spread, "node long, n long, g long"))
    common = elements.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ordered = elements.join(common, "g", "left").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "g")))
    head = ordered.where((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    holders = checkpoint(head.join(labels, "node").select("g", "node", "n", "at", "label"))
    discard(elements)
    main = holders.groupBy("g", "label").agg(F.count("*").alias("size")).groupBy("g").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = checkpoint(holders.join(main, "g").drop("labels"))
    discard(holders)
    x = mixed.where("label <> main").select("g", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "at", "label")])
    y = mixed.select("g", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "at", "label")])
    left = 1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    enough = left * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y"))
    found = x.join(y, "g").where((F.col("label_x") != F.col("label_y")) & _may_reach("n_x", "n_y", percent) & enough)
    return found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, least: float = LEAST_ESTIMATE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles; a
    shorter text is one shingle. Null and wordless texts have the empty set and are linked with nothing. component_id is the smallest doc_id reachable, itself
    included, and ``kept`` says that it is the row's own. Rows with one doc_id are one document: those with words share a component. A null doc_id is never
    linked and stays. An empty table gives no rows; other columns are ignored.
    """
    sketched = checkpoint(sketch(docs, width))
    sets = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    bands = map_batches(nodes.select("node", "n", "regs"), _keys, "node long, n long, keys array<long>").select("node", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    crowded = checkpoint(bands.join(shared, "key"))
    popular = crowded.groupBy("node").agg(F.sum("members").alias("popular"))
    centers = checkpoint(crowded.join(popular, "node").groupBy("key").agg(F.max(F.struct("popular", "node", "n")).alias("c")).select("key", F.col("c.node").alias("a"), F.col("c.n").alias("n_a")))
    rest = crowded.join(centers, "key").where("node <> a")
    pairs = checkpoint(rest.where(_may_reach("n", "n_a", percent)).select("a", F.col("node").alias("b")).distinct())
    alike = checkpoint(estimated(pairs, nodes, least))
    ends = alike.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a doc_id with several texts ties its nodes together
    several = sets.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id")
    own = sets.join(several, "doc_id").join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
    tied = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    links = checkpoint(verified(alike, checkpoint(full_sets(ends, nodes, docs, width)), percent).unionByName(tied))
    final = components(links)

    labels = rest.select("key", "node").join(final, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    undecided = labels.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = checkpoint(labels.join(undecided, "key").select("node", "label").distinct())
    if open_.limit(1).count():
        open_sets = checkpoint(full_sets(open_.select("node"), nodes, docs, width))
        more = checkpoint(verified(checkpoint(rare_pairs(open_sets, open_, percent)), open_sets, percent))
        if more.limit(1).count():
            # what is linked already stands as one edge of each node
            final = components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    smallest = final.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = nodes.select("d1", "d2", "node", "rep").join(final, "node", "left").join(smallest, "component", "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("of_class"))
    joined = sketched.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: one document of each component."""
    kept = near_duplicates(docs, width, percent).where("kept").select("doc_id").distinct()
    rows = whole_rows(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(kept, "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL")).select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
reps AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM reps),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
           FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.rep, b.rep),
edges AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT rep AS node, rep AS reach FROM reps UNION SELECT w.node, e.b FROM walk w JOIN pairs e ON e.a = w.reach),
c AS (SELECT node, min(reach) AS component FROM walk GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN reps r ON r.sh = list_sort(s.sh) LEFT JOIN c ON c.node = r.rep
"""
