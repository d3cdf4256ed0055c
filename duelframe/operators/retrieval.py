"""Lexical and dense retrieval, fusion, reranking, diversity and compression as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import settled

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a piece, queries of a block, and products or cells of a piece that are there at once.
PIECE_ROWS, PIECE_QUERIES, CELLS = 2048, 4096, 2_000_000


def tokens(text: Column) -> Column:
    """Runs of letters, digits, dots, hyphens and underscores in lower case, and each CJK character once more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}._-]+)"), 1)
    return F.concat(words, F.regexp_extract_all(text, F.lit(r"([一-鿿])"), 1))


def simple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_.-]+|[一-鿿])"), 1)


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has; 0 for a question without tokens."""
    asked = F.array_distinct(simple_tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, simple_tokens(text))).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def _best_of(at: tuple, docs: pa.Table, weights: pa.Table, k: int, avgdl: float) -> pa.Table:
    """(qid, id, score): the best ``k`` documents (id, toks) of a piece for every query of a block of (qid, term, weight)."""
    terms, asked = (weights.column(c).combine_chunks().dictionary_encode() for c in ("term", "qid"))
    ids = docs.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    # codes of ids in their order, so that ties go by code
    in_order = pc.array_sort_indices(ids.dictionary, null_placement="at_start")
    code = np.argsort(in_order.to_numpy())[ids.indices.to_numpy()]
    by_term = np.argsort(terms.indices.to_numpy(), kind="stable")
    q_of, w_of = asked.indices.to_numpy()[by_term], weights.column("weight").to_numpy()[by_term]
    n_terms, n_asked = len(terms.dictionary), len(asked.dictionary)
    upto = np.r_[0, np.cumsum(np.bincount(terms.indices.to_numpy(), minlength=n_terms))]
    toks = docs.column("toks").combine_chunks()
    lengths = pc.list_value_length(toks).to_numpy()
    term = pc.fill_null(pc.index_in(toks.flatten(), value_set=terms.dictionary), -1).to_numpy()
    # rows of one id and length are one document
    same, row = np.unique(code * (lengths.max(initial=0) + 1) + lengths, return_inverse=True)
    posting, tf = np.unique((np.repeat(row, lengths) * n_terms + term)[term >= 0], return_counts=True)
    owner, length = np.divmod(same[posting // max(1, n_terms)], lengths.max(initial=0) + 1)
    term = posting % max(1, n_terms)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))
    fan = np.diff(upto)[term]
    # some ids at a time, so that neither their cells nor their products are many
    work = np.cumsum(np.bincount(owner, fan, minlength=len(in_order))).astype(np.int64) // CELLS
    bounds = np.flatnonzero(np.r_[True, (np.diff(work) > 0) | (np.diff(np.arange(len(work)) * n_asked // CELLS) > 0), True]) if len(work) else np.zeros(1, np.int64)
    best_q, best_id, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        first, last = np.searchsorted(owner, (lo, hi))
        n = fan[first:last]
        each = np.repeat(np.arange(first, last), n)
        use = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + upto[term[each]]
        cell = (owner[each] - lo) * n_asked + q_of[use]
        score = np.bincount(cell, part[each] * w_of[use], minlength=(hi - lo) * n_asked)
        met = np.flatnonzero(np.bincount(cell, minlength=len(score)))
        q, i, x = np.r_[best_q, met % n_asked], np.r_[best_id, met // n_asked + lo], np.r_[best_score, np.round(score[met], 6)]
        order = np.lexsort((i, -x, q))
        q, i, x = q[order], i[order], x[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        best_q, best_id, best_score = q[kept], i[kept], x[kept]
    return pa.table({"qid": asked.dictionary.take(pa.array(best_q)), "id": ids.dictionary.take(in_order).take(pa.array(best_id)), "score": pa.array(best_score)})


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", piece_rows: int = PIECE_ROWS, piece_queries: int = PIECE_QUERIES) -> DataFrame:
    """(qid, rank, id, score): the best ``k`` documents of every query, ties by id; documents without an asked term score 0 and fill up what is missing to ``k``.

    Statistics cover all of ``docs``. A term in more than half of them would weigh negatively and gets EPSILON times the mean weight
    instead. Document frequencies, the number of documents and their mean length come from one partial aggregation by term, which is written. Documents are dealt
    to pieces and queries to blocks; every piece meets every block's weights, and only the best ``k`` of a query leave a piece, so that no pair of a query and a document
    is shuffled. The result is written, so that its readers do not search again. A null text is an empty document.
    """
    lists = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("toks"))
    # the row without a term stands for the document itself; the outer form, as Spark would make the tokens twice to leave out empty arrays
    terms = lists.select(F.size("toks").alias("dl"), F.explode_outer(F.concat(F.array_distinct("toks"), F.array(F.lit(None).cast("string")))).alias("term"))
    counts = settled(terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length")))
    shape = counts.where("term IS NULL").first()
    n, avgdl = (shape["df"], (shape["length"] / shape["df"]) or 1.0) if shape else (0, 1.0)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = counts.where("term IS NOT NULL").agg(F.avg(raw).alias("mean")).first()["mean"] or 0.0
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    weights = settled(asked.join(counts, "term").select("qid", "term", (F.col("qn") * F.when(raw < 0, EPSILON * F.lit(mean)).otherwise(raw)).alias("weight")))
    pieces, blocks = max(1, -(-n // piece_rows)), max(1, -(-weights.agg(F.countDistinct("qid").alias("n")).first()["n"] // piece_queries))

    def dealt(key: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = lists.select(dealt("id", pieces).alias("piece"), each(blocks).alias("block"), "id", "toks")
    right = weights.select(each(pieces).alias("piece"), dealt("qid", blocks).alias("block"), "qid", "term", "weight")
    kinds = f"qid {weights.schema['qid'].dataType.simpleString()}, id {lists.schema['id'].dataType.simpleString()}, score double"
    key = ("piece", "block")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        lambda at, a, b: _best_of(at, a.select(["id", "toks"]), b, k, avgdl) if len(a) and len(b) else pa.table({c: pa.array([], t) for c, t in (("qid", b.schema.field("qid").type), ("id", a.schema.field("id").type), ("score", pa.float64()))}), kinds
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = settled(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score"))
    # a query with m < k matches lacks k - m documents, and its matches are at most m of the first 2 k
    short = settled(queries.select("qid").distinct().join(best.where(F.col("rank") == k), "qid", "left_anti"))
    if short.limit(1).count() == 0:
        return best
    first = docs.select(F.col(id_col).alias("id")).orderBy("id").limit(2 * k)
    rest = short.crossJoin(F.broadcast(first)).join(best.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    filled = best.join(short, "qid", "left_semi").select("qid", "id", "score").unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return settled(best.join(short, "qid", "left_anti").select("qid", "rank", "id", "score").unionByName(filled.select("qid", "rank", "id", "score")))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def dense(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Best max(3k, 20) rows by cosine; ``where`` filters after that cut, so fewer than ``k`` may come back."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.withColumn("score", F.round(cosine(F.col(col).cast("array<double>"), q), 6)).orderBy(F.desc("score"), id_col).limit(max(3 * k, 20))
    kept = best if where is None else best.where(where)
    return kept.orderBy(F.desc("score"), id_col).limit(k).select(F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"), F.col(id_col).alias("id"), "score")


def min_max(rows: DataFrame, by: str | None = None, col: str = "score") -> DataFrame:
    """Scores scaled to [0, 1] per group; equal scores become 1."""
    w = Window.partitionBy(by) if by else Window.partitionBy()
    low, high = F.min(col).over(w), F.max(col).over(w)
    return rows.withColumn("normalised", F.when(high == low, F.lit(1.0)).otherwise(F.try_divide(F.col(col) - low, high - low)))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """(id, rank_first, rank_second, score): (k + 1) * sum of weight / (k + rank), the first list's order before the second's on ties."""
    k = min(1000, max(1, k))
    both = first.select("id", F.col("rank").alias("rank_first")).join(second.select("id", F.col("rank").alias("rank_second")), "id", "full_outer")
    part = F.coalesce(F.lit(alpha) / (k + F.col("rank_first")), F.lit(0.0)) + F.coalesce(F.lit(1 - alpha) / (k + F.col("rank_second")), F.lit(0.0))
    return both.withColumn("score", F.round((k + 1) * part, 9)).orderBy(F.desc("score"), F.col("rank_first").asc_nulls_last(), "rank_second")


def rerank(rows: DataFrame, question: Column, bonus: Column, top: int) -> DataFrame:
    score = 0.55 * F.col("base") + 0.25 * lexical_overlap(question, F.col("text")) + 0.20 * F.least(bonus, F.lit(1.0))
    return rows.withColumn("rerank_score", F.round(score, 9)).orderBy(F.desc("rerank_score"), "id").limit(top)


def diverse(rows: DataFrame, top: int, per_source: int = 3, by: str = "qid") -> DataFrame:
    """The best of every source first, then the rest by score, at most ``per_source`` of a source."""
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(by, "source").orderBy(F.desc("score"), "id"))).where(F.col("_in") <= per_source)
    order = Window.partitionBy(by).orderBy(F.col("_in") > 1, F.desc("score"), "id")
    return ranked.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= top).drop("_in")


def lanes(*found: DataFrame) -> DataFrame:
    """Several lanes' results, each document once at its best score, with the lanes that found it."""
    both = found[0].withColumn("lane", F.lit(0))
    for i, rows in enumerate(found[1:], 1):
        both = both.unionByName(rows.withColumn("lane", F.lit(i)))
    return both.groupBy("qid", "id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("lane")).alias("lanes"))


def compress(rows: DataFrame, max_items: int, budget: int) -> DataFrame:
    """Greedy choice per query under a character budget: in rank order, repeated ids and texts skipped, too long ones skipped, the first always kept.

    The choice depends on what was taken before, so each query's few ranked rows are walked in Python.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, used, ids, seen = [], 0, set(), set()
        for i, row in enumerate(pdf.sort_values("rank").itertuples()):
            if len(kept) == max_items or row.id in ids or row.text in seen:
                continue
            if kept and used + len(row.text) > budget:
                continue
            kept.append(row.Index)
            used += len(row.text)
            ids.add(row.id)
            seen.add(row.text)
        return pdf.loc[kept, ["qid", "id", "rank"]].assign(chars=[len(t) for t in pdf.loc[kept, "text"]])

    return rows.select("qid", "id", "rank", "text").groupBy("qid").applyInPandas(walk, "qid long, id long, rank int, chars long")
