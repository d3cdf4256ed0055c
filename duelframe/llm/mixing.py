"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import WORD, checkpoint, whole_rows

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SHARD_WORDS = 1 << 20
SEED = 20240607


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) for sized rows.

    Sources in code-point order, null last, take the weights in turn. Their targets share ``share`` of all
    words by weight; a target stops at ``most`` times its source's size and the excess is shared again. That
    fixed point is found in one pass: with sources ordered by cap/weight, a source is capped exactly while
    its cap/weight is at most what is left over, divided by the weight left over.
    """
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    )
    cap = (F.col("source_size") * most).cast("double")
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("_cap", cap)
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(order), F.lit(0.0)))
        .withColumn("_wleft", F.col("_weights") - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("_capped", F.col("_cap") * F.col("_wleft") <= F.col("_left") * F.col("weight"))
        .withColumn("_open_w", F.sum(F.when(~F.col("_capped"), F.col("weight")).otherwise(0.0)).over(everything))
        .withColumn("_capped_sum", F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everything))
    )
    share_of_rest = F.try_divide((F.col("_total") - F.col("_capped_sum")) * F.col("weight"), F.col("_open_w"))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(share_of_rest, F.col("_cap")))
    return filled.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def apportion(parties: DataFrame, seats: Column, votes: Column, cap: Column, group: list[str], order: list[str]) -> DataFrame:
    """Sainte-Laguë: the ``seats`` of each ``group`` go to the highest quotients votes/(2s+1), none beyond ``cap``.

    Dividing by votes/seats and rounding gives each party nearly its seats; only the few seats by which that
    misses are then moved along the quotients, so no list of all seats is made.
    """
    w = Window.partitionBy(*group)
    start = checkpoint(
        parties.withColumn("_votes", votes.cast("double"))
        .withColumn("_cap", cap.cast("long"))
        .withColumn("_seats", F.least(seats.cast("long"), F.sum("_cap").over(w)))
        .withColumn("_ideal", F.coalesce(F.try_divide(F.col("_votes") * F.col("_seats"), F.sum("_votes").over(w)), F.lit(0.0)))
        .withColumn("_s", F.least(F.floor(F.col("_ideal") + 0.5).cast("long"), F.col("_cap")))
        .withColumn("_miss", F.col("_seats") - F.sum("_s").over(w))
        .withColumn("_n", F.count("*").over(w))
        .withColumn("_part", F.coalesce(F.try_divide(F.col("_votes"), F.sum(F.when(F.col("_s") < F.col("_cap"), F.col("_votes"))).over(w)), F.lit(1.0)))
    )
    # seats that may be added (s, s+1, ...) or given back (s-1, s-2, ...): rounding alone moves a party by no more than its part of
    # misses and parties, and one; where caps leave more seats than that, each party may take all of them
    most_moved = F.when(F.abs("_miss") <= F.col("_n"), F.least(F.abs("_miss"), F.floor(F.col("_part") * (F.abs("_miss") + F.col("_n"))) + 2)).otherwise(F.abs("_miss"))
    step = F.explode(F.sequence(F.lit(0), F.greatest(most_moved.cast("long") - 1, F.lit(0).cast("long"))))
    moved = start.where("_miss <> 0").select("*", step.alias("_k"))
    gain = moved.where("_miss > 0 AND _s + _k < _cap").withColumn("_q", F.col("_votes") / (2 * (F.col("_s") + F.col("_k")) + 1))
    lose = moved.where("_miss < 0 AND _s - _k > 0").withColumn("_q", -F.col("_votes") / (2 * (F.col("_s") - F.col("_k")) - 1))
    best = Window.partitionBy(*group).orderBy(F.col("_q").desc(), *order)
    change = (
        gain.unionByName(lose)
        .withColumn("_r", F.row_number().over(best))
        .where("_r <= abs(_miss)")
        .groupBy(*group, *order)
        .agg(F.sum(F.signum("_miss")).cast("long").alias("_change"))
    )
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in dict.fromkeys([*group, *order])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    kept = [F.col(f"l.{c}") for c in parties.columns]
    return start.alias("l").join(change.alias("r"), cond, "left").select(
        *kept, (F.col("l._s") + F.coalesce(F.col("r._change"), F.lit(0))).alias("quota")
    )


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, shard_words: int = SHARD_WORDS, seed: int = SEED, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words that the mix takes of each row of ``docs``, and the row's ``carry`` columns.

    A source is dealt by a seeded hash over shards of about ``shard_words`` words. Blocks of equal token counts are
    apportioned over sources by target, then over a source's shards by size. A shard's documents lie in a seeded order on a ring;
    its quota takes whole turns of the ring and then a run of consecutive blocks from a seeded start, so a
    document is split only at the two ends of that run. Rows with null or empty text have size 0 and take 0.
    Repeated doc_ids are separate rows; equal rows on a ring are ordered by a hash of the row. An empty table gives no rows.
    """
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.col("text")).alias("_order"), *carry
    )
    sized = checkpoint(sized)
    targets = source_targets(sized, weights, share, most)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    blocks = targets.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(512), F.floor(smallest / 200))), F.lit(1)).cast("long"))
    all_seats = F.round(F.sum("target").over(Window.partitionBy()) / F.col("block"))
    quotas = apportion(
        blocks.withColumn("_all", F.lit(0)), all_seats, F.col("target"), F.floor(most * F.col("source_size") / F.col("block")), ["_all"], ["source"]
    ).withColumnRenamed("quota", "source_blocks").drop("_all")
    quotas = checkpoint(quotas)
    # the sources are few beside the documents, but their number is not bounded, so the joins are left to Spark
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))).cast("int")
    placed = (
        sized.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
        .select("d.*", "source_size", "target", "block", "source_blocks", F.pmod(F.col("_order"), shards).alias("shard"))
    )
    per_shard = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("block").alias("block"), F.max("source_blocks").alias("source_blocks"), F.max("source_size").alias("source_size")
    )
    shard_quota = checkpoint(apportion(
        per_shard, F.col("source_blocks"), F.col("shard_size"), F.floor(most * F.col("shard_size") / F.col("block")), ["source"], ["shard"]
    ).select(F.col("source").alias("_src"), F.col("shard").alias("_shard"), "shard_size", (F.col("quota") * F.col("block")).alias("quota_words")))
    ring = Window.partitionBy("source", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        placed.withColumn("offset", F.coalesce(F.sum("size").over(ring), F.lit(0)))
        .join(shard_quota, F.col("source").eqNullSafe(F.col("_src")) & (F.col("shard") == F.col("_shard")))
        .withColumn("turns", F.coalesce(F.try_divide(F.col("quota_words"), F.col("shard_size")), F.lit(0.0)).cast("long"))
        .withColumn("run", F.col("quota_words") - F.col("turns") * F.col("shard_size"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))))
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("n_blocks")) * F.col("block"))
    )
    end = F.col("start") + F.col("run")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("offset") + F.col("size"), hi) - F.greatest(F.col("offset"), lo))

    taken = F.col("turns") * F.col("size") + overlap(F.col("start"), end) + overlap(F.col("start") - F.col("shard_size"), end - F.col("shard_size"))
    return laid.select("doc_id", "source", "size", "source_size", F.col("target"), taken.cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row is repeated by its taken share, rounded to whole copies.

    Every column of ``docs`` is kept, whatever its name. A row whose share rounds to 0 goes; one that is taken twice comes twice. Rows of
    size 0 (null or empty text) carry no tokens and are kept once. Rows with a null or repeated doc_id have their own copies.
    """
    # numbered in a written table, so that a row keeps its number; doc_ids may be null or repeated
    rows = checkpoint(whole_rows(docs, F.monotonically_increasing_id().alias("at")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    mix = mix_sources(rows.select("row.doc_id", "row.source", "row.text", "at"), carry=("at",), **options).select("at", copies.alias("copies")).where("copies > 0")
    return rows.join(mix, "at").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
