"""Evaluation statistics: ratios, latency percentiles, bootstrap intervals, paired effects, ranking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equal values up to which bootstrap counts are drawn by inversion.
EXACT = 60


def ratio(test: Column, over: Column | None = None) -> Column:
    """Share of rows that pass, over those where ``over`` holds; 0 if there are none."""
    base = F.lit(True) if over is None else over
    return F.coalesce(F.try_divide(F.count(F.when(base & test, 1)).cast("double"), F.count(F.when(base, 1)).cast("double")), F.lit(0.0))


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, p50, p95 and max; percentiles interpolate linearly between ranks."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), p.alias("_p"), F.max(value).alias("max")).select(
        *by, "n", "mean", F.round(F.col("_p")[0], 6).alias("p50"), F.round(F.col("_p")[1], 6).alias("p95"), "max"
    )


def paired_effect(rows: DataFrame, baseline: str, treatment: str, *by: str) -> DataFrame:
    """Cohen's d of paired differences: 0 when all are 0, null when all are equal but not 0."""
    d = F.col(treatment) - F.col(baseline)
    out = rows.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(d).alias("_mean"), F.stddev_samp(d).alias("_sd"))
    none = F.coalesce(F.col("_sd"), F.lit(0.0)) < 1e-12
    effect = F.when(none & (F.abs("_mean") < 1e-12), F.lit(0.0)).when(~none, F.col("_mean") / F.col("_sd"))
    return out.select(*by, "pairs", F.round("_mean", 6).alias("mean_difference"), F.round(effect, 6).alias("effect"))


def case_scores(rows: DataFrame, k: int) -> DataFrame:
    """(case_id, recall_at_k, reciprocal_rank) from case_id, relevant and retrieved ids."""
    at = F.array_position(F.slice("retrieved", 1, k), F.col("relevant"))
    return rows.select("case_id", F.when(at > 0, 1).otherwise(0).alias("recall_at_k"), F.when(at > 0, 1.0 / at).otherwise(0.0).alias("reciprocal_rank"))


def ranking_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("cases"), F.sum("recall_at_k").cast("long").alias("hits"), F.round(F.avg("recall_at_k"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def misaligned(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """Keys that only one side has; empty for comparable runs."""
    return a.select(key).join(b.select(key), key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.select(key).join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def bootstrap_mean(rows: DataFrame, value: str, iterations: int = 2000, seed: int = 73, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of a mean by Poisson resampling.

    A value that n rows have is drawn Poisson(n) times in every iteration, once per (value, iteration): by inverting the distribution for up to ``EXACT`` rows,
    by the normal approximation with continuity correction beyond. Draws are hashes of value, iteration and seed, so iterations are partial
    sums and no sample is collected.
    """
    n = F.col("n").cast("double")
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    draws = counted.select("v", "n", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("i"))

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64("v", "i", F.lit(seed + salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    # cumulative probabilities of 0, 1, 2, ... events, far enough to hold all but 1e-12 of EXACT expected ones
    start = F.struct(F.lit(0.0).alias("below"), F.exp(-n).alias("p"), F.lit(0).alias("k"), F.lit(0).alias("drawn"))

    def step(state: Column, k: Column) -> Column:
        below = state["below"] + state["p"]
        return F.struct(below.alias("below"), (state["p"] * n / (k + 1)).alias("p"), (k + 1).alias("k"), F.when(F.col("u") >= below, k + 1).otherwise(state["drawn"]).alias("drawn"))

    exact = F.aggregate(F.sequence(F.lit(0), (2 * n + 30).cast("int")), start, step, lambda s: s["drawn"].cast("double"))
    normal = F.sqrt(-2 * F.log(F.col("u"))) * F.cos(2 * 3.141592653589793 * F.col("u2"))
    weight = F.when(n <= EXACT, exact).otherwise(F.greatest(F.lit(0.0), F.round(n + F.sqrt(n) * normal)))
    weighted = draws.withColumn("u", uniform(0)).withColumn("u2", uniform(1)).withColumn("w", weight)
    means = weighted.groupBy("i").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ci = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    centre = rows.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return centre.crossJoin(F.broadcast(ci)).select("n", "mean", F.least(F.col("p")[0], "mean").alias("lower"), F.greatest(F.col("p")[1], "mean").alias("upper"))


def _share(rows_of: str, of: str) -> Column:
    """Sum over sum, negative or missing counts as 0; 0 if nothing was expected."""
    part, whole = (F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).cast("double") for c in (rows_of, of))
    return F.when(whole > 0, part / whole).otherwise(0.0)


#: Metrics of a scorecard and the columns that a row must report to count for them.
METRIC_FIELDS = {
    "retrieval_recall": ("retrieval_relevant", "retrieval_expected"),
    "assertion_support_rate": ("assertions_supported", "assertions_total"),
    "citation_precision": ("citations_correct", "citations_total"),
    "refusal_accuracy": ("refusal_correct",),
    "boundary_violation_rate": ("boundary_violations",),
    "first_token_latency_ms": ("first_token_latency_ms",),
    "total_latency_ms": ("total_latency_ms",),
    "timeout_rate": ("timed_out",),
    "fallback_rate": ("fallback_used",),
    "token_count": ("token_count",),
    "estimated_cost": ("estimated_cost",),
}


def scorecard(rows: DataFrame, *by: str) -> DataFrame:
    """The eleven metrics over the rows that were not ``skipped``, each over the rows that report it, in one aggregation; ``*_rows`` count those."""
    def mean(c: str) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    metrics = {
        "retrieval_recall": _share("retrieval_relevant", "retrieval_expected"),
        "assertion_support_rate": _share("assertions_supported", "assertions_total"),
        "citation_precision": _share("citations_correct", "citations_total"),
        "refusal_accuracy": ratio(F.col("refusal_correct"), F.col("refusal_correct").isNotNull()),
        "boundary_violation_rate": ratio(F.col("boundary_violations") > 0, F.col("boundary_violations").isNotNull()),
        "first_token_latency_ms": mean("first_token_latency_ms"),
        "total_latency_ms": mean("total_latency_ms"),
        "timeout_rate": ratio(F.col("timed_out"), F.col("timed_out").isNotNull()),
        "fallback_rate": ratio(F.col("fallback_used"), F.col("fallback_used").isNotNull()),
        "token_count": F.coalesce(F.sum(F.greatest("token_count", F.lit(0))), F.lit(0)).cast("long"),
        "estimated_cost": F.round(F.coalesce(F.sum(F.greatest("estimated_cost", F.lit(0.0))), F.lit(0.0)), 8),
    }
    reported = [F.count(F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in cols)), 1)).alias(f"{m}_rows") for m, cols in METRIC_FIELDS.items()]
    compared = rows.where(~F.coalesce(F.col("skipped"), F.lit(False)))
    return compared.groupBy(*by).agg(F.count("*").alias("case_count"), *[F.round(c, 8).alias(m) for m, c in metrics.items()], *reported)


def paired_report(baseline: DataFrame, treatment: DataFrame, intervals: bool = False) -> DataFrame:
    """(metric, cases, baseline_mean, treatment_mean, mean_delta, effect) of two runs' ``case_scores``, joined on case_id.

    Runs whose cases differ or repeat are rejected. With ``intervals``, lower and upper bounds of the mean difference by bootstrap.
    """
    sides = F.sum(F.lit(1)).alias("n"), F.sum("left").alias("l")
    both = baseline.select("case_id", F.lit(1).alias("left")).unionByName(treatment.select("case_id", F.lit(0).alias("left")))
    if both.groupBy("case_id").agg(*sides).where("n <> 2 OR l <> 1").limit(1).count():
        raise ValueError("paired runs must hold the same cases, each once")
    names = ("recall_at_k", "reciprocal_rank")
    pairs = baseline.select("case_id", *[F.col(m).alias(f"b_{m}") for m in names]).join(treatment.select("case_id", *[F.col(m).alias(f"t_{m}") for m in names]), "case_id")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").cast("double").alias("b"), F.col(f"t_{m}").cast("double").alias("t")) for m in names]))
    rows = pairs.select(each.alias("x")).select("x.*")
    means = rows.groupBy("metric").agg(F.round(F.avg("b"), 6).alias("baseline_mean"), F.round(F.avg("t"), 6).alias("treatment_mean"))
    out = means.join(paired_effect(rows, "b", "t", "metric"), "metric").select("metric", F.col("pairs").alias("cases"), "baseline_mean", "treatment_mean", F.col("mean_difference").alias("mean_delta"), "effect")
    if not intervals:
        return out
    deltas = rows.select("metric", (F.col("t") - F.col("b")).alias("d"))
    bounds = [bootstrap_mean(deltas.where(F.col("metric") == m), "d").select(F.lit(m).alias("metric"), "lower", "upper") for m in names]
    return out.join(F.broadcast(bounds[0].unionByName(bounds[1])), "metric")
