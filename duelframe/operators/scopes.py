"""Rolling, rank-limited scopes: membership, summaries, gates, retention and period deltas.

A scope is a window on batch completion, half open (now - end, now - start], and a limit on the observer's rank. Scopes overlap, so
membership is exploded to (scope, match) once and every statistic is grouped by scope in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import rates

WINDOWS = {"7d": (0, 7), "35d": (0, 35), "d7_14": (7, 14), "d14_21": (14, 21), "d21_28": (21, 28), "d28_35": (28, 35)}
LEVELS = {"top_100": 100, "top_200": 200, "top_500": 500, "top_1000": 1000, "all": None}
DELTA_WINDOWS = (("7d", "d7_14"), ("d7_14", "d14_21"), ("d14_21", "d21_28"), ("d21_28", "d28_35"))
RANKED = "ranked_direct"
MEASURES = ("games", "wins", "losses", "usage_rate", "clean_win_rate")
SCOPES = [(f"{w}_{level}", *WINDOWS[w], limit) for w in WINDOWS for level, limit in LEVELS.items()]


def _after(now: Column, days: float, unit_days: float) -> Column:
    return now - F.make_dt_interval(F.lit(int(days * unit_days)))


def scope_names(completed: Column, source: Column, rank: Column, now: Column, unit_days: float = 1.0) -> Column:
    """Names of all scopes that an observation belongs to; a null rank is in no rank-limited one."""
    tests = [
        F.when(
            (completed > _after(now, end, unit_days)) & (completed <= _after(now, start, unit_days)) & (F.lit(True) if limit is None else (source == RANKED) & (rank <= limit)),
            F.lit(name),
        )
        for name, start, end, limit in SCOPES
    ]
    return F.array_compact(F.array(*tests))


def membership(observations: DataFrame, batches: DataFrame, now: Column, unit_days: float = 1.0) -> DataFrame:
    """Distinct (dataset_scope, match_id) over observations of accepted batches."""
    accepted = batches.where("status = 'accepted'").select("batch_id", "completed_at")
    seen = observations.join(accepted, "batch_id")
    names = scope_names(F.col("completed_at"), F.col("observer_source"), F.col("observer_rank"), now, unit_days)
    return seen.select(F.explode(names).alias("dataset_scope"), "match_id").distinct()


def minimum_rank(observations: DataFrame, batches: DataFrame, now: Column, window_days: float, unit_days: float = 1.0) -> DataFrame:
    recent = batches.where((F.col("status") == "accepted") & (F.col("completed_at") > _after(now, window_days, unit_days)) & (F.col("completed_at") <= now))
    return observations.join(recent.select("batch_id"), "batch_id", "left_semi").groupBy("match_id").agg(F.min("observer_rank").alias("minimum_rank"))


def survivors(rows: DataFrame, observations: DataFrame, key: str = "match_id") -> DataFrame:
    """Rows that some observation still refers to; the rest are orphans."""
    return rows.join(observations.select(key), key, "left_semi")


def retained(batches: DataFrame, now: Column, days: float, most_daily: int = 35, unit_days: float = 1.0) -> DataFrame:
    """Accepted batches inside the retention period, of the daily ones only the newest ``most_daily``."""
    newest = Window.partitionBy("batch_type").orderBy(F.desc("completed_at"), F.desc("batch_id"))
    live = batches.where((F.col("status") == "accepted") & (F.col("completed_at") > _after(now, days, unit_days)))
    return live.withColumn("_rn", F.row_number().over(newest)).where((F.col("batch_type") != "daily") | (F.col("_rn") <= most_daily)).drop("_rn")


def gate(batches: DataFrame, least_coverage: float = 0.99, expansion_target: int = 200_000) -> DataFrame:
    """Status and list of failures of every batch."""
    ranked = F.coalesce(F.try_divide(F.col("ranked_successes").cast("double"), F.col("ranked_target").cast("double")), F.lit(0.0))
    checks = {
        "top_rank_incomplete": F.col("top_rank_successes") < F.col("top_rank_target"),
        "ranked_coverage": ranked < least_coverage,
        "rate_limited": F.col("rate_limited") > 0,
        "conflicts": F.col("conflicts") > 0,
        "expansion_coverage": (F.col("coverage") < least_coverage) & (F.col("unique_matches") < expansion_target),
    }
    failures = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    return batches.withColumn("failures", failures).withColumn("status", F.when(F.size("failures") == 0, "accepted").otherwise("rejected"))


def missing_dates(batches: DataFrame, first: Column, last: Column, zone: str = "UTC") -> DataFrame:
    """Local dates of a period without a completed batch."""
    spine = batches.limit(1).select(F.explode(F.sequence(first, last)).alias("day"))
    have = batches.select(F.to_date(F.from_utc_timestamp("completed_at", zone)).alias("day")).distinct()
    return spine.join(have, "day", "left_anti")


def period_delta(current: DataFrame, baseline: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Full outer comparison of two periods' counters and rates.

    Both frames have ``keys``, games, wins, losses, usage_rate and clean_win_rate; absent items count as 0. Significant is what appeared or
    disappeared at the threshold, or moved by 0.5 points of usage or 3 of wins with disjoint Wilson intervals and enough games on both sides.
    """
    now = current.select(*keys, *[F.col(c).alias(f"current_{c}") for c in MEASURES])
    then = baseline.select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in MEASURES])
    return _judged(now.join(then, keys, "full_outer").na.fill(0), keys, threshold)


def adjacent_deltas(items: DataFrame, pairs: list[tuple[str, str]], key: str, threshold: int) -> DataFrame:
    """The deltas of many scope pairs in one pass over per-scope items, without a join.

    Every row takes part as current scope of its pair and as baseline of the one that follows; the two roles meet in a grouping.
    Pairs of which a scope has no rows are left out.
    """
    before = F.create_map(*[x for c, b in pairs for x in (F.lit(c), F.lit(b))])
    after = F.create_map(*[x for c, b in pairs for x in (F.lit(b), F.lit(c))])
    scope = F.col("dataset_scope")
    roles = F.array(
        F.struct(scope.alias("current_scope"), F.try_element_at(before, scope).alias("baseline_scope"), F.lit(True).alias("now")),
        F.struct(F.try_element_at(after, scope).alias("current_scope"), scope.alias("baseline_scope"), F.lit(False).alias("now")),
    )
    rows = items.select("*", F.explode(roles).alias("r")).where("r.current_scope IS NOT NULL AND r.baseline_scope IS NOT NULL")
    keys = ["current_scope", "baseline_scope", key]
    both = rows.select("r.*", key, *MEASURES).groupBy(*keys).agg(
        *[F.max(F.when(F.col("now"), F.col(c))).alias(f"current_{c}") for c in MEASURES], *[F.max(F.when(~F.col("now"), F.col(c))).alias(f"baseline_{c}") for c in MEASURES]
    )
    pair = Window.partitionBy("current_scope", "baseline_scope")
    ready = both.withColumn("_ready", (F.count("current_games").over(pair) > 0) & (F.count("baseline_games").over(pair) > 0)).where("_ready").drop("_ready")
    return _judged(ready.na.fill(0), keys, threshold)


def _judged(both: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    c_low, c_high = rates.wilson_interval(F.col("current_wins"), F.col("current_losses"))
    b_low, b_high = rates.wilson_interval(F.col("baseline_wins"), F.col("baseline_losses"))
    usage, clean = F.col("current_usage_rate") - F.col("baseline_usage_rate"), F.col("current_clean_win_rate") - F.col("baseline_clean_win_rate")
    appeared = (F.col("baseline_games") == 0) & (F.col("current_games") >= threshold)
    gone = (F.col("current_games") == 0) & (F.col("baseline_games") >= threshold)
    moved = (F.abs(usage) >= 0.5) | (F.abs(clean) >= 3.0)
    enough = (F.col("current_games") >= threshold) & (F.col("baseline_games") >= threshold)
    apart = (c_low > b_high) | (b_low > c_high)
    return both.select(
        *keys, "current_games", "baseline_games", rates.rnd(usage).alias("usage_delta"), rates.rnd(clean).alias("clean_win_delta"),
        F.when(appeared, "appeared").when(gone, "disappeared").otherwise("changed").alias("kind"), (appeared | gone | (enough & apart & moved)).alias("significant"),
    )


def merged(frames: dict[str, DataFrame]) -> DataFrame:
    """Statistics of several scopes as one table with ``dataset_scope``; a column that a scope lacks is null there."""
    named = [rows.select(F.lit(scope).alias("dataset_scope"), "*") for scope, rows in frames.items()]
    out = named[0]
    for rows in named[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def generation_id(summaries: DataFrame, at: Column, prefix: str = "gen") -> DataFrame:
    """One row ``generation_id``: time stamp and the first 12 hex digits of the summaries' digest, one short line for each scope in order."""
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in summaries.columns])
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256)
    return summaries.agg(F.concat_ws("-", F.lit(prefix), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.substring(digest, 1, 12)).alias("generation_id"))
