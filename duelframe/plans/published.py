"""Queries over a published, scope-partitioned store: which scopes a refresh builds, and what a reader then finds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators import scopes as sc
from duelframe.operators import stats, store
from duelframe.plans.registry import query as register
from duelframe.plans.scopes import SCOPED
from duelframe.session import shared_folder
from duelframe.sources import matches as src
from duelframe.sources import observations as ob

#: What identifies a match's content in a scope.
LINE = ("match_id", "match_time", "team_score", "opponent_score")
STORED = SCOPED + """,
first_members AS (SELECT DISTINCT w || '_' || lv AS dataset_scope, match_id FROM obs JOIN gated USING (batch_id), clock, windows, levels
   WHERE status = 'accepted' AND completed_at > now - to_days(e * 20) AND completed_at <= now - to_days(s * 20) AND (lim IS NULL OR (observer_source = 'ranked_direct' AND observer_rank <= lim)) AND observer_rank <= 500),
content_lines AS (SELECT match_id, match_id || '|' || match_time || '|' || team_score || '|' || opponent_score AS line FROM valid),
buckets AS (SELECT round, dataset_scope, substr(md5(line), 1, 2) AS bucket, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest
   FROM (SELECT 1 AS round, * FROM first_members UNION ALL SELECT 2, * FROM members) JOIN content_lines USING (match_id) GROUP BY ALL),
digests AS (SELECT round, dataset_scope, sum(n)::BIGINT AS matches, sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS digest FROM buckets GROUP BY ALL)
"""


def _store(spark, sf_dir: str) -> tuple[str, DataFrame]:
    """A store published twice, first from observers of rank 500 or better, then from all, and the second refresh's scopes."""
    # written, as each generation asks for matches, observations, batches and the time, and all come from the same joins
    rows = store.settled(src.valid(src.matches(spark, sf_dir)))
    seen = store.settled(ob.observations(rows, *src.tables(spark, sf_dir, "customer")))
    raw = store.settled(ob.batches(seen))
    batches, now = sc.gate(raw), ob.now_of(raw)
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    line = F.concat_ws("|", *LINE)
    steps = None
    for generation, observed in (("g1", seen.where("observer_rank <= 500")), ("g2", seen)):
        members = store.settled(sc.membership(observed, batches, now, ob.UNIT_DAYS).join(rows, "match_id"))

        def build(todo: DataFrame, members: DataFrame = members) -> dict[str, DataFrame]:
            sides = src.sides(members.join(F.broadcast(todo), "dataset_scope", "left_semi"))
            total = stats.side_total(sides, ("dataset_scope",))
            return {"items": stats.deck_rates(stats.item_counts(sides, ("dataset_scope",)), total, ("dataset_scope",)).drop("net_win_rate")}

        steps = store.refresh(root, generation, store.scope_digests(members, line), build)
    return root, steps


@register("r192_scope_refresh", """SELECT dataset_scope, CASE WHEN a.digest = b.digest THEN 'reuse' ELSE 'build' END AS action, b.matches, b.digest, items, games
  FROM (FROM digests WHERE round = 2) b LEFT JOIN (FROM digests WHERE round = 1) a USING (dataset_scope) JOIN (SELECT dataset_scope, count(*) AS items, sum(games)::BIGINT AS games FROM sitem GROUP BY 1) USING (dataset_scope)""", STORED)
def scope_refresh(spark, sf_dir):
    """Every scope's action in a second refresh, with what a reader finds of it afterwards."""
    root, steps = _store(spark, sf_dir)
    found = store.load(spark, root, "items").groupBy("dataset_scope").agg(F.count("*").alias("items"), F.sum("games").alias("games"))
    return steps.join(found, "dataset_scope").select("dataset_scope", "action", "matches", "digest", "items", "games")


@register("r7_scope_view", "SELECT item, games, wins, losses, draws, usage_rate, clean_win_rate FROM sitem WHERE dataset_scope = '35d_top_500'", STORED)
def scope_view(spark, sf_dir):
    """One scope read back from the store, from that scope's folder alone."""
    root, _ = _store(spark, sf_dir)
    return store.load(spark, root, "items", "35d_top_500").drop("dataset_scope")
