"""Import, queue, manifest, snapshot, provenance, redaction and display queries; weeks of the adapter are batches, events stand in for records of operation."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.functions import text as tx
from duelframe.operators import audit, intake, stats
from duelframe.operators import loadouts as lo
from duelframe.plans.items import BASE
from duelframe.plans.loadouts import LOADOUTS, full_sides
from duelframe.plans.registry import query as register
from duelframe.sources import matches as src
from duelframe.sources import observations as ob
from duelframe.sources import raw

NUMBER = "CAST(substring(match_id, 2) AS BIGINT)"
IMPORTS = ob.BASE_SQL.strip() + """,
numbered AS (SELECT o.batch_id, o.match_id, o.observer_tag, md5(v.match_time) AS h, substr(o.match_id, 2)::BIGINT AS num FROM obs o JOIN valid v USING (match_id)),
every AS (SELECT batch_id, match_id, observer_tag, h, num FROM numbered UNION ALL
  SELECT batch_id || 'b', match_id, observer_tag + 1, CASE WHEN num % 5 = 0 THEN md5(h) WHEN num % 7 <> 0 THEN h END, num FROM numbered),
firsts AS (SELECT match_id, batch_id, observer_tag, h, num FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY batch_id, observer_tag) AS rn FROM every WHERE h IS NOT NULL) WHERE rn = 1),
acted AS (SELECT e.batch_id, e.match_id, e.observer_tag, CASE WHEN e.h IS NULL OR e.h <> CASE WHEN e.num % 11 = 0 THEN n.h ELSE f.h END THEN 'conflict'
  WHEN e.num % 11 <> 0 AND e.batch_id = f.batch_id AND e.observer_tag = f.observer_tag THEN 'insert' ELSE 'same' END AS action FROM every e JOIN firsts f USING (match_id) JOIN numbered n USING (match_id))
"""


def _observed(spark, sf_dir):
    rows, seen, _ = ob.load(spark, sf_dir)
    return intake.observed(seen, rows.select("match_id", "match_time", "team_tag"))


def _actions(spark, sf_dir):
    """Every match seen twice: the second record differs in every fifth and cannot be read in every seventh; every eleventh is known before."""
    one = _observed(spark, sf_dir).select("batch_id", "match_id", "observer_tag", F.md5("match_time").alias("payload_hash"))
    told = F.expr(f"CASE WHEN {NUMBER} % 5 = 0 THEN md5(payload_hash) WHEN {NUMBER} % 7 <> 0 THEN payload_hash END")
    two = one.select(F.concat("batch_id", F.lit("b")).alias("batch_id"), "match_id", F.expr("observer_tag + 1").alias("observer_tag"), told.alias("payload_hash"))
    return intake.import_actions(one.where(f"{NUMBER} % 11 = 0").select("match_id", "payload_hash"), one.unionByName(two))


@register("r45_observed_matches", "SELECT batch_id, match_id, observer_tag, observer_rank, v.match_time, v.team_tag FROM obs JOIN valid v USING (match_id)", ob.BASE_SQL)
def observed_matches(spark, sf_dir):
    return _observed(spark, sf_dir).select("batch_id", "match_id", "observer_tag", "observer_rank", "match_time", "team_tag")


@register("r8_import_actions", "SELECT batch_id, match_id, observer_tag, action FROM acted", IMPORTS)
def import_actions(spark, sf_dir):
    return _actions(spark, sf_dir).select("batch_id", "match_id", "observer_tag", "action")


@register("r8_batch_reports", "SELECT batch_id, count(*) FILTER (WHERE action = 'insert') AS facts_inserted, count(*) FILTER (WHERE action <> 'conflict') AS observations_imported, count(*) FILTER (WHERE action = 'conflict') AS conflicts, CASE WHEN bool_or(action = 'conflict') THEN 'conflicted' ELSE 'imported' END AS status FROM acted GROUP BY batch_id", IMPORTS)
def batch_reports(spark, sf_dir):
    return intake.batch_reports(_actions(spark, sf_dir))


@register("r8_loadout_coverage", "SELECT year, count(*) AS observed_battle_rows, count(*) FILTER (WHERE c = 2 AND k = 2) AS complete_battle_rows, sum(ev)::BIGINT AS evolution_slots, sum(el)::BIGINT AS elite_slots, sum(k - c)::BIGINT AS slot_contract_failures FROM (SELECT substr(s.match_time, 1, 4) AS year, s.match_id, count(*) AS k, count(*) FILTER (WHERE n = 3 AND ne <= 2 AND nl <= 2 AND ne + nl <= 3) AS c, sum(len(list_filter(items, lambda x: x.evolution > 0 AND NOT x.elite))) AS ev, sum(nl) AS el FROM sides s JOIN config ON '#' || ok = s.tag GROUP BY 1, 2) GROUP BY year", LOADOUTS)
def coverage(spark, sf_dir):
    """Configurations of all sides, those that break the slot contract included."""
    orders, lines, part = src.tables(spark, sf_dir, "orders", "lineitem", "part")
    forms = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("ok"), F.col("p_type").alias("id")).agg(
        (F.max("l_tax") >= 0.07).cast("int").alias("evolution"), (F.max("l_discount") >= 0.09).alias("elite")
    )
    config = forms.groupBy("ok").agg(F.collect_list(F.struct("id", "evolution", "elite")).alias("items")).join(orders, F.col("ok") == F.col("o_orderkey"))
    config = config.select(F.concat(F.lit("#"), F.col("ok").cast("string")).alias("tag"), F.col("o_orderpriority").alias("leader"), "items")
    sides = src.sides(src.valid(src.matches(spark, sf_dir))).join(config, "tag").withColumn("year", F.substring("match_time", 1, 4))
    return intake.loadout_coverage(sides, lo.complete(F.col("leader"), F.col("items"), src.SIZE), ("year",))


@register("r9_archive_import", "SELECT match_id, observer_rank, observer_source FROM obs WHERE substr(match_id, 2)::BIGINT % 4 > 0 UNION ALL SELECT match_id, NULL, 'legacy_full' FROM valid WHERE substr(match_id, 2)::BIGINT % 4 = 0", ob.BASE_SQL)
def archive_import(spark, sf_dir):
    rows, seen, _ = ob.load(spark, sf_dir)
    return intake.import_archive(seen.where(f"{NUMBER} % 4 > 0"), rows).select("match_id", "observer_rank", "observer_source")


@register("r18_publication_queue", "SELECT mode, batch_id, coalesce(a, b) AS queued_at FROM (SELECT event_type AS mode, user_id AS batch_id, min(ts) FILTER (WHERE value < 5) AS a, min(ts) FILTER (WHERE value >= 10) AS b, bool_or(value >= 60) AS done FROM events GROUP BY ALL) WHERE coalesce(a, b) IS NOT NULL AND NOT done")
def publication_queue(spark, sf_dir):
    """Queued once, the earlier entry's time kept, finished ones gone."""
    (events,) = src.tables(spark, sf_dir, "events")
    rows = events.select(F.col("event_type").alias("mode"), F.col("user_id").alias("batch_id"), F.col("ts").alias("queued_at"), "value")
    there = rows.where("value < 5").groupBy("mode", "batch_id").agg(F.min("queued_at").alias("queued_at"))
    return intake.dequeue(intake.enqueue(there, rows.where("value >= 10")), rows.where("value >= 60"))


@register("r10_scope_manifest", "SELECT substr(match_time, 1, 4) AS dataset_scope, substr(md5(match_id), 1, 2) AS part, count(*) AS records, sha256(string_agg(match_id || ',' || match_time, chr(10) ORDER BY match_id)) AS sha256 FROM valid GROUP BY 1, 2", BASE)
def scope_manifest(spark, sf_dir):
    rows = src.valid(src.matches(spark, sf_dir)).select(F.substring("match_time", 1, 4).alias("dataset_scope"), "match_id", "match_time")
    return audit.manifest(rows, "dataset_scope", "match_id", F.concat_ws(",", "match_id", "match_time"))


PATHS = "CASE doc_id % 7 WHEN 0 THEN concat('../d', doc_id) WHEN 1 THEN concat('a/../d', doc_id) WHEN 2 THEN concat('./d', doc_id) WHEN 3 THEN concat('/d', doc_id) WHEN 4 THEN concat('a/../../d', doc_id) WHEN 5 THEN '' ELSE concat('d', doc_id) END"


@register("r211_audit_mismatches", f"SELECT CASE WHEN path = '' THEN '<missing-path>' ELSE path END AS path FROM (SELECT doc_id, {PATHS} AS path FROM documents) WHERE doc_id % 7 IN (0, 3, 4, 5) OR doc_id % 5 = 2 OR doc_id % 13 = 0")
def audit_mismatches(spark, sf_dir):
    (docs,) = src.tables(spark, sf_dir, "documents")
    listed = docs.select(F.expr(PATHS).alias("path"), F.md5(F.col("doc_id").cast("string")).alias("sha256"))
    files = docs.where("doc_id % 5 <> 2").selectExpr("concat('d', doc_id) AS path", "CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE md5(CAST(doc_id AS STRING)) END AS sha256")
    return audit.mismatches(listed, files)


SNAPSHOTS = (
    "event_id",
    "CASE WHEN event_id % 4 = 0 THEN 90 ELSE 100 END AS sample_battles",
    "100 AS target_battles",
    "CASE WHEN event_id % 6 = 1 THEN 5 WHEN event_id % 6 > 2 THEN 0 END AS shortfall_battles",
    "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'ranked' END AS collection_scope",
    "CASE WHEN event_id % 7 = 0 THEN 'v0' ELSE 'v1' END AS scope_contract",
    "CASE WHEN event_id % 3 > 0 THEN 100 END AS record_count",
    "CASE WHEN event_id % 2 = 0 THEN ts END AS published_at",
    "CASE WHEN event_id % 11 > 0 THEN ts END AS fetched_at",
    "event_id % 9 = 0 AS rate_limited",
    "CASE WHEN event_id % 10 > 0 THEN event_id % 10 = 1 END AS refresh_budget_exhausted",
)


@register("r200_snapshot_state", f"SELECT event_id, complete, CASE WHEN t IS NOT NULL THEN greatest(0.0, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(t))::DOUBLE END AS age_seconds, NOT complete OR t IS NULL OR epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(t) >= 864000 AS refresh_due FROM (SELECT event_id, coalesce(published_at, fetched_at) AS t, sample_battles = 100 AND coalesce(shortfall_battles, 0) = 0 AND (collection_scope IS NULL OR (collection_scope = 'ranked' AND scope_contract = 'v1')) AND coalesce(record_count, sample_battles) = sample_battles AND NOT rate_limited AND NOT coalesce(refresh_budget_exhausted, false) AS complete FROM (SELECT {', '.join(SNAPSHOTS)} FROM events))")
def snapshot_state(spark, sf_dir):
    rows = src.tables(spark, sf_dir, "events")[0].selectExpr(*SNAPSHOTS)
    state = audit.snapshot_state(rows, F.to_timestamp(F.lit("2024-01-20 00:00:00")), 100, "ranked", "v1", 864000)
    return state.select("event_id", "complete", "age_seconds", "refresh_due")


@register("r175_provenance", "SELECT item, appearances, CASE WHEN appearances < 20 THEN 'LOW_SAMPLE_WARNING' END AS warning, t.n AS total_sample_battles, v.n AS included_battles, t.n - v.n AS excluded_incomplete_decks, 2 * v.n AS side_records, a AS window_started_at, z AS window_ended_at, 'order tables' AS source, 'exactly_3_unique_items_on_both_sides' AS deck_contract FROM item_stats, (SELECT count(*) AS n, min(match_time) AS a, max(match_time) AS z FROM matches) t, (SELECT count(*) AS n FROM valid) v", BASE)
def provenance(spark, sf_dir):
    rows = src.matches(spark, sf_dir)
    items = stats.item_stats(src.sides(src.valid(rows))).select("item", "appearances")
    return audit.with_provenance(items, rows, src.valid(rows), "appearances", "order tables", "exactly_3_unique_items_on_both_sides")


@register("r96_citation_rates", "SELECT count(*) AS case_count, count(*) FILTER (WHERE g) AS grounded_count, count(*) FILTER (WHERE i) AS invalid_citation_count, count(*) FILTER (WHERE g) / count(*)::DOUBLE AS grounding_rate, count(*) FILTER (WHERE i) / count(*)::DOUBLE AS invalid_citation_rate, false AS snapshot_consistent, false AS passed FROM (SELECT event_id % 40 <> 1 AND event_id % 3 > 0 AS g, event_id % 40 <> 1 AND event_id % 8 = 0 AS i FROM events)")
def citation_rates(spark, sf_dir):
    """Answers of two snapshots held against one; some name none."""
    (events,) = src.tables(spark, sf_dir, "events")
    cases = events.selectExpr("CASE event_id % 40 WHEN 0 THEN ' ' WHEN 1 THEN 's2' ELSE 's1' END AS snapshot_id", "event_id % 3 > 0 AND event_id % 8 > 0 AS passed", "event_id % 3 > 0 AS grounded", "event_id % 8 = 0 AS invalid_citation")
    return audit.citation_rates(cases, "s1")


@register("r140_redaction", "SELECT event_id, '[redacted]' AS api_key, user_id AS asked_by, '[redacted]' AS session_token, value, '[redacted]' AS password, event_type AS kind FROM events")
def redaction(spark, sf_dir):
    (events,) = src.tables(spark, sf_dir, "events")
    inner = F.array(F.struct(F.col("event_type").alias("sessionToken"), "value"))
    rows = events.select("event_id", F.struct(F.col("event_type").alias("API-Key"), F.col("user_id").alias("asked_by"), inner.alias("steps"), F.create_map(F.lit("Password"), F.col("event_type"), F.lit("kind"), F.col("event_type")).alias("extra")).alias("x"))
    clean = rows.select("event_id", audit.redacted(F.col("x"), rows.schema["x"].dataType).alias("x"))
    return clean.select("event_id", F.col("x").getField("API-Key").alias("api_key"), "x.asked_by", F.col("x.steps")[0]["sessionToken"].alias("session_token"), F.col("x.steps")[0]["value"].alias("value"), F.col("x.extra")["Password"].alias("password"), F.col("x.extra")["kind"].alias("kind"))


TYPE_NAMES = {"ECONOMY": "Economy", "PROMO": "Promotion"}


@register("r215_displayed_loadouts", f"SELECT match_id, tag, array_to_string(list_transform(items, lambda x: CASE x.id {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in TYPE_NAMES.items())} ELSE x.id END), ' / ') AS names FROM fs", LOADOUTS)
def displayed_loadouts(spark, sf_dir):
    return full_sides(spark, sf_dir).select("match_id", "tag", F.array_join(F.transform(audit.displayed(F.col("items"), TYPE_NAMES), lambda x: x["display_name"]), " / ").alias("names"))


@register("r31_fact_signatures", "SELECT match_id, tag, 'loadout-v1:' || sha256('{\"cards\":[' || array_to_string(list_transform(items, lambda x: '[\"' || x.id || '\",' || x.evolution || ',' || CASE WHEN x.elite THEN 'true' ELSE 'false' END || ',' || len(x.id) || ']'), ',') || '],\"leader\":\"' || leader || '\"}') AS fact_signature FROM fs", LOADOUTS)
def fact_signatures(spark, sf_dir):
    """The length of an item's name stands for its level."""
    items = F.transform("items", lambda x: x.withField("level", F.length(x["id"])))
    return full_sides(spark, sf_dir).select("match_id", "tag", lo.fact_signature(F.col("leader"), items).alias("fact_signature"))


@register("r55_display_names", "SELECT item, appearances, coalesce(n, item) AS display_name FROM item_stats LEFT JOIN (SELECT p_type, min(p_name) AS n FROM part WHERE p_size > 40 GROUP BY p_type) ON p_type = item", BASE)
def display_names(spark, sf_dir):
    (part,) = src.tables(spark, sf_dir, "part")
    aliases = part.where("p_size > 40").groupBy(F.col("p_type").alias("item")).agg(F.min("p_name").alias("display_name"))
    items = stats.item_stats(src.sides(src.valid(src.matches(spark, sf_dir)))).select("item", "appearances")
    return audit.decorated(items, aliases, "item")


@register("r212_document_stats", "SELECT coalesce(s, lang) AS dataset_scope, coalesce(n, c) AS documents, CASE WHEN n IS NULL THEN 'derived' ELSE 'published' END AS origin FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang) FULL JOIN (SELECT lang AS s, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE lang < 'f' GROUP BY lang UNION ALL SELECT 'none', count(*) FROM labels WHERE toxic = 1) t ON s = lang")
def document_stats(spark, sf_dir):
    """Counts are published for two languages and for a scope without documents, and derived for the others."""
    docs, labels = src.tables(spark, sf_dir, "documents", "labels")
    told = docs.join(labels, "doc_id").where("lang < 'f'").groupBy(F.col("lang").alias("dataset_scope")).agg(F.count("*").alias("documents"))
    none = labels.where("toxic = 1").agg(F.count("*").alias("documents")).select(F.lit("none").alias("dataset_scope"), "documents")
    return audit.document_stats(told.unionByName(none), docs.select(F.col("lang").alias("dataset_scope")))


@register("r19_typed_records", "SELECT event_id FROM events WHERE event_id % 4 < 2")
def typed_records(spark, sf_dir):
    (events,) = src.tables(spark, sf_dir, "events")
    rows = events.selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'PathOfLegend' WHEN 1 THEN ' pathoflegend ' WHEN 2 THEN 'PvP' END AS type")
    return raw.of_type(rows, "pathOfLegend").select("event_id")


_FORMS = "SELECT p_partkey, p_size < 5 AS tower, name, CASE p_partkey % 5 WHEN 0 THEN concat('Evolved ', name) WHEN 1 THEN concat('how is elite ', name) WHEN 2 THEN concat(name, ' evolution rate') WHEN 3 THEN concat(name, ' 觉醒') ELSE concat('rate of ', name) END AS text FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN concat('Elite ', p_name) WHEN p_partkey % 4 = 1 THEN concat(p_name, ' Evolution') ELSE p_name END AS name FROM {part})"


@register("r205_entity_forms", f"""SELECT p_partkey, CASE WHEN tower OR ev OR el THEN 'loadout_entity' ELSE 'base8' END AS entity_mode, CASE WHEN tower THEN 'tower' WHEN ev OR el THEN 'card' END AS entity_type,
  CASE WHEN tower THEN name WHEN ev THEN regexp_replace(name, ' Evolution$', '') WHEN el THEN name END AS entity_name, CASE WHEN tower THEN 'tower' WHEN ev THEN 'evolution' WHEN el THEN 'elite' END AS special_state
  FROM (SELECT p_partkey, tower, name, p_partkey % 5 IN (0, 2, 3) AS ev, p_partkey % 5 = 1 AS el FROM ({_FORMS.format(part='part')}))""")
def entity_forms(spark, sf_dir):
    """A word of a form counts only outside the name: "rate of Elite X" asks for no form, "elite Elite X" does."""
    src.tables(spark, sf_dir, "part")[0].createOrReplaceTempView("duelframe_part")
    return spark.sql(_FORMS.format(part="duelframe_part")).select("p_partkey", tx.entity_form(F.col("text"), F.col("name"), F.col("tower")).alias("x")).select("p_partkey", "x.*")
