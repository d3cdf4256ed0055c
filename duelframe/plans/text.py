"""Queries of the text expressions over sentences made from parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.functions import names as nm
from duelframe.functions import text as tx
from duelframe.operators import documents, stats
from duelframe.operators import retrieval as rt
from duelframe.plans.items import BASE
from duelframe.plans.registry import query as register
from duelframe.sources import matches, raw
from duelframe.sources.matches import order_baskets, tables


def _questions(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    made = F.concat(F.lit("show top "), F.col("p_size").cast("string"), F.lit(" by win rate for "), "p_name", F.lit(" rank "), (F.col("p_partkey") % 40).cast("string"), F.lit(" on 2026/"), (F.col("p_partkey") % 12 + 1).cast("string"), F.lit("/7"))
    return part.select("p_partkey", made.alias("text"))


QUESTION = "SELECT p_partkey, 'show top ' || p_size || ' by win rate for ' || p_name || ' rank ' || p_partkey % 40 || ' on 2026/' || (p_partkey % 12 + 1) || '/7' AS text FROM part"


@register("r120_tokens", "SELECT doc_id, len(list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}._-]+'), regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')))::INT AS tokens FROM documents")
def tokens(spark, sf_dir):
    return tables(spark, sf_dir, "documents")[0].select("doc_id", F.size(rt.tokens(F.col("text"))).alias("tokens"))


@register("r132_top_n_and_rank", f"SELECT p_partkey, least(30, greatest(1, regexp_extract(text, 'top (\\d+)', 1)::INT)) AS top_n, least(30, greatest(1, regexp_extract(text, 'rank (\\d+)', 1)::INT)) AS rank FROM ({QUESTION})")
def top_n_and_rank(spark, sf_dir):
    return _questions(spark, sf_dir).select("p_partkey", tx.top_n(F.col("text")).alias("top_n"), tx.rank_target(F.col("text")).alias("rank"))


_METRIC_WORDS = ("净胜率", "win rate or usage rate", "胜率", "how many appearances", "Clean_Win_Rate", "rating", "sample of games", "USAGE RATE")
_DATES = ("on 2026/%d/7", "2025年%d月31日", "2024-%d-09 or 2023-01-01", "2022.%d.5", "in week %d")
_DAY = r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})"
_METRIC_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {a!r})' for a in aliases)} THEN '{name}'" for name, aliases in tx.METRIC_NAMES.items()) + " ELSE 'usage_rate' END"


@register("r133_metric_and_date", f"SELECT p_partkey, {_METRIC_SQL} AS metric, CASE WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS day FROM (SELECT *, regexp_extract(text, '{_DAY}', 1) AS y, regexp_extract(text, '{_DAY}', 2) AS m, regexp_extract(text, '{_DAY}', 3) AS d FROM (SELECT p_partkey, {list(_METRIC_WORDS)!r}[p_partkey % 8 + 1] || ' of ' || p_name || ' ' || printf({list(_DATES)!r}[p_partkey % 5 + 1], p_partkey % 12 + 1) AS text FROM part))")
def metric_and_date(spark, sf_dir):
    """Metrics under several names, two of them in one text, and dates of four kinds, two in one text, or none."""
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, _METRIC_WORDS)), (k % 8 + 1).cast("int"))
    day = F.replace(F.element_at(F.array(*map(F.lit, _DATES)), (k % 5 + 1).cast("int")), F.lit("%d"), (k % 12 + 1).cast("string"))
    text = F.concat(word, F.lit(" of "), "p_name", F.lit(" "), day)
    return tables(spark, sf_dir, "part")[0].select("p_partkey", tx.metric(text).alias("metric"), tx.iso_date(text).alias("day"))


@register("r126_numeric_facts", r"SELECT event_id, len(list_distinct(fs))::INT AS facts, array_to_string(list_sort(list_distinct(fs)), ' ') AS all_facts FROM (SELECT event_id, list_transform(regexp_extract_all(text, '(?i)(?:^| )((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?:%|games?|battles?|appearances?|场|次))', 1), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(replace(regexp_extract(x, '^[\d.,]+'), ',', ''), '0'), '.') ELSE replace(regexp_extract(x, '^[\d.,]+'), ',', '') END || CASE WHEN contains(x, '%') THEN '%' WHEN contains(lower(x), 'appear') OR contains(x, '次') THEN '次' ELSE '场' END) AS fs FROM (SELECT event_id, event_type || ' ' || printf('%.2f', value) || '%' || CASE event_id % 4 WHEN 0 THEN ' over 1,' || printf('%03d', event_id % 1000) || ' games' WHEN 1 THEN ' in ' || user_id || ' Appearances and ' || user_id || '.0 次' WHEN 2 THEN ' v' || user_id || ' games, ' || user_id || ' of them' ELSE ' 7 battles 07 battles 7 场' END AS text FROM events))")
def numeric_facts(spark, sf_dir):
    """Numbers with separators, in two spellings of one unit, after a letter (none) and without a unit (none)."""
    (events,) = tables(spark, sf_dir, "events")
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    tail = (
        F.when(k == 0, F.concat(F.lit(" over 1,"), F.format_string("%03d", F.col("event_id") % 1000), F.lit(" games")))
        .when(k == 1, F.concat(F.lit(" in "), user, F.lit(" Appearances and "), user, F.lit(".0 次")))
        .when(k == 2, F.concat(F.lit(" v"), user, F.lit(" games, "), user, F.lit(" of them"))).otherwise(" 7 battles 07 battles 7 场")
    )
    facts = tx.numeric_facts(F.concat("event_type", F.lit(" "), F.format_string("%.2f", "value"), F.lit("%"), tail))
    return events.select("event_id", F.size(facts).alias("facts"), F.array_join(F.sort_array(F.transform(facts, lambda f: F.concat(f["value"], f["unit"]))), " ").alias("all_facts"))


#: Names with their aliases, among them forms whose aliases are made, and two that begin alike.
NAMES = (
    ("Ring", "ring", 0), ("Ring", "rings", 1), ("Small Ring", "small ring", 2), ("Red Widget", "red-widget", 3), ("Widget", "widget", 4), ("Bolt", "螺栓", 5), ("Ring Evolution", None, 6), ("Hero Bolt", None, 7),
)
ALIASES_SQL = """
names(name, alias, place) AS (VALUES ('Ring', 'ring', 0), ('Ring', 'rings', 1), ('Small Ring', 'small ring', 2), ('Red Widget', 'red-widget', 3), ('Widget', 'widget', 4), ('Bolt', '螺栓', 5), ('Ring Evolution', NULL, 6), ('Hero Bolt', NULL, 7)),
base AS (SELECT name, alias FROM names WHERE alias IS NOT NULL UNION SELECT name, lower(name) FROM names),
made AS (SELECT name, alias FROM base UNION SELECT 'Ring Evolution', replace(t, '{}', alias) FROM base, (SELECT unnest(['{}进化', '进化{}', '觉醒{}', '{}觉醒', 'evo {}', 'evolved {}']) AS t) WHERE name = 'Ring'
  UNION SELECT 'Hero Bolt', replace(t, '{}', alias) FROM base, (SELECT unnest(['英雄{}', '{}英雄', 'hero {}']) AS t) WHERE name = 'Bolt'),
normal AS (SELECT name, trim(regexp_replace(regexp_replace(alias, '[._-]+', ' ', 'g'), ' +', ' ', 'g')) AS alias FROM made),
aliases AS (SELECT name, alias FROM normal UNION SELECT name, replace(alias, ' ', '') FROM normal),
asked AS (SELECT p_partkey, lower(text) AS text FROM (SELECT p_partkey, """ + """CASE p_partkey % 5 WHEN 0 THEN p_name || ' and evolved rings' WHEN 1 THEN '比较 hero螺栓英雄 ' || p_name WHEN 2 THEN 'SMALL.RING, smallring or ring_evolution of ' || p_name WHEN 3 THEN p_name || 'ring bolts' ELSE p_name END AS text FROM part)),
clean AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(text, '[._-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM asked),
hits AS (SELECT p_partkey, i, length(alias) AS n, name FROM clean, aliases, range(1, 60) r(i) WHERE substr(text, i::INT, length(alias)) = alias
  AND (NOT regexp_full_match(alias, '[a-z0-9 .''-]+') OR (NOT regexp_matches(substr(text, (i - 1)::INT, 1), '^[a-z0-9]') OR i = 1) AND NOT regexp_matches(substr(text, (i + length(alias))::INT, 1), '^[a-z0-9]'))),
sorted AS (SELECT p_partkey, list({'i': i, 'e': i + n, 'name': name} ORDER BY i, n DESC, name) AS hs FROM hits GROUP BY p_partkey),
picked AS (SELECT p_partkey, list_reduce(list_transform(hs, lambda h: {'e': h.e, 'i': h.i, 'names': [h.name]}), lambda a, h: CASE WHEN h.i >= a.e AND NOT list_contains(a.names, h.names[1]) THEN {'e': h.e, 'i': 0::BIGINT, 'names': a.names || h.names} ELSE a END, {'e': 0::BIGINT, 'i': 0::BIGINT, 'names': []::VARCHAR[]}).names AS names FROM sorted)
"""


def _asked(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    made = F.when(k == 0, F.concat(name, F.lit(" and evolved rings"))).when(k == 1, F.concat(F.lit("比较 hero螺栓英雄 "), name)).when(k == 2, F.concat(F.lit("SMALL.RING, smallring or ring_evolution of "), name)).when(k == 3, F.concat(name, F.lit("ring bolts"))).otherwise(name)
    return part.select("p_partkey", made.alias("text"))


@register("r131_resolved_names", "SELECT p_partkey, coalesce(array_to_string(names, ','), '') AS names FROM clean LEFT JOIN picked USING (p_partkey)", ALIASES_SQL)
def resolved_names(spark, sf_dir):
    aliases = nm.catalogue(spark.createDataFrame(NAMES, "name string, alias string, at int"))
    return _asked(spark, sf_dir).select("p_partkey", F.array_join(nm.resolve_names(nm.unshared(aliases))("text"), ",").alias("names"))


@register("r207_alias_catalogue", "SELECT alias, count(*) AS names FROM aliases GROUP BY alias", ALIASES_SQL)
def alias_catalogue(spark, sf_dir):
    """All aliases with the number of names that have them."""
    aliases = nm.catalogue(spark.createDataFrame(NAMES, "name string, alias string, at int"))
    return aliases.groupBy("alias").agg(F.count("*").alias("names"))


#: Two names begin or end with a word that is displayed, too.
DISPLAYED = {"Red Widget": "红件", "Large Gear": "大齿轮", "Large": "大", "Small": "小", "Economy": "经济", "Gear": "齿轮"}
DISPLAYED_SQL = "text"
for _name in sorted(DISPLAYED, key=len, reverse=True):
    DISPLAYED_SQL = f"regexp_replace({DISPLAYED_SQL}, '\\b{_name.lower()}\\b', '{DISPLAYED[_name]}', 'gi')"


@register("r137_displayed_answers", f"SELECT p_partkey, trim({DISPLAYED_SQL}) AS answer FROM (SELECT p_partkey, '要点' || chr(10) || '- ' || p_name || ' of ' || p_type || chr(10) || 'Sources of ' || upper(p_name) AS text FROM part)")
def displayed_answers(spark, sf_dir):
    """Answers about parts without markup, with names as they are displayed."""
    (part,) = tables(spark, sf_dir, "part")
    raw = F.concat(F.lit("## Summary：\n* **"), "p_name", F.lit("** of "), "p_type", F.lit("\n### Sources of "), F.upper("p_name"))
    return part.select("p_partkey", nm.replace_names(DISPLAYED)(nm.plain_answer(raw, {"summary": "要点"})).alias("answer"))


_RATES = ("win rate NaN %", "none%", "usage Null  %", "banan%", "nan", "5 %", "win rate 5% none", "(NONE%)")
_CITED = ("snapshot:a1", "Supercell-x:zz", "official:b2|", "other_9:`q`", "plain", "unofficial:b2", "snapshot:a1;snapshot:c3", "OFFICIAL:b2")
_ALLOWED = ("snapshot:a1", "official:b2")


@register("r129_broken_percent", f"SELECT event_id, regexp_matches(text, '(?i)\\b(none|null|nan)\\s*%') AS broken FROM (SELECT event_id, event_type || ' ' || {list(_RATES)!r}[event_id % 8 + 1] || ' ' || value AS text FROM events)")
def broken_percent(spark, sf_dir):
    """Percentages that are no numbers, also in brackets, and words that only end like them."""
    (events,) = tables(spark, sf_dir, "events")
    rate = F.element_at(F.array(*map(F.lit, _RATES)), (F.col("event_id") % 8 + 1).cast("int"))
    return events.select("event_id", tx.has_broken_percent(F.concat("event_type", F.lit(" "), rate, F.lit(" "), F.col("value").cast("string"))).alias("broken"))


@register("r128_citations", f"SELECT event_id, len(list_filter(list_distinct(regexp_extract_all(text, '(?i)\\b((?:supercell|snapshot|official|other)[\\w-]*:[^\\s|`]+)', 1)), lambda x: x NOT IN {_ALLOWED!r}))::INT AS unknown FROM (SELECT event_id, {list(_CITED)!r}[event_id % 8 + 1] || ' and ' || {list(_CITED)!r}[user_id % 8 + 1] || ', ' || event_type AS text FROM events)")
def citations(spark, sf_dir):
    """Two citations of eight kinds: known, unknown, ended by a bar or a quote, in other case, two without a blank, none."""
    (events,) = tables(spark, sf_dir, "events")
    cited = [F.element_at(F.array(*map(F.lit, _CITED)), (F.col(c) % 8 + 1).cast("int")) for c in ("event_id", "user_id")]
    text = F.concat(cited[0], F.lit(" and "), cited[1], F.lit(", "), "event_type")
    return events.select("event_id", F.size(tx.unknown_citations(text, F.array(*map(F.lit, _ALLOWED)))).alias("unknown"))


@register("r138_local_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, (ts + INTERVAL 8 HOUR)::DATE AS local_day FROM events")
def local_dates(spark, sf_dir):
    return tables(spark, sf_dir, "events")[0].select("event_id", tx.iso(F.col("ts")).alias("iso"), tx.local_date(F.col("ts")).alias("local_day"))


@register("r130_number_containment", "SELECT doc_id, count(*) AS extra FROM (SELECT doc_id, n, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d+')) AS n FROM documents) GROUP BY ALL) WHERE c > 1 GROUP BY doc_id")
def number_containment(spark, sf_dir):
    """Numbers that occur more often in a document than once: not contained in a source that has each of them once."""
    numbers = tables(spark, sf_dir, "documents")[0].select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)).alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    return numbers.where("c > 1").groupBy("doc_id").agg(F.count("*").alias("extra"))


@register("r38_field_probe", "SELECT key, count(*) AS rows FROM (SELECT unnest(json_keys(props::JSON)) AS key FROM events) GROUP BY key")
def field_probe(spark, sf_dir):
    return tables(spark, sf_dir, "events")[0].select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


@register("r23_normalised_logs", "SELECT '#' || o.ok AS team_tag, to_json(o.deck)::VARCHAR AS team_deck, o.score AS team_score FROM (SELECT l_orderkey AS ok, list_sort(list_distinct(list(p_type))) AS deck, count(*) FILTER (WHERE l_returnflag = 'R') AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) o")
def normalised_logs(spark, sf_dir):
    """Orders written as raw logs, their side an object or a list, their cards objects or names, and read again."""
    lines, part = tables(spark, sf_dir, "lineitem", "part")
    baskets = order_baskets(lines, part)
    cards = F.when(F.col("ok") % 3 == 0, F.to_json(F.transform("deck", lambda x: F.struct(x.alias("name"))))).otherwise(F.to_json("deck"))
    one = F.concat(F.lit('{"tag":"#'), F.col("ok").cast("string"), F.lit('","crowns":'), F.col("score").cast("string"), F.lit(',"cards":'), cards, F.lit("}"))
    side = F.when(F.col("ok") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    logs = baskets.select(F.concat(F.lit('{"type":"ranked","battleTime":"t","team":'), side, F.lit(',"opponent":{"tag":"#x","deck":["A"]}}')).alias("value"))
    return raw.normalise(raw.parse(logs)).select("team_tag", F.to_json("team_deck").alias("team_deck"), "team_score")


@register("r159_item_documents", "SELECT 'snapshot:item:' || item AS doc_id, 'item' AS source_type, printf('Item: %s; usage rate %.2f%%; clean win rate %.2f%%; %d appearances.', item, usage_rate, clean_win_rate, appearances) AS text FROM item_stats UNION ALL SELECT 'snapshot:pair:' || item || '+' || teammate, 'pair', printf('Pair: %s with %s; %d games.', item, teammate, games) FROM teammates WHERE item < teammate", BASE)
def item_documents(spark, sf_dir):
    sides = matches.sides(matches.valid(matches.matches(spark, sf_dir)))
    made = documents.all_documents(documents.item_documents(stats.item_stats(sides)), documents.deck_documents(stats.deck_stats(sides)), documents.pair_documents(stats.teammates(sides)))
    return made.where("source_type <> 'deck'").select("doc_id", "source_type", "text")


@register("r160_document_checks", "SELECT count(*) AS documents, (count(*) FILTER (WHERE length(doc_id) % 3 <> 1))::INT AS malformed FROM (SELECT 'snapshot:item:' || item AS doc_id FROM item_stats UNION ALL SELECT 'snapshot:pair:' || item || '+' || teammate FROM teammates WHERE item < teammate)", BASE)
def document_checks(spark, sf_dir):
    """Two thirds of the documents, by the length of their id, are blank or hold a percentage that is no number."""
    sides = matches.sides(matches.valid(matches.matches(spark, sf_dir)))
    made = documents.all_documents(documents.item_documents(stats.item_stats(sides)), documents.pair_documents(stats.teammates(sides)))
    kind = F.length("doc_id") % 3
    made = made.withColumn("text", F.when(kind == 0, " ").when(kind == 2, F.concat("text", F.lit(" null %"))).otherwise(F.col("text")))
    bad = documents.malformed(made).agg(F.count("*").cast("int").alias("malformed"))
    return made.agg(F.count("*").alias("documents")).crossJoin(bad)
