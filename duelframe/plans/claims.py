"""Grounding queries: answers and evidence of several sentences made from events, held against the same claims written as relations in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators import claims as cl
from duelframe.plans.registry import query as register
from duelframe.sources.matches import tables

FAR = "which players of every league asked about most of the time"
#: By (side, sentence): entity, metric, number and unit of each claim, as they are meant, not as they are read.
CLAIMS_SQL = f"""
e AS (SELECT event_id, event_type AS card, 'Zed ' || chr((65 + user_id % 26)::INT) AS other, value, event_id % 3000 + 1000 AS n,
  rtrim(rtrim(printf('%.2f', value), '0'), '.') AS v, rtrim(rtrim(printf('%.2f', value + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), '0'), '.') AS w FROM events),
have AS (SELECT event_id, card AS entity, 'usage_rate' AS metric, v AS value, '%' AS unit FROM e
  UNION ALL SELECT event_id, card, 'sample_size', n::VARCHAR, '场' FROM e UNION ALL SELECT event_id, other, 'win_rate', v, '%' FROM e),
made AS (SELECT event_id, 0 AS sentence, card AS entity, 'usage_rate' AS metric, w AS value, '%' AS unit FROM e
  UNION ALL SELECT event_id, 1, CASE WHEN event_id % 5 = 0 THEN card ELSE other END, 'win_rate', v, '%' FROM e
  UNION ALL SELECT event_id, 2, '*', 'sample_size', (n + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR, '场' FROM e
  UNION ALL SELECT event_id, 3, '*', NULL, CASE WHEN event_id % 11 = 0 THEN v || '7' ELSE v END, '%' FROM e WHERE contains(v, '.')),
bad AS (SELECT m.* FROM made m WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.event_id = m.event_id AND h.value = m.value AND h.unit = m.unit
  AND (m.metric IS NULL OR h.metric = m.metric) AND (m.entity = '*' OR h.entity = m.entity)))
"""


def texts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence): four sentences and a section of references for each event, and two lines that name one entity each."""
    v, i, n = F.col("value"), F.col("event_id"), F.col("event_id") % 3000 + 1000
    other = F.concat(F.lit("Zed "), F.char((F.col("user_id") % 26 + 65).cast("long")))

    def number(x: Column) -> Column:
        return F.format_string("%.2f", x)

    def thousands(x: Column) -> Column:
        return F.regexp_replace(x.cast("string"), r"(\d)(\d{3})$", "$1,$2")

    evidence = F.concat(
        F.lit("卡牌：") , F.col("event_type"), F.lit("；usage rate "), number(v), F.lit("%；样本 "), n.cast("string"), F.lit(" games\n| "), other, F.lit(" | 胜率 "), number(v), F.lit("% |")
    )
    answer = F.concat(
        F.col("event_type"), F.lit(" 使用率 "), number(v + F.when(i % 3 == 0, 1).otherwise(0)), F.lit("%。"),
        F.when(i % 5 == 0, F.col("event_type")).otherwise(other), F.lit(" has a clean win rate of "), number(v), F.lit("%!"),
        F.lit(" Seen in "), thousands(n + F.when(i % 7 == 0, 1).otherwise(0)), F.lit(" battles.\n"),
        F.when(F.contains(F.regexp_replace(number(v), r"\.?0+$", ""), F.lit(".")), F.concat(F.lit(f"The usage rate, {FAR}, is "), F.regexp_replace(number(v), "0+$", ""), F.when(i % 11 == 0, "7").otherwise(""), F.lit("%?"))).otherwise("No number here?"),
        F.lit("\n参考来源：usage rate 1%。"),
    )
    rows = events.select(i.alias("answer_id"), i.alias("evidence_id"), answer.alias("text"))
    return rows, events.select(i.alias("evidence_id"), evidence.alias("text"))


def _texts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    answers, evidence = texts(*tables(spark, sf_dir, "events"))
    return answers.withColumn("text", F.regexp_replace("text", "(?s)\n参考来源.*$", "")), evidence


@register("r155_grounding", "SELECT e.event_id AS answer_id, count(line) = 0 AS passed, coalesce(string_agg(line, ';' ORDER BY line), '') AS unsupported FROM e LEFT JOIN (SELECT DISTINCT event_id, entity || '|' || coalesce(metric, '*') || '|' || value || unit AS line FROM bad) b USING (event_id) GROUP BY e.event_id", CLAIMS_SQL)
def grounding(spark, sf_dir):
    out = cl.unsupported(*_texts(spark, sf_dir))
    return out.withColumn("unsupported", F.array_join("unsupported", ";"))


@register("r127_claim_metrics", "SELECT event_id AS answer_id, sentence AS segment, value, unit, metric FROM made", CLAIMS_SQL)
def claim_metrics(spark, sf_dir):
    """Every claim of every answer with the metric named nearest before it."""
    answers, evidence = _texts(spark, sf_dir)
    found = cl.claims(answers, cl.known_entities(evidence), "answer_id")
    return found.select("answer_id", "segment", "value", "unit", "metric")


@register("r156_grounded_sentences", "SELECT event_id AS answer_id, s::INT AS sentence, NOT EXISTS (SELECT 1 FROM bad WHERE bad.event_id = e.event_id AND bad.sentence = s) AS supported FROM e, range(5) t(s)", CLAIMS_SQL)
def grounded_sentences(spark, sf_dir):
    """Every sentence before the references, and whether it may be shown."""
    answers, evidence = texts(*tables(spark, sf_dir, "events"))
    return cl.grounded(answers, evidence).select("answer_id", "sentence", "supported")
