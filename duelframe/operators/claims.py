"""Numeric claims of texts as relations, and whether evidence has them.

A claim is a number with its unit, the metric that is named last in the 48 characters before it, and the known entities of its sentence. Numbers and metric
names get their positions from the lengths of what lies between them, inside their sentence's row, so that texts are dealt out once, to meet the names that their
evidence knows; a claim without a counterpart in its evidence is what an anti-join leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions import text as tx

#: Characters before a number in which its metric is looked for.
REACH = 48
# How evidence names its entities; metrics of counted units.
ENTITY_LINE = r"(?i)(?:卡牌|card)\s*[:：]\s*([A-Za-z][A-Za-z .'-]{1,50})"
ENTITY_CELL = r"(?i)\|\s*([A-Z][A-Za-z .'-]{1,50})\s*\|(?=[^\n]*(?:使用率|胜率|usage\s*rate|win\s*rate))"
COUNTED = "sample_size"
_NUMBER = "(?iU)" + tx.NUMBER
_ALIASES = [(name, alias) for name, aliases in tx.METRIC_NAMES.items() for alias in aliases]


def known_entities(evidence: DataFrame, key: str = "evidence_id", text: str = "text") -> DataFrame:
    """Distinct (key, entity) that a text names in lines of one entity or in cells of a table."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in (ENTITY_LINE, ENTITY_CELL)])
    rows = evidence.select(key, F.explode_outer(found).alias("entity")).withColumn("entity", F.regexp_replace("entity", "^[ .;；]+|[ .;；]+$", ""))
    return rows.where("entity <> ''").distinct()


def segments(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, segment, body): the sentences of each text that hold a digit, by their number."""
    # the outer form, here and below, as Spark would compute the array once more to leave out empty ones
    return texts.select(*keys, F.posexplode_outer(F.split(text, tx.SEGMENT_END)).alias("segment", "body")).where(F.col("body").rlike(r"(?U)\d"))


def _placed(gaps: Column, hits: Column) -> Column:
    """Array of struct(start, hit) of a pattern's hits, from what lies between them."""
    zipped = F.transform(hits, lambda x, i: F.named_struct(F.lit("gap"), F.length(F.get(gaps, i)), F.lit("hit"), x))
    none = F.array().cast("array<struct<start:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.named_struct(F.lit("at"), start + F.length(x["hit"]), F.lit("out"), F.concat(acc["out"], F.array(F.named_struct(F.lit("start"), start, F.lit("hit"), x["hit"]))))

    return F.aggregate(zipped, F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), none), step, lambda acc: acc["out"])


def numbers(body: Column) -> Column:
    """Array of struct(start, hit) of every number with a unit in a sentence."""
    return _placed(F.split(body, _NUMBER, -1), F.regexp_extract_all(body, F.lit(_NUMBER), 0))


def mentions(low: Column) -> Column:
    """Array of struct(start, stop, metric) of every place in a sentence, in lower case, where a metric's name stands; names may overlap."""
    names = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).alias("alias")) for m, a in _ALIASES])

    def places(n: Column) -> Column:
        gaps = F.split(low, F.concat(F.lit(r"\Q"), n["alias"], F.lit(r"\E")), F.lit(-1))
        found = _placed(gaps, F.array_repeat(n["alias"], F.size(gaps) - 1))
        return F.transform(found, lambda x: F.named_struct(F.lit("start"), x["start"], F.lit("stop"), x["start"] + F.length(x["hit"]), F.lit("metric"), n["metric"]))

    return F.flatten(F.transform(F.filter(names, lambda n: F.contains(low, n["alias"])), places))


def claims(texts: DataFrame, entities: DataFrame, *keys: str, of: str = "evidence_id", text: str = "text") -> DataFrame:
    """(keys, of, segment, start, value, unit, metric, entities) of every claim; ``entities`` are the known ones of ``of`` that its sentence names, null metric if none is near."""
    own = list(dict.fromkeys([*keys, of]))
    known = entities.groupBy(of).agg(F.sort_array(F.collect_set("entity")).alias("_known"))
    # both sides grow with the texts, so that no join may gather one of them in the driver
    sentences = segments(texts.select(*own, text).join(known.hint("merge"), of, "left"), *own, "_known", text=text).withColumn("_low", F.lower("body"))
    here = F.filter(F.coalesce("_known", F.array().cast("array<string>")), lambda e: F.contains("_low", F.lower(e)))
    each = sentences.select(*own, "segment", here.alias("entities"), mentions(F.col("_low")).alias("_names"), F.explode_outer(numbers(F.col("body"))).alias("_n")).where("_n IS NOT NULL")
    # a mention may end where the number begins, and one that begins too early has no later one beside it
    start = F.col("_n.start")
    near = F.filter("_names", lambda n: (n["stop"] <= start) & (n["stop"] >= start - REACH))
    last = F.array_max(F.transform(near, lambda n: F.named_struct(F.lit("start"), n["start"], F.lit("metric"), n["metric"])))
    each = each.select(*own, "segment", start.alias("start"), F.get(tx.numeric_facts(F.col("_n.hit")), F.lit(0)).alias("_fact"), last.alias("_last"), "entities")
    metric = F.when(F.col("_fact.unit").isin("场", "次"), F.lit(COUNTED)).otherwise(F.when(F.col("_last.start") >= F.col("start") - REACH, F.col("_last.metric")))
    return each.select(*own, "segment", "start", "_fact.*", metric.alias("metric"), "entities")


def unsupported(answers: DataFrame, evidence: DataFrame, key: str = "answer_id", of: str = "evidence_id") -> DataFrame:
    """One row per answer: key, passed, unsupported (ordered ``entities|metric|number`` of claims that its evidence lacks).

    ``answers`` has key, of, text, ``evidence`` one row per ``of`` with text. A claim is supported by one of equal value and unit, of the same metric if its own is known and with a shared entity
    if its sentence names one. Null and empty texts claim nothing; an answer whose evidence is missing has no support.
    """
    named = known_entities(evidence, of)
    made = claims(answers, named, key, of, of=of)
    have = claims(evidence, named, of, of=of).select(of, "value", "unit", F.col("metric").alias("_metric"), F.col("entities").alias("_entities")).distinct()
    same = [F.col(f"m.{c}") == F.col(f"h.{c}") for c in (of, "value", "unit")]
    fits = (F.col("metric").isNull() | (F.col("metric") == F.col("_metric"))) & ((F.size("entities") == 0) | F.arrays_overlap("entities", "_entities"))
    lacking = made.alias("m").join(have.alias("h").hint("merge"), same[0] & same[1] & same[2] & fits, "left_anti")
    line = F.concat_ws("|", F.when(F.size("entities") > 0, F.array_join("entities", ",")).otherwise("*"), F.coalesce("metric", F.lit("*")), F.concat("value", "unit"))
    lines = lacking.groupBy(key).agg(F.sort_array(F.collect_set(line)).alias("unsupported"))
    return answers.select(key).distinct().join(lines.hint("merge"), key, "left").select(key, F.col("unsupported").isNull().alias("passed"), F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))


def sentences(texts: DataFrame, *keys: str, text: str = "text", stop: tuple[str, ...] = tx.REFERENCE_MARKERS) -> DataFrame:
    """(keys, sentence, body): each text in whole sentences, their ends kept, up to the earliest stop marker."""
    marker = "(?s)(?:" + "|".join(rf"\Q{m}\E" for m in stop) + ").*$"
    shown = F.regexp_replace(text, marker, "") if stop else F.col(text)
    parts = F.filter(F.split(shown, r"(?<=[\n。！？!?])"), lambda x: x != "")
    return texts.select(*keys, F.posexplode(parts).alias("sentence", "body"))


def judged(each: DataFrame, evidence: DataFrame, key: str = "answer_id", of: str = "evidence_id") -> DataFrame:
    """(key, sentence, body, supported) of sentences (key, of, sentence, body): whether all their claims have support."""
    number = each.select(F.struct(key, "sentence").alias("_id"), of, F.col("body").alias("text"))
    found = unsupported(number, evidence, "_id", of).select(F.col(f"_id.{key}").alias(key), F.col("_id.sentence").alias("sentence"), F.col("passed").alias("supported"))
    return each.select(key, "sentence", "body").join(found.hint("merge"), [key, "sentence"]).select(key, "sentence", "body", "supported")


def grounded(answers: DataFrame, evidence: DataFrame, key: str = "answer_id", of: str = "evidence_id", stop: tuple[str, ...] = tx.REFERENCE_MARKERS) -> DataFrame:
    """(key, sentence, body, supported): every sentence of every answer before a stop marker."""
    return judged(sentences(answers, key, of, stop=stop), evidence, key, of)
