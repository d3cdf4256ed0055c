"""Text expressions: numeric facts and grounding, rankings, dates, metrics, limits of what can be answered, normalisation."""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number pattern and unit names of checked facts, broken percentages, beginnings of document ids.
NUMBER = r"(?<![\w.,])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*(%|场|次|battles?|games?|appearances?)"
ID_PREFIXES = ("supercell", "snapshot", "official", "other")
BROKEN_PERCENT = r"(?i)\b(?:none|null|nan)\s*%"
SEGMENT_END = r"[\n。！？!?]+"
METRIC_NAMES = {
    "clean_win_rate": ("净胜率", "clean win rate", "clean_win_rate"),
    "usage_rate": ("使用率", "usage rate", "usage_rate"),
    "win_rate": ("胜率", "win rate", "win_rate"),
    "sample_size": ("样本", "出场", "sample", "appearances", "battles", "games"),
}
CHINESE_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
REFERENCE_MARKERS = ("参考来源", "参考资料", "引用来源", "References")


def numeric_facts(text: Column) -> Column:
    """Distinct struct(value, unit) of a text: separators and trailing zeros dropped, units in one spelling."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + NUMBER), 0)

    def fact(x: Column) -> Column:
        raw = F.regexp_replace(F.regexp_extract(x, r"^[\d.,]+", 0), ",", "")
        value = F.when(F.contains(raw, F.lit(".")), F.regexp_replace(raw, r"\.?0+$", "")).otherwise(raw)
        unit = F.lower(F.trim(F.regexp_replace(x, r"^[\d.,]+", "")))
        unit = F.when(unit.startswith("battle") | unit.startswith("game"), "场").when(unit.startswith("appearance"), "次").otherwise(unit)
        return F.struct(value.alias("value"), unit.alias("unit"))

    return F.array_distinct(F.transform(found, fact))


def has_broken_percent(text: Column) -> Column:
    return text.rlike(BROKEN_PERCENT)


def citations(text: Column, prefixes: tuple[str, ...] = ID_PREFIXES) -> Column:
    """Distinct document ids in a text: a word that begins with one of ``prefixes``, a colon, and all up to white space, a bar or a back quote."""
    pattern = r"(?i)\b((?:" + "|".join(map(re.escape, prefixes)) + r")[\w-]*:[^\s|`]+)"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def unknown_citations(text: Column, allowed: Column) -> Column:
    return F.array_except(citations(text), allowed)


def strip_references(text: Column) -> Column:
    """The text before the earliest reference section that a model wrote."""
    cut = F.regexp_replace(text, r"(?s)\n[ #*]*(?:" + "|".join(REFERENCE_MARKERS) + r").*$", "")
    return F.regexp_replace(cut, r"\s+$", "")


def top_n(text: Column, default: int = 10, most: int = 30) -> Column:
    """The number of a top-n request, 1 to ``most``; digits or one Chinese numeral, else the default."""
    digits = F.regexp_extract(text, r"(?i)(?:top|前)\s*(\d{1,4})", 1)
    word = F.regexp_extract(text, "前\\s*([一二两三四五六七八九十])", 1)
    known = F.create_map(*[x for k, v in CHINESE_DIGITS.items() for x in (F.lit(k), F.lit(v))])
    n = F.when(digits != "", digits.cast("int")).otherwise(F.coalesce(F.try_element_at(known, word), F.lit(default)))
    return F.least(F.lit(most), F.greatest(F.lit(1), n))


def rank_target(text: Column, most: int = 30) -> Column:
    """The rank asked for ("#3", "第三", "rank 3"), null if none; out of range clamps."""
    digits = F.regexp_extract(text, r"(?i)(?:#|第|rank\s*)(\d{1,4})", 1)
    word = F.regexp_extract(text, "第\\s*([一二两三四五六七八九十])", 1)
    known = F.create_map(*[x for k, v in CHINESE_DIGITS.items() for x in (F.lit(k), F.lit(v))])
    n = F.when(digits != "", digits.cast("int")).otherwise(F.try_element_at(known, word))
    return F.when(n.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(1), n)))


def metric(text: Column, default: str = "usage_rate") -> Column:
    """The first metric, in the order of METRIC_NAMES, one of whose names occurs."""
    low = F.lower(text)
    out = F.lit(default)
    for name, aliases in reversed(METRIC_NAMES.items()):
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | F.contains(low, F.lit(alias))
        out = F.when(hit, name).otherwise(out)
    return out


def iso_date(text: Column) -> Column:
    """The first date of a text as yyyy-MM-dd, null if none."""
    y, m, d = (F.regexp_extract(text, r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def normal_alias(text: Column) -> Column:
    """Dots, underscores and hyphens become blanks, blanks collapse, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[._-]+", " "), r"\s+", " "))


def local_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# What questions that statistics can't answer contain, white space removed.
GUARANTEED = r"必胜|稳赢|包赢|百分百胜|保证.{0,8}(?:胜率|获胜|赢)|(?:8\d|9\d|100)%(?:胜率)?(?:的)?(?:卡组|套牌)"
FORECAST = r"预测|预估|预计|推测|将会|会不会"
FUTURE = r"下周|下个月|下月|明天|后天|未来|下赛季|下个赛季|下个版本|下版本|下一版本"
TARGET = r"使用率|胜率|净胜率|评分|排名|最高|最低|概率|可能性|表现|环境|体系|趋势|走势|卡牌|卡组"
EXACT = r"(?:精确|准确|确切|绝对|真实)(?:概率|可能性|胜率)"
CAUSE = r"(?:让|导致|造成|使得|带来).{0,32}(?:胜率|使用率).{0,16}(?:提高|提升|增加|降低|下降|变化|多少)"
SWAP = r"(?:换成|换掉|加入|移除|不带).{0,32}(?:会|能).{0,24}(?:胜率|使用率).{0,16}(?:提高|提升|增加|降低|下降|变化|多少)"
PAST = r"(?:过去|近|最近)(?:一|二|两|三|四|五|六|七|八|九|十|几|\d+)(?:天|周|个?月|赛季|版本)"
TREND = r"趋势|走势|变化|上涨|下降|环比|同比|曲线"


def unsupported_analysis(text: Column) -> Column:
    """Why statistics can't answer a question, null if they can: the first boundary that it crosses."""
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    return (
        F.when(t.rlike(GUARANTEED), "guaranteed_outcome")
        .when(t.rlike(FORECAST) | (t.rlike(FUTURE) & t.rlike(TARGET)), "future_forecast")
        .when(t.rlike(EXACT), "exact_probability")
        .when(t.rlike(CAUSE) | t.rlike(SWAP), "causal_effect")
        .when(t.rlike(PAST) & t.rlike(TREND), "historical_trend")
    )


def _asks_form(asked: Column, name: Column, word: str) -> Column:
    """Whether the text has the word outside the first place of the name, so that a word of an official name is no form."""
    own = normal_alias(name)
    at = F.position(own, asked)
    rest = F.when((own != "") & (at > 0), F.concat(F.substr(asked, F.lit(1), at - 1), F.lit(" "), F.substr(asked, at + F.length(own)))).otherwise(asked)
    return rest.rlike(rf"\b{word}\b")


def entity_form(text: Column, name: Column, tower: Column) -> Column:
    """(entity_mode, entity_type, entity_name, special_state) that a text asks of its resolved name: a tower, an evolution, an elite form, or neither.

    Without a name nothing is asked. The words are fixed values.
    """
    asked, there = normal_alias(text), F.coalesce(name != "", F.lit(False))
    evolved = there & (asked.contains("觉醒") | _asks_form(asked, name, "evolved") | _asks_form(asked, name, "evolution"))
    elite = there & (asked.contains("精英") | _asks_form(asked, name, "elite"))

    def made(mode: str, kind: str | None, of: Column, state: str | None) -> Column:
        return F.struct(F.lit(mode).alias("entity_mode"), F.lit(kind).cast("string").alias("entity_type"), of.cast("string").alias("entity_name"), F.lit(state).cast("string").alias("special_state"))

    return (
        F.when(there & tower, made("loadout_entity", "tower", name, "tower"))
        .when(evolved, made("loadout_entity", "card", F.regexp_replace(name, " Evolution$", ""), "evolution"))
        .when(elite, made("loadout_entity", "card", name, "elite"))
        .otherwise(made("base8", None, F.lit(None), None))
    )
