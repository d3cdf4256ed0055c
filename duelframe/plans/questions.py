"""Questions of four parts about parts, and what they ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.functions import intents as it
from duelframe.functions import names as nm
from duelframe.plans.registry import query as register
from duelframe.sources.matches import tables

_OPEN = ("", "谁上", "下一轮的", "总结一下", "怎么准备 ", "相比上周 ", "Current Meta of ", "进攻风格 ", "热门卡组 ", "给我看 3 个 ", "TOP 5 ")
_MID = (" ", " vs ", " and ", " 和 ", " with ring ", " or Red Widget ")
_CLOSE = ("", " 使用率", " 一起出现", " 排第几", " 更高", " 的队友", " 第 3 名", " 有哪些", " 比赛", " 前三", " what rank", " 环境", "?")
_NAMES = {"ring": "Ring", "red widget": "Red Widget", "widget": "Widget", "bolt": "Bolt", "gear": "Gear"}


def _has(words: tuple[str, ...], of: str = "q") -> str:
    return "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"


_SIGNS_SQL = {
    "players": _has(it.PLAYERS), "schedule": _has(it.SCHEDULE), "schedule_summary": f"({_has(it.SUMMARY_PHRASES)} OR {_has(it.SUMMARY)} AND {_has(it.SUMMARY_OF)})",
    "match_preparation": f"({_has(it.PREPARE_PHRASES)} OR {_has(it.PREPARE)} AND {_has(it.PREPARE_FOR)})", "meta_delta": _has(it.CHANGES),
    "meta_analysis": f"({_has(it.CHANGES)} OR {_has(it.ANALYSIS_PHRASES)} OR {_has(it.ANALYSIS)} AND ({_has(it.ANALYSIS_OF)} OR n > 0))", "deck": _has(it.DECKS), "card": f"({_has(it.CARDS)} OR n > 0)", "card_ranking": _has(it.RANKING),
    "card_compare": f"(n >= 2 AND {_has(it.COMPARE)})", "card_cooccurrence": f"(n >= 2 AND {_has(it.TOGETHER)} OR n >= 1 AND {_has(it.TEAMMATES)})", "card_rank_lookup": f"(n >= 1 AND {_has(it.RANK_OF)})",
    "explicit_rank": f"regexp_matches(text, '{it.NAMED_RANK}')", "explicit_top_n": f"regexp_matches(text, '{it.TOP_SIGNAL}')", "implicit_list": _has(it.LISTS, "text"),
}
# a second mention of a name that was taken leaves its words free for other names
_WORD = " + ".join(f"regexp_matches(q, '(^|[^a-z0-9]){w}($|[^a-z0-9])')::INT" for w in ("ring", "bolt", "gear", "red widget")) + " + regexp_matches(regexp_replace(q, 'red widget', '#'), '(^|[^a-z0-9])widget($|[^a-z0-9])')::INT"


@register("r135_intents", f"SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, sql in _SIGNS_SQL.items())} FROM (SELECT *, {_WORD} AS n FROM (SELECT *, lower(text) AS q FROM (SELECT p_partkey, {list(_OPEN)!r}[p_partkey % 11 + 1] || p_name || {list(_MID)!r}[p_partkey % 6 + 1] || p_type || {list(_CLOSE)!r}[p_partkey % 13 + 1] AS text FROM part)))")
def intents(spark, sf_dir):
    """All fifteen signs of every question."""
    (part,) = tables(spark, sf_dir, "part")
    pick = [F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int")) for words in (_OPEN, _MID, _CLOSE)]
    asked = part.select("p_partkey", F.concat(pick[0], "p_name", pick[1], "p_type", pick[2]).alias("text"))
    named = asked.withColumn("names", nm.resolve_names(_NAMES)("text"))
    return named.select("p_partkey", it.intents(F.col("text"), F.col("names")).alias("i")).select("p_partkey", "i.*")
