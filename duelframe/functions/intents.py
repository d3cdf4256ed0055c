"""What a question asks for: fifteen signs as columns, from word lists and from the names that it resolves to."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by sign; a sign with two lists needs one of each, unless one of its whole phrases occurs.
PLAYERS = ("谁上", "谁打", "上场", "选手", "对战选手", "player", "who plays")
SCHEDULE = ("下一轮", "赛程", "对战", "打谁", "上场", "round", "match", "轮")
SUMMARY_PHRASES = ("接下来的赛程", "后面的赛程", "赛程压力", "赛程总结", "总结赛程", "总结一下赛程", "后面还有几场比赛", "还有几场比赛", "剩下几场比赛", "剩余几场比赛")
SUMMARY = ("总结", "概况", "压力", "密集", "还有几场", "剩下几场", "剩余几场")
SUMMARY_OF = ("赛程", "比赛", "对阵", "下一轮", "后面几轮", "后续几轮", "轮次", "round", "match", "upcoming")
PREPARE_PHRASES = ("下一轮怎么准备", "下一场比赛有什么准备建议", "备战建议", "推荐几套可练的卡组", "帮我推荐几套可练的卡组", "给我备战建议")
PREPARE = ("准备", "备战", "练", "训练", "推荐")
PREPARE_FOR = ("下一轮", "下一场", "比赛", "对手", "赛程", "卡组", "meta", "单卡")
CHANGES = (
    "最近环境发生了什么变化", "环境发生了什么变化", "环境有什么变化", "最近一周变化", "相比上周", "对比上周", "上周相比", "趋势变化", "meta change", "meta changes", "changed since last week", "compared with last week",
)
ANALYSIS_PHRASES = ("current meta", "current environment", "meta decks", "mainstream decks")
ANALYSIS = (
    "当前版本", "当前环境", "现在的环境", "环境是怎样", "当前主流卡组", "整体环境", "环境是什么样", "环境怎么样", "meta环境", "进攻风格", "卡组构筑", "构筑思路", "卡组体系", "定位", "搭配", "主要怕什么", "克制", "反制",
    "速转", "空军", "重甲推进", "打法",
)
ANALYSIS_OF = ("卡组", "卡牌", "单卡", "meta", "环境", "绿龙", "青龙", "龙宝", "baby dragon")
DECKS = ("热门卡组", "高使用率卡组", "最热门卡组", "卡组", "deck")
CARDS = ("使用率", "胜率", "单卡", "卡牌", "meta", "热门卡牌", "card")
RANKING = ("前", "排行", "排名", "高使用率", "热门卡牌", "使用率最高", "胜率最高", "top", "分别是谁", "第")
COMPARE = ("哪个", "谁更", "更高", "更强", "比较", "vs", "对比")
TOGETHER = ("共同出现", "一起出现", "同时出现", "共现", "搭配了多少", "appear together")
TEAMMATES = ("最常和", "最常与", "经常和", "经常与", "常和", "常与", "一起使用", "一起出现", "常见搭配", "队友", "teammate")
RANK_OF = ("排第几", "排名多少", "排名第几", "榜排第几", "榜排名多少", "榜单排名多少", "ranking position", "rank position", "what rank", "what position")
LISTS = ("有哪些", "哪些", "分别是谁", "都有什么", "几个", "一些")
NAMED_RANK = r"第\s*(?:\d+|[一二两三四五六七八九十]+)\s*名|排名\s*(?:\d+|[一二两三四五六七八九十]+)"
TOP_SIGNAL = r"(?i)(?:最高|最多|最常见|最常用|排名靠前)的?\s*(?:\d+|[一二两三四五六七八九十]+)|前\s*(?:\d+|[一二两三四五六七八九十]+)|(?:给我看|来)\s*\d+\s*个|\btop\s*\d+\b"

SIGNS = (
    "players", "schedule", "schedule_summary", "match_preparation", "meta_delta", "meta_analysis", "deck", "card", "card_ranking", "card_compare", "card_cooccurrence", "card_rank_lookup", "explicit_rank", "explicit_top_n",
    "implicit_list",
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def intents(text: Column, names: Column) -> Column:
    """Struct of the fifteen ``SIGNS`` of a question; ``names`` is the array of distinct names in it. A null question has none of them."""
    q, raw = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(text, F.lit(""))
    named = F.coalesce(F.size(names), F.lit(0))
    changed = _any(q, CHANGES)
    values = (
        _any(q, PLAYERS), _any(q, SCHEDULE), _any(q, SUMMARY_PHRASES) | (_any(q, SUMMARY) & _any(q, SUMMARY_OF)), _any(q, PREPARE_PHRASES) | (_any(q, PREPARE) & _any(q, PREPARE_FOR)), changed,
        changed | _any(q, ANALYSIS_PHRASES) | (_any(q, ANALYSIS) & (_any(q, ANALYSIS_OF) | (named > 0))), _any(q, DECKS), _any(q, CARDS) | (named > 0), _any(q, RANKING),
        _any(q, COMPARE) & (named >= 2), (_any(q, TOGETHER) & (named >= 2)) | (_any(q, TEAMMATES) & (named >= 1)), _any(q, RANK_OF) & (named >= 1), raw.rlike(NAMED_RANK), raw.rlike(TOP_SIGNAL), _any(raw, LISTS),
    )
    return F.struct(*[v.alias(s) for s, v in zip(SIGNS, values)])
