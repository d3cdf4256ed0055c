"""Alias catalogue and the automaton over it."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from duelframe.functions import names as nm


def rows(spark, given):
    return spark.createDataFrame([(n, a, i) for i, (n, a) in enumerate(given)], "name string, alias string, at int")


def test_catalogue_expands_forms_and_rejects_shared_aliases(spark):
    got = nm.catalogue(rows(spark, [("Mini P.E.K.K.A", "小皮卡"), ("Ice Golem", "冰人"), ("Ice Golem Evolution", None), ("Hero Ice Golem", " "), ("Ice Golem", "ICE  golem")]))
    by = {}
    for r in got.collect():
        by.setdefault(r.name, set()).add(r.alias)
    assert {"mini p e k k a", "minipekka", "小皮卡"} == by["Mini P.E.K.K.A"] and {"ice golem", "icegolem", "冰人"} == by["Ice Golem"]
    assert {"冰人进化", "觉醒冰人", "evo 冰人", "evoicegolem", "ice golem evolution"} <= by["Ice Golem Evolution"] and {"英雄冰人", "hero ice golem", "heroicegolem"} <= by["Hero Ice Golem"]
    assert nm.shared_aliases(got).count() == 0 and nm.unshared(got)["evolved 冰人"] == "Ice Golem Evolution"
    shared = nm.catalogue(rows(spark, [("Zap", "小电"), ("Spark", "小电"), ("Spark", "zap")]))
    with pytest.raises(nm.SharedAlias, match="Spark, Zap"):
        nm.unshared(shared)
    assert nm.unshared(shared, keep_first=True)["小电"] == "Zap"


def plain(names, text):
    """Every alias by its own expression, then leftmost and longest."""
    found = []
    for alias, name in names.items():
        p = rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])" if re.fullmatch(r"[a-z0-9 .'-]+", alias) else re.escape(alias)
        found += [(m.start(), -m.end(), name) for m in re.finditer(rf"(?={p})", text) for m in [re.compile(p).match(text, m.start())]]
    out, reach, seen = [], 0, set()
    for start, end, name in sorted(found):
        if start >= reach and name not in seen:
            out.append(name)
            reach = -end
            seen.add(name)
    return out


def test_ten_thousand_aliases_in_linear_time(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcde冰火") for _ in range(r.randint(2, 5))) for _ in range(4000)]
    names = {" ".join(r.choice(words) for _ in range(r.randint(1, 3))): f"n{i % 9000}" for i in range(16_000)}
    assert len(names) > 10_000
    automaton = nm.Automaton(names)
    for _ in range(3):
        text = " ".join(r.choice(words) for _ in range(200))
        assert automaton.resolve(text) == plain(names, text)
    short, long = (" ".join(r.choice(words) for _ in range(n)) for n in (20_000, 80_000))
    spent = []
    for text in (short, long):
        began = time.process_time()
        automaton.resolve(text)
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * spent[0]
    frame = spark.createDataFrame([(short,), (None,), ("",)], "t string")
    assert [len(x.n) > 0 for x in frame.select(nm.resolve_names(names)("t").alias("n")).collect()] == [True, False, False]


def test_replacement(spark):
    shown = {"Ring": "环", "Small Ring": "小环", "Ice": "冰"}
    frame = spark.createDataFrame([("a small RING, Ring-Ice icé rings İring Ring.",), (None,), ("",)], "t string")
    assert [r.t for r in frame.select(nm.replace_names(shown)("t").alias("t")).collect()] == ["a 小环, 环-冰 icé rings İring 环.".replace("İring", "İ环"), None, ""]
    assert nm.Automaton({}).replace("x") == "x" and nm.Automaton({}).resolve("x") == []
    text = spark.createDataFrame([("### Summary:\n* **one**\n  * two__\nplain",)], "t string")
    assert text.select(nm.plain_answer(F.col("t"), {"summary": "总结"}).alias("t")).first().t == "总结\n- one\n- two\nplain"
    assert text.select(nm.plain_answer(F.col("t"), {}).alias("t")).first().t.startswith("Summary:")


def test_intents(spark):
    from duelframe.functions import intents as it

    rows = [("谁上场", []), ("下一轮怎么准备", []), ("Ring vs Bolt 哪个更强", ["Ring", "Bolt"]), ("vs", ["Ring"]), ("Ring 的队友", ["Ring"]), ("ring 排第几", ["Ring"]), ("第 三 名 and Top 5 有哪些", []), ("Meta Changes", None), (None, [])]
    frame = spark.createDataFrame(rows, "t string, names array<string>")
    got = [{s for s in it.SIGNS if r.i[s]} for r in frame.select(it.intents(F.col("t"), F.col("names")).alias("i")).collect()]
    assert got == [
        {"players", "schedule"}, {"schedule", "match_preparation"}, {"card", "card_compare"}, {"card"}, {"card", "card_cooccurrence"}, {"card", "card_ranking", "card_rank_lookup"},
        {"card_ranking", "explicit_rank", "explicit_top_n", "implicit_list"}, {"card", "meta_delta", "meta_analysis"}, set(),
    ]
