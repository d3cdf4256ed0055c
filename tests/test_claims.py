"""Claims of texts and their support, whole and arriving piece by piece."""

import random

from pyspark.sql import functions as F

from duelframe.operators import claims as cl
from duelframe.streaming import incremental as inc
from duelframe.streaming import sentences as sn

EVIDENCE = {
    1: "卡牌：Electro Giant；使用率：4.3%；胜率：62.3%\n卡牌：Poison；使用率：5.5%；胜率：51.2%",
    2: "sample_battles=20000 场 | usage rate 4.30% and 859 appearances",
    3: None,
}
ANSWERS = [
    (1, 1, "Electro Giant 的使用率是 5.5%。", ["Electro Giant|usage_rate|5.5%"]),
    (2, 1, "electro giant 的使用率 4.30%！Poison 胜率 51.2%", []),
    (3, 2, "20,000 场 and usage rate 4.3% in 859 次", []),
    (4, 2, "99.9% of 5 games", ["*|*|99.9%", "*|sample_size|5场"]),
    (5, 2, None, []),
    (6, 3, "usage rate 1%", ["*|usage_rate|1%"]),
    (7, 1, "净胜率 62.3%。Poison 净胜率 62.3%", ["Poison|win_rate|62.3%"]),
    (8, 2, "usage rate" + " " * 38 + "4.3% but usage rate" + " " * 39 + "4.3%, win rate 4.3%", ["*|win_rate|4.3%"]),
    (9, 9, "no evidence: 3%", ["*|*|3%"]),
]


def frames(spark):
    answers = spark.createDataFrame([a[:3] for a in ANSWERS], "answer_id long, evidence_id long, text string")
    return answers, spark.createDataFrame(list(EVIDENCE.items()), "evidence_id long, text string")


def test_unsupported_claims(spark):
    got = {r.answer_id: (r.passed, r.unsupported) for r in cl.unsupported(*frames(spark)).collect()}
    assert got == {i: (not bad, bad) for i, _, _, bad in ANSWERS}


def test_the_metric_is_the_last_one_named_within_reach(spark):
    answers, evidence = frames(spark)
    rows = cl.claims(answers.where("answer_id = 8"), cl.known_entities(evidence), "answer_id").orderBy("start").collect()
    # 48 characters before the number reach the first name, but not the second, which is one further off
    assert [r.metric for r in rows] == ["usage_rate", None, "win_rate"]
    assert [r.entity for r in cl.known_entities(evidence).where("evidence_id = 1").orderBy("entity").collect()] == ["Electro Giant", "Poison"]


def pieces(seed=4):
    """Answers of several sentences, cut at random places and sent in three batches; a marker ends some of them."""
    r = random.Random(seed)
    rows, whole = [], []
    for i in range(20):
        text = "".join(r.choice(["使用率 4.3%。", "win rate 99%!", "plain?", "\n", "5.5% of it. And more "]) for _ in range(r.randint(1, 6))) + r.choice(["", "end", "\n参考来源：使用率 77%。"])
        whole.append((i, 1 + i % 2, text))
        cuts = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randint(2, 7))))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(i, 1 + i % 2, k, p, k == len(parts) - 1, min(2, 3 * k // len(parts))) for k, p in enumerate(parts)]
    return rows, whole


def test_a_stream_shows_what_the_batch_shows(spark, tmp_path):
    rows, whole = pieces()
    schema = "answer_id long, evidence_id long, seq long, delta string, last boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    evidence = frames(spark)[1]
    # with timers pending, runs that stop at the end of their input would go on with empty batches
    settings = {"spark.sql.streaming.stateStore.providerClass": sn.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        seen = []
        for batch in range(3):
            spark.createDataFrame([x[:5] for x in rows if x[5] == batch], schema).coalesce(1).write.mode("append").parquet(source)
            stream = sn.whole_sentences(spark.readStream.schema(schema).parquet(source))
            each = sn.show_supported(evidence, lambda df, n: df.write.mode("append").parquet(out))
            assert inc.run_once(stream, each, str(tmp_path / "ck")).awaitTermination(90)
            seen.append(spark.read.parquet(out).count())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert 0 < seen[0] < seen[1] < seen[2]
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, cl.grounded(spark.createDataFrame(whole, "answer_id long, evidence_id long, text string"), evidence).collect()))
    assert got == want
    assert all("77%" not in body for _, _, body, _ in got) and {s for *_, s in got} == {True, False}


def test_cutting_sentences():
    assert sn.cut("a。b!c", (), False) == (["a。", "b!"], "c", False)
    assert sn.cut("a。b", (), True) == (["a。", "b"], "", False)
    assert sn.cut("a。b参考来源x。", ("参考来源", "b"), False) == (["a。"], "", True)
    assert sn.cut("", (), True) == ([], "", False)


def test_no_join_of_claims_is_gathered_in_the_driver(spark):
    """at six times the events the driver's heap did not hold what the joins broadcast."""
    answers, evidence = frames(spark)
    judged = cl.grounded(answers, evidence)
    judged.collect()
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_claims_take_few_exchanges_and_no_window(spark):
    """windows over positions and joins of sentences with themselves dealt the same texts out again and again."""
    plan = cl.unsupported(*frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 12
