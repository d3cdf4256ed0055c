"""Evidence documents, their bonus and checks, retrieval fill-up and bootstrap counts on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from duelframe.functions import text as tx
from duelframe.operators import evaluation, evidence, retrieval


def test_card_documents_read_as_written(spark):
    items = spark.createDataFrame([("s", "Bow", 12.5, 50.0, 40), ("s", "Axe", 20.0, 45.25, 64), ("t", "Bow", 1.0, 0.0, 3)], "dataset_scope string, item string, usage_rate double, clean_win_rate double, appearances long")
    got = {r.doc_id: r for r in evidence.card_documents(items).collect()}
    assert got["s:card:Axe"].text == "Card evidence for Axe: rank 1, usage 20.0%, clean win rate 45.25%, 64 appearances."
    assert got["s:card:Bow"]["rank"] == 2 and got["t:card:Bow"]["rank"] == 1 and got["s:card:Bow"].metadata["appearance_count"] == "40"
    docs = evidence.card_documents(items)
    short = {r.doc_id: (r.s, r.p) for r in docs.select("doc_id", evidence.short_text(F.col("text")).alias("s"), evidence.probe().alias("p")).collect()}
    assert short["t:card:Bow"] == ("Card: Bow; rank: 1; usage rate: 1.0%; win rate: 0.0%; clean win rate: 0.0%; 3 appearances", "Bow usage rate win rate sample appearances")
    scopes = spark.createDataFrame([("s",), ("t",)], "dataset_scope string")
    assert evidence.validate(docs, scopes).first().failures == ""
    assert evidence.validate(docs.unionByName(docs.limit(1)), scopes.where("dataset_scope = 's'")).first().failures == "invalid_or_duplicate_doc_ids,dataset_scope_coverage_mismatch"


def test_metadata_bonus_adds_up_to_one(spark):
    rows = [("card", {"rank": "3", "card_name": "BOW"}), ("card", {"rank": "4"}), ("schedule", {"round": "2", "player_name": "ann", "opponent_player": "TBD"}), ("card", {"rank": "3", "card_name": "bow", "round": "2"})]
    df = spark.createDataFrame(rows, "source_type string, metadata map<string,string>").withColumn("asked", F.struct(F.lit(3).alias("rank"), F.lit(2).alias("round"), F.lit("Bow").alias("card_name"), F.lit(True).alias("ask_players")))
    got = [r[0] for r in df.select(F.round(evidence.metadata_bonus(F.col("asked"), F.col("metadata"), F.col("source_type")), 6)).collect()]
    assert got == [1.0, 0.0, 0.6, 1.0]


def test_bm25_fills_up_with_documents_of_score_0(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox", "green hen", "hen", "owl owl", "", "cat"])], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "owl"), (1, "nothing here")], "qid long, text string")
    got = {}
    for r in retrieval.bm25(docs, asked, 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    assert [i for _, i, _ in sorted(got[0])] == [4, 0, 1, 2] and sorted(got[0])[0][2] > 0 and [i for _, i, _ in sorted(got[1])] == [0, 1, 2, 3]


def test_bootstrap_counts_repeated_values(spark):
    x = [0.0] * 700 + [1.0] * 300 + [0.25, 0.5, 0.75]
    got = evaluation.bootstrap_mean(spark.createDataFrame([(v,) for v in x], "v double"), "v", 800).first()
    error = 1.96 * np.std(x) / np.sqrt(len(x))
    assert got.n == 1003 and abs(got.lower - (np.mean(x) - error)) < 0.25 * error and abs(got.upper - (np.mean(x) + error)) < 0.25 * error
    few = [1.0, 2.0, 3.0, 4.0, 10.0] * 8
    got = evaluation.bootstrap_mean(spark.createDataFrame([(v,) for v in few], "v double"), "v", 800).first()
    error = 1.96 * np.std(few) / np.sqrt(len(few))
    assert abs(got.lower - (np.mean(few) - error)) < 0.3 * error and abs(got.upper - (np.mean(few) + error)) < 0.3 * error


def test_citations_and_boundaries(spark):
    row = spark.range(1).select(
        tx.citations(F.lit("see Supercell-x:1, snapshot:a|b and other_2:q`")).alias("c"), tx.unsupported_analysis(F.lit("下 周使用率")).alias("f"), tx.unsupported_analysis(F.lit("使用率前十")).alias("n"),
    ).first()
    assert row.c == ["Supercell-x:1,", "snapshot:a", "other_2:q"] and row.f == "future_forecast" and row.n is None
