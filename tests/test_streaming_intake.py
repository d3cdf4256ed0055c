"""The stateful intake in several micro-batches against the batch form."""

import shutil

from duelframe.operators import intake
from duelframe.plans import intake as plans
from duelframe.streaming import incremental as inc
from duelframe.streaming import intake as si
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_a_stream_of_batches_acts_like_one_import(spark, tmp_path):
    one = plans._observed(spark, SF).select("batch_id", "match_id", F.col("observer_tag").cast("long"), F.md5("match_time").alias("payload_hash"))
    told = F.expr(f"CASE WHEN {plans.NUMBER} % 5 = 0 THEN md5(payload_hash) WHEN {plans.NUMBER} % 7 <> 0 THEN payload_hash END")
    two = one.select(F.concat("batch_id", F.lit("b")).alias("batch_id"), "match_id", F.expr("observer_tag + 1").alias("observer_tag"), told.alias("payload_hash"))
    every = one.unionByName(two).toPandas()
    known = spark.createDataFrame(one.where(f"{plans.NUMBER} % 11 = 0").select("match_id", "payload_hash").toPandas())
    batches = sorted(every["batch_id"].unique())
    cuts = [batches[len(batches) // 3], batches[2 * len(batches) // 3]]
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    settings = {"spark.sql.streaming.stateStore.providerClass": si.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sizes = []
        for part in (every[every.batch_id < cuts[0]], every[(every.batch_id >= cuts[0]) & (every.batch_id < cuts[1])], every[every.batch_id >= cuts[1]]):
            frame = spark.createDataFrame(part[["match_id", "batch_id", "observer_tag", "payload_hash"]], "match_id string, batch_id string, observer_tag long, payload_hash string")
            frame.coalesce(1).write.mode("append").parquet(source)
            stream = si.import_actions(spark.readStream.schema(frame.schema).parquet(source), known)
            assert inc.run_once(stream, lambda df, n: df.write.mode("append").parquet(out), ck).awaitTermination(100)
            sizes.append(spark.read.parquet(out).count())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert 0 < sizes[0] < sizes[1] < sizes[2] == len(every)
    names = ["match_id", "batch_id", "observer_tag", "action"]
    want = intake.import_actions(known, spark.createDataFrame(every))
    got = sorted(map(tuple, spark.read.parquet(out).select(*names).collect()))
    assert got == sorted(map(tuple, want.select(*names).collect()))
    assert {a for *_, a in got} == {"insert", "same", "conflict"}
    shutil.rmtree(ck)
