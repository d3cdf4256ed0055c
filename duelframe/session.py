"""Session defaults shared by the tests, the bench and interactive use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "duelframe", master: str | None = None, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution on; settings of a running cluster win over none given here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def settled(rows: DataFrame) -> DataFrame:
    """Rows written once as a table in the shared folder, and read back: all later readers see the same rows, and an executor's loss costs nothing that is written."""
    path = f"{shared_folder(rows.sparkSession)}/settled-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
