"""Numbering, imports, queue, audit paths, snapshots, citation rates, redaction and forms on small fixtures."""

import datetime

from pyspark.sql import functions as F

from duelframe.functions import text as tx
from duelframe.operators import audit, intake
from duelframe.operators import queries as q


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = spark.range(0, 20_000, 1, 13).select((F.col("id") * 7919 % 20_000).alias("k"), F.col("id").alias("other"), F.lit("x" * 50).alias("wide"))
    got = q.numbered(rows, F.desc("k")).where(F.col("position") + F.col("k") != 20_000)
    assert got.count() == 0
    assert [r.k for r in q.sampled(rows, "k", 2, 5000, 3).orderBy("k").collect()] == [0, 1, 2, 5002, 10002, 15002, 19998, 19999]
    assert q.numbered(rows.limit(0), F.col("k")).count() == 0


def test_import_keeps_the_first_record_and_counts_conflicts(spark):
    known = spark.createDataFrame([("m1", "a")], "match_id string, payload_hash string")
    seen = spark.createDataFrame(
        [("b1", 1, "m1", "a"), ("b1", 2, "m1", "z"), ("b1", 1, "m2", None), ("b1", 2, "m2", "c"), ("b2", 1, "m2", "c"), ("b2", 1, "m3", None), ("b2", 2, "m4", "d")],
        "batch_id string, observer_tag int, match_id string, payload_hash string",
    )
    actions = intake.import_actions(known, seen)
    got = {(r.batch_id, r.observer_tag, r.match_id): r.action for r in actions.collect()}
    assert got == {
        ("b1", 1, "m1"): "same", ("b1", 2, "m1"): "conflict", ("b1", 1, "m2"): "conflict", ("b1", 2, "m2"): "insert", ("b2", 1, "m2"): "same", ("b2", 1, "m3"): "conflict", ("b2", 2, "m4"): "insert",
    }
    reports = {r.batch_id: tuple(r)[1:] for r in intake.batch_reports(actions).collect()}
    assert reports == {"b1": (1, 2, 2, "conflicted"), "b2": (1, 2, 1, "conflicted")}


def test_archive_adds_unseen_matches_without_a_rank(spark):
    seen = spark.createDataFrame([("m1", 4, "ranked_direct")], "match_id string, observer_rank int, observer_source string")
    archive = spark.createDataFrame([("m1",), ("m2",), ("m2",), (None,)], "match_id string")
    assert sorted(map(tuple, intake.import_archive(seen, archive).collect())) == [("m1", 4, "ranked_direct"), ("m2", None, "legacy_full")]


def test_queue_is_idempotent(spark):
    schema = "mode string, batch_id string, queued_at string"
    queue = spark.createDataFrame([("daily", "b1", "t5")], schema)
    new = spark.createDataFrame([("daily", "b1", "t1"), ("weekly", "b1", "t3"), ("weekly", "b1", "t2")], schema)
    queue = intake.enqueue(queue, new)
    assert sorted(map(tuple, queue.collect())) == [("daily", "b1", "t5"), ("weekly", "b1", "t2")]
    assert intake.dequeue(queue, new.where("mode = 'weekly'")).count() == 1


def test_traces_are_appended_and_read_by_id(spark, tmp_path):
    schema = "trace_id string, at timestamp, step string"
    path = str(tmp_path / "traces")
    for day, step in ((2, "second"), (1, "first")):
        intake.append_trace(spark.createDataFrame([("t", datetime.datetime(2024, 1, day), step), ("u", datetime.datetime(2024, 1, day), step)], schema), path)
    assert [r.step for r in intake.read_trace(spark, path, "t", schema).collect()] == ["first", "second"]


def test_audit_finds_escapes_and_changed_files(spark):
    listed = spark.createDataFrame([("a/b", "1"), ("a/./x/../c", "2"), ("../a/b", "1"), ("a/../../a/b", "1"), ("/a/b", "1"), (None, "1"), ("gone", "1"), ("d", None)], "path string, sha256 string")
    files = spark.createDataFrame([("a/b", "1"), ("a/c", "2"), ("d", "9")], "path string, sha256 string")
    assert sorted(r.path for r in audit.mismatches(listed, files).collect()) == ["../a/b", "/a/b", "<missing-path>", "a/../../a/b", "d", "gone"]


def test_manifest_digests_lines_in_key_order(spark):
    import hashlib

    rows = spark.createDataFrame([("s", f"k{i}") for i in range(300)], "scope string, k string")
    got = {r.part: (r.records, r.sha256) for r in audit.manifest(rows, "scope", "k", F.upper("k"), 1).collect()}
    parts: dict[str, list[str]] = {}
    for i in range(300):
        parts.setdefault(hashlib.md5(f"k{i}".encode()).hexdigest()[:1], []).append(f"k{i}")
    assert got == {p: (len(ks), hashlib.sha256("\n".join(k.upper() for k in sorted(ks)).encode()).hexdigest()) for p, ks in parts.items()}


def test_citation_rates_of_mixed_missing_and_asked_snapshots(spark):
    schema = "snapshot_id string, passed boolean, grounded boolean, invalid_citation boolean"
    one = spark.createDataFrame([("s", True, True, False), (" ", True, True, False)], schema)
    assert audit.citation_rates(one).first().passed and audit.citation_rates(one, "s").first().passed
    other = audit.citation_rates(one, "t").first()
    assert not other.snapshot_consistent and other.grounded_count == 1
    mixed = audit.citation_rates(one.unionByName(spark.createDataFrame([("t", True, False, True)], schema))).first()
    assert (mixed.case_count, mixed.grounded_count, mixed.invalid_citation_count, mixed.snapshot_consistent, mixed.passed) == (3, 2, 1, False, False)
    none = audit.citation_rates(one.limit(0)).first()
    assert none.grounding_rate == 0.0 and not none.passed


def test_redaction_reaches_every_depth(spark):
    rows = spark.sql("SELECT named_struct('api_key', 1, 'ok', 2, 'in', array(named_struct('authorization', 'b', 'v', map('my_secret', 's', 'n', 'm'))), 'none', CAST(NULL AS STRUCT<token: STRING>)) AS x")
    got = rows.select(audit.redacted(F.col("x"), rows.schema["x"].dataType).alias("x")).first().x.asDict(True)
    assert got == {"api_key": "[redacted]", "ok": 2, "in": [{"authorization": "[redacted]", "v": {"my_secret": "[redacted]", "n": "m"}}], "none": None}


def test_a_word_of_the_name_is_no_form(spark):
    cases = [("show Elite Archer", "Elite Archer", False), ("show elite Elite Archer", "Elite Archer", False), ("evolved knight", "Knight", False), ("Cannoneer rate", "Cannoneer", True), ("rates", None, False), ("精英 knight", "Knight", False)]
    df = spark.createDataFrame(cases, "text string, name string, tower boolean")
    got = [tuple(r.x) for r in df.select(tx.entity_form(F.col("text"), F.col("name"), F.col("tower")).alias("x")).collect()]
    assert got == [
        ("base8", None, None, None), ("loadout_entity", "card", "Elite Archer", "elite"), ("loadout_entity", "card", "Knight", "evolution"), ("loadout_entity", "tower", "Cannoneer", "tower"), ("base8", None, None, None),
        ("loadout_entity", "card", "Knight", "elite"),
    ]


def test_snapshots_are_complete_fresh_or_due(spark):
    schema = "sample_battles int, target_battles int, shortfall_battles int, collection_scope string, scope_contract string, record_count int, published_at timestamp, fetched_at timestamp, rate_limited boolean, refresh_budget_exhausted boolean"
    day = datetime.datetime(2024, 1, 10)
    rows = spark.createDataFrame([(9, 9, None, None, None, None, day, None, None, None), (9, 9, 0, "s", "v", 9, None, day, False, False), (8, 9, 0, "s", "v", 8, day, None, False, False), (9, 9, 0, "s", "w", 9, None, None, False, False)], schema)
    got = [(r.complete, r.age_seconds, r.refresh_due) for r in audit.snapshot_state(rows, F.lit("2024-01-11 00:00:00"), 9, "s", "v", 90_000).collect()]
    assert got == [(True, 86400.0, False), (True, 86400.0, False), (False, 86400.0, True), (False, None, True)]
