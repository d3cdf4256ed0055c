"""The scope-partitioned store: what is rebuilt, carried, repaired and pruned, and who may publish."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from duelframe.operators import lease as ls
from duelframe.operators import store


def content(spark, changed=()):
    rows = [(s, i, i * (7 if s in changed else 1)) for s in ("a", "b", "c") for i in range(40)]
    return spark.createDataFrame(rows, "dataset_scope string, k int, v int")


def publish(spark, root, generation, rows, seen=None, **more):
    def build(todo):
        scopes = sorted(r.dataset_scope for r in todo.collect())
        if seen is not None:
            seen.append(scopes)
        mine = rows.join(todo, "dataset_scope", "left_semi")
        return {"sums": mine.groupBy("dataset_scope", (F.col("k") % 5).alias("g")).agg(F.sum("v").alias("v")), "rows": mine}

    steps = store.refresh(root, generation, store.scope_digests(rows, F.concat_ws("|", "k", "v")), build, **more)
    return {r.dataset_scope: r.action for r in steps.collect()}


def files(root, table, scope):
    return sorted(glob.glob(f"{root}/tables/{table}/generation=*/dataset_scope={scope}/part-*"))


def test_only_changed_scopes_are_built(spark, tmp_path):
    root, seen = str(tmp_path), []
    assert publish(spark, root, "g1", content(spark), seen) == {"a": "build", "b": "build", "c": "build"}
    before = {s: files(root, "sums", s) for s in "abc"}
    assert publish(spark, root, "g2", content(spark, {"b"}), seen) == {"a": "reuse", "b": "build", "c": "reuse"}
    assert publish(spark, root, "g3", content(spark, {"b"}), seen) == {"a": "reuse", "b": "reuse", "c": "reuse"}
    assert seen == [["a", "b", "c"], ["b"]]
    # unchanged partitions keep their files, the changed one has new ones beside the old
    assert {s: files(root, "sums", s) for s in "ac"} == {s: before[s] for s in "ac"} and set(before["b"]) < set(files(root, "sums", "b"))
    now = {(r.dataset_scope, r.g): r.v for r in store.load(spark, root, "sums").collect()}
    assert len(now) == 15 and now["b", 1] == 7 * now["a", 1]
    assert store.load(spark, root, "rows", generation="g1").where("dataset_scope = 'b'").agg(F.sum("v")).first()[0] == sum(range(40))
    # other rules make everything anew; a scope that is gone is not carried
    assert publish(spark, root, "g4", content(spark, {"b"}).where("dataset_scope <> 'c'"), rules="v2") == {"a": "build", "b": "build"}
    assert store.load(spark, root, "sums", "c").count() == 0
    gone = store.prune(spark, root, keep=1)
    assert "sums/generation=g1/dataset_scope=a" in gone and store.load(spark, root, "rows").count() == 80 and not os.path.exists(f"{root}/manifests/g1")


def test_a_reader_opens_one_partition(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, "g1", content(spark))
    publish(spark, root, "g2", content(spark, {"b"}))
    plan = store.load(spark, root, "rows", "b")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_scope" in text
    scan = plan.select("k")
    rows = scan.select("k", F.input_file_name().alias("f")).collect()
    assert len(rows) == 40 and all("generation=g2/dataset_scope=b" in r.f for r in rows)


@pytest.mark.parametrize("harm", ["cut", "lost", "other"])
def test_a_damaged_partition_is_made_again(spark, tmp_path, harm):
    root, seen = str(tmp_path), []
    publish(spark, root, "g1", content(spark))
    assert store.damaged(spark, root).count() == 0
    (path,) = files(root, "rows", "b")[:1]
    if harm == "cut":
        with open(path, "r+b") as f:
            f.truncate(40)
    elif harm == "lost":
        for p in files(root, "rows", "b"):
            os.remove(p)
    else:
        fresh = str(tmp_path / "other")
        content(spark).where("dataset_scope = 'b' AND k > 3").select("k", "v").coalesce(1).write.parquet(fresh)
        for p in files(root, "rows", "b"):
            os.remove(p)
        os.rename(glob.glob(f"{fresh}/part-*")[0], path)
    for crc in glob.glob(f"{root}/tables/rows/generation=g1/dataset_scope=b/.*.crc"):
        os.remove(crc)
    assert [tuple(r) for r in store.damaged(spark, root).collect()] == [("rows", "b")]
    kept = files(root, "rows", "a")
    assert publish(spark, root, "g2", content(spark), seen, verify=True) == {"a": "reuse", "b": "repair", "c": "reuse"}
    assert seen == [["b"]] and files(root, "rows", "a") == kept
    assert store.damaged(spark, root).count() == 0 and store.load(spark, root, "rows").select(*content(spark).columns).exceptAll(content(spark)).count() == 0


def test_the_pointer_stays_where_a_build_fails(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, "g1", content(spark))

    def broken(todo):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.refresh(root, "g2", store.scope_digests(content(spark, {"a"}), F.col("v").cast("string")), broken)
    assert ls.pointed(spark, root) == {"generation": "g1"}
    assert publish(spark, root, "g2", content(spark, {"a"})) == {"a": "build", "b": "reuse", "c": "reuse"}


def test_one_writer_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    first = ls.acquire(spark, root, "one", seconds=60, now=1000.0)
    with pytest.raises(ls.StoreBusy, match="one"):
        ls.acquire(spark, root, "two", now=1059.0)
    # the first writer sleeps past its time; the second takes over, and what the first then tries is refused
    second = ls.acquire(spark, root, "two", seconds=60, now=1061.0)
    with pytest.raises(ls.StaleWriter):
        first.point({"generation": "late"})
    second.point({"generation": "new"})
    assert (first.number, second.number) == (1, 2) and ls.pointed(spark, root) == {"generation": "new"}
    # even a pointer set between check and overtaking has the lower number
    assert ls.create_once(spark, f"{root}/pointers/{first.number:012d}", '{"generation": "late"}') and ls.pointed(spark, root) == {"generation": "new"}
    second.release()
    with ls.acquire(spark, root, "three") as third:
        assert third.number == 3
        with pytest.raises(ls.StoreBusy):
            store.refresh(root, "g", spark.createDataFrame([], "dataset_scope string, matches long, digest string"), dict)


def test_racing_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: ls.create_once(spark, f"{root}/once", str(i)), range(16)))
        ids = list(pool.map(lambda _: ls.attempt_id(spark, root, " batch "), range(8)))
    assert sum(won) == 1 and ls.read_text(spark, f"{root}/once") == str(won.index(True))
    assert sorted(ids) == ["batch", *[f"batch-attempt-{n}" for n in range(2, 9)]]
    with pytest.raises(ValueError):
        ls.attempt_id(spark, root, " ")


def test_a_queue_goes_on_where_it_stopped(spark, tmp_path):
    root, done = str(tmp_path), []

    def work(entry):
        if entry == "b" and "c" not in done:
            raise OSError("not yet")
        if entry == "d" and done.count("stop") == 0:
            done.append("stop")
            raise KeyboardInterrupt
        done.append(entry)

    with pytest.raises(KeyboardInterrupt):
        ls.drain(spark, root, ["a", "b", "c", "d"], work, attempts=2)
    assert ls.drain(spark, root, ["a", "b", "c", "d"], work, attempts=3) == {"a": "skipped", "b": "done", "c": "skipped", "d": "done"}
    assert done == ["a", "c", "stop", "b", "d"]


def test_the_published_store_makes_its_matches_once(spark, monkeypatch):
    """F16, F17: every generation made matches, observations and batches again from the order tables."""
    from duelframe.plans import published

    plans, real = [], store.settled
    monkeypatch.setattr(store, "settled", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows))
    published._store(spark, "/root/testdata/sf0.001")
    assert sum("l_orderkey" in p for p in plans) == 1
