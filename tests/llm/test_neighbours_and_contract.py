import importlib
import os
import re

import numpy as np

from duelframe.llm import neighbours, queries

SF = "/root/testdata/sf0.001"


def test_neighbours_recall_ties_and_edges(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(600, 16))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0 OR vec_id = 5 OR vec_id = 904")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [*range(0, 600, 20), 5]:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(s == d[v] for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(want.tolist()))
        total += 10
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[5])][:2] == [6, 7] and 904 not in got and not set(got) & {900, 901, 902, 903}
    few = df.where("vec_id < 4")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 3
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    pieces = neighbours.nearest(df, df.where("vec_id % 20 = 0"), piece_rows=40, piece_queries=5).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in pieces} == {(q, r, v) for q, rows in got.items() if q % 20 == 0 for r, v, _ in rows}


def test_neighbours_of_large_and_of_close_vectors(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=8) * 1e6
    x = np.vstack([base + rnd.normal(size=8) * 1e-4 for _ in range(60)] + [rnd.normal(size=8) * 1e200 for _ in range(5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id IN (0, 10, 61)"), probes=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 10):
        d = np.sqrt(((x[:60] - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [v for _, v, _ in sorted(got[q])] == np.lexsort((np.arange(60), d))[:10].tolist()
        assert all(s == d[v] for _, v, s in got[q])
    assert all(np.isfinite(s) for _, _, s in got[61]) and len(got[61]) == 10


def test_contract_columns(spark):
    want = {
        "op1_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op11_": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
        "op12_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op13_": {
            "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string",
        },
        "op3_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op4_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op7_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
        "op8_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op10_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    }
    for prefix, columns in want.items():
        name = next(n for n in queries.QUERIES if n.startswith(prefix))
        have = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert {c: have.get(c) for c in columns} == columns, name
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == start.columns, name
    assert docs.columns == ["doc_id", "ids", "n_pieces"] and docs.count() > 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "duelframe")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert "duelframe.llm" not in f.read(), n


def test_neighbours_under_repeated_ids(spark):
    """Copies of an id take no places: 20 candidates of 12 rows each give ten rows, also where the rows differ, and recall is that of single rows."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(20, 16))
    equal = [(0, x[0].tolist())] + [(i + 1, v.tolist()) for i, v in enumerate(x) for _ in range(12)]
    df = spark.createDataFrame(equal, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 0"), probes=32).collect())
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert [v for _, _, v, _ in got] == (np.lexsort((np.arange(20), d))[:10] + 1).tolist() and [r for _, r, _, _ in got] == list(range(1, 11))
    moved = {i + 1: [v + rnd.normal(size=16) * 0.3 for _ in range(12)] for i, v in enumerate(x)}
    rows = [(0, x[0].tolist())] + [(i, v.tolist()) for i, vs in moved.items() for v in vs]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    near = {i: np.sqrt(((np.array(vs) - x[0]) ** 2).sum(axis=1)).min() for i, vs in moved.items()}
    for piece_rows in (8192, 30):
        got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 0"), probes=32, piece_rows=piece_rows).collect())
        assert [v for _, _, v, _ in got] == sorted(near, key=lambda i: (near[i], i))[:10]
        assert all(s == near[v] for _, _, v, s in got)
