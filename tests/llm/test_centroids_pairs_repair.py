"""Centroid clustering, byte-pair matrices and conversation repair against SQL, plain loops and the library."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from duelframe.llm import byte_pairs, centroids, repair

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_sql(tmp_path, frame, name, sql):
    path = str(tmp_path / name)
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(sql).fetchall(), key=str)


def vector_rows(n=300, seed=1):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in r.normal(size=64).round(2)], 7) for i in range(n)]
    return rows + rows[:40] + [
        (None, [0.5] * 64, 1), (900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [float("nan")] + [1.0] * 63, 1), (904, [float("inf")] + [1.0] * 63, 1), (905, [None] + [1.0] * 63, 1), (906, [0.0] * 64, 1),
    ]


def test_sort_means_matches_the_sql(spark, tmp_path):
    frame = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, cluster int")
    got = sorted((tuple(r)[:6] for r in centroids.sort_means(frame).collect()), key=str)
    assert got == by_sql(tmp_path, frame, "embeddings", centroids.ORACLE_SQL)
    assert len(got) == 300 + 40 + 2


def test_scan_is_exact_and_skips_far_centroids():
    r = np.random.default_rng(4)
    centres = r.integers(-400, 400, (40, 8))
    x = centres[r.integers(0, 40, 3000)] + r.integers(-9, 10, (3000, 8))
    whole = ((x[:, None] - centres) ** 2).sum(axis=2)
    near = whole.argmin(axis=1)
    cluster, distance, tried = centroids.scan(x, near, centres)
    assert (cluster == near).all() and (distance == whole.min(axis=1)).all()
    assert tried < 3 * len(x)
    # from anywhere else the result is the same, and ties go to the smaller number
    same = np.concatenate([centres, centres])
    assert (centroids.scan(x, np.full(len(x), 79), same)[0] == near).all()


def test_sort_means_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.sort_means(spark.createDataFrame([], schema)).collect() == []
    few = centroids.sort_means(spark.createDataFrame([(1, [1.0] * 64), (2, [1e300] * 64), (3, [-1e300] * 64)], schema)).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and all(r.inertia == 0 for r in few)
    assert {tuple(r.v)[0] for r in few} == {64, centroids.MOST, -centroids.MOST}


TEXTS = [
    None, "", " ", "one", "Don't we'll  two  ", "naïve 東京 🙂🙂​", "<|endoftext|>", "\x1c\x1d a b \n\n c", "a" * 5000, " " * 3000 + "x", "=-" * 3000, "ab" * 700 + "1" * 900,
    "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "".join(chr(random.Random(3).randint(0x4E00, 0x9FFF)) for _ in range(3000)),
]


def test_byte_pairs_match_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "twice", "y"), (1, "twice", "y"), (None, "no id", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_pairs.round_trips(frame, RANKS).collect()), key=str) == sorted(want, key=str)
    encoded = byte_pairs.encode_documents(frame, RANKS, ids="n_tokens")
    assert encoded.columns == ["doc_id", "text", "n_tokens"]
    back = byte_pairs.decode_documents(encoded, RANKS, ids="n_tokens").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == library.encode_ordinary(r.text or "") for r in back)
    assert byte_pairs.round_trips(frame.limit(0), RANKS).collect() == []


def test_decoding_unknown_ids_gives_null(spark):
    frame = spark.createDataFrame([([64, 65],), ([],), ([10**6],), ([-1],), ([None],), (None,)], "ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_pairs.decode_documents(frame, RANKS).collect()] == [b"ab", b"", None, None, None, None]


def test_rows_settle_at_their_seams(library, monkeypatch):
    """Long pieces are cut into very short rows, which must give the same ids; so must the heap that takes what does not settle."""
    codec = byte_pairs.codec(RANKS)
    r = random.Random(8)
    pieces = ["".join(r.choice(letters) for _ in range(400)) for letters in ("ab", "aeiourst", "abcdefghijklmnopqrstuvwxyz", " ")]
    for row_bytes, stretch in ((3, 4096), (7, 4096), (3, 4)):
        monkeypatch.setattr(byte_pairs, "ROW_BYTES", row_bytes)
        monkeypatch.setattr(byte_pairs, "STRETCH_BYTES", stretch)
        for piece, ids in zip(pieces, codec.encode_pieces([p.encode() for p in pieces])):
            assert ids.tolist() == library._core_bpe.encode_single_piece(piece.encode())


def test_pieces_are_kept_only_up_to_the_bound(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "PIECES_KEPT", 3)
    encoder = byte_pairs.Encoder(byte_pairs.codec(RANKS))
    for text in ("many different words here", "other ones there", "many words again"):
        assert encoder.encode([text, text])[1].tolist() == library.encode_ordinary(text)


def message_rows(seed=3):
    r = random.Random(seed)
    rows = []
    for conv in (None, *range(40)):
        for _ in range(r.choice([0, 1, 2, 3, 5, 9, 40])):
            rows.append((conv, r.choice([None, *range(12)]), r.choice([None, "user", "assistant", "system", "user", "assistant", "", "tool", "Ass"]), r.choice([None, "", "a.", "b", "hi!", "c? \n", " \t", "é", "yes. no"]), 1))
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 5])
def test_repair_matches_the_sql(spark, tmp_path, block):
    frame = spark.createDataFrame(message_rows(), "conv_id long, turn int, role string, text string, cost int")
    got = sorted((tuple(r) for r in repair.repair(repair.damaged(frame), block).collect()), key=str)
    assert got == by_sql(tmp_path, frame, "conversations", repair.ORACLE_SQL)


def test_repair_finds_the_cheapest_edits():
    """Against every string of edits over short conversations."""
    r, legal = random.Random(5), re.compile(r"(s?(ua)+)?\Z")
    for _ in range(60):
        roles = [r.choice(["system", "user", "assistant", "x"]) for _ in range(r.randint(0, 3))]
        texts = [r.choice(["a.", "b", "", "c!"]) for _ in roles]
        got = repair.repair_whole(np.array([0, len(roles)]), np.arange(len(roles)), np.ones(len(roles), bool), roles, texts)
        seen, kinds = set(), []
        for row in zip(roles, texts):
            kinds.append(repair.fault(row[1], row in seen))
            seen.add(row)
        best = None
        moves = [["D"] if k in (1, 2) else ["D", "K", "Ru", "Ra"] for k in kinds]
        gaps = [("",), ("u",), ("a",), ("u", "a"), ("a", "u")]
        for chosen in itertools.product(*[list(itertools.product(gaps, m)) for m in moves], [(g, None) for g in gaps]):
            shape, audit, cost = "", "", 0
            for i, (gap, move) in enumerate(chosen):
                for g in gap:
                    if g:
                        shape, audit, cost = shape + g, audit + "I", cost + 2
                if move is None:
                    continue
                audit += move[0]
                if move != "D":
                    shape += roles[i][0] if move == "K" else move[1]
                    cost += (kinds[i] == 3) + (2 if move != "K" else 0)
                else:
                    cost += 3
            if legal.match(shape) and (best is None or (cost, audit) < best):
                best = cost, audit
        assert (got["cost"][0], got["audit"][0]) == best


def test_repair_edges(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert repair.repair(repair.prepared(spark.createDataFrame([], schema))).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    dropped = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = repair.repair(repair.damaged(spark.createDataFrame([(1, dropped, "user", "x.")], schema))).collect()
    assert [tuple(g) for g in got] == [(1, 0, 0, 0, 0, 0, 0, "", nothing)]
    rows = [(2, None, "user", "hi."), (2, 1, "assistant", "yes."), (2, 4, "assistant", "yes."), (3, 0, "system", "be good.")]
    got = {r.conv_id: r for r in repair.repair(repair.prepared(spark.createDataFrame(rows, schema))).collect()}
    assert (got[2].gaps, got[2].duplicate, got[2].illegal, got[2].cost, got[2].audit) == (2, 1, 1, 3, "KKD")
    assert got[2].repaired_sha256 == hashlib.sha256(b"user:hi.\nassistant:yes.").hexdigest()
    assert (got[3].cost, got[3].audit, got[3].repaired_sha256) == (3, "D", nothing)
