"""Small fixtures and brute-force counterparts of the dealt operators on text."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from duelframe.llm import bpe, language, media, mixing, near_dedup, passages, quotes, sentence_pieces, token_counts, toxicity
from duelframe.llm.common import WordHash, components, word_ids

RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, extra int"):
    full = [(*r, *[None] * (6 - len(r))) for r in rows]
    return spark.createDataFrame(full, schema)


EDGES = [(1, None), (2, ""), (3, "one"), (4, " \n\t "), (5, "one"), (5, "one"), (6, "x" * 5000), (None, "no id here"), (7, "two words")]


def brute_components(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=1, groups=6, size=7):
    rows, i = [], 0
    for g in range(groups):
        base = prose(120, seed * 100 + g).split()
        for k in range(size):
            r = random.Random(seed * 1000 + g * 50 + k)
            w = list(base)
            for _ in range(k * 2):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    rows = near_copies() + [(100 + i, prose(80, 900 + i)) for i in range(10)] + [(200, None), (201, ""), (202, "word"), (203, "WORD")]
    want = brute_components(rows, width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_edges(spark):
    got = near_dedup.near_duplicates(frame(spark, EDGES), 2).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 3 and not by[5].kept and by[1].n_shingles == 0 and by[1].kept
    assert near_dedup.near_duplicates(frame(spark, []), 2).count() == 0
    assert near_dedup.deduplicated(frame(spark, EDGES)).columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]


def test_clusters_are_compared_past_their_star(spark):
    """A chain whose ends are far apart: links that no star centre has are still found."""
    base = prose(100, 77).split()
    rows = []
    for k in range(12):
        w = list(base)
        for j in range(k * 4):
            w[j] = f"new{j}"
        rows.append((k, " ".join(w)))
    want = brute_components(rows, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_setsketch_estimate_and_merge():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = x[:900], x[100:]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (np.maximum(ra, rb) == near_dedup.registers(x)).all()
    j = near_dedup.estimate(ra[None], rb[None], np.array([900]), np.array([900]))[0]
    assert abs(j - 0.8) < 0.1


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41), (50, 50)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 40: 40, 41: 40}


def test_passages_are_cut_once(spark):
    hot = prose(70, 1)
    rows = [(i, f"{prose(40, 10 + i)} {hot} {prose(30, 60 + i)}") for i in range(6)] + [(50, prose(200, 99)), (51, None), (52, ""), (53, prose(10, 3)), (53, prose(10, 3))]
    got = {r.doc_id: r for r in passages.without_repeats(frame(spark, rows)).collect()}
    assert hot in got[0].text and got[0].removed_words == 0
    for i in range(1, 6):
        assert hot not in got[i].text and got[i].removed_words >= 68 and got[i].component_id == 0
    assert got[50].text == rows[6][1] and got[50].n_links == 0 and got[51].text is None and got[52].text == ""
    assert passages.without_repeats(frame(spark, [])).count() == 0
    kept = passages.cleaned_documents(frame(spark, rows + [(60, hot), (None, hot)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert not kept.where("doc_id = 60").count() and kept.where("doc_id IS NULL").count() == 1


def test_equal_windows_share_every_band():
    cache = WordHash()
    hot = prose(50, 2).encode().split()
    a, b = word_ids(prose(33, 5).encode().split() + hot + prose(9, 6).encode().split(), cache), word_ids(hot + prose(44, 7).encode().split(), cache)
    ka, kb = passages.anchors(a)[0], passages.anchors(b)[0]
    assert len(set(ka.tolist()) & set(kb.tolist())) >= passages.BANDS
    h = np.random.default_rng(1).integers(0, 2**60, 300, dtype=np.uint64)
    assert passages.window_minima(h, 46).tolist() == sorted({i + int(h[i : i + 46].argmin()) for i in range(255)})


def test_window_minima_are_at_their_own_places():
    r = np.random.default_rng(2)
    for n, most in ((300, 40), (120, 3), (200, 1), (47, 5), (46, 5)):
        h = r.integers(0, most, n, dtype=np.uint64)
        assert passages.window_minima(h, 46).tolist() == sorted({i + int(h[i : i + 46].argmin()) for i in range(n - 45)})


def test_passages_twice_in_one_document(spark):
    """A later document's two copies go, and so does the second copy inside one document."""
    hot, own = prose(70, 201), prose(60, 202)
    rows = [(1, f"{prose(40, 203)} {hot}"), (2, f"{hot} {prose(45, 204)} {hot} {prose(20, 205)}"), (3, f"{own} {prose(30, 206)} {own} {prose(10, 207)}")]
    got = {r.doc_id: r for r in passages.without_repeats(frame(spark, rows)).collect()}
    assert got[1].removed_words == 0 and hot not in got[2].text and got[2].removed_words >= 138
    assert got[3].text.startswith(own) and got[3].text.count(own) == 1 and got[3].removed_words >= 60 and got[3].n_links == 0


def test_passage_whose_minima_occur_earlier_in_the_text():
    """The lines that hold the passage's minima stand alone further up in the text: the passage is still marked at its own place."""
    cache = WordHash()
    hot = prose(50, 211).split()
    pos = passages.anchors(word_ids(" ".join(hot).encode().split(), cache))[1].tolist()
    early = [w for i, p in enumerate(pos) for w in [*hot[p : p + 5], *prose(25, 220 + i).split()]] + prose(60, 214).split()
    keys, at = passages.anchors(word_ids(" ".join(early + hot + prose(30, 215).split()).encode().split(), cache))
    assert {len(early) + p for p in pos} <= set(at.tolist())


def test_passages_beside_a_line_of_an_earlier_document(spark):
    """x and y share a few words and a 40-word line that an earlier document has too: y's copy is cut and linked to x."""
    rows, shared = [], {}
    for i in range(24):
        line = prose(40, 300 + i)
        shared[i] = f"{prose(11 + i % 10, 400 + i)} {line}"
        rows += [(i, f"{prose(30, 500 + i)} {line} {prose(30, 600 + i)}")]
        rows += [(100 + i, f"{prose(30, 700 + i)} {shared[i]} {prose(30, 800 + i)}"), (200 + i, f"{prose(20, 900 + i)} {shared[i]} {prose(40, 1000 + i)}")]
    got = {r.doc_id: r for r in passages.without_repeats(frame(spark, rows)).collect()}
    for i in range(24):
        assert shared[i] in got[100 + i].text and shared[i] not in got[200 + i].text
        assert got[200 + i].removed_words >= 51 + i % 10 and got[200 + i].component_id == 100 + i and got[i].n_links == 0


NASTY = ["a", "b", " ", "  ", "\n", "\t", "\x85", "\xa0", "　", "'s", "'ll", "<|endoftext|>", "<|endof", "1", "é", "日本", "!", "😀", "​", "ing", "\r\n", "İ", "_", "▁", "<0x0A>", "<s>"]


def nasty(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(NASTY) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(nasty(200, 1) + [prose(60, i) for i in range(20)] + ["y" * 3000, None, "", "don't 'tis ''s 'r're 've'l 'LL x'"])]
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    for chunk in (1 << 16, 7):
        got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, rows), path, chunk).collect()}
        assert {i: r.n_tokens for i, r in got.items()} == want
        assert all(got[i].n_bytes == len((t or "").encode()) for i, t in rows)
    assert token_counts.token_counts(frame(spark, EDGES), path, 3).count() == len(EDGES)
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


LONG = ["a" + " " * 100_000 + "b", "xyq" * 350_000, "日本" * 20_000, "\n" * 50_000 + "z", ("word " * 7 + "  \n") * 9_000]


def test_very_long_texts_equal_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = list(enumerate(LONG))
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, rows), path, 10_000).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentence_pieces.encode_documents(frame(spark, rows), path).select("doc_id", "ids", "decoded").collect():
        assert r.ids == pieces.encode(LONG[r.doc_id]) and r.decoded == pieces.decode(r.ids)


def test_transducer_states_name_all_that_matters():
    """Counting in steps through any cut gives the whole: the state carries what the rest needs."""
    t = token_counts.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    for text in nasty(60, 7):
        state, n = t.start, 0
        for char in text:
            state, change = t.state(state.mode, state.inner, state.waiting)[char]
            n += change
        if not t.special.search(text):
            assert n + t.final(state) == t.count(text)


def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate(nasty(300, 2) + [prose(60, i) for i in range(20)] + [None, "", " ", "z" * 2000])]
    got = {r.doc_id: r for r in sentence_pieces.encode_documents(frame(spark, rows), path).collect()}
    for i, t in rows:
        assert got[i].ids == lib.encode(t or "") and got[i].n_pieces == len(got[i].ids)
        assert got[i].decoded == lib.decode(got[i].ids)
    assert sentence_pieces.encode_documents(frame(spark, EDGES), path).count() == len(EDGES)
    assert sentence_pieces.encode_documents(frame(spark, []), path).count() == 0


def test_merge_paths_equal_stepwise_merges():
    merges, _, _ = bpe.byte_level(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(9)
    for _ in range(400):
        raw = bytes(r.choice(b"theandingreo sz1!\xc3\xa9") for _ in range(r.randint(1, 14)))
        assert merges.path(raw) == merges.merge(raw)
    pieces = sentence_pieces.PieceTransducer(public_tokenizers.path("piece_bpe_32k.model")).merges
    for n in range(1, 90):
        for end in ("", "a", "the", "1", "日"):
            assert pieces.path("▁" * n + end) == pieces.merge("▁" * n + end)


def sample_docs():
    speech = {
        "en": "the and of to that with which this have from they would there their what about".split(),
        "de": "der die und nicht mit auch eine wird sich dem dass über schön müssen zwischen".split(),
        "fr": "le la les des une est pas que qui avec dans être où déjà très leur".split(),
        "es": "el los las una por con para está también más niño corazón donde pero sobre".split(),
    }
    r = random.Random(4)
    return [(i, " ".join(r.choice(speech[lang]) for _ in range(25)), lang, "s", 0) for i, lang in enumerate(list(speech) * 60)]


def test_languages_of_held_out_rows(spark):
    rows = sample_docs() + [(1000, None), (1001, "12 34 !!"), (1002, "")]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    held = [(i, lang) for i, _, lang, *_ in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.accepted(frame(spark, rows)).count() == 240
    assert language.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in language.identify(frame(spark, [(1, "no labels at all")])).collect()} == {"und"}


def test_toxicity_of_held_out_rows_and_location(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        parts = [prose(8, i * 10 + k) + "." for k in range(6)]
        bad = i % 4 == 0
        if bad:
            parts[3] = f"{prose(3, i)} {r.choice(['vilecur', 'rottenhag'])} {prose(3, i + 1)}."
        rows.append((i, " ".join(parts)))
        labels.append((i, 0, int(bad)))
    rows += [(900, None), (901, "")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxic_documents(frame(spark, rows), marks).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(any(s.sentence == 3 for s in got[i].offending) for i in held if i % 4 == 0 and got[i].predicted)
    assert got[900].score == got[901].score == 0.0 and all(0 <= x.score <= 1 for x in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxic_documents(frame(spark, rows[:3]), none).where("predicted = 0").count() == 3
    assert toxicity.toxic_documents(frame(spark, []), marks).count() == 0


def test_all_bytes_of_a_long_run_count():
    for joint in ("天気がいい", "word/"):
        plain, bad = (joint * 20).encode(), (joint * 20 + "vilecur").encode()
        got, tail = set(toxicity.word_features([bad])[0].tolist()), toxicity.word_features([b"xvilecur"])
        assert got != set(toxicity.word_features([plain])[0].tolist())
        inner = {int(b) for b in tail[0].tolist()} & set(toxicity.word_features([b"yvilecur"])[0].tolist())
        assert inner and inner <= got


def test_media_payloads_round_trip(spark):
    import hashlib

    rows = [r for r in EDGES if r[0] is not None] + [(70, "z" * 64), (71, "é" * 33), (72, prose(500, 1)), (73, prose(500, 1))]
    got = media.document_media(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes == len(padded) + 44
        assert r.media_sha256 == hashlib.sha256(media.pack(padded)).hexdigest() and media.unpack(media.pack(padded)) == padded
    by = {r.doc_id: r for r in got}
    assert by[72][2:] == by[73][2:]
    assert media.document_media(frame(spark, [])).count() == 0


def test_interleaved_sequences_keep_order_and_captions(spark):
    html = '<p>a <b>b</b><figure><img src="sha256:00" alt=x><figcaption>cap <i>t</i></figcaption></figure>tail<script>no</script><img src=u>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>open <p>tags")], "page_id long, html string")
    got = {r.page_id: [(i.position, i.kind, i.text, i.ref, i.caption) for i in r["items"]] for r in media.interleave(pages, "page_id").collect()}
    assert got[1] == [(0, "text", "a b", None, None), (1, "media", None, "00", "x cap t"), (2, "text", "tail", None, None), (3, "media", None, "u", None)]
    assert got[2] == [] and [x[2] for x in got[3]] == ["open", "tags"]
    refs = media.references(media.interleave(pages, "page_id"), "page_id")
    found = media.resolve(refs, spark.createDataFrame([("00", 5)], "digest string, size int")).collect()
    assert {(r.ref, r.size) for r in found} == {("00", 5), ("u", None)}


def test_document_pages_hold_text_then_media(spark):
    """Items of whole tables are in the page's order: the text's words, then one reference with its caption."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r["items"] for r in media.interleave(media.document_pages(docs), "doc_id").collect()}
    for d in docs.collect():
        words = " ".join((d.text or "").split())
        assert [(i.kind, i.text, i.caption) for i in rows[d.doc_id]] == ([("text", words, None)] if words else []) + [("media", None, d.source)]
        assert [i.position for i in rows[d.doc_id]] == list(range(len(rows[d.doc_id])))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for p in media.interleave(pages, "page_id").join(pages.select("page_id", "html"), "page_id").collect():
        at = -1
        bare = " ".join(__import__("html").unescape(p.html).split())
        for item in (i for i in p["items"] if i.kind == "text"):
            found = bare.find(item.text.split()[0], at + 1)
            assert found > at
            at = found
        assert not any("track(" in (i.text or "") for i in p["items"])


def water_fill(sizes, weights, total, most=2):
    capped, target = set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    rows = [(i, prose(r.randint(5, 60), i), "en", r.choice(["a", "b", "c", "d", "hot", "hot", "hot", None]), 0) for i in range(300)] + [(900, None, None, "a", 0), (901, "", None, "z", 0)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    again = mixing.mix_sources(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = Counter()
    for r_ in got:
        size[r_.source] += r_.size
        assert 0 <= r_.taken <= 2 * r_.size
    order = sorted(size, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_fill({s: n for s, n in size.items() if n}, weights, 1.5 * sum(size.values()))
    taken = Counter()
    for r_ in got:
        taken[r_.source] += r_.taken
        assert r_.source_size == size[r_.source] and abs(r_.target - want.get(r_.source, 0)) < 1e-6
    assert all(abs(taken[s] - t) <= 0.02 * t + 4 for s, t in want.items())
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    copies = mixing.mixed_documents(frame(spark, rows))
    assert copies.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"] and 300 < copies.count() < 700


def test_mixed_rows_with_null_or_repeated_ids_keep_their_own_copies(spark):
    rows = [(None if i % 4 == 0 else i % 7, prose(5 + i, i), "en", "ab"[i % 2], 0) for i in range(60)] + [(None, None, None, "a", 0)]
    df = frame(spark, rows)
    size = Counter()
    for r in mixing.mix_sources(df).collect():
        size[r.doc_id, r.source, r.size] += int(r.taken / r.size + 0.5) if r.size else 1
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mixed_documents(df).collect())
    assert got == +size and any(k[0] is None for k in got)


def test_seats_follow_the_highest_quotients(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 1}
    df = spark.createDataFrame([(0, k, v) for k, v in votes.items()], "g int, p string, v long")
    got = {r.p: r.quota for r in mixing.apportion(df, F.lit(15), F.col("v"), F.lit(9), ["g"], ["p"]).collect()}
    seats = Counter()
    for _ in range(15):
        seats[max((k for k in votes if seats[k] < 9), key=lambda k: votes[k] / (2 * seats[k] + 1))] += 1
    assert got == {k: seats[k] for k in votes}


CHAT = [
    (1, 0, "user", "Hello there\nhow are you"), (1, 1, "assistant", "Fine thanks"), (1, 2, "user", "> Hello   THERE\n> how are you\nI asked"),
    (1, 3, "assistant", "> > Hello there\n> > how are you\n> I asked\nyes"), (1, 4, "user", ">nothing like it\n\nok"), (2, 0, "user", None), (2, 1, "user", ""), (2, 1, "user", ""),
    (None, 0, "user", "lost"), (None, 1, "assistant", "> lost\nfound"), (3, None, "system", "> Fine thanks\nx"), (4, 5000, "user", "late"), (4, 2, "user", "early"),
]


def quoting_chat(n_convs=150, turns=20):
    """Mail-like conversations: bodies of lines and paragraphs, quotes of bodies, paragraphs, lines and quoting messages, at several levels, some without an original."""
    r = random.Random(21)
    rows = []
    for c in range(n_convs):
        bodies = []
        for t in range(turns):
            own = "\n\n".join("\n".join(prose(r.randint(2, 6), r.randrange(10**6)).replace(" ", r.choice([" ", "  "])) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3)))
            parts = []
            for _ in range(r.randint(0, 3) if t else 0):
                source = r.choice(bodies) if r.random() < 0.8 else prose(5, r.randrange(10**6))
                pick = r.choice([source, r.choice(source.split("\n\n")), r.choice(source.split("\n"))])
                mark = r.choice([">", "> ", "> > ", ">>", " > "])
                parts.append("\n".join(mark + (x.upper() if r.random() < 0.3 else x) for x in pick.split("\n")))
            parts.insert(r.randint(0, len(parts)), own)
            bodies.append(own)
            rows.append((c or None, t, "user" if t % 2 else "assistant", r.choice(["\n", "\r\n", "\n\n"]).join(parts)))
    return rows


def test_quote_links_equal_the_sql_on_quoting_conversations(spark):
    import duckdb
    import pandas as pd

    rows = quoting_chat()
    frame_ = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame_)
    names = ["conv_id", "turn", "role", "position", "reply_to", "body", "depth", "n_quotes", "n_linked"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({quotes.ORACLE_SQL})").fetchall(), key=lambda r: (r[0] or 0, r[1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = [tuple(r[n] for n in names) for r in quotes.conversations(df).orderBy(F.coalesce("conv_id", F.lit(0)), "turn").collect()]
    assert len(got) == 3000 and sum(r[8] for r in got) > 1500 and max(r[6] for r in got) >= 2
    assert got == want


def test_long_quotes_take_linear_time(spark):
    body = "\n".join(prose(4, i) for i in range(30_000))
    rows = [(1, 0, "user", body), (1, 1, "assistant", "\n".join("> " + x for x in body.split("\n")) + "\nagreed"), (1, 2, "user", "> agreed\n" * 20_000)]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].body, got[1].n_linked, got[1].reply_to, got[2].n_quotes, got[2].n_linked) == ("agreed", 1, 0, 1, 0)


def test_columns_with_names_of_our_own_stay(spark):
    """Columns that carry the operators' working names come through the pipeline's stages untouched."""
    names = ["score", "lang_pred", "row", "id", "_id", "spans", "keep", "left_over", "at", "copies", "copy", "size", "taken", "node", "component_id", "kept"]
    rows = [(i, prose(60, i), "en", "ab"[i % 2], 9, *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (language.accepted, near_dedup.deduplicated, passages.cleaned_documents, mixing.mixed_documents):
        out = stage(df)
        assert out.columns == df.columns
        kept = {r.doc_id: r for r in out.collect()}
        assert kept and all(r[n] == f"{n}{i}" for i, r in kept.items() for n in names), stage
    for query in (lambda d: near_dedup.near_duplicates(d, 2), passages.without_repeats, mixing.mix_sources, language.identify, media.document_media):
        assert query(df).count() == 12


def test_samples_stay_bounded_under_repeated_ids(spark):
    rows = [(7, prose(10, 1), "en", "s", 0)] * 300 + [(None, prose(10, i), "fr", "s", 0) for i in range(50)]
    got = Counter(r.lang for r in language.training_rows(frame(spark, rows), F.lit(False), 20).collect())
    assert got["en"] <= 20 and got["fr"] <= 20


def test_texts_under_one_doc_id_are_all_linked(spark):
    """A doc_id with two texts ties the near copies of both together."""
    x, y = prose(80, 31), prose(80, 32)
    rows = [(1, x + " end"), (2, x), (2, y), (3, y + " end"), (9, prose(80, 33))]
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 1), (3, 1), (9, 9)]


def test_links_between_members_that_no_centre_has(spark):
    """Two families that share buckets: links inside the smaller one and between edited members are those of brute force."""
    r, rows = random.Random(3), []
    base = prose(150, 400).split()
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([6, 10, 14, 18])):
            w[r.randrange(len(w))] = f"own{i}x{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 2)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_edited_passages_are_found(spark):
    """Recall over passages of 80 words of which three are changed (five-word similarity 0.7 to 0.85, of whole windows of 50 at times above 0.8)."""
    r, rows = random.Random(12), []
    for i in range(60):
        own = prose(80, 5000 + i).split()
        rows.append((i, f"{prose(40, 6000 + i)} {' '.join(own)} {prose(30, 7000 + i)}"))
        for at in r.sample(range(0, 12), 2):
            own[at] = "edit"
        rows.append((100 + i, f"{prose(25, 8000 + i)} {' '.join(own)} {prose(45, 9000 + i)}"))
    got = {x.doc_id: x for x in passages.without_repeats(frame(spark, rows)).collect()}
    found = [got[100 + i].removed_words >= 60 and got[100 + i].component_id == i for i in range(60)]
    assert sum(found) >= 0.96 * 60


def test_quotes_are_linked_to_their_messages(spark):
    df = spark.createDataFrame([(*r, 1) for r in CHAT], "conv_id long, turn long, role string, text string, extra int")
    rows = quotes.conversations(df).collect()
    assert len(rows) == len(CHAT)
    got = {(r.conv_id, r.turn): r for r in rows}
    assert (got[1, 2].reply_to, got[1, 2].body, got[1, 2].depth, got[1, 2].n_linked) == (0, "I asked", 1, 1)
    assert (got[1, 3].reply_to, got[1, 3].body, got[1, 3].depth, got[1, 3].n_quotes, got[1, 3].n_linked) == (2, "yes", 2, 2, 2)
    assert (got[1, 4].reply_to, got[1, 4].n_linked, got[1, 1].reply_to, got[1, 0].reply_to) == (3, 0, 0, None)
    assert (got[None, 1].reply_to, got[None, 1].body, got[None, 1].n_linked) == (0, "found", 1)
    assert (got[4, 5000].reply_to, got[4, 5000].position, got[3, None].n_linked) == (2, 2, 0)
    assert sorted(r.position for r in rows if r.conv_id == 2) == [1, 2, 3]
    assert quotes.conversations(df.limit(0)).count() == 0
    chats = {(r.conv_id, r.segment): r.chat for r in quotes.chat_text(quotes.conversations(df), 3).collect()}
    assert chats[1, 0].count("<|") == 3 and ">" not in chats[1, 0].replace("|>", "")


def test_marks_of_many_texts_are_those_of_each_alone():
    rng = random.Random(5)
    sizes = [0, 3, 49, 50, 51, 400, 0, 120, 50]
    cache = WordHash()
    own = [word_ids([b"w%d" % rng.randrange(30) for _ in range(n)], cache) for n in sizes]
    together = passages.anchors_and_windows(np.concatenate(own), np.array(sizes))
    alone = [passages.anchors_and_windows(ids, np.array([len(ids)])) for ids in own]

    def rows(marks, row=None):
        return [tuple([row if row is not None else int(m[0]), *map(int, m[1:])]) for m in zip(*marks)]

    assert sorted(rows(together)) == sorted(x for i, marks in enumerate(alone) for x in rows(marks, i))
    assert {m[0] for m in rows(together)} == {i for i, n in enumerate(sizes) if n >= passages.WIDTH}
    row, _, at, first, count = together[:5]
    order = np.argsort(row, kind="stable")
    keys = passages.group_keys(np.concatenate(own), np.array(sizes), row[order], at[order], first[order], count[order])
    single = []
    for i, (ids, marks) in enumerate(zip(own, alone)):
        got = passages.group_keys(ids, np.array([len(ids)]), marks[0], *marks[2:5])
        single += [(i, *map(int, x)) for x in zip(*got[1:])]
    assert sorted(tuple(map(int, x)) for x in zip(*keys)) == sorted(single)
