"""Toxicity by multiple-instance learning: a document is a bag of sentences and only bags have labels.

A sentence's probability is a logistic model of its words and the letter groups inside them; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Features are screened by how unevenly they occur in documents of either label, the weights are trained on
document labels alone, and the sentence probabilities then locate the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import CACHE_LIMIT, arrow_lists, checkpoint, map_batches, mix, split_by_hash, whole_rows, with_row

#: Most labelled documents that the fit reads (a sample by hash; each label is drawn up to half of it).
SAMPLE = 6000
#: Least documents of a feature and least z-score of their counts; all features that reach them are weighted.
LEAST_DOCUMENTS = 5
LEAST_Z = 5.0
DIMS = 1 << 20
#: Words whose features are computed at a time.
PIECE = 5_000
_END = regex.compile(rb"(?<=[.!?])[ \x09-\x0D]+|[\x0A\x0D]+")
_EDGE = b".,;:!?\"'()[]{}<>|*#%$&-_/\\=+~`"


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, positions in ``words``): every word and all letter groups of 4 to 7 bytes in it, as often as they occur."""
    marked = [b"^" + w + b"$" if w else b"" for w in (x.strip(_EDGE) for x in words)]
    sizes = np.array([len(m) for m in marked], np.int64)
    letters = np.frombuffer(b"".join(marked) + bytes(8), np.uint8).astype(np.uint64)
    n = len(letters) - 8
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes from here to the word's end
    whole = np.flatnonzero(sizes)
    buckets, owners = [np.array([xxhash.xxh32_intdigest(marked[i]) % DIMS for i in whole], np.int64)], [whole]
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for size in range(1, 8):
            h = h * np.uint64(0x9E3779B97F4A7C15) + letters[size - 1 : size - 1 + n] + np.uint64(1)
            if size >= 4:
                at = np.flatnonzero(left >= size)
                buckets.append((mix(h[at]) & np.uint64(DIMS - 1)).astype(np.int64))
                owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


class WordCache(dict):
    """word -> what ``_values`` makes of its features, kept for words seen lately."""

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all of ``words`` are there, pieces of bounded size at a time."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_LIMIT:
            self.clear()
            new = list(words)
        for at in range(0, len(new), PIECE):
            piece = new[at : at + PIECE]
            self.update(zip(piece, self._values(len(piece), *word_features(piece))))


class Buckets(WordCache):
    """word -> its features' positions among ``chosen``."""

    def __init__(self, chosen: dict[int, int]):
        super().__init__()
        self.places = np.full(DIMS, -1, np.int64)
        self.places[list(chosen.keys())] = list(chosen.values())

    def _values(self, n: int, buckets: np.ndarray, owners: np.ndarray) -> list[list[int]]:
        place = self.places[buckets]
        out: list[list[int]] = [[] for _ in range(n)]
        for i in np.flatnonzero(place >= 0):
            out[owners[i]].append(int(place[i]))
        return out


class WordWeights(WordCache):
    """word -> the sum of its features' weights."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.table = np.zeros(DIMS)
        self.table[list(weights.keys())] = list(weights.values())

    def _values(self, n: int, buckets: np.ndarray, owners: np.ndarray) -> list[float]:
        return np.bincount(owners, weights=self.table[buckets], minlength=n).tolist()


def sentences(text: bytes) -> list[bytes]:
    return [s for s in _END.split(text) if s.strip()]


def bag(text: bytes, buckets: Buckets) -> tuple[list[int], list[int]]:
    """(chosen features of every sentence in order, number of them in each sentence)."""
    flat: list[int] = []
    sizes: list[int] = []
    parts = [s.lower().split() for s in sentences(text)]
    buckets.learn({w for words in parts for w in words})
    for words in parts:
        n = len(flat)
        for w in words:
            flat += buckets[w]
        sizes.append(len(flat) - n)
    return flat, sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, some of which may be empty."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends] - total[ends - sizes]


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(logit)), summed as logarithms; an empty bag gives 0."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


class SentenceModel:
    """Logistic sentence weights trained through the noisy-or of their documents."""

    def __init__(self, weights: dict[int, float], bias: float, threshold: float):
        self.weights, self.bias, self.threshold = weights, bias, threshold

    def calibrated(self, p: float) -> float:
        """The probability moved so that the trained threshold sits at one half."""
        t = self.threshold
        return 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / max(1 - t, 1e-9)

    def score(self, text: bytes, words: WordWeights) -> tuple[float, np.ndarray]:
        parts = [s.lower().split() for s in sentences(text)]
        words.learn({w for own in parts for w in own})
        logits = np.array([sum(map(words.__getitem__, own)) for own in parts]) + self.bias
        return min(1.0, max(0.0, self.calibrated(noisy_or(logits)))), 1 / (1 + np.exp(-np.clip(logits, -50, 50)))

    @classmethod
    def fit(cls, features: list[int], bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float, rounds: int = 300, rate: float = 0.1, l2: float = 1e-3):
        """Full-batch Adam on the documents' log loss, both labels weighing the same; the threshold is set at the labels' own ``share``."""
        if not len(y) or y.min() == y.max():
            return cls({}, 20.0 if len(y) and y.max() else -20.0, 0.5)
        keep = [i for i, (_, s) in enumerate(bags) if len(s)]
        bags, y = [bags[i] for i in keep], y[keep]
        ids = np.concatenate([b for b, _ in bags]).astype(np.int64)
        sizes = np.concatenate([s for _, s in bags]).astype(np.int64)
        n_sent = np.array([len(s) for _, s in bags])
        doc_starts = np.concatenate([[0], np.cumsum(n_sent)[:-1]])
        sentence_of = np.repeat(np.arange(len(sizes)), sizes)
        doc_of = np.repeat(np.arange(len(bags)), n_sent)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        k = len(features)
        w, moment, spread = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
        w[k] = -4.0
        for t in range(1, rounds + 1):
            z = _sums(w[ids], sizes) + w[k]
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            clean = np.exp(-np.add.reduceat(np.logaddexp(0, z), doc_starts))
            # d loss / d z: clean documents add p, toxic ones take p * clean / (1 - clean)
            gz = (np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * weight)[doc_of] * p
            g = np.append(np.bincount(ids, weights=gz[sentence_of], minlength=k) + l2 * w[:k], gz.sum())
            moment = 0.9 * moment + 0.1 * g
            spread = 0.999 * spread + 0.001 * g * g
            w -= rate * (moment / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
        p = -np.expm1(-np.add.reduceat(np.logaddexp(0, _sums(w[ids], sizes) + w[k]), doc_starts))
        return cls(dict(zip(features, w[:k].tolist())), float(w[k]), _threshold(p, y, share))


def _threshold(p: np.ndarray, y: np.ndarray, share: float) -> float:
    """The cut with the fewest errors at the labels' own share of toxic rows, midway in its gap."""
    order = np.argsort(p)
    p, y = p[order], y[order]
    pos, neg = share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1)
    below = np.concatenate([[0.0], np.cumsum(np.where(y == 1, pos, 0.0))])
    above = np.concatenate([np.cumsum(np.where(y == 0, neg, 0.0)[::-1])[::-1], [0.0]])
    at = int(np.argmin(below + above))
    low, high = (p[at - 1] if at else 0.0), (p[at] if at < len(p) else 1.0)
    return float(min(max((low + high) / 2, 1e-6), 1 - 1e-6))


def _document_counts(batches):
    """Toxic and clean documents of each feature, added up over a task's rows."""
    counts = np.zeros((2, DIMS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("toxic").to_pylist()):
            words = list(set((text or b"").lower().split()))
            parts = [np.unique(word_features(words[i : i + PIECE])[0]) for i in range(0, len(words), PIECE)]
            counts[int(toxic == 1), np.unique(np.concatenate(parts)) if parts else []] += 1
    at = np.flatnonzero(counts.sum(axis=0) > 0)
    yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int64()), "toxic": pa.array(counts[1, at], pa.int64()), "clean": pa.array(counts[0, at], pa.int64())})


def screen(rows: DataFrame, n_toxic: int, n_clean: int) -> list[int]:
    """Features whose document counts differ between the labels by ``LEAST_Z`` standard errors; there are at most DIMS."""
    counts = rows.mapInArrow(_document_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    pooled = (F.col("t") + F.col("c")) / float(n_toxic + n_clean)
    z = (F.col("t") / n_toxic - F.col("c") / n_clean) / F.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    found = counts.where(F.col("t") + F.col("c") >= LEAST_DOCUMENTS).where(F.abs(z) >= LEAST_Z).select("feature").toArrow()
    return sorted(found.column("feature").to_pylist())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> SentenceModel:
    """Train on a bounded sample of labelled rows for which ``learn`` (over doc_id) holds; repeated labels count once."""
    marked = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.where(draw < F.when(F.col("toxic") == 1, sample / 2 / max(counts.get(1, 0), 1)).otherwise(sample / 2 / max(counts.get(0, 0), 1)))
    # at most about ``sample`` ids, so they are sent to the documents instead of the documents to them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # rows that repeat a doc_id are drawn together; the limit holds them in every task before the shuffle
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    texts = checkpoint(rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).select("doc_id", "text", "toxic"))
    drawn = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not drawn.get(0) or not drawn.get(1):
        return SentenceModel.fit([], [], np.array(sorted(drawn)), 0.0)
    features = screen(texts, drawn[1], drawn[0])
    place = {f: i for i, f in enumerate(features)}

    def bags_of(batch: pa.RecordBatch, buckets: Buckets) -> dict:
        bags = [bag(x or b"", buckets) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "ids": [i for i, _ in bags], "sizes": [n for _, n in bags]}

    found = map_batches(texts, bags_of, "doc_id long, toxic int, ids array<int>, sizes array<int>", setup=lambda: Buckets(place)).toArrow()
    doc_ids, toxic = found.column("doc_id").to_pylist(), found.column("toxic").to_pylist()
    ids, sizes = arrow_lists(found, "ids"), arrow_lists(found, "sizes")
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i], ids[i].tobytes()))
    bags = [(ids[i], sizes[i]) for i in order]
    return SentenceModel.fit(features, bags, np.array([toxic[i] for i in order]), counts.get(1, 0) / max(sum(counts.values()), 1))


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """(row, score, offending): every row as it is in the struct ``row``, and the offending sentences (position and probability of those at 0.5 or more)."""
    rows = whole_rows(docs)

    def run(batch: pa.RecordBatch, words: WordWeights) -> dict:
        scores, spots = [], []
        for text in batch.column("row").field("text").cast(pa.binary()).to_pylist():
            s, p = model.score(text or b"", words)
            scores.append(s)
            spots.append([{"sentence": int(i), "p": float(p[i])} for i in np.flatnonzero(p >= 0.5)])
        return {"row": batch.column("row"), "score": scores, "offending": spots}

    return map_batches(rows, run, with_row(rows, "score double, offending array<struct<sentence:int,p:double>>"), setup=lambda: WordWeights(model.weights))


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) of every row.

    Labels of rows with crc32(doc_id) mod 5 = 0 are never read. A null or empty text is a bag without sentences: score 0. Without labels,
    or with labels of one kind, every score is that kind's. Repeated rows stay, an empty table gives no rows, other columns are ignored.
    """
    held_out = F.coalesce(split_by_hash("doc_id", 5) == 0, F.lit(False))
    found = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels, ~held_out, sample)).select("row.doc_id", "score", "offending")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
