"""Language identification in two steps: family first, then one-versus-one linear support vector machines within it.

Texts become normalised counts of hashed byte 1- to 4-grams of their lower-cased letters in UTF-8. A linear machine per pair of families votes for the
family; the pairwise machines of that family's languages vote for the language. Machines are fitted here, on a bounded
sample of labelled rows, by dual coordinate descent of the squared hinge loss.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import arrow_lists, map_batches, split_by_hash, whole_rows, with_row

#: Most rows per language that the fit reads (a sample by hash, whatever the table's size); it also bounds what reaches the driver.
SAMPLE_PER_LANGUAGE = 400
DIMS = 1 << 13
UNKNOWN = "und"
# Families of language codes; a code without an entry is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ur", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def letters(text: str) -> bytes | None:
    """Lower-cased letters with one blank for every gap, as UTF-8; None without letters."""
    words = _GAP.sub(" ", text).strip()
    return f" {words.lower()} ".encode() if words else None


def gram_counts(raw: bytes, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): hashed byte 1-, 2-, 3- and 4-gram counts, square-rooted and scaled to length 1."""
    total = np.zeros(dims, np.float64)
    step = 1 << 20
    for at in range(0, len(raw), step):
        b = np.frombuffer(raw[at : at + step + 3], np.uint8).astype(np.uint32)
        gram = b.copy()
        for k in range(4):
            if k:
                gram = (gram[:-1] << np.uint32(8)) | b[k:]
            if len(gram):
                h = (gram * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - int(dims).bit_length() + 1)
                total += np.bincount(h, minlength=dims)
    at = np.flatnonzero(total)
    values = np.sqrt(total[at])
    return at.astype(np.int32), (values / np.linalg.norm(values)).astype(np.float32)


Rows = list[tuple[np.ndarray, np.ndarray]]


def fit_machine(x: Rows, y: np.ndarray, dims: int = DIMS, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear machine for y in {-1, 1}: squared hinge loss, dual coordinate descent over sparse rows."""
    w, alpha = np.zeros(dims + 1), np.zeros(len(x))
    diagonal = [float(v @ v) + 1 + 1 / (2 * cost) for _, v in x]
    rnd = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rnd.permutation(len(x)):
            at, values = x[i]
            gradient = y[i] * (w[at] @ values + w[dims]) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * values
                w[dims] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Discriminator:
    """Families' and languages' one-versus-one machines."""

    def __init__(self, langs: list[str], x: Rows, y: np.ndarray):
        self.families = {f: [l for l in langs if family(l) == f] for f in sorted({family(l) for l in langs})}
        of = np.array([family(l) for l in y]) if len(y) else np.array([], object)
        self.machines = {("", a, b): self._fit(x, of, a, b) for a, b in combinations(self.families, 2)}
        for f, members in self.families.items():
            self.machines |= {(f, a, b): self._fit(x, y, a, b) for a, b in combinations(members, 2)}

    @staticmethod
    def _fit(x: Rows, y: np.ndarray, a: str, b: str) -> np.ndarray:
        rows = np.flatnonzero((y == a) | (y == b))
        return fit_machine([x[i] for i in rows], np.where(y[rows] == a, 1.0, -1.0)).astype(np.float32)

    def _vote(self, level: str, members: list[str], at: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        """The member with most wins, ties to the larger sum of margins, and its mean probability against the others."""
        if len(members) == 1:
            return members[0], 1.0
        tally = {m: [0, 0.0, 0.0] for m in members}
        for a, b in combinations(members, 2):
            w = self.machines[level, a, b]
            margin = float(w[at] @ values + w[-1])
            p = 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
            for m, won, s, q in ((a, margin >= 0, margin, p), (b, margin < 0, -margin, 1 - p)):
                tally[m] = [tally[m][0] + won, tally[m][1] + s, tally[m][2] + q]
        best = max(members, key=lambda m: (tally[m][0], tally[m][1]))
        return best, tally[best][2] / (len(members) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        raw = letters(text) if text else None
        if raw is None or not self.families:
            return UNKNOWN, 0.0
        at, values = gram_counts(raw)
        f, p = self._vote("", list(self.families), at, values)
        lang, q = self._vote(f, self.families[f], at, values)
        return lang, float(min(1.0, max(0.0, p * q)))


def training_rows(docs: DataFrame, held_out: Column, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled rows of each language, those whose hash of doc_id and text is smallest; repeated rows add nothing beyond that."""
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    few = labelled.select("lang", "text", draw.alias("draw")).join(F.broadcast(counts), "lang").where(F.col("draw") < 1.5 * per_language / F.col("n"))
    # the limit applies in every task before the shuffle, so not even a row repeated without end is gathered
    return few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("at") <= per_language).select("lang", "text")


def _grams(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"lang": [], "at": [], "values": []}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        raw = letters(text)
        at, values = gram_counts(raw) if raw else (np.zeros(0, np.int32), np.zeros(0, np.float32))
        out["lang"].append(lang)
        out["at"].append(at.astype(np.int16))
        out["values"].append(values)
    return out


def fit(docs: DataFrame, held_out: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Discriminator:
    """Learn from text and lang of rows outside ``held_out``; a sample of a bounded number of rows reaches the driver as sparse feature vectors."""
    found = map_batches(training_rows(docs, held_out, per_language), _grams, "lang string, at array<smallint>, values array<float>").toArrow()
    langs, at, values = found.column("lang").to_pylist(), arrow_lists(found, "at"), arrow_lists(found, "values")
    # the order of rows decides the last digits of the fit, so it is made independent of partitioning
    order = sorted((i for i in range(len(langs)) if len(at[i])), key=lambda i: (langs[i], at[i][:32].tobytes(), values[i][:32].tobytes()))
    y = np.array([langs[i] for i in order], object)
    return Discriminator(sorted(set(y)), [(at[i], values[i]) for i in order], y)


def predict(docs: DataFrame, model: Discriminator) -> DataFrame:
    """(row, lang_pred, score): every row as it is in the struct ``row``. Null texts and texts without a letter are ``und`` with score 0."""
    rows = whole_rows(docs)

    def run(batch: pa.RecordBatch) -> dict:
        found = [model.predict(x) for x in batch.column("row").field("text").to_pylist()]
        return {"row": batch.column("row"), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_batches(rows, run, with_row(rows, "lang_pred string, score double"))


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Rows with crc32(doc_id) mod 3 = 1 are held out of the fit. lang, source and doc_id never enter a prediction. With no labelled row
    to learn from, every prediction is ``und``. Repeated rows stay, an empty table gives no rows, other columns are ignored whatever their names.
    """
    held_out = F.coalesce(split_by_hash("doc_id", 3) == 1, F.lit(False))
    found = predict(docs.select("doc_id", "text"), fit(docs, held_out, per_language)).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows whose text has an identifiable language, with all their columns, whatever their names; rows predicted ``und`` go."""
    held_out = F.coalesce(split_by_hash("doc_id", 3) == 1, F.lit(False))
    return predict(docs, fit(docs, held_out, per_language)).where(F.col("lang_pred") != UNKNOWN).select("row.*")
