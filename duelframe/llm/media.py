"""Media columns: interleaved document sequences with digest-addressed payloads.

A page is HTML whose media elements name their payload by digest. Parsing gives an ordered array of structs (position, kind, text, ref,
caption) in which a caption stays on its media element. The media table holds one stored form per digest (8-bit
mono PCM in a RIFF container, lossless); features are read from the stored bytes once per digest and joined back to every reference.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import map_batches, salted_join, with_row

UNIT = 64
RATE = 8000
_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_SKIP = {"script", "style", "template", "noscript"}
_MEDIA = {"img", "audio", "video", "source"}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "tr", "td", "table", "nav", "figure", "figcaption", "blockquote", "pre", "body", "title", "head", "html"}


def pack(payload: bytes) -> bytes:
    """The payload as samples of a RIFF/WAVE file: 8 bits, one channel."""
    n = len(payload)
    return _HEAD.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def unpack(stored: bytes) -> bytes:
    """Samples of a stored form, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE payload")
    at = 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: Column, unit: int = UNIT) -> Column:
    """UTF-8 bytes of a text (null: empty) with zero bytes up to a positive multiple of ``unit``."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    n = F.octet_length(raw)
    pad = F.when(n == 0, unit).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(raw.cast("binary"), F.unhex(F.repeat(F.lit("00"), pad.cast("int"))))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = self.caption = 0
        self.media: dict | None = None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.caption and self.media is not None:
            self.media["caption"] = text if not self.media["caption"] else f"{self.media['caption']} {text}"
        else:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCK or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.media = None
        elif tag == "figcaption":
            self.caption += 1
        elif tag in _MEDIA and (src := dict(attrs).get("src")):
            self.media = {"kind": "media", "text": None, "ref": src.removeprefix("sha256:"), "caption": dict(attrs).get("alt") or None}
            self.items.append(self.media)

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag in _BLOCK:
            self.flush()
        if tag == "figcaption" and self.caption:
            self.caption -= 1
        elif tag == "figure":
            self.media = None

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered items of one page; null or empty html has none, unclosed and stray tags are read as far as they go."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return [{"position": i, **item} for i, item in enumerate(page.items)]


def interleave(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, items): the sequence of each page; columns of ``pages`` other than the html stay."""
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row"), F.col(html_col).alias("html"))
    found = map_batches(kept, lambda b: {"row": b.column("row"), "items": [sequence(x) for x in b.column("html").to_pylist()]}, with_row(kept, f"items {SEQUENCE}"))
    return found.select("row.*", "items")


def references(sequences: DataFrame, *ids: str) -> DataFrame:
    """(ids, position, ref, caption): media references of each sequence, in place."""
    return sequences.select(*ids, F.explode("items").alias("item")).where("item.kind = 'media'").select(*ids, "item.position", "item.ref", "item.caption")


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media): one stored form per distinct ``payload``, addressed by the payload's SHA-256."""
    def packed_batch(batch: pa.RecordBatch) -> dict:
        rows = batch.column("payload").to_pylist()
        return {"digest": [hashlib.sha256(x).hexdigest() for x in rows], "media": [pack(x) for x in rows]}

    packed = map_batches(payloads.select("payload"), packed_batch, "digest string, media binary")
    return packed.groupBy("digest").agg(F.first("media").alias("media"))


def _features(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
    for stored in batch.column("media").to_pylist():
        payload = unpack(stored)
        samples = np.frombuffer(payload, np.uint8)
        bins = np.bincount(samples >> 5, minlength=8)
        out["payload_bytes"].append(len(payload))
        out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
        out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
        out["media_bytes"].append(len(stored))
        out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
        out["feature"].append(f"sum={int(samples.sum(dtype=np.int64))};turns={int(np.count_nonzero(np.diff(samples)))};hist={','.join(map(str, bins))}")
    return out | {"digest": batch.column("digest")}


def features(media: DataFrame) -> DataFrame:
    """Features of the stored bytes as they are read back, one row per digest."""
    return map_batches(
        media,
        _features,
        "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def resolve(refs: DataFrame, by_digest: DataFrame) -> DataFrame:
    """References joined to their media rows; references without a stored payload keep nulls. Hot digests are salted."""
    return salted_join(refs, by_digest.withColumnRenamed("digest", "ref"), "ref")


def escaped(text: Column) -> Column:
    """Text as HTML data."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html): a page per document, its text as a paragraph and then a figure that names the document's payload, with the source as caption."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
        F.concat(
            F.lit("<article><p>"), escaped(text), F.lit('</p><figure><img src="sha256:'), F.sha2(padded(F.col("text")), 256),
            F.lit('"><figcaption>'), escaped(source), F.lit("</figcaption></figure></article>"),
        ).alias("html"),
    )


def document_media(docs: DataFrame) -> DataFrame:
    """The media features of every document's text, through an interleaved page per document.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null text counts
    as empty, an empty one as 64 zero bytes. Equal texts share one stored form, so all their values agree. Repeated rows
    stay; an empty table gives no rows; other columns are ignored.
    """
    refs = references(interleave(document_pages(docs), "doc_id"), "doc_id", "n_bytes")
    stored = features(store(docs.select(padded(F.col("text")).alias("payload"))))
    return resolve(refs.select("doc_id", "n_bytes", "ref"), stored).drop("ref")
