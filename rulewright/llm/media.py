"""Media columns: interleaved document sequences.

HTML is parsed into an ordered list of structs, text and media references, each with its position; a figure's caption stays
with its reference. References name a payload by its digest; the payloads are rows of a store (PNG images of 8-bit grey
samples, which hold any bytes without loss), and a join on the digest resolves them. What a query needs of a payload is worked
out on the store's side first, so the join moves that and not the payloads, and one hot digest is one row of it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH = 64
PREFIX = "media:"
#: The format's signature, and elements that part one run of text from the next.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, length: int, level: int = 6) -> bytes:
    """A grey image 64 samples wide of a payload (a positive multiple of 64 bytes); length is told in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"Length\0%d" % length) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[bytes, int]:
    """The payload of an image that to_png() made, and the length it tells."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, length, height = 8, [], None, 0
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    payload = rows[:, 1:].tobytes()
    return payload, len(payload) if length is None else length


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.silent = 0

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if self.caption is None and (tag in BLOCKS or tag in MEDIA):
            self.flush()
        a = dict(attrs)
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA and a.get("src"):
            src = a["src"]
            digest = src[len(PREFIX) :] if src.startswith(PREFIX) else None
            self.items.append({"position": len(self.items), "kind": "media", "text": src, "digest": digest, "caption": a.get("alt") or a.get("title")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = "".join(self.caption), None
            own = [x for x in self.items[self.figure or 0 :] if x["kind"] == "media"]
            if own:
                own[-1]["caption"] = caption
            else:
                self.text.append(caption)
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered text and media references of a page; blank runs of text are left out."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    if p.caption:
        p.text += p.caption
    p.flush()
    return p.items


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    for b in batches:
        for a in range(0, len(b), 256):
            part = b.slice(a, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sequence(x.as_py()) for x in part.column(1)], kind)], names=["id", "items"])


def parse_sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items): every page's ordered list of (position, kind, text, digest, caption).

    kind is ``text`` or ``media``; digest is set for references of the form media:DIGEST. Null and empty html give empty lists;
    damaged html is read as far as it goes. Repeated rows give equal rows; other columns are ignored.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return base.mapInArrow(_parse, f"id {dict(base.dtypes)['id']}, items {SEQUENCE}")


def _encode(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), 512):
            part = b.slice(a, 512)
            media = [to_png(padded(x), len(x), level) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["digest", "media"])


def media_store(payloads: DataFrame, level: int = 6) -> DataFrame:
    """A stored table (digest, media) of (digest, payload) rows. Rows of one digest are alike, so any of them can stand for it."""
    return stored(payloads.select("digest", F.col("payload").cast("binary")).mapInArrow(partial(_encode, level=level), "digest string, media binary"))


def describe(media: bytes, digest: str) -> dict:
    """What op7 tells of one stored payload; the bytes that are read back must have the digest they are stored under."""
    payload, n = from_png(media)
    if hashlib.sha256(memoryview(payload)[:n]).hexdigest() != digest:
        raise ValueError("payload and digest differ")
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / len(x)
    feature = f"{WIDTH}x{len(x) // WIDTH} mean={x.mean():.4f} entropy={-(p * np.log2(p)).sum():.4f} values={len(p)}"
    return {"n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _project(batches: Iterator[pa.RecordBatch], function: Callable, names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), 512):
            part = b.slice(a, 512)
            rows = [function(m, d) for d, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)]], names=["digest", *names])


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}


def resolve(sequences: DataFrame, store: DataFrame, function: Callable | None = None, schema: str = "media binary") -> DataFrame:
    """(id, position, caption, digest, ...) of every media reference, with what ``function`` makes of its stored payload.

    Without a function the stored bytes themselves are joined. References without a payload in the store stay, with nulls; so do
    those of a null digest. Payloads of one digest count once. What a function makes is written first, so that the references to a
    digest of very many can be split.
    """
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    if function:
        store = store.mapInArrow(partial(_project, function=function, names=list(names), kinds=[_ARROW[k] for k in kinds]), f"digest string, {schema}")
    refs = sequences.select("id", F.explode("items").alias("i")).where("i.kind = 'media'").select("id", "i.position", "i.caption", "i.digest")
    once = store.dropDuplicates(["digest"])
    return refs.join(stored(once) if function else once, "digest", "left")


def page_of(text: Column, digest: Column) -> Column:
    """A page that shows a text and, behind it, its payload as a figure."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<article><p>"), safe, F.lit('</p><figure><img src="' + PREFIX), digest, F.lit('"><figcaption>payload '), digest, F.lit("</figcaption></figure></article>"))


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """The payload of every document as it is read back from the store. Null and empty texts are 64 bytes 0; repeated rows and equal
    texts give equal rows; an empty table none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    store = media_store(docs.select("digest", F.col("text").cast("binary").alias("payload")))
    pages = docs.select("doc_id", page_of(F.col("text"), F.col("digest")).alias("html"))
    out = resolve(parse_sequences(pages, "doc_id", "html"), store, describe, DESCRIBED)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
