"""Interleaved document sequences with media columns.

HTML is parsed into an ordered array of structs: text passages and references to media by digest,
with position and caption. Payloads lie in a content-addressed table, once per digest and task, as
8-bit grey PNG images (lossless); references are resolved by a join on the digest, so positions and
captions stay with their reference however often a payload is used. Only digests and features go
through the shuffle; payloads are written once to the shared folder and read back from there.

Defined cases: null html counts as empty and gives an empty sequence; null text gives 64 zero bytes.
A reference without a stored payload keeps null features. Captions are the figcaption of the
figure, before or after the media, else that of a figure around it, else the alt text, else null; a
figcaption without media or outside a figure is a text passage. A head ends with its end tag or where
the first thing stands that only a body can hold. Markup that is not closed ends with the element
around it, at the latest with the document. Repeated
rows give repeated references. An empty table gives an empty table. Payloads are whole, long ones
included; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, row_bytes, table, text_batches, written

WIDTH = 64
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
SILENT = {"script", "style", "template"}
HEAD = {"head", "html", "title", "base", "basefont", "bgsound", "link", "meta", "noscript", "noframes"}
HIDDEN = {"title", "noscript", "noframes"}  # their text is no content while they stand in a head
CONTAINERS = {"figure", "figcaption", "div", "main", "aside", "article", "section", "nav", "header", "footer", "blockquote", "ul", "ol", "li", "table", "tr", "td", "th", "body", "html"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "article", "section", "nav", "footer", "header", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "blockquote", "pre"}


class Interleaver(HTMLParser):
    """Collects passages and media references in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent, self.head, self.hidden, self.begun = 0, False, False, False
        self.open: list[str] = []  # containers, the outermost first
        self.figures: list[tuple[list[dict], list[tuple[dict, list[str]]]]] = []  # media, captions
        self.captions: list[list[str]] = []  # words of the open figcaptions

    def passage(self) -> None:
        if self.captions:
            self.captions[-1].append(" ")
        text = joined(self.words)
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_container(self) -> str:
        tag = self.open.pop()
        if tag == "figcaption":
            self.captions.pop()
        elif tag == "figure":
            media, captions = self.figures.pop()
            for item, words in captions:
                if not media:
                    item["text"] = joined(words)
            for item in media if captions else ():
                item["caption"] = joined([" ".join(["".join(words) for _, words in captions])])
            if not captions and self.figures:
                self.figures[-1][0].extend(media)
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "head":
            self.head = not self.begun
        elif tag not in HEAD and tag not in SILENT:
            self.head, self.hidden, self.begun = False, False, True
        if self.head and tag in HIDDEN:
            self.hidden = True
        if tag in SILENT:
            self.silent += 1
        elif tag in ("img", "audio", "video", "source") and (src := dict(attrs).get("src")):
            self.passage()
            self.items.append({"kind": "media", "text": None, "digest": src.removeprefix("sha256:"), "caption": dict(attrs).get("alt")})
            if self.figures:
                self.figures[-1][0].append(self.items[-1])
        elif tag == "figcaption" and self.figures:
            self.passage()
            self.items.append({"kind": "text", "text": "", "digest": None, "caption": None})  # filled if the figure has no media
            self.captions.append([])
            self.figures[-1][1].append((self.items[-1], self.captions[-1]))
        elif tag in BLOCKS or tag == "figcaption":
            self.passage()
            if tag == "figure":
                self.figures.append(([], []))
        if tag in CONTAINERS and (tag != "figcaption" or self.figures):
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head, self.hidden = False, False
        elif tag in HIDDEN:
            self.hidden = False
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS or tag in CONTAINERS:
            self.passage()
            while tag in self.open and self.end_container() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.silent or self.hidden:
            return
        if data.strip():
            self.head, self.begun = False, True
        (self.captions[-1] if self.captions else self.words).append(data)


def joined(words: list[str]) -> str:
    return " ".join("".join(words).split())


def interleave(html: str) -> list[dict]:
    parser = Interleaver()
    parser.feed(html)
    parser.close()
    parser.passage()
    while parser.open:
        parser.end_container()
    kept = [item for item in parser.items if item["kind"] == "media" or item["text"]]
    return [{"position": i, **item} for i, item in enumerate(kept)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and sequence of every page. The key may be a struct of columns that go with the page."""
    kind = dict(pages.dtypes)[key]
    arrow = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {key: batch.column(key), "sequence": pa.array([interleave(h or "") for h in batch.column("html").to_pylist()], arrow)}

    return mapped(pages.select(key, F.col(html).alias("html")), run, f"`{key}` {kind}, sequence {SEQUENCE}", "html")


def references(found: DataFrame) -> DataFrame:
    """One row per media reference, with its number among those of its page, position and caption."""
    keys = [c for c in found.columns if c != "sequence"]
    media = F.filter("sequence", lambda item: item["kind"] == "media")
    return found.select(*keys, F.posexplode(media).alias("reference", "item")).select(*keys, "reference", "item.position", "item.digest", "item.caption")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


CAPTION = 60


def article(text: Column, digest: Column) -> Column:
    """A text as a page: its lines as paragraphs, after the first one a figure that shows the payload
    with the beginning of that line as caption, and the payload once more at the end."""
    whole = F.coalesce(text, F.lit(""))
    first = F.substring_index(whole, "\n", 1)
    rest = F.substring(whole, F.length(first) + 2, F.length(whole))
    image = F.concat(F.lit('<img src="sha256:'), digest, F.lit('"'))
    figure = F.concat(F.lit("<figure>"), image, F.lit("><figcaption>"), escaped(F.left(first, F.lit(CAPTION))), F.lit("</figcaption></figure>"))
    paragraphs = lambda t: F.concat(F.lit("<p>"), F.replace(escaped(t), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return F.concat(F.lit("<article>"), paragraphs(first), figure, paragraphs(rest), image, F.lit(' alt="payload"></article>'))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A positive multiple of WIDTH bytes as an 8-bit grey image of that width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image made by to_png; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])[::-1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)[:, 1:]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest and media of every payload, written once per distinct text and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for start, stop in text_batches(batch, "text"):
                digests, media = [], []
                for raw in row_bytes(batch.slice(start, stop - start).column("text")):
                    payload = padded(raw)
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()  # a payload is then stored again, which changes nothing
                        seen.add(digest.digest())
                        digests.append(digest.hexdigest())
                        media.append(to_png(payload))
                if digests:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], names=["digest", "media"])

    return written(docs.select(F.col(text).alias("text")).mapInArrow(run, "digest string, media binary"), "media")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: bytes) -> tuple:
    samples = from_png(media)
    payload = samples.tobytes()
    flat = samples.reshape(-1)
    bins = np.bincount(flat >> 4, minlength=16)
    feature = f"grey8:{samples.shape[1]}x{samples.shape[0]}:sum={int(flat.sum(dtype=np.int64))}:bins={','.join(map(str, bins.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def features(stored: DataFrame) -> DataFrame:
    """One row per digest, computed from the stored bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = list(zip(*[describe(m) for m in batch.column("media").to_pylist()]))
        names = [x.split()[0] for x in FEATURES.split(", ")]
        yield dict(zip(names, [batch.column("digest"), *map(list, rows)]))

    made = mapped(stored, run, FEATURES, "media")
    return made.groupBy("digest").agg(*[F.min(c).alias(c) for c in made.columns if c != "digest"])


def resolve(found: DataFrame, described: DataFrame) -> DataFrame:
    """References with the columns of their payload."""
    return found.join(described, "digest", "left")


def payload_column(text: Column) -> Column:
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH).cast("int")) * WIDTH
    return F.call_function("rpad", raw, size, F.lit(b"\x00"))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """Each document as a page that its text is interleaved in: passages, a figure and a second
    reference, both of which show the text as payload. A document's row is that of its figure; position,
    caption, passages and references tell where the figure stands in the page's sequence."""
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(payload_column(F.col("text")), 256)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    pages = docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("page"), article(F.col("text"), digest).alias("html"))
    found = sequences(pages, "page")
    media = F.size(F.filter("sequence", lambda item: item["kind"] == "media"))
    counted = found.select(F.struct("page.doc_id", "page.n_bytes", (F.size("sequence") - media).alias("passages"), media.alias("references")).alias("page"), "sequence")
    described = written(features(store(docs)), "media-features")  # a plain side, so that a hot digest can be split
    whole = resolve(references(counted).where("reference = 0"), described)
    return whole.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "page.passages", "page.references")
