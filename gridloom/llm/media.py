"""Interleaved document sequences: HTML to ordered text and media references, payloads by digest.

A page is parsed into items in reading order: text items, and media items with a reference and the caption of their figure
(or their alt text). References that name a digest are joined with a media table on it; every item keeps its position, so
texts, media and captions stay aligned. Media are 8-bit grey PNG images, 192 samples wide, of any bytes.

Pages that are null or empty have no items. A reference without a payload keeps its item, with null payload columns. Equal
payloads are one entry of the media table, however many references share it. Null texts count as empty payloads, which are
padded to one row. Unclosed and stray tags are tolerated; text in script and style is dropped.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import column, map_batches, save, with_row_id

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Tags that end a run of text, and tags whose text isn't any.
BLOCKS = set("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = {"script", "style", "template", "noscript"}
MEDIA = {"img", "audio", "video", "source", "embed"}
REFERENCE = "media:sha256:"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.said: list[tuple[int, str]] = []

    def end_figure(self) -> None:
        """Give the captions to all media of the figure, or make them text items at their places where there are none."""
        self.end_caption()
        self.flush()
        if self.figure:
            for i in self.figure:
                self.items[i]["caption"] = " ".join(x for _, x in self.said) or self.items[i]["caption"]
        else:
            for at, x in reversed(self.said):
                self.items.insert(at, {"kind": "text", "text": x, "src": None, "caption": None})
        self.figure, self.said = None, []

    def end_caption(self) -> None:
        if self.caption is None:
            return
        said = " ".join("".join(self.caption).split())
        self.caption = None
        if said and self.figure is None:
            self.items.append({"kind": "text", "text": said, "src": None, "caption": None})
        elif said:
            self.said.append((len(self.items), said))

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA:
            self.flush()
            got = dict(attrs)
            if got.get("src"):
                self.items.append({"kind": "media", "text": None, "src": got["src"], "caption": " ".join((got.get("alt") or "").split()) or None})
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                if self.figure is not None:
                    self.end_figure()
                self.figure = []
            elif tag == "figcaption":
                self.end_caption()
                self.caption = []

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figure is not None:
                self.end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """Items of a page in order: position, kind (text or media), text, src, digest, caption."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.end_figure()
    return [{"position": i, **x, "digest": x["src"].removeprefix(REFERENCE) if x["src"] and x["src"].startswith(REFERENCE) else None} for i, x in enumerate(reader.items)]


ITEM = "position int, kind string, text string, src string, digest string, caption string"


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id_col and items, an array of structs, for each row of pages."""
    kind = pages.schema[id_col].dataType.simpleString()

    def make():
        return lambda batch: {id_col: batch.column(0), "items": [parse(x) for x in batch.column(1).to_pylist()]}

    return map_batches(pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`").cast("string")), make, f"`{id_col}` {kind}, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def resolve(items: DataFrame, media: DataFrame, digest_col: str = "digest") -> DataFrame:
    """items, one row each, with the other columns of media by digest; media has one row for each digest. Items without a digest aren't shuffled to one task: their key is their own hash."""
    keyed = items.withColumn("_key", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64(*items.columns).cast("string"))))
    return keyed.join(media.withColumnRenamed(digest_col, "_key"), "_key", "left").drop("_key")


def interleaved(pages: DataFrame, media: DataFrame, id_col: str, html_col: str = "html", row_col: str | None = None) -> DataFrame:
    """id_col and items for each row of pages: its sequence of texts and media in order, each media item with the columns of media for its digest (null where there are none).

    Rows of pages may repeat an id; each has a sequence of its own. A page's items are all that meets in one task. Sequences are
    saved with a row id, unless row_col names a distinct long of saved pages; then they are parsed twice.
    """
    if row_col is None:
        parsed = save(with_row_id(sequences(pages, id_col, html_col), "row"), "sequences")
    else:
        both = pages.select(F.struct(column(row_col).alias("row"), column(id_col).alias("id")).alias("both"), column(html_col).alias("html"))
        parsed = sequences(both, "both").select(F.col("both.id").alias(id_col), "items", F.col("both.row").alias("row"))
    each = parsed.select("row", F.explode("items").alias("item"))
    wanted = each.where("item.kind = 'media'").select("row", "item.position", "item.digest")
    facts = [c for c in media.columns if c != "digest"]
    found = resolve(wanted, media).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*facts)))).alias("facts"))
    names = [x.split(" ")[0] for x in ITEM.split(", ")]
    whole = F.transform("items", lambda x: F.struct(*[x[n].alias(n) for n in names], F.try_element_at(F.col("facts"), x["position"]).alias("media")))
    return parsed.join(found, "row", "left").select(column(id_col), whole.alias("items"))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text with spaces up to a positive multiple of the width; and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH or (WIDTH if not raw else 0)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image of the payload, whose length is a multiple of the width; every sample is a byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that to_png made; checks every chunk."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, inside = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(inside, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        head = struct.unpack(">IIBBBBB", inside) if kind == b"IHDR" else head
        body += inside if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey 8-bit image")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(head[1], head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 16-bin histogram in thousandths."""
    flat = samples.reshape(-1)
    bins = np.bincount(flat >> 4, minlength=16)
    return f"{samples.shape[1]}x{samples.shape[0]};{flat.mean():.4f};{flat.std():.4f};" + ",".join(str(int(x)) for x in bins * 1000 // len(flat))


def preview_of(payload: bytes) -> bytes:
    """The first row of samples."""
    return payload[:WIDTH]


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Saved: row, key (id and n_bytes), html (a page that shows the text's image with a caption between two paragraphs, and a preview after them), and media, an array of the images with their digests."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(batch):
            out: dict[str, list] = {"key": [], "html": [], "media": []}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, n = payload_of(text)
                images = {hashlib.sha256(x).hexdigest(): x for x in (payload, preview_of(payload))}
                digest, small = hashlib.sha256(payload).hexdigest(), hashlib.sha256(preview_of(payload)).hexdigest()
                caption = html.escape(f"document {name} & {n} bytes")
                shown = f'<figure><img src="{REFERENCE}{digest}" alt=""><figcaption>{caption}</figcaption></figure>'
                out["html"].append(f'<html><body><p>Before {name}</p>{shown}<p>After {name}</p><img src="{REFERENCE}{small}" alt="preview"></body></html>')
                out["media"].append([{"digest": k, "media": to_png(x)} for k, x in images.items()])
                out["key"].append({"id": name, "n_bytes": n})
            return out

        return one

    rows = map_batches(docs.select(column(id_col), column(text_col).cast("string")), make, f"key struct<id:{kind},n_bytes:bigint>, html string, media array<struct<digest:string,media:binary>>")
    return save(with_row_id(rows, "row"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """media: digest and media. One row for each digest, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; digests as bytes."""

    def make():
        def one(batch):
            out: dict[str, list] = {"digest": batch.column(0), **{c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}}
            for data in batch.column(1).to_pylist():
                samples = from_png(data)
                payload = samples.tobytes()
                for c, x in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).digest()), ("tail_crc32", zlib.crc32(payload[-16:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).digest()), ("feature", features(samples))):
                    out[c].append(x)
            return out

        return one

    read = map_batches(media.select("digest", "media"), make, "digest string, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string")
    return read.groupBy("digest").agg(*[F.first(c).alias(c) for c in read.columns if c != "digest"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's image by way of its page: the page's sequence is read, its references are joined by digest with what the stored images hold, and the figure of the sequence is the document's.

    sequence is the page's whole sequence as JSON: position, kind, text, digest, caption and the media columns of every item.
    """
    stored = as_pages(docs, id_col, text_col)
    facts = read_back(stored.select(F.inline("media")))
    columns = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    written = lambda m: F.when(m.isNotNull(), F.struct(*[(F.lower(F.hex(m[c])) if c.endswith("sha256") else m[c]).alias(c) for c in columns]))
    items = interleaved(stored, facts, "key", row_col="row").select("key", F.transform("items", lambda x: x.withField("media", written(x["media"]))).alias("items"))
    items = items.withColumn("item", F.filter("items", lambda x: (x["kind"] == "media") & x["caption"].startswith("document "))[0])
    m = F.col("item.media")
    return items.select(F.col("key.id").alias(id_col), F.col("key.n_bytes").alias("n_bytes"), *[m[c].alias(c) for c in columns], "item.position", "item.caption", F.size("items").cast("long").alias("n_items"), F.to_json("items").alias("sequence"))
