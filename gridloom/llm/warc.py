"""WARC archives with revisit resolution.

Captures are written as response records, one gzip member each, into archives of bounded size. Resolution reads their headers
only, shuffles them by payload digest, takes the capture with the largest page id as the original of each digest, and joins
the others to it; then each archive is written anew with fresh headers: originals as responses, the others as revisits
without a payload. An archive is a row (archive, content) of a table, so Spark commits it, any executor can read it, and a
lost one is made again; export() writes rows out as .warc.gz files.

A null html counts as an empty payload; a null page id sorts below all others and is read back as null; of captures with the
same id and payload the later record is the original. Payloads below min_payload bytes are all responses. Line breaks,
spaces and characters outside ASCII in a URL are percent-encoded in its header. Empty tables make no archives.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import map_batches, save, slices

#: An archive is closed after so many bytes of payload or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 4 << 20, 1024
#: Bytes of an archive that are unpacked at once.
STEP = 16 << 10
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(generation: str, archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{generation}/{archive}/{place}')}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A gzip member with one record; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def response(name: str, page: int | None, url: str, payload: bytes, digest: str) -> bytes:
    return record([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page)], http(len(payload)) + payload)


def revisit(name: str, page: int | None, url: str, size: int, digest: str, original: str, original_page: int | None, original_url: str) -> bytes:
    return record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Profile", PROFILE), ("WARC-Refers-To", original), ("WARC-Refers-To-Target-URI", original_url), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", original_page), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page)], http(size))


def records(content: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Headers, HTTP headers and payload of each record of an archive. It is stepped through by offset: what follows a record is never copied whole."""
    whole, at = memoryview(content), 0
    while at < len(whole):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            step = whole[at : at + STEP]
            if not step:
                raise ValueError("an archive ends inside a record")
            parts.append(unpacker.decompress(step))
            at += len(step) - len(unpacker.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(fields["Content-Length"])]
        if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a WARC/1.1 record")
        web, _, payload = block.partition(b"\r\n\r\n")
        yield fields, dict(x.split(": ", 1) for x in web.decode().split("\r\n")[1:]), payload


ARCHIVE = "archive string, content binary"


def write_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Saved archives with a response for each row of pages."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, content, size, place = TaskContext.get().partitionId(), 0, [], 0, 0
        closed = lambda: pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{count:06d}"], "content": [b"".join(content)]})
        for batch in slices(batches):
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                content.append(response(record_id("capture", f"{part:06d}-{count:06d}", place), page, quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._"), payload, payload_digest(payload)))
                size, place = size + len(payload), place + 1
                if size >= ARCHIVE_BYTES or place >= ARCHIVE_RECORDS:
                    yield closed()
                    count, content, size, place = count + 1, [], 0, 0
        if content:
            yield closed()

    return save(rows.mapInArrow(run, ARCHIVE), "captures", "uncompressed")


def _page(fields: dict[str, str], key: str = "Page-Id") -> int | None:
    return int(fields[key]) if key in fields else None


def headers(archives: DataFrame) -> DataFrame:
    """archive, place, page_id, url, payload_bytes, digest of each record; payloads aren't kept."""
    kinds = "archive string, place int, page_id bigint, url string, payload_bytes bigint, digest string"

    def make():
        def one(batch):
            rows = [(a, i, _page(f), f["WARC-Target-URI"], int(w["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")) for a, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for i, (f, w, _) in enumerate(records(c))]
            return dict(zip((x.split(" ")[0] for x in kinds.split(", ")), map(list, zip(*rows, strict=True)), strict=True)) if rows else None

        return one

    return map_batches(archives, make, kinds)


def resolve(archives: DataFrame, min_payload: int = 0) -> DataFrame:
    """archive and revisits: its records that repeat a payload, with the original of each. A digest's original is found by a partial aggregate, so one that most records share is no task's alone."""
    heads = save(headers(archives), "headers")
    counted = heads.where(F.col("payload_bytes") >= min_payload)
    originals = counted.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "archive", "place", "url")).alias("original"), F.count("*").alias("n")).where("n > 1")
    again = counted.join(save(originals, "originals"), ["digest", "payload_bytes"]).where((F.col("archive") != F.col("original.archive")) | (F.col("place") != F.col("original.place")))
    return again.groupBy("archive").agg(F.collect_list(F.struct("place", F.col("original.page_id").alias("page_id"), F.col("original.archive").alias("archive"), F.col("original.place").alias("at"), F.col("original.url").alias("url"))).alias("revisits"))


def deduplicate(archives: DataFrame, min_payload: int = 0) -> DataFrame:
    """Saved archives in which each payload is written once and repeated captures are revisits."""
    decided = archives.join(resolve(archives, min_payload), "archive", "left").select("archive", "content", "revisits")

    def make():
        def one(batch):
            out: dict[str, list] = {"archive": batch.column(0), "content": []}
            for name, content, revisits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                again = {r["place"]: r for r in revisits or ()}
                members = []
                for i, (f, w, payload) in enumerate(records(content)):
                    own, digest = record_id("deduplicated", name, i), f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r := again.get(i):
                        members.append(revisit(own, _page(f), f["WARC-Target-URI"], int(w["Content-Length"]), digest, record_id("deduplicated", r["archive"], r["at"]), r["page_id"], r["url"]))
                    else:
                        members.append(response(own, _page(f), f["WARC-Target-URI"], payload, digest))
                out["content"].append(b"".join(members))
            return out

        return one

    return save(map_batches(decided, make, ARCHIVE), "deduplicated", "uncompressed")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record; the digest of a response is that of the payload read."""
    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"

    def make():
        def one(batch):
            rows = []
            for content in batch.column(0).to_pylist():
                for f, w, payload in records(content):
                    own = f["WARC-Type"] == "response"
                    rows.append((_page(f), len(payload) if own else int(w["Content-Length"]), payload_digest(payload) if own else f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], None if own else _page(f, "Refers-To-Page-Id"), f["WARC-Target-URI"]))
            return dict(zip((x.split(" ")[0] for x in kinds.split(", ")), map(list, zip(*rows, strict=True)), strict=True)) if rows else None

        return one

    return map_batches(archives.select("content"), make, kinds)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write each archive to a .warc.gz file of a folder of the driver, one at a time."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in archives.toLocalIterator():
        names.append(f"{folder}/{r['archive']}.warc.gz")
        with open(names[-1], "wb") as f:
            f.write(r["content"])
    return names
