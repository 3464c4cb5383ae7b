"""WARC archives: one gzip member for each record, written by the tasks that hold the pages, and a sequential reader.

Equal payloads are found by their digests before anything is written; the first page of each stays a
response, the others become revisits that refer to it. Writers name files by task attempt, and only the
names in the manifest of the tasks that ended are read: a lost executor leaves files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Bytes of an archive file before the next is begun, and of a read.
SEGMENT, BLOCK = 32 << 20, 1 << 16
RECORD_ID = "urn:page:"


def open_file(uri: str, mode: str) -> BinaryIO:
    """A stream at a path or URI, in any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), uri
    elif uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    else:
        store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_stream(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP headers and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{f'urn:uuid:{uuid.uuid4()}' if page_id is None else f'{RECORD_ID}{page_id}'}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {target}"] * bool(target)
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


class Corrupt(ValueError):
    """An archive that breaks its format or a digest."""


def members(stream: BinaryIO, block: int = BLOCK) -> Iterator[bytes]:
    """The members of a gzip file, decompressed one by one in blocks; memory follows the largest member."""
    rest = b""
    while rest or (rest := stream.read(block)):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := stream.read(block)):
                raise Corrupt("the file ends within a member")
            parts.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(parts)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse(member: bytes) -> dict:
    """A record: its headers, and of a response the payload. Raises Corrupt where a length or digest is wrong."""
    head, sep, body = member.partition(b"\r\n\r\n")
    version, h = _headers(head)
    if not sep or not version.startswith("WARC/"):
        raise Corrupt("no record header")
    n = int(h.get("content-length", -1))
    if n < 0 or body[n:] != b"\r\n\r\n":
        raise Corrupt("the block is not as long as said")
    block = body[:n]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise Corrupt("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    _, hh = _headers(http)
    length, digest = int(hh.get("content-length", len(payload))), h.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = h.get("warc-type", "")
    if kind == "response" and (length != len(payload) or digest and digest != digest_of(payload)):
        raise Corrupt("payload digest")
    ident = lambda k: int(x.removeprefix(RECORD_ID)) if (x := h.get(k, "").strip("<>")).startswith(RECORD_ID) else None
    return {"page_id": ident("warc-record-id"), "url": h.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": ident("warc-refers-to")}


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, count, path = None, 0, 0, ""
        done: list[tuple[str, int]] = []
        for batch in batches:
            for k, url, html, ref in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_file(path, "wb")
                payload = (html.as_py() or "").encode()
                member = record(k.as_py(), url.as_py(), payload, ref.as_py(), digest_of(payload))
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= SEGMENT:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["path", "records"])

    return run


def write(pages: DataFrame, root: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of all pages under a shared folder; returns a lazy manifest (path, records). Materialise it once.

    The payload is the html in UTF-8, a null one is empty. Of records with equal payloads of at least min_bytes bytes that
    with the smallest page_id is the response and the others revisits; smaller payloads are all responses. A row with a null id
    gets a record of a random name: it is read back with a null id, never referred to, and a revisit where a row with an id has
    its payload. Of rows that repeat an id and payload each is written, as a response if the id is the smallest of its payload.
    No pages, no files; columns other than the three are not written.

    Only digests and ids are shuffled to find the first of each payload. Pages meet that table by a broadcast where its files
    are small; else by a join that spreads the pages of a hot payload over all tasks.
    """
    scratch = Scratch(pages.sparkSession, "warc-first")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.unhex(F.sha2("html", 256)))
    long = F.octet_length("html") >= min_bytes
    first = p.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = scratch.save(first, "first")
    ref = F.when(long & (F.col("page_id").isNull() | (F.col("first") < F.col("page_id"))), F.col("first")).alias("refers_to")
    out = scratch.spread_join(p, first, "digest", F.xxhash64("page_id", "url"))
    return out.select("page_id", "url", "html", ref).mapInArrow(_writer(root), "path string, records bigint")


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        kinds = [x for x in kinds if payloads or x[0] != "payload"]
        rows: list[dict] = []
        held = 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path, "rb") as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        held += len(rows[-1]["payload"] or b"") if payloads else 0
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield make()
                            rows, held = [], 0
        yield make()

    return run


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives whose paths a column ``path`` names: page_id, url, payload (binary, null for revisits),
    payload_bytes, payload_digest, record_type, refers_to. Lengths and digests are verified; a corrupt archive fails the read.
    Each file is read once from its start by one task, in blocks.
    """
    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not payloads:
        schema = schema.replace("payload binary, ", "")
    return manifest.select("path").mapInArrow(_reader(payloads), schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, then read their records back (without payloads)."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.save(write(pages, scratch.path("archive"), min_bytes), "manifest", rows_per_batch=500)
    n = max(1, manifest.count())
    return read(manifest.repartition(n), payloads=False).drop("url")
