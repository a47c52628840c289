"""WARC archives without repeated payloads: revisit resolution.

Headers (id, URL, digest; no payload) are shuffled by digest to find the first record of
each payload. Records then meet what was found by digest: the first is written as a
response with its payload, all others as revisits that refer to it, each with headers of
its own. A digest is dealt to its shuffle partition with a salt of id and URL, and firsts
are found by (digest, salt) before they are by digest, so copies by the thousand fill no
task. Equality is that of SHA-256; the archives carry the usual SHA-1.

Every task writes an archive of its own, a gzip member a record, under a name no other
attempt uses. The manifest lists only those of attempts that ended well; a lost executor
leaves at most an unlisted file. Reading takes the archives record by record, checks each
payload against its digest, and can join revisits to the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, parts, saved

MANIFEST = "part int, file string, n_records long, n_bytes long"
RECORDS = "page_id long, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload string"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of an archive read at once; gzip's effort.
CHUNK, EFFORT = 1 << 20, 1
#: Digits of Spark's conv to base 32, each of five bits.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: twenty bits, five hex digits, at a time."""
    h = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*chunks), _DIGITS, BASE32)


def resolved(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, html, digest, _sha, _salt and first_id, first_url: the record that holds the payload.

    Rows of one payload and salt share a partition. The first has the smallest page_id, a null
    one last, then the smallest url.
    """
    n = parts(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("_sha"), F.pmod(F.xxhash64("page_id", "url"), F.lit(n)).alias("_salt"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("_first")
    heads = saved(rows.groupBy("_sha", "_salt").agg(first))
    best = heads.groupBy("_sha").agg(F.min("_first").alias("_best"))
    known = heads.join(best, "_sha").select("_sha", "_salt", F.col("_best.page_id").alias("first_id"), F.col("_best.url").alias("first_url"))
    met = rows.repartition(n, "_sha", "_salt").join(known.hint("shuffle_hash"), ["_sha", "_salt"])
    return met.select("page_id", "url", "html", base32_sha1(F.col("html")).alias("digest"), "_sha", "_salt", "first_id", "first_url")


def record_id(page_id: int | None, url: str | None, sha: bytes, k: int) -> str:
    """The name of the k-th record of one page, URL and payload; whoever refers to it can tell it without looking."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((page_id, url, k)).encode('utf-8', 'surrogatepass') + sha).digest()[:16], version=5)}>"


def target(url: str | None) -> str:
    """A URL that stays on its header's line."""
    return urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127))))


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    z = zlib.compressobj(EFFORT, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Archive:
    """Writes one archive, a gzip member a record."""

    def __init__(self, folder: str, part: int, date: str):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{part:05d}-{uuid.uuid4().hex}.warc.gz"
        self.file, self.date, self.n_records, self.n_bytes = f"{folder}/{name}", date, 0, 0
        self.out = fs.open_output_stream(f"{base}/{name}", compression=None)
        info = b"software: plumbline\r\nformat: WARC File Format 1.1\r\n"
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        self.put(record(about, info))

    def put(self, raw: bytes) -> None:
        z = gzipped(raw)
        self.out.write(z)
        self.n_bytes += len(z)

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, sha: bytes, k: int, first: tuple) -> None:
        """The k-th record of this page, URL and payload, whose payload ``first`` (page_id, url) holds."""
        revisit = k > 0 or (page_id, url) != first
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = http if revisit else http + payload
        headers = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(page_id, url, sha, k)),
            ("WARC-Date", self.date),
            ("WARC-Target-URI", target(url) if url is not None else None),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("X-Page-ID", None if page_id is None else str(page_id)),
        ]
        if revisit:
            headers += [
                ("WARC-Profile", PROFILE),
                ("WARC-Refers-To", record_id(*first, sha, 0)),
                ("WARC-Refers-To-Target-URI", target(first[1]) if first[1] is not None else None),
                ("WARC-Refers-To-Date", self.date),
                ("X-Refers-To-Page-ID", None if first[0] is None else str(first[0])),
            ]
        self.put(record(headers, block))
        self.n_records += 1

    def close(self) -> None:
        self.out.close()


def write(pages: DataFrame, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest: part, file, n_records, n_bytes.

    A null html is an empty payload, and empty payloads are equal to each other. A null page_id
    or url leaves its header out; a null page_id comes after all others. Of repeated rows one is the
    response and the others revisit it. An empty table gives no archive. Other columns are ignored.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, k, part = None, None, 0, TaskContext.get().partitionId()
        for b in batches:
            out = out or (Archive(folder, part, date) if b.num_rows else None)
            ids, urls, html, digests, shas, first_ids, first_urls = b.columns
            html = html.cast(pa.large_binary())
            rest = zip(ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), shas.to_pylist(), first_ids.to_pylist(), first_urls.to_pylist(), strict=True)
            for i, (page_id, url, digest, sha, *first) in enumerate(rest):
                key = sha, page_id, url
                k = k + 1 if key == last else 0
                last = key
                out.add(page_id, url, html[i].as_py(), digest, sha, k, tuple(first))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.file]), pa.array([out.n_records]), pa.array([out.n_bytes])], ["part", "file", "n_records", "n_bytes"])

    rows = resolved(pages).sortWithinPartitions("_sha", "_salt", F.col("page_id").asc_nulls_last(), "url")
    return saved(rows.select("page_id", "url", "html", "digest", "_sha", "first_id", "first_url").mapInArrow(task, MANIFEST))


def members(uri: str) -> Iterator[bytes]:
    """The records of an archive, one after the other, as bytes; no more than one is held."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z, out, data = zlib.decompressobj(31), [], f.read(CHUNK)
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
            data = data or f.read(CHUNK)
        if out:
            raise ValueError(f"{uri}: cut off within a record")


def fields(raw: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """The fields after the first line of a header, and where what follows it begins."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def parsed(raw: bytes, uri: str) -> dict | None:
    """A response or revisit as a row of RECORDS; the payload of a response is checked against its digest."""
    head, at = fields(raw)
    if head["WARC-Type"] == "warcinfo":
        return None
    http, body = fields(raw, at)
    end = at + int(head["Content-Length"])
    digest, number = head["WARC-Payload-Digest"].removeprefix("sha1:"), lambda k: int(head[k]) if k in head else None
    row = {"page_id": number("X-Page-ID"), "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "target_uri": head.get("WARC-Target-URI"), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest}
    if head["WARC-Type"] == "revisit":
        return row | {"refers_to": number("X-Refers-To-Page-ID"), "refers_to_record": head["WARC-Refers-To"], "payload": None}
    payload = raw[body:end]
    if len(payload) != row["payload_bytes"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{uri}: {row['record_id']} does not match its digest")
    return row | {"refers_to": None, "refers_to_record": None, "payload": payload}


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives, as RECORDS; without ``payloads`` that column is null. A payload that does not match its digest raises an error."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {"payload": r["payload"].decode() if payloads and r["payload"] is not None else None} for r in rows], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            held, size = [], 0
            for raw in members(uri):
                if (row := parsed(raw, uri)) is None:
                    continue
                held.append(row if payloads else row | {"payload": None})
                size += len(raw) if payloads else 200
                if size > CHUNK:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    return manifest.select("file").mapInArrow(task, RECORDS)


def restored(records: DataFrame) -> DataFrame:
    """page_id, target_uri, payload of all records: revisits get the payload of the response they refer to."""
    full = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("payload").alias("_payload"))
    back = records.where("record_type = 'revisit'").join(full, "refers_to_record").select("page_id", "target_uri", F.col("_payload").alias("payload"))
    return records.where("record_type = 'response'").select("page_id", "target_uri", "payload").unionByName(back)


def remove(manifest: DataFrame) -> None:
    """Delete the archives of a manifest, where they are no longer wanted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            fs, path = pa.fs.FileSystem.from_uri(uri)
            fs.delete_file(path)
        yield from ()

    manifest.select("file").mapInArrow(task, "file string").write.format("noop").mode("overwrite").save()


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: ('{BASE32}')[(('0x' || x[i // 4 * 5 + 1 : i // 4 * 5 + 5])::BIGINT >> (15 - i % 4 * 5)) % 32 + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
