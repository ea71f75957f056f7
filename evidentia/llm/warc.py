"""A deterministic, sharded WARC 1.1 writer with revisit records, and its reader.

Rows are range-sorted by id; each task writes its range to files that roll once
their compressed size reaches TARGET_BYTES. Every record is a gzip member of its
own. A file is written under a temporary name and renamed when it is whole; the
tasks' manifest rows name the files that count, so what a lost task left behind
is never read. Dates are a parameter and record ids derive from the page id and
the digest: the same rows give the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

TARGET_BYTES = 256 << 20
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:evidentia:warc")
MANIFEST = "file string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One page as a gzip member: a response with the payload, or a revisit of page refers_to with its HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(refers_to))]
        if refers_url is not None:
            headers.append(("WARC-Refers-To-Target-URI", _line(refers_url)))
    headers += [("WARC-Payload-Digest", _base32(digest)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


class _Out:
    """One archive file under a temporary name."""

    def __init__(self, uri: str, date: str):
        self.uri = uri
        self._fs, self._path = _shared.open_fs(uri)
        self._temp = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._out, self._sha = self._fs.open_output_stream(self._temp, compression=None), hashlib.sha256()
        self.bytes = self.records = 0
        name = uri.rsplit("/", 1)[-1]
        self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: evidentia\r\nformat: WARC File Format 1.1\r\n"))

    def _write(self, raw: bytes) -> None:
        self._out.write(raw)
        self._sha.update(raw)
        self.bytes += len(raw)

    def add(self, raw: bytes) -> None:
        self._write(raw)
        self.records += 1

    def close(self) -> tuple[str, int, int, str]:
        self._out.close()
        self._fs.move(self._temp, self._path)
        return self.uri, self.records, self.bytes, self._sha.hexdigest()


def write(df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", target_bytes: int = TARGET_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for each row of df under path; returns the manifest, itself stored in path/_manifest.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the
    largest id are responses and the others revisit it. Null payloads are empty;
    rows without an id sort first and, where no row of equal payload has an id,
    are responses. An empty table gives an empty manifest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("id", "url", "digest")
    held = long.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("held")).where("n > 1").select("digest", F.col("held.id").alias("held"), F.col("held.url").alias("held_url"))
    # written first, so that its size is known and few repeated payloads are joined without shuffling the pages
    held = _shared.materialize(held, "warc-held")
    marked = rows.join(held, "digest", "left").withColumn("held", F.when(F.col("id").eqNullSafe(F.col("held")), None).otherwise(F.col("held")))
    ordered = marked.select("id", "url", "payload", "digest", "held", "held_url").repartitionByRange("id", "digest").sortWithinPartitions("id", "digest", "url")

    def run(batches):
        part, done, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for page_id, url, body, digest, held, held_url in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    out = out or _Out(f"{path}/shard-{part:06d}-{len(done):04d}.warc.gz", date)
                    out.add(page_record(page_id, url, body, digest, held, held_url, date))
                    if out.bytes >= target_bytes:
                        done.append(out.close())
                        out = None
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes", "sha256"])

    fs, where = _shared.open_fs(path)
    fs.create_dir(where, recursive=True)
    _shared.map_arrow(ordered, run, MANIFEST).write.parquet(f"{path}/_manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; one record is held at a time."""
    fs, path = _shared.open_fs(uri)
    with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as f:
        while line := f.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{uri}: a record begins with {line[:40]!r}")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[key] = value
            block = f.read(int(headers["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record has no end")
            yield headers, block


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def read(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """One row for each page record of the manifest's files; every digest is verified, and a mismatch fails the query.

    Columns: page_id, url, payload_bytes, payload_digest (hex), record_type,
    refers_to; with payloads=True also payload, null for revisits.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, names[: 6 + payloads], strict=False)], names[: 6 + payloads])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, block in records(uri):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    if hashlib.sha1(block).hexdigest() != _hex(h["WARC-Block-Digest"]):
                        raise ValueError(f"{uri}: a block of {h['WARC-Record-ID']} differs from its digest")
                    head, _, body = block.partition(b"\r\n\r\n")
                    n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    digest = _hex(h["WARC-Payload-Digest"])
                    if h["WARC-Type"] == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"{uri}: a payload of {h['WARC-Record-ID']} differs from its digest")
                    row = (number(h.get("X-Page-Id")), h.get("WARC-Target-URI"), n, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id")))
                    rows.append((*row, body if h["WARC-Type"] == "response" else None) if payloads else row)
                    size += len(body) if payloads else 0
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    spark = manifest.sparkSession
    return _shared.map_arrow(manifest.select("file").repartition(_shared.partitions(spark)), run, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives, then what the archives say of each."""
    manifest = write(_shared.table(spark, sf_dir, "pages"), _shared.scratch(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS held FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND held <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND held <> page_id THEN held END AS refers_to
FROM h
"""
