"""WARC archives: written as monolithic gzip streams, then normalised to one gzip member a record with an offset index.

1. Each task writes its pages as one WARC file in a single gzip stream, as crawlers and `gzip file.warc` leave them: no
   record can be reached without inflating all before it.
2. The normaliser inflates each stream once, front to back in bounded memory, rewrites every record as its own gzip
   member and writes beside the file an index: offset, length, record id, type.
3. Readers go by the index and inflate only the members they want.

Files are written under a name of their own and renamed when complete, so that a repeated task attempt leaves no half
file under a final name. Of records with equal payloads of MIN_REVISIT bytes or more, the one with the largest page_id is
the response; the others are revisits that refer to it and carry its digest and length, not the payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored

MIN_REVISIT = 1000
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CHUNK = 1 << 20


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _ref(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(ref: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", ref or "")
    return int(m[1]) if m else None


def record(page_id, url: str | None, payload: bytes, digest_hex: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_ref(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_ref(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflated(stream):
    """The records of a gzip file of any number of members, one at a time."""
    z, buffer = zlib.decompressobj(31), bytearray()
    size = None
    while True:
        chunk = stream.read(_CHUNK)
        if not chunk and not z.unconsumed_tail:
            break
        data = z.unconsumed_tail + chunk
        while data:
            buffer += z.decompress(data, _CHUNK)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            while True:
                if size is None:
                    at = buffer.find(b"\r\n\r\n")
                    if at < 0:
                        break
                    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", bytes(buffer[:at]))
                    size = at + 4 + int(length[1]) + 4
                if len(buffer) < size:
                    break
                yield bytes(buffer[:size])
                del buffer[:size]
                size = None
    if buffer:
        raise ValueError("the archive ends inside a record")


class _Output:
    """A file that gets its name when it is complete."""

    def __init__(self, filesystem, path: str):
        self.fs, self.path, self.own = filesystem, path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.own, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)


def with_roles(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with digest, revisit and refers_to."""
    body = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    top = own.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    rows = own.join(stored(top, "payloads"), "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("bytes") >= least)
    return rows.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(file): one whole-file gzip stream for each task that has pages."""

    def run(batches):
        fs, root = _filesystem(folder)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        name = f"{root}/crawl-{TaskContext.get().partitionId():06d}.warc.gz"
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with _Output(fs, name) as out:
            for b in [first], batches:
                for part in slices(b, "html"):
                    for r in part.to_pylist():
                        out.write(z.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], r["revisit"])))
            out.write(z.flush())
        yield pa.record_batch([pa.array([name])], ["file"])

    return pages.mapInArrow(run, "file string")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """(file, offset, length): members of the rewritten archives, as their sidecar indexes have them."""

    def run(batches):
        fs, root = _filesystem(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                target = f"{root}/{name.rpartition('/')[2].removesuffix('.warc.gz')}.records.warc.gz"
                rows, at = [], 0
                with fs.open_input_stream(name, compression=None) as source, _Output(fs, target) as out:
                    for raw in inflated(source):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        fields, _ = parse(raw[: raw.index(b"\r\n\r\n") + 4])
                        rows.append((at, len(member), fields["warc-record-id"], fields["warc-type"]))
                        out.write(member)
                        at += len(member)
                with _Output(fs, f"{target}.idx") as out:
                    for o, n, ref, kind in rows:
                        out.write(json.dumps({"offset": o, "length": n, "id": ref, "type": kind}).encode() + b"\n")
                yield pa.record_batch([pa.array([target] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["file", "offset", "length"])

    return files.mapInArrow(run, "file string, offset long, length long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records at (file, offset, length); a response's length and digest are taken from its payload."""

    def run(batches):
        fs, _ = _filesystem(folder)
        name, source = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != name:
                    name, source = r["file"], fs.open_input_file(r["file"])
                fields, block = parse(zlib.decompress(source.read_at(r["length"], r["offset"]), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
                if fields["warc-type"] == "response":
                    size, found = len(payload), hashlib.sha1(payload).hexdigest()
                    if found != declared:
                        raise ValueError(f"{fields['warc-record-id']}: the payload's digest is {found}")
                rows.append((_page(fields["warc-record-id"]), size, declared, fields["warc-type"], _page(fields.get("warc-refers-to"))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as archives, normalise them, and read every record back.

    A null html is an empty payload, a null url a placeholder, a null page_id an id that reads as null and is a response
    only where no row of its payload has an id. Repeated rows are records each; with the largest page_id all are responses.
    Other columns are ignored. An empty table writes no archive.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    jvm = pages.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    folder = folder if "://" in folder or ":" in folder.split("/")[0] else f"file://{folder}"
    files = stored(write_monolithic(with_roles(pages, least), folder), "archives")
    index = stored(normalise(files.repartition(max(1, files.count()), "file"), folder), "members")
    return read_records(index, folder)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
