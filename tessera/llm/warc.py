"""WARC archives: a writer that stores repeated payloads as revisits, and a splittable reader.

Writing: one gzip member per record, one file per task, under a name that no other attempt uses; the manifest, written
by Spark's own committer, names the files that count, so that lost or repeated attempts leave no trace in results.

Reading: an archive is cut into byte ranges. A task scans its range for the gzip magic, takes a candidate for a member
only if it decodes to a WARC header, however long, with its mandatory fields, and owns the records that start inside its range, the
last of which it reads beyond the range's end. What was read is stored, and its count must be the manifest's.

Defined results: null html is an empty payload, null or unprintable URLs are percent-encoded or left out; rows that
repeat an id and its payload are written each on its own; rows without an id are responses; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, shared_folder

MAGIC = b"\x1f\x8b\x08"
RECORDS = (
    "page_id bigint, record_type string, target_uri string, refers_to bigint, payload_bytes bigint, payload_digest string,"
    " payload binary, file string, at bigint"
)
PREFIX = "urn:x-page:"


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, refers_to: the page that a revisit refers to, null for responses.

    Digests are computed in the scan; only (id, digest) rows are grouped, with partial maxima, so one payload that a
    third of all pages share costs no task more than the others.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    facts = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    shared = keep(facts.groupBy("digest").agg(F.max("page_id").alias("rep"), F.min("page_id").alias("low")).where("low < rep").select("digest", "rep"), "payloads")
    links = keep(facts.join(shared, "digest").where("page_id < rep").distinct(), "revisits")
    links = links.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("rep").alias("refers_to"))
    return rows.join(links, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Write planned records; returns the stored manifest (file, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    member = _record(row[0], row[1], row[2].encode(), row[3], row[4], level)
                    out.write(member)
                    size, count = size + len(member), count + 1
        if count:
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [count]})
        else:
            files.delete_file(f"{root}/{name}")

    return keep(records.mapInArrow(run, "file string, bytes bigint, records bigint"), "manifest")


def _headers(text: bytes) -> tuple[dict[str, str], int] | None:
    """WARC header fields, by lower-case name, and where the block starts; None if this is no WARC record."""
    end = text.find(b"\r\n\r\n")
    if not text.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in text[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode().strip()
    return (fields, end + 4) if {"warc-type", "warc-record-id", "content-length"} <= fields.keys() else None


def scan_range(stream, size: int, start: int, end: int, chunk: int = 1 << 20, probe: int = 8192) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record that starts in bytes [start, end) of an archive."""
    at, data = start, b""

    def fill(least: int) -> None:
        nonlocal data
        while len(data) < least and at + len(data) < size:
            stream.seek(at + len(data))
            data += stream.read(max(chunk, least - len(data)))

    def is_member() -> bool:
        """Whether a WARC header starts the data: as much is decoded as it is long."""
        engine, text, used = zlib.decompressobj(31), b"", 0
        try:
            while b"\r\n\r\n" not in text:
                fill(used + probe)
                if engine.eof or used >= len(data) or not text.startswith(b"WARC/1."[: len(text)]):
                    return False
                text += engine.decompress(data[used : used + probe])
                used += probe
        except zlib.error:
            return False
        return _headers(text) is not None

    # the first member: any later one starts where its predecessor ends
    while at < end:
        fill(chunk)
        k = data.find(MAGIC)
        if k < 0:
            if at + len(data) >= size:
                return
            k = len(data) - len(MAGIC) + 1
            at, data = at + k, data[k:]
            continue
        at, data = at + k, data[k:]
        if at < end and is_member():
            break
        at, data = at + 1, data[1:]
    while at < end and at < size:
        fill(3)
        engine, out, used = zlib.decompressobj(31), [], 0
        while not engine.eof:
            if used == len(data):
                fill(used + chunk)
                if used == len(data):
                    raise ValueError(f"archive ends inside the member at {at}")
            out.append(engine.decompress(data[used:]))
            used = len(data) - len(engine.unused_data)
        text = b"".join(out)
        found = _headers(text)
        if found is None:
            raise ValueError(f"no WARC record in the member at {at}")
        fields, body = found
        yield at, fields, text[body : body + int(fields["content-length"])]
        at, data = at + used, data[used:]


def _id(value: str | None) -> int | None:
    value = (value or "").strip("<>").removeprefix(PREFIX)
    return int(value) if value else None


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest. A response's digest is computed from its payload and must be the one
    in its header; a revisit's length and digest are those that its headers give. ``payloads``: return them, too."""
    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    total = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORDS.split(",")]
        rows, held = [], 0
        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "start"))):
                with files.open_input_file(f"{root}/{name}") as stream:
                    for at, fields, block in scan_range(stream, size, start, min(size, start + split_bytes)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "revisit":
                            length = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                            payload = None
                        else:
                            length = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: the payload at {at} has another digest")
                        rows.append((_id(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), _id(fields.get("warc-refers-to")), length, digest, payload if payloads else None, name, at))
                        held += len(payload or b"") if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    records = keep(ranges.repartition(max(1, int(total))).mapInArrow(run, RECORDS), "records")
    counts = records.groupBy("file").agg(F.count(F.lit(1)).alias("found"))
    if wrong := manifest.join(counts, "file", "left").where(F.coalesce("found", F.lit(0)) != F.col("records")).first():
        raise ValueError(f"{wrong.file}: {wrong.found or 0} records of {wrong.records}")
    return records


def archive_pages(pages: DataFrame, least: int = 1000, split_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, least), folder), folder, split_bytes, payloads)
