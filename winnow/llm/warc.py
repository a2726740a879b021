"""Legacy archives to WARC: ARC files of either version are parsed by their header lines and declared lengths, and equivalent
WARC records are written: identifiers, ISO timestamps, record types, SHA-1 digests, and revisits for payloads seen before.

An archive file is one task's unit. What decides between response and revisit (the payloads' digests) is a DataFrame join
over all files; payloads themselves are never shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, file_system, new_path, saved, slices

#: The header lines' fields by ARC version, as the format defines them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file long, path string, records long"


class _Out:
    """A file of gzip members, one for each record, put in its place when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.attempt{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.out, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def add(self, record: bytes) -> int:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = squeeze.compress(record) + squeeze.flush()
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _open(uri: str):
    fs, path = file_system(uri)
    return gzip.GzipFile(fileobj=fs.open_input_stream(path, compression=None), mode="rb")


def arc_header(version: int, url: bytes, ip: bytes, date: bytes, kind: bytes, length: int, offset: int = 0, filename: bytes = b"-") -> bytes:
    fields = [url, ip, date, kind, b"%d" % length]
    if version == 2:
        fields[4:4] = [b"200", b"-", b"-", b"%d" % offset, filename]
    return b" ".join(fields) + b"\n"


def write_arc(pages: DataFrame, path: str, date: str = "20200101000000") -> DataFrame:
    """One ARC file for each partition of pages (page_id, url, html): odd ones in version 2, the others in version 1.

    A record's body is an HTTP response whose entity is the html (null: empty). The page's id stands in a header of it; a null
    id has none. White space and control characters in a url are percent-encoded; a null url is written as unknown:.
    """

    def run(batches):
        k, out, n = TaskContext.get().partitionId(), None, 0
        version, name = 1 + k % 2, f"pages-{k:06d}.arc.gz"
        for batch in slices(batches):
            if out is None:
                out = _Out(f"{path}/{name}")
                about = b"%d 0 winnow\n%s\n\n" % (version, " ".join(ARC_FIELDS[version]).encode())
                out.add(arc_header(version, b"filedesc://" + name.encode(), b"0.0.0.0", date.encode(), b"text/plain", len(about)) + about + b"\n")
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), as_bytes(batch.column("url")), as_bytes(batch.column("html")), strict=True):
                url = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url) or b"unknown:"
                key = b"" if page_id is None else b"X-Record-Key: %d\r\n" % page_id
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (key, len(html), html)
                out.add(arc_header(version, url, b"0.0.0.0", date.encode(), b"text/html", len(body), out.at, name.encode()) + body + b"\n")
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [k], "path": [f"{path}/{name}"], "records": [n]})

    return saved(pages.select("page_id", "url", "html").mapInArrow(run, FILES), "arc-files")


def read_arc(uri: str):
    """(fields by name, body) of each record, the version block first. Fields are taken from the right: a url may hold spaces."""
    with _open(uri) as f:
        names = ARC_FIELDS[1]
        first = True
        while line := f.readline():
            if not line.strip():
                continue
            found = line.rstrip(b"\r\n")
            if first:  # the version block's own line has 5 fields, or 10 in version 2; its body tells which
                length = int(found.rpartition(b" ")[2])
                body = f.read(length)
                names = ARC_FIELDS.get(int(body.split(None, 1)[0]), ARC_FIELDS[1])
                n = len(names) if found.count(b" ") >= len(names) - 1 else 5
                fields = dict(zip(ARC_FIELDS[1] if n == 5 else names, found.rsplit(b" ", n - 1), strict=True))
                first = False
                yield fields, body
                continue
            fields = dict(zip(names, found.rsplit(b" ", len(names) - 1), strict=True))
            yield fields, f.read(int(fields["Archive-length"]))


def payload_at(body: bytes) -> int:
    """Where the entity begins in an HTTP response; 0 for anything else."""
    if not body.startswith(b"HTTP/"):
        return 0
    at = [i + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (i := body.find(gap)) >= 0]
    return min(at, default=len(body))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_header(head: bytes, name: bytes) -> int | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(m[1]) if m else None


def record_id(file: str, ordinal: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{ordinal}')}"


def iso_date(date: bytes) -> str:
    """14 digits (older tools: 12 or 8) as a WARC date; anything else as the epoch."""
    d = date.decode("ascii", "replace")
    if not re.fullmatch(r"\d{8}|\d{12}|\d{14}", d):
        return "1970-01-01T00:00:00Z"
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def _units(files: DataFrame) -> DataFrame:
    return files.repartitionByRange(_tasks(files), "file")


def _tasks(files: DataFrame) -> int:
    """A task for each file; of very many files, several in turn."""
    return max(1, min(64 * files.sparkSession.sparkContext.defaultParallelism, files.count()))


def _batches(rows, types: list[pa.DataType], names: list[str], most: int = 2000):
    """Arrow batches of rows as they come, so a file of many records isn't held as a list."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def arc_index(files: DataFrame) -> DataFrame:
    """file, path, ordinal, key, payload_bytes, digest of every record but the version blocks."""

    def records(batches):
        for batch in batches:
            for file, uri in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                for ordinal, (_, body) in enumerate(read_arc(uri)):
                    if ordinal:
                        at = payload_at(body)
                        yield file, uri, ordinal, http_header(body[:at], b"X-Record-Key"), len(body) - at, digest(body[at:])

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield from _batches(records(batches), types, ["file", "path", "ordinal", "key", "payload_bytes", "digest"])

    return _units(files).mapInArrow(run, "file long, path string, ordinal long, key long, payload_bytes long, digest string")


def decide(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """index with the record that each one revisits (first_file, first_ordinal), null for responses.

    Of equal payloads of at least min_bytes the one with the smallest key is the response (null keys last, then file order).
    """
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "file", "ordinal", "path")
    first = index.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min(order).alias("of"), F.count("*").alias("n")).where("n > 1")
    met = index.join(first.select(F.col("digest").alias("same"), "of"), (F.col("digest") == F.col("same")) & (F.col("payload_bytes") >= min_bytes), "left")
    own = (F.col("of.file") == F.col("file")) & (F.col("of.ordinal") == F.col("ordinal"))
    pick = lambda c: F.when(~own, F.col(f"of.{c}"))
    return met.select("file", "path", "ordinal", pick("path").alias("first_path"), pick("ordinal").alias("first_ordinal"))


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def to_warc(name: str, ordinal: int, fields: dict, body: bytes, refers_to: str | None) -> bytes:
    """The WARC record of an ARC record: warcinfo for the version block, then response, revisit or resource by what the body is."""
    url, date = fields["URL"].decode("utf-8", "replace"), iso_date(fields["Archive-date"])
    own = [("WARC-Record-ID", f"<{record_id(name, ordinal)}>"), ("WARC-Date", date)]
    if ordinal == 0:
        info = f"software: winnow\r\nformat: WARC File Format 1.1\r\nisPartOf: {url}\r\n".encode()
        return _warc([("WARC-Type", "warcinfo"), *own, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)
    at, short = payload_at(body), len(body) < int(fields["Archive-length"])
    own += [("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"].decode()), ("WARC-Payload-Digest", f"sha1:{digest(body[at:])}")]
    own += [("WARC-Truncated", "disconnect")] if short else []
    if body.startswith(b"HTTP/"):
        kind, mime = "response", "application/http;msgtype=response"
    else:
        kind, mime = ("response" if url.startswith("dns:") else "resource"), fields["Content-type"].decode("utf-8", "replace")
    if refers_to:
        kind, body = "revisit", body[:at]
        own += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    return _warc([("WARC-Type", kind), *own, ("WARC-Block-Digest", f"sha1:{digest(body)}"), ("Content-Type", mime)], body)


def convert(files: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write a WARC file under path for each ARC file; returns the new files. No records: no file."""
    decisions = saved(decide(saved(arc_index(files), "arc-index"), min_bytes), "arc-decisions")

    def run(batches):
        name, file, source, out, k = None, None, None, None, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [file], "path": [f"{path}/{name}.warc.gz"], "records": [k]})

        for batch in batches:
            for f, uri, ordinal, first_path, first in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "ordinal", "first_path", "first_ordinal")), strict=True):
                if f != file:
                    if out:
                        yield done()
                    name, file, source, k = stem(uri), f, enumerate(read_arc(uri)), 0
                    out = _Out(f"{path}/{name}.warc.gz")
                    at, (fields, body) = next(source)
                    out.add(to_warc(name, at, fields, body, None))
                at, (fields, body) = next(source)
                if at != ordinal:
                    raise ValueError(f"{uri}: record {ordinal} expected, {at} found")
                out.add(to_warc(name, at, fields, body, record_id(stem(first_path), first) if first_path else None))
                k += 1
        if out:
            yield done()

    return saved(decisions.repartitionByRange(_tasks(files), "file").sortWithinPartitions("file", "ordinal").mapInArrow(run, FILES), "warc-files")


def stem(uri: str) -> str:
    return re.sub(r"\.arc(\.gz)?$", "", uri.rpartition("/")[2])


def read_warc(uri: str):
    """(headers in lower case, block) of each record."""
    with _open(uri) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: no WARC record where one was expected")
            headers = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers[k.strip().lower()] = v.strip()
            yield headers, f.read(int(headers["content-length"]))


def warc_records(files: DataFrame) -> DataFrame:
    """record_id, key, record_type, payload_bytes, payload_digest, refers_to_id of each record but warcinfo; digests are checked."""

    def records(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                for h, block in read_warc(uri):
                    if h["warc-type"] == "warcinfo":
                        continue
                    at, told = payload_at(block), h["warc-payload-digest"].removeprefix("sha1:")
                    again = h["warc-type"] == "revisit"
                    if not again and digest(block[at:]) != told or digest(block) != h["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"{uri}: {h['warc-record-id']} doesn't match its digest")
                    n = http_header(block[:at], b"Content-Length") if again else len(block) - at
                    yield h["warc-record-id"], http_header(block[:at], b"X-Record-Key"), h["warc-type"], n, told, h.get("warc-refers-to")

    def run(batches):
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield from _batches(records(batches), types, ["record_id", "key", "record_type", "payload_bytes", "payload_digest", "refers_to_id"])

    return _units(files).mapInArrow(run, "record_id string, key long, record_type string, payload_bytes long, payload_digest string, refers_to_id string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from WARC files converted from ARC files.

    Null html is an empty payload; a null page_id comes back as null and never takes a response from a page with an id. Repeated
    rows are records of their own, the first in file order being the response; no pages: no records. Other columns aren't read.
    """
    arcs = write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "arc"))
    records = saved(warc_records(convert(arcs, new_path(spark, "warc"))), "warc-records")
    first = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("of_id"), F.col("key").alias("of_key"))
    met = records.where("refers_to_id is not null").join(first, F.col("refers_to_id") == F.col("of_id"), "left")
    columns = [F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type"]
    return records.where("refers_to_id is null").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionAll(met.select(*columns, F.col("of_key").alias("refers_to")))
