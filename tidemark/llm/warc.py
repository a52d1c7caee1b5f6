"""WARC archives: a PySpark data source that reads and writes them.

Reading: `spark.dataSource.register(WarcSource)`, then `spark.read.format("warc").schema(...).load(path)`. Files are planned
into partitions by size, and a large *.warc.gz is cut into ranges: a gzip member (by custom one record) belongs to the range
that it begins in, and the first of a range is found by its magic bytes and by what it inflates to. Plain files are one range
each, as a payload may look like the beginning of a record. Each record's headers are parsed first, and predicates on the
record type and on headers that Spark pushes down are applied to them. The payload is inflated only if the schema asks for it
or for its digest: members written here carry their own size in the gzip header's "sl" field, so the rest of one that is not
wanted is not even read; of other members it is inflated and thrown away. Ask for few columns: others are not decoded.
Pushdown needs spark.sql.python.filterPushdown.enabled=true; without it Spark filters afterwards.

Writing: each row becomes one record, formatted by SQL functions, and each record one gzip member. Tasks write under
_temporary; what the successful attempts wrote is moved into place at the end, so lost executors leave nothing behind. Which
record is a response is found from digests alone; only then are the ids of the few revisits joined to the payloads, by id.

Both sides open files with pyarrow's file systems, so any store that these reach will do.

Nulls and repeats: a null payload is empty; null ids, URIs and headers are left out and read back as null. Repeated rows are
records of their own; of rows with one id and one payload, all are responses. A null id refers to nothing and never is what
others refer to. An empty table gives an empty archive and an empty result. Other columns are not read and may clash.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from .common import fresh_path, read

#: Columns that are one header each.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "profile": "warc-profile",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload_length long, headers map<string,string>, payload binary, payload_sha256 string"
PARTITION_BYTES, FILE_BYTES = 64 << 20, 1 << 30


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, int, int]]  # path, and the range of bytes in which its members begin


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 16


def member(record: bytes) -> bytes:
    """A record as a gzip member that tells its own size: subfield "sl" holds compressed and plain length."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    size = 12 + 12 + len(body) + 8
    head = MAGIC + b"\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Member:
    """The plain bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.ended = file, at, b"", False
        file.seek(at)
        raw = file.read(CHUNK)
        self.size = None
        if raw[3:4] == b"\x04" and raw[10:16] == struct.pack("<H2sH", 12, b"sl", 8) and len(raw) >= 24:
            self.size = struct.unpack("<I", raw[16:20])[0] or None
        self.unpack, self.read_to, self.waiting = zlib.decompressobj(31), at + len(raw), raw

    def _more(self) -> bool:
        """Inflate another piece; whether there was one."""
        if self.ended:
            return False
        raw = self.waiting
        if not raw:
            self.file.seek(self.read_to)
            raw = self.file.read(CHUNK)
            self.read_to += len(raw)
        if not raw:
            raise ValueError("a gzip member without an end")
        self.held += self.unpack.decompress(raw, CHUNK)
        self.waiting = self.unpack.unconsumed_tail
        self.ended = self.unpack.eof
        return True

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n")) < 0 and self._more():
            pass
        end = end + 1 if end >= 0 else len(self.held)
        line, self.held = self.held[:end], self.held[end:]
        return line

    def read(self, n: int) -> bytes:
        parts, missing = [], n
        while missing > len(self.held):
            parts.append(self.held)
            missing -= len(self.held)
            self.held = b""
            if not self._more():
                break
        parts.append(self.held[:missing])
        self.held = self.held[missing:]
        return b"".join(parts)

    def seek(self, n: int, whence: int) -> None:
        """Forward only. Of a member that tells its size, which is one record, the rest is not inflated."""
        if n > len(self.held) and self.size:
            self.held, self.ended = b"", True
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self._more():
                return
        self.held = self.held[n:]

    def next_at(self) -> int:
        if self.size:
            return self.at + self.size
        while self._more():
            self.held = b""
        return self.read_to - len(self.unpack.unused_data)


def begins(raw: bytes) -> bool:
    """Whether a member with a record begins with these bytes."""
    try:
        return zlib.decompressobj(31).decompress(raw, 5) == b"WARC/"
    except zlib.error:
        return False


def first_member(file, start: int, end: int) -> int:
    """Where the first member at or after start begins (end: none before it)."""
    at, held = start, b""
    file.seek(start)
    while at < end:
        raw = file.read(CHUNK)
        held += raw
        found = held.find(MAGIC)
        while found >= 0 and at + found < end:
            probe = held[found : found + 512]
            if len(probe) < 512:
                more = file.read(CHUNK)
                held, raw = held + more, raw or more
                probe = held[found : found + 512]
            if begins(probe):
                return at + found
            found = held.find(MAGIC, found + 1)
        if not raw:
            break
        keep = min(len(held), len(MAGIC) - 1)
        at, held = at + len(held) - keep, held[len(held) - keep :]
    return end


def members(file, start: int, end: int):
    at = first_member(file, start, end) if start else 0
    while at < end:
        found = Member(file, at)
        yield found
        at = found.next_at()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _headers(stream, first: bytes) -> dict[str, str]:
    """Name (lower case) to value, of the lines up to a blank one; a line that begins with a blank continues the last."""
    found: dict[str, str] = {}
    name, line = "", first
    while line.strip(b"\r\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
        line = stream.readline()
    return found


def _holds(test, value: str | None) -> bool:
    kind, want = test
    if value is None:
        return False
    return {"eq": lambda: value == want, "in": lambda: value in want, "some": lambda: True, "starts": lambda: value.startswith(want),
            "ends": lambda: value.endswith(want), "has": lambda: want in value}[kind]()


def records(stream, columns: list[str], tests: list[tuple[str, tuple]]):
    """Rows (tuples in the order of columns) of one opened archive."""
    payload_wanted = "payload" in columns or "payload_sha256" in columns
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        head = _headers(stream, stream.readline())
        length = int(head.get("content-length", 0))
        if not all(_holds(test, head.get(name)) for name, test in tests):
            stream.seek(length, io.SEEK_CUR)
            continue
        left, payload_length, payload = length, length, None
        http = head.get("content-type", "").startswith("application/http")
        if length and http and (payload_wanted or "payload_length" in columns):
            block = stream.readline()
            left -= len(block)
            inner: dict[str, str] = {}
            while left and block.strip():
                block = stream.readline()
                left -= len(block)
                if b":" in block:
                    name, value = block.decode("utf-8", "replace").split(":", 1)
                    inner[name.strip().lower()] = value.strip()
            payload_length = int(inner.get("content-length", left)) if head.get("warc-type") == "revisit" else left
        if payload_wanted and head.get("warc-type") != "revisit":
            payload = stream.read(left)
        else:
            stream.seek(left, io.SEEK_CUR)
        row = []
        for column in columns:
            if column in HEADERS:
                row.append(head.get(HEADERS[column]))
            elif column == "content_length":
                row.append(length)
            elif column == "payload_length":
                row.append(payload_length)
            elif column == "headers":
                row.append(list(head.items()))
            elif column == "payload":
                row.append(payload)
            else:
                row.append(None if payload is None else hashlib.sha256(payload).hexdigest())
        yield tuple(row)


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.names
        self.path = options["path"]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "some", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((HEADERS[f.attribute[0]], (kinds[type(f)], getattr(f, "value", None))))
            else:
                yield f

    def partitions(self):
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [x for x in found if x.is_file and x.size and not any(part.startswith(("_", ".")) for part in x.path[len(path) :].split("/"))]
        planned, room = [Ranges([])], self.size
        for x in sorted(files, key=lambda x: x.path):
            cuts = [*range(0, x.size, self.size), x.size] if x.path.endswith(".gz") else [0, x.size]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end - start > room and planned[-1].parts:
                    planned.append(Ranges([]))
                    room = self.size
                planned[-1].parts.append((x.path, start, end))
                room -= end - start
        return planned

    def read(self, partition):
        store = _open(self.path)[0]
        types = {"content_length": pa.int64(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in self.columns])
        for path, start, end in partition.parts:
            with store.open_input_file(path) as file:
                streams = members(file, start, end) if path.endswith(".gz") else [io.BufferedReader(file, 1 << 20)]
                rows, weight = [], 0
                for stream in streams:
                    for row in records(stream, self.columns, self.tests):
                        rows.append(row)
                        weight += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                        if weight > 8 << 20:
                            yield _batch(rows, schema)
                            rows, weight = [], 0
                if rows:
                    yield _batch(rows, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcWriter(DataSourceArrowWriter):
    """Rows of one string column, the records. A file ends after fileBytes."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("fileBytes", FILE_BYTES))
        self.hidden = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        store, path = _open(self.path)
        store.create_dir(f"{path}/{self.hidden}", recursive=True)
        paths, file, size = [], None, 0
        for batch in iterator:
            for text in batch.column(0):
                if file is None:
                    paths.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file, size = store.open_output_stream(f"{path}/{self.hidden}/{paths[-1]}", compression=None), 0
                packed = member((text.as_py() + "\r\n\r\n").encode())
                file.write(packed)
                size += len(packed)
                if size >= self.most:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(paths)

    def commit(self, messages):
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        for message in messages:
            for name in message.paths if message else ():
                store.move(f"{path}/{self.hidden}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, path = _open(self.path)
        if store.get_file_info(f"{path}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.hidden}")


class WarcSource(DataSource):
    """Options: path (a file or folder), partitionBytes, fileBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are added to a folder, not overwritten: use mode('append')")
        return WarcWriter(self.options)


def record(id_: Column, uri: Column, payload: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """The text of one record; refers_to (an id) makes it a revisit, which has no payload."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda x: F.concat(F.lit("<urn:x-record:"), x.cast("string"), F.lit(">"))
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(payload))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", urn(id_)),
        line("WARC-Target-URI", F.regexp_replace(uri, r"[\r\n]+", "%0A")), line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Refers-To", urn(refers_to)),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 100,
               date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Add a record per row to a folder. Of rows with equal payloads of at least least_bytes, that with the smallest id is the response."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    digests = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    same = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = digests.join(same, "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    known = rows.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    text = known.select(record(F.col("id"), F.col("uri"), F.col("payload"), F.col("digest"), F.col("first"), date).alias("record"))
    pages.sparkSession.dataSource.register(WarcSource)
    text.write.format("warc").mode("append").option("fileBytes", file_bytes).save(path)


def read_warc(spark, path: str, columns: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).load(path)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, payload_length long, payload_sha256 string")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-record:(.*)>$', 1) AS bigint)")
    return back.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.coalesce("payload_sha256", F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": SQL}
