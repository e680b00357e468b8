"""WARC archives as a Python data source, with revisit records for repeated payloads.

Reading (``spark.read.format("warc").load(folder)``): the driver lists the archives, from the folder's manifest if it
has one, and packs them into partitions by size.  Predicates on ``record_type`` and on the columns taken from headers
are pushed to the reader, which parses a record's headers first and passes over the payload of records that fail.  In
archives written here each record is one gzip member whose extra field ``sl`` holds its compressed and plain length, so
that passing over costs a seek; other members are inflated without being kept, and plain records are passed over by their
``Content-Length``.  With ``payload`` set to ``false`` no payload is decoded at all.

Writing (``df.write.format("warc")``): every task writes files of its own under a name that no other attempt uses, and
the driver's commit lists those of the attempts that succeeded in a manifest.  Files of lost attempts are never read.

Columns: record_id, record_type, target_uri, date, refers_to, payload_digest (``sha1:`` and base32), payload_length
(of the full payload, also for revisits), payload (null for revisits).

Revisits: of records with equal payloads, of at least ``min_bytes``, the one with the largest id is the response and
the others revisit it.  Payloads are compared by SHA-1 and length.  The largest id is a partially aggregated ``max``
that is written to the shared folder, and rows meet it in an equi-join of two plain shuffles, whose large partitions
Spark splits: all copies of one common page need not pass through one task.

Defined cases: a null payload is written as an empty one; rows with a null id are responses of their own and have a
null id when read back; of rows that tie in the largest id all are responses; very long payloads
are written and read whole, one at a time; an empty table makes an archive without records; rows may have other columns,
which are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringStartsWith,
    WriterCommitMessage,
)

from quarry.llm import scratch

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST = "_manifest.json"
#: A task starts a new file at this size.
FILE_BYTES = 256 << 20
#: Small files share a partition up to this size.
PARTITION_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records -------------------------------------------------------------------------------------------------------


def render(record_id: str, kind: str, uri: str, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone; both tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with the skip lengths in its extra field."""
    packed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packed.compress(record) + packed.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + len(tail), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class Record:
    """Headers, and the block on demand."""

    def __init__(self, headers: dict[str, str], block):
        self.headers, self.block = headers, block


def _plain_records(f) -> Iterator[Record]:
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        raw = [line.rstrip(b"\r\n")]
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line.rstrip(b"\r\n"))
        headers = _parse_headers(b"\r\n".join(raw))
        at, length = f.tell(), int(headers.get("content-length", 0))
        yield Record(headers, lambda n=length: f.read(n))
        f.seek(at + length)


def _skip_length(head: bytes) -> int:
    """The member's compressed length from its extra field; 0 if it has none."""
    if len(head) < 12 or not head[3] & 4:
        return 0
    size = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + size
    while at + 4 <= end:
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and n >= 4:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + n
    return 0


class Member:
    """A gzip member that is inflated as far as it is asked for."""

    def __init__(self, f, first: bytes):
        self.f, self.raw = f, first
        self.inflate = zlib.decompressobj(31)
        self.plain = bytearray()

    def more(self, limit: int) -> bool:
        """Inflates up to ``limit`` bytes more; False if there are none."""
        if self.inflate.eof:
            return False
        raw = self.raw or self.f.read(1 << 15)
        out = self.inflate.decompress(raw, limit)
        self.raw = self.inflate.unconsumed_tail
        self.plain += out
        return bool(out or raw)

    def until(self, size: int) -> bytes:
        while len(self.plain) < size and self.more(max(size - len(self.plain), 1 << 14)):
            pass
        return bytes(self.plain[:size])

    def skip(self) -> int:
        """Inflates to the end without keeping anything; the place in the file where the next member starts."""
        while self.more(1 << 20):
            self.plain.clear()
        return self.f.tell() - len(self.inflate.unused_data)


def _gzip_records(f) -> Iterator[Record]:
    """A record per member.  Only the headers are inflated until the block is asked for."""
    at = 0
    while True:
        f.seek(at)
        data = f.read(4096)
        if not data:
            return
        member = Member(f, data)
        while (end := member.plain.find(b"\r\n\r\n")) < 0:
            if not member.more(2048):
                raise ValueError("a WARC record without an end of its headers")
        headers = _parse_headers(bytes(member.plain[:end]))
        yield Record(headers, lambda m=member, e=end, n=int(headers.get("content-length", 0)): m.until(e + 4 + n)[e + 4 :])
        length = _skip_length(data)
        at = at + length if length else member.skip()


def records(f) -> Iterator[Record]:
    magic = f.read(2)
    f.seek(0)
    return _gzip_records(f) if magic == b"\x1f\x8b" else _plain_records(f)


def _payload(block: bytes) -> tuple[bytes, int]:
    """What follows the HTTP headers, and the length that they tell."""
    head, _, body = block.partition(b"\r\n\r\n")
    told = _parse_headers(head).get("content-length", "")
    return body, int(told) if told.isdigit() else len(body)


# --- files ---------------------------------------------------------------------------------------------------------


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _list(path: str) -> list[tuple[str, int]]:
    """Archives and their sizes: those of the manifests if there are any."""
    from pyarrow import fs

    store, root = _filesystem(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return [(root, store.get_file_info(root).size)]
    found = [x for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File]
    manifests = [x for x in found if x.base_name.endswith(MANIFEST)]
    if manifests:
        named = set()
        for x in manifests:
            with store.open_input_stream(x.path) as f:
                named.update(json.loads(f.read()))
        found = [x for x in found if x.base_name in named]
    return sorted((x.path, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz")))


# --- data source ---------------------------------------------------------------------------------------------------


class WarcSource(DataSource):
    """``warc``: options ``path``, ``payload`` (default true) and, for writing, ``compress`` (default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, list(schema.names))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, list(schema.names))


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path, self.names = options["path"], names
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column not in HEADER_OF:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, StringContains):
                self.tests.append((column, "contains", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, size = [], PARTITION_BYTES
        for path, n in _list(self.path):
            if size + n > PARTITION_BYTES and size:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def _passes(self, headers: dict[str, str]) -> bool:
        for column, how, value in self.tests:
            found = headers.get(HEADER_OF[column])
            if found is None or how == "in" and found not in value or how == "starts" and not found.startswith(value) or how == "contains" and value not in found:
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _filesystem(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 16) as f:
                for record in records(f):
                    if self._passes(record.headers):
                        yield self._row(record)

    def _row(self, record: Record) -> tuple:
        row = {c: record.headers.get(h) for c, h in HEADER_OF.items()}
        row["payload_length"] = row["payload"] = None
        if self.with_payload or row["record_type"] == "revisit":
            body, told = _payload(record.block())
            row["payload_length"] = told
            if row["record_type"] != "revisit":
                row["payload"] = body
                if row["payload_digest"] not in (None, f"sha1:{base32_digest(body)}"):
                    raise ValueError(f"the payload of {row['record_id']} doesn't have the digest that its header tells")
        return tuple(row[c] for c in self.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    """Rows: record_id, record_type, target_uri, date, refers_to, payload_digest, payload_length and payload."""

    def __init__(self, options, names: list[str]):
        self.path, self.names = options["path"], names
        self.compress = str(options.get("compress", "true")).lower() == "true"
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        at = {c: i for i, c in enumerate(self.names)}
        names: list[str] = []
        out, size = None, 0
        for row in rows:
            if out is None or size >= FILE_BYTES:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}")
                out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
            kind = row[at["record_type"]]
            payload = bytes(row[at["payload"]] or b"") if kind != "revisit" else None
            record = render(*(row[at[c]] for c in ("record_id", "record_type", "target_uri", "date", "payload_digest", "payload_length")), payload, row[at["refers_to"]])
            data = gzip_member(record) if self.compress else record
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{self.job}{MANIFEST}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        store, root = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages to archives and back ------------------------------------------------------------------------------------


def _uri_safe(url):
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20]", "%20")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, compress: bool = True) -> None:
    """Writes one record per row into the folder ``path``."""
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("length", F.length("payload").cast("long"))
    shared = rows.where((F.col("length") >= min_bytes) & F.col("id").isNotNull())
    groups = shared.groupBy("sha1", "length").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # written by itself, so that both sides of the join are plain shuffles and a hot payload's partition can be split
    responses = scratch.materialize(groups, "warc-responses")
    marked = rows.join(responses.df, ["sha1", "length"], "left")
    revisit = F.col("response").isNotNull() & (F.col("id") != F.col("response"))
    urn = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))
    out = marked.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _uri_safe(F.col("url")).alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn(F.col("response"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), _base32(F.col("sha1"))).alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )
    out.write.format("warc").option("compress", str(compress).lower()).mode("append").save(path)
    responses.drop()


def _base32(hex_digest):
    """40 hex digits as 32 letters: each five hex digits are four letters of five bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        value = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(letters), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
