"""WARC archives as a PySpark Python data source, for reading and writing.

Reading: the driver plans a partition for each range of SPLIT bytes of a plain file, or of a compressed one whose members name their lengths,
and for each other compressed file. A task parses a record's headers first; predicates on the record's type and other headers are pushed down and decide from
those, so payloads of unwanted records are neither inflated nor decoded, nor read where the record's length is known. With option payload=false none are.

A compressed file has a gzip member per record, as the standard recommends.

Writing: each record is a gzip member of its own whose extra field holds its length (subfield SL), so readers step
over it; other readers see ordinary gzip. Tasks write to names of their own, and the commit renames those of the tasks
that count: retried and speculative tasks leave nothing behind.

archive() writes a table of payloads with revisits: of records with equal payloads of least bytes or more, the one with
the largest key is the response, others revisit it.

Defined results: a null payload is an empty one; null keys are keys as others, less than
any (of rows with equal payload and largest key that with the largest url is the response; rows that are equal in all
three are one record written again, and as it is); a null url has no header and reads back as null; line ends in a url
are percent-encoded; payloads of any length are kept whole; an empty table gives an archive without records.
Extra columns don't take part.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import for_python, new_path

SCHEMA = "record_type string, record_id string, url string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "url": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SPLIT = 64 << 20
HEAD = 4096  # bytes of a member that are read for its head
_MAGIC = b"\x1f\x8b\x08\x04"  # of a gzip member with an extra field
BATCH_BYTES = 4 << 20
#: The profile of revisits with an equal payload, and when all records are dated that have no date.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode(record_type: str, record_id: str, url: str | None, date: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A record. Revisits have the digest and the HTTP headers of their payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {record_type}", f"WARC-Record-ID: <{_line(record_id)}>", f"WARC-Date: {date or DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{_line(refers_to or '')}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SL = struct.Struct("<4BIBBH2sHII")  # magic, method, flags; time; level, system; length of the extra field; id, length, member's and record's bytes


def member(record: bytes) -> bytes:
    """A gzip member that names its own length."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    total = _SL.size + len(body) + 8
    return _SL.pack(0x1F, 0x8B, 8, 4, 0, 4, 255, 12, b"SL", 8, total, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_head(raw: bytes) -> dict[str, str]:
    """Header fields by name in lower case; continuation lines belong to the field before."""
    fields: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def columns_of(fields: dict[str, str]) -> dict[str, str | None]:
    """The columns that headers give."""
    row = {c: fields.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if row[c]:
            row[c] = row[c].removeprefix("<").removesuffix(">")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].partition(":")[2]
    return row


def member_length(raw: bytes) -> int | None:
    """The length of a gzip member that names it, from its first bytes."""
    if len(raw) < _SL.size or not raw.startswith(_MAGIC):
        return None
    own = _SL.unpack(raw[: _SL.size])
    return own[10] if own[7] >= 12 and own[8] == b"SL" and own[10] > _SL.size + 8 else None


def _sized(fs: pafs.FileSystem, path: str) -> bool:
    """Whether the first member of a large file names its length."""
    with fs.open_input_file(path) as file:
        return member_length(file.read(_SL.size)) is not None


class Source:
    """Records of a plain or compressed file, one after another: head() gives the next one's header fields or None, body() its
    block; head() steps over a block that wasn't asked for."""

    def __init__(self, file, start: int, end: int, packed: bool):
        self.file, self.end, self.packed, self.at, self.next = file, end, packed, start, start
        self.rest, self.left = None, None
        if start:
            self.next = self._find_member(start) if packed else self._find(start)

    def _find(self, start: int) -> int:
        """Where the first record at or after start begins."""
        self.file.seek(max(0, start - 4))
        seen, base = self.file.read(1 << 16), max(0, start - 4)
        while True:
            found = -1
            while (found := seen.find(b"\r\n\r\nWARC/", found + 1)) >= 0:
                if self._begins(base + found + 4):
                    return base + found + 4
            more = self.file.read(1 << 16)
            if not more:
                return self.end
            base, seen = base + len(seen) - 16, seen[-16:] + more

    def _find_member(self, start: int) -> int:
        """Where the first member at or after start begins, in a file whose members name their lengths: what looks like one is one if
        another begins where it ends, or the file ends there."""
        self.file.seek(0, 2)
        at, step, size = start, 1 << 16, self.file.tell()
        while at < self.end:
            self.file.seek(at)
            seen = self.file.read(step + _SL.size)
            found = -1
            while (found := seen.find(_MAGIC, found + 1)) >= 0 and found < step:
                self.file.seek(at + found)
                own = member_length(self.file.read(_SL.size))
                if own and at + found + own <= size:
                    self.file.seek(at + found + own)
                    after = self.file.read(_SL.size)
                    if not after or member_length(after):
                        return at + found
            at += step
        return self.end

    def _read(self, n: int) -> bytes:
        """The next bytes of the file, or of a member that names its length."""
        raw = self.file.read(n if self.left is None else min(n, self.left))
        if self.left is not None:
            self.left -= len(raw)
        return raw

    def _begins(self, at: int) -> bool:
        """Whether a record begins there: it has the headers that all have, and ends where the next one begins or the file ends. A
        payload that quotes a record doesn't pass, unless it goes on with another one to the end of its own record."""
        back = self.file.tell()
        self.file.seek(at)
        raw = b""
        while (stop := raw.find(b"\r\n\r\n")) < 0 and len(raw) < 1 << 20 and (more := self.file.read(4096)):
            raw += more
        fields = parse_head(raw[:stop]) if stop >= 0 else {}
        length, ok = fields.get("content-length", ""), False
        if length.isdigit() and {"warc-type", "warc-record-id", "warc-date"} <= set(fields):
            self.file.seek(at + stop + 4 + int(length))
            end = self.file.read(9)
            ok = end == b"\r\n\r\n" or end == b"\r\n\r\nWARC/"
        self.file.seek(back)
        return ok

    def head(self) -> dict[str, str] | None:
        if self.packed and self.rest is not None:
            self._finish()
        self.at = self.next
        if self.at >= self.end:
            return None
        self.file.seek(self.at)
        return self._packed_head() if self.packed else self._plain_head()

    def _plain_head(self) -> dict[str, str] | None:
        raw = b""
        while (stop := raw.find(b"\r\n\r\n")) < 0:
            more = self.file.read(4096)
            if not more:
                return None
            raw += more
        fields = parse_head(raw[:stop])
        self.block, self.length = self.at + stop + 4, int(fields.get("content-length", 0))
        self.next = self.block + self.length + 4
        return fields

    def _packed_head(self) -> dict[str, str] | None:
        first = self.file.read(_SL.size)
        if len(first) < 18:
            return None
        own = member_length(first)
        self.sized = own is not None
        if self.sized:  # a head is in the first bytes; the rest of an unwanted member is never read
            self.next, self.left = self.at + own, own - _SL.size - 8
            self.inflate, raw = zlib.decompressobj(-15), self._read(HEAD)
        else:
            self.left = None
            self.inflate, raw = zlib.decompressobj(31), first + self._read(1 << 16)
        self.record = self.inflate.decompress(raw, 2048)
        while (stop := self.record.find(b"\r\n\r\n")) < 0:
            more = self.inflate.decompress(self.inflate.unconsumed_tail or self._read(HEAD), 2048)
            if not more:
                return None
            self.record += more
        fields = parse_head(self.record[:stop])
        self.block, self.length, self.rest = stop + 4, int(fields.get("content-length", 0)), True
        return fields

    def _finish(self) -> None:
        """To the end of a member that doesn't name its length."""
        if not self.sized:
            while not self.inflate.eof:
                raw = self.inflate.unconsumed_tail or self._read(1 << 16)
                if not raw:
                    break
                self.inflate.decompress(raw, 1 << 20)
            self.next = self.file.tell() - len(self.inflate.unused_data) if self.inflate.eof else self.end
        self.rest = None

    def body(self) -> bytes:
        if not self.packed:
            self.file.seek(self.block)
            return self.file.read(self.length)
        parts = [self.record]
        have = len(self.record)
        while have < self.block + self.length and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self._read(1 << 18)
            if not raw:
                break
            parts.append(self.inflate.decompress(raw, 1 << 20))
            have += len(parts[-1])
        return b"".join(parts)[self.block : self.block + self.length]


_HTTP_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers and payload; a block without headers is all payload."""
    if block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        return head, payload
    return b"", block


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    packed: bool


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)], key=lambda x: x.path):
            if info.type != pafs.FileType.File or posixpath.basename(info.path)[0] in "._":
                continue
            packed = info.path.endswith(".gz")
            whole = packed and (info.size <= SPLIT or not _sized(fs, info.path))
            out += [Range(info.path, 0, info.size, True)] if whole else [Range(info.path, a, min(a + SPLIT, info.size), packed) for a in range(0, info.size, SPLIT)]
        return out

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            ok = x is None if kind == "IsNull" else x is not None and (kind == "IsNotNull" or kind == "EqualTo" and x == value or kind == "In" and x in value or kind == "StringStartsWith" and x.startswith(value))
            if not ok:
                return False
        return True

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            source = Source(file, partition.start, partition.end, partition.packed)
            while (fields := source.head()) is not None:
                row = columns_of(fields)
                if not self._wanted(row):
                    continue
                row |= {"payload_bytes": None, "payload": None}
                if self.payload:
                    http, payload = split_http(source.body())
                    if row["record_type"] == "revisit":
                        found = _HTTP_LENGTH.search(http)
                        row["payload_bytes"] = int(found[1]) if found else None
                    else:
                        row |= {"payload_bytes": len(payload), "payload": payload}
                        if row["payload_digest"] is not None and row["payload_digest"] != digest(payload):
                            raise ValueError(f"{row['record_id']} in {partition.path}: the payload isn't that of its digest")
                        held += len(payload)
                rows.append(row)
                if held > BATCH_BYTES or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        name = f"{self.job}-{uuid.uuid4().hex}.warc.gz"
        empty = True
        with fs.open_output_stream(posixpath.join(path, f"_{name}"), compression=None) as out:
            for batch in iterator:
                kind, key, url, date, refers, payload = (batch.column(c).to_pylist() for c in ("record_type", "record_id", "url", "date", "refers_to", "payload"))
                for k, i, u, d, r, p in zip(kind, key, url, date, refers, payload, strict=True):
                    out.write(member(encode(k, i or "", u, d, p or b"", r)))
                    empty = False
        return Written("" if empty else name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            if m and m.name:
                fs.move(posixpath.join(path, f"_{m.name}"), posixpath.join(path, m.name))
        for info in fs.get_file_info(pafs.FileSelector(path)):
            if posixpath.basename(info.path).startswith(f"_{self.job}-"):  # of this job's tasks that don't count
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name and fs.get_file_info(posixpath.join(path, f"_{m.name}")).type == pafs.FileType.File:
                fs.delete_file(posixpath.join(path, f"_{m.name}"))


class Warc(DataSource):
    """format("warc"): SCHEMA, in either direction."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    for_python(spark, 1000)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


URN = "urn:key:"


def archive(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Writes a record per row of df into the folder path."""
    spark = df.sparkSession
    register(spark)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("_sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    heads = rows.filter("_sha is not null").groupBy("_sha").agg(F.max(F.struct("key", "url")).alias("_head"), F.count("*").alias("_n"))
    joined = rows.join(heads, "_sha", "left")
    first = F.col("_n").isNull() | (F.col("_n") == 1) | (F.col("key").eqNullSafe(F.col("_head.key")) & F.col("url").eqNullSafe(F.col("_head.url")))
    head_id = F.concat(F.lit(URN), F.coalesce(F.col("_head.key").cast("string"), F.lit("")))
    records = joined.select(
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.concat(F.lit(URN), F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("record_id"),
        "url",
        F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.when(~first, head_id).alias("refers_to"),
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload",
    )
    records.write.format("warc").mode("append").save(path)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to of each row of df, as read back from an archive of df."""
    path = new_path(df.sparkSession, "warc")
    archive(df, path, key, url, payload, least)
    found = read(df.sparkSession, path)

    def number(c: str):
        return F.nullif(F.substring(F.col(c), len(URN) + 1, 1000), F.lit("")).cast("long")

    return found.select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
