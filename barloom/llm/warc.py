"""WARC archives as a Python data source of Spark, to read and to write.

Reading (`spark.read.format("warc").load(path)`) plans partitions of whole files, and of parts of large ones where the
file has an index of record places beside it. Conditions on the record type and on headers are pushed down. A record's
headers are parsed first; if they fail a condition, its block is not decoded: it is sought past in plain files, and in
compressed ones when the member says its length (the "sl" field of the gzip header), else inflated and dropped.
Option `payload`: "full" (default), "digest" (length and SHA-1 alone, the bytes stay in the task) or "none" (blocks are
never decoded). A payload that does not match the digest in its header is an error.

Writing (`df.write.format("warc").mode("append").save(path)`) gives each task files of one gzip member a record, with
lengths in the member's header and an index beside the file. Files are written under names of their own in a staging
folder and moved when all tasks are done, so that attempts of lost executors leave nothing that is read.

:func:`archive` stores pages so that equal payloads are stored once: one page is the response, others revisit it.

Files are opened through pyarrow's file systems (local and shared mounts, hdfs, s3, gs), named by URI.

Cases: null payloads are empty. Rows that are equal in all have a record each. A null page id is the smallest; a null url
has no WARC-Target-URI. Line ends and other control characters in a header are percent-encoded. Empty tables make archives
without records. Very long payloads are held one at a time. A file that ends within a record, or with anything but a
record where one should begin, is an error. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import discard, hub_join, persisted, read_table, shared_dir, text_of

#: Columns that are headers of their own, by header.
NAMED = {"record_id": "warc-record-id", "warc_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "refers_to_uri": "warc-refers-to-target-uri", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
SCHEMA = ", ".join(f"{c} string" for c in NAMED) + ", content_length long, headers map<string,string>, payload binary, payload_bytes long, payload_sha1 string"
RECORD = "record_id string, warc_type string, target_uri string, refers_to string, refers_to_uri string, payload_digest string, extra map<string,string>, payload binary"
CHUNK = 1 << 16
#: Bytes of headers that a record may have.
HEAD_BYTES = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


class Stream:
    """The decoded bytes of an archive, forward only; `at` is the file's offset of the member or byte that comes next."""

    def __init__(self, f, packed: bool, at: int = 0):
        self.f, self.packed = f, packed
        self.raw, self.buf = b"", b""
        self.end = False
        self.inflate = None
        self.member: tuple[int, int, int] | None = None
        self.seek(at)

    def seek(self, at: int) -> None:
        self.f.seek(at)
        self.place, self.raw, self.buf, self.inflate, self.member = at, b"", b"", None, None

    @property
    def at(self) -> int:
        """Where in the file the next decoded byte begins; inside a member, where the member begins."""
        if not self.packed:
            return self.place - len(self.buf)
        if self.inflate is not None or self.buf:
            return self.member[0]
        return self.place - len(self.raw)

    def more(self, n: int = CHUNK) -> bytes:
        out = self.f.read(n)
        self.place += len(out)
        return out

    def fill(self) -> bool:
        """Decodes some more; False at the end of the file."""
        if not self.packed:
            got = self.more()
            self.buf += got
            return bool(got)
        if self.inflate is None:
            while len(self.raw) < 24 and (got := self.more()):
                self.raw += got
            if not self.raw:
                return False
            if self.raw[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at {self.place - len(self.raw)}")
            known = self.raw[3] & 4 and self.raw[12:16] == b"sl\x08\x00"
            packed, whole = struct.unpack_from("<II", self.raw, 16) if known else (0, 0)
            self.member = (self.place - len(self.raw), packed, whole)
            self.inflate, self.done = zlib.decompressobj(31), 0
        fed = self.raw = self.raw or self.more()
        out = self.inflate.decompress(fed, CHUNK)
        if not fed and not out and not self.inflate.eof:
            raise ValueError(f"the file ends in the member at {self.member[0]}")
        self.done += len(out)
        self.buf += out
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        return True

    def head(self) -> bytes | None:
        """The bytes up to an empty line; None at the end of the file. Line ends between records are passed over."""
        while True:
            self.buf = self.buf.lstrip(b"\r\n")
            if not self.buf:
                if not self.fill():
                    return None
                continue
            cut = self.buf.find(b"\r\n\r\n")
            if cut >= 0:
                out, self.buf = self.buf[:cut], self.buf[cut + 4 :]
                return out
            if len(self.buf) > HEAD_BYTES or not self.fill():
                raise ValueError(f"no end of the headers at {self.at}")

    def take(self, n: int) -> bytes:
        """n decoded bytes."""
        parts, have = [self.buf], len(self.buf)
        self.buf = b""
        while have < n:
            if not self.fill():
                raise ValueError("the file ends in a record")
            parts.append(self.buf)
            have += len(self.buf)
            self.buf = b""
        out = b"".join(parts)
        self.buf = out[n:]
        return out[:n]

    def skip(self, n: int) -> None:
        """Passes over n decoded bytes, undecoded where their length in the file is known."""
        if not self.packed and n > len(self.buf):
            self.seek(self.place - len(self.buf) + n)
            return
        # A member that holds the rest of this record and the line ends after it.
        if self.inflate is not None and self.member[1] and self.member[2] - (self.done - len(self.buf)) == n + 4:
            self.seek(self.member[0] + self.member[1])
            return
        while n > len(self.buf):
            n -= len(self.buf)
            self.buf = b""
            if not self.fill():
                raise ValueError("the file ends in a record")
        self.buf = self.buf[n:]


def parse_head(head: bytes) -> dict[str, str]:
    """Headers of a record by lower-cased name; folded lines are joined, of repeated ones the first holds."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record: {first[:40]!r}")
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out.setdefault(name, value.strip())
    return out


def body_of(block: bytes, kind: str | None) -> bytes:
    """The payload of a block: what follows the HTTP headers where it has such, its chunks joined."""
    if not (kind or "").replace(" ", "").lower().startswith("application/http"):
        return block
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return b""
    if not re.search(rb"\r\ntransfer-encoding:[ \t]*chunked", head, re.I):
        return body
    out = []
    while (cut := body.find(b"\r\n")) >= 0 and re.fullmatch(rb"[0-9A-Fa-f]+", size := body[:cut].split(b";")[0].strip()) and int(size, 16):
        n = int(size, 16)
        out.append(body[cut + 2 : cut + 2 + n])
        body = body[cut + 2 + n + 2 :]
    return b"".join(out)


def known(f: Filter, of: Callable[[str], object]) -> bool | None:
    """What a pushed condition says of a record's headers; None as in SQL."""
    if isinstance(f, Not):
        inner = known(f.child, of)
        return None if inner is None else not inner
    x = of(f.attribute[0])
    if isinstance(f, (IsNull, IsNotNull)):
        return (x is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, In):
        return True if x in f.value else (None if None in f.value else False)
    tests = {EqualTo: lambda: x == f.value, GreaterThan: lambda: x > f.value, GreaterThanOrEqual: lambda: x >= f.value, LessThan: lambda: x < f.value, LessThanOrEqual: lambda: x <= f.value, StringStartsWith: lambda: x.startswith(f.value), StringEndsWith: lambda: x.endswith(f.value), StringContains: lambda: f.value in x}
    return None if getattr(f, "value", x) is None else tests[type(f)]()


#: Conditions that :func:`known` judges.
JUDGED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


def judged(f: Filter) -> bool:
    if isinstance(f, Not):
        return judged(f.child)
    # Spark compares strings by their bytes, as code points stand in Python.
    return isinstance(f, JUDGED) and len(f.attribute) == 1 and f.attribute[0] in {*NAMED, "content_length"}


@dataclass
class Ranges(InputPartition):
    """(file, first offset, offset before which records begin or None) of one task."""

    parts: list

    def __init__(self, parts: list):
        self.parts = parts


@dataclass
class Counted:
    """What a task did, for tests: records seen, blocks decoded."""

    seen: int = 0
    decoded: int = 0


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "full")
        if self.payload not in ("full", "digest", "none"):
            raise ValueError(f"payload: {self.payload}")
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if judged(f):
                self.filters.append(f)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        fs, at = store(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        every = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].split("/") if x)
        return sorted((x.path, x.size) for x in every if x.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and not hidden(x.path))

    def partitions(self) -> list[InputPartition]:
        """Files packed up to `partition_bytes`; larger ones cut at places that their index names."""
        fs, _ = store(self.path)
        cuts: list[tuple[str, int, int | None, int]] = []
        for name, size in self.files():
            places = [0]
            if size > self.bytes and fs.get_file_info(f"{name}.places").type == pafs.FileType.File:
                with fs.open_input_stream(f"{name}.places") as f:
                    for p in json.loads(f.read()):
                        if p - places[-1] >= self.bytes:
                            places.append(p)
            cuts += [(name, a, z, (z or size) - a) for a, z in zip(places, [*places[1:], None], strict=True)]
        out, held, total = [], [], 0
        for *part, size in cuts:
            if held and total + size > self.bytes:
                out.append(Ranges(held))
                held, total = [], 0
            held.append(tuple(part))
            total += size
        return [*out, Ranges(held)]

    def records(self, fs: pafs.FileSystem, name: str, begin: int, end: int | None, count: Counted) -> Iterator[tuple]:
        with fs.open_input_file(name) as f:
            s = Stream(f, name.endswith(".gz"), begin)
            while True:
                s.buf = s.buf.lstrip(b"\r\n")
                if not s.buf and end is not None and s.at >= end:
                    return
                try:
                    head = s.head()
                    if head is None:
                        return
                    h = parse_head(head)
                    length = int(h["content-length"])
                    count.seen += 1
                    named = {c: h.get(x) for c, x in NAMED.items()} | {"content_length": length}
                    if not all(known(x, named.get) for x in self.filters):
                        s.skip(length)
                        continue
                    body = n = digest = None
                    if self.payload == "none":
                        s.skip(length)
                    else:
                        count.decoded += 1
                        body = body_of(s.take(length), h.get("content-type"))
                        n, digest = len(body), base32_sha1(body)
                        said = re.fullmatch(r"sha1:([A-Z2-7]{32})", h.get("warc-payload-digest", ""))
                        if said and said[1] != digest and h.get("warc-type") != "revisit":
                            raise ValueError(f"the payload of {h.get('warc-record-id')} does not match its digest")
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{name}, near {s.at}: {e}") from e
                yield (*named.values(), h, body if self.payload == "full" else None, n, digest)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.path)
        kinds = pa.schema([(c, pa.string()) for c in NAMED] + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string())])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array([list(x.items()) for x in c] if f.name == "headers" else c, f.type) for c, f in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=kinds)

        for name, begin, end in partition.parts:
            for r in self.records(fs, name, begin, end, Counted()):
                rows.append(r)
                size += 500 + len(r[-3] or b"")
                if size >= 8 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list


def clean(x: str) -> str:
    """A header's value without control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {clean(v)}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose header tells both lengths where 32 bits hold them."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(len(data), len(body) + 24) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body) + 24, len(data)) + body


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 1 << 30))
        self.place_bytes = int(options.get("place_bytes", 16 << 20))
        self.level = int(options.get("level", 6))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = store(self.staging)
        fs.create_dir(at)
        names: list[str] = []
        out = None
        size = 0
        places: list[int] = []

        def close() -> None:
            if out is not None:
                out.close()
                with fs.open_output_stream(f"{at}/{names[-1]}.places") as f:
                    f.write(json.dumps(places).encode())

        for b in iterator:
            for r in b.to_pylist():
                if out is None or size >= self.file_bytes:
                    close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size, places = fs.open_output_stream(f"{at}/{names[-1]}", compression=None), 0, []
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", names[-1]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size += out.write(member(info, self.level))
                if size - (places[-1] if places else 0) >= self.place_bytes:
                    places.append(size)
                size += out.write(member(self.record(r), self.level))
        close()
        return Written(names)

    def record(self, r: dict) -> bytes:
        revisit = r["warc_type"] == "revisit"
        body = r["payload"] or b""
        block = b"" if revisit else HTTP % len(body) + body
        digest = r["payload_digest"] if revisit else f"sha1:{base32_sha1(body)}"
        headers = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", self.date), ("WARC-Target-URI", r["target_uri"]), ("WARC-Payload-Digest", digest)]
        if revisit:
            headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", r["refers_to"]), ("WARC-Refers-To-Target-URI", r["refers_to_uri"])]
        else:
            headers += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
        return record([*headers, ("Content-Type", "application/http;msgtype=response"), *(r["extra"] or [])], block)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = store(self.staging)
        to = posixpath.dirname(at)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{at}/{name}.places", f"{to}/{name}.places")
            fs.move(f"{at}/{name}", f"{to}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = store(self.staging)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to, not overwritten")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, and lets Spark push conditions down to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def urn(*parts: Column) -> Column:
    """A record id made of what the parts say."""
    h = F.md5(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts]))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def archive(pages: DataFrame, path: str, revisit_from: int = 0, file_bytes: int = 1 << 30) -> None:
    """Appends a record for every row of pages (page_id, url, html) to the archives at path.

    Of rows with equal payloads of at least revisit_from bytes, the one with the largest page_id (then url) is the
    response; the others revisit it. Payloads are equal by their SHA-256. Only one row of equal payloads is shuffled with
    its payload; what revisits need is counted without it, so that no group, however large, is gathered.
    """
    register(pages.sparkSession)
    base = pages.select("page_id", "url", text_of("html").alias("html"))
    base = base.withColumn("sha", F.when(F.octet_length("html") >= revisit_from, F.sha2(F.col("html").cast("binary"), 256)))
    shared = base.where("sha is not null")
    kept = shared.groupBy("sha").agg(F.max(F.struct("page_id", "url", "html")).alias("x")).select("sha", "x.*")
    tagged = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("X-Page-Id"), F.col(c).cast("string")))
    none = F.lit(None).cast("string")
    written = lambda df, record_id: df.select(record_id.alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), none.alias("refers_to"), none.alias("refers_to_uri"), none.alias("payload_digest"), tagged("page_id").alias("extra"), F.col("html").cast("binary").alias("payload"))
    records = written(kept, urn(F.lit("response"), F.col("sha")))
    if revisit_from > 0:
        records = records.unionByName(written(base.where("sha is null"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))))

    # Rows that are equal in all are interchangeable: their number is enough.
    digest = F.concat(F.lit("sha1:"), base32(F.sha1(F.col("html").cast("binary"))))
    light = persisted(shared.select("sha", "page_id", "url", digest.alias("digest")).groupBy("sha", "page_id", "url", "digest").agg(F.count("*").alias("n")), "copies")
    groups = light.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("rows")).where("rows > 1").select("sha", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"))
    copies = hub_join(light, groups, "sha")
    is_top = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    spare = copies.withColumn("spare", F.col("n") - is_top.cast("long")).where("spare > 0")
    each = spare.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("spare")))).repartition(F.xxhash64("sha", "page_id", "url", "copy"))
    revisits = each.select(urn(F.lit("revisit"), F.col("sha"), F.col("page_id"), F.col("url"), F.col("copy")).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"), urn(F.lit("response"), F.col("sha")).alias("refers_to"), F.col("top_url").alias("refers_to_uri"), F.col("digest").alias("payload_digest"), tagged("page_id").alias("extra"), F.lit(None).cast("binary").alias("payload"))
    records.unionByName(revisits).write.format("warc").mode("append").option("file_bytes", file_bytes).save(path)
    discard(light)


def base32(sha1: Column) -> Column:
    """The upper-case base32 of a SHA-1 in hexadecimal: eight groups of 20 bits, each four letters of five bits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    group = lambda i: F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substring(letters, F.shiftright(group(i), s).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for s in (15, 10, 5, 0)])


def page_records(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives at path; payloads are decoded for responses alone."""
    register(spark)
    read = lambda payload, what: spark.read.format("warc").option("payload", payload).load(path).where(F.col("warc_type") == what)
    page = F.col("headers")["x-page-id"].cast(kind)
    full = persisted(read("digest", "response").select("record_id", page.alias("page_id"), "payload_bytes", "payload_sha1"), "responses")
    out = full.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    revisits = read("none", "revisit").select(F.col("refers_to").alias("record_id"), page.alias("page_id"))
    to = full.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"))
    return out.unionByName(hub_join(revisits, to, "record_id").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    return page_records(spark, path, pages.schema["page_id"].dataType.simpleString())


OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, max(page_id) OVER (PARTITION BY b) AS top FROM p),
d AS (SELECT *, CAST(unhex(s) AS BIT)::VARCHAR AS bits FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * (16 >> j))) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
