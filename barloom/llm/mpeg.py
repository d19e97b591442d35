"""Media columns: MPEG audio streams in a binary column.

Reading resynchronises on frame headers (a header counts only when the frame it announces is followed by another header
or the stream's end), parses ID3v1 and ID3v2.2 to 2.4 tags and Xing/Info/VBRI tables, verifies the CRC-16 of protected
frames of all three layers and the tables' seek points against the frames found, and gives exact durations (samples
over rate) with the byte offset of every frame for seeking.

Writing stores arbitrary bytes losslessly: silent MPEG-1 layer III mono frames at 48 kHz whose ancillary bytes - the
format's unit for foreign data - hold the payload. Frames have the bit rate that their share needs, so streams are
variable-bitrate and begin with a Xing table; every frame has a checksum; an ID3v2 tag holds the payload's length.

Cases: null and empty texts are one block of 192 blanks. Null, truncated or undecodable media parse to the whole frames
that they hold, possibly none. Garbage before, between or after frames is skipped and counted. TAG, ID3, Xing, VBRI or a
frame header in a frame's payload is payload. How many payload bytes are missing of those that the stream's own tag
announces is a column, and an error in the query, which reads its own streams. Equal texts give equal bytes. Extra columns are ignored, whatever their names.
Memory is one record's at a time, records being streamed through Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, read_table

BLOCK = 192
#: Fixed values of the format: kbit/s by (MPEG-1?, layer) and index 1..14, samples/s by version bits and index.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Fixed values of layer II: bits of a subband's allocation from the first subband on, by table.
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "lsf": [4] * 4 + [3] * 7 + [2] * 19,
}
SIDE = 17
HEAD = 4 + 2 + SIDE


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    #: The first subband that both channels share (joint stereo of layers I and II).
    bound: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information, which the checksum covers besides the header's last two (layer III)."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first, pad = version == 3, word[2] >> 1 & 1
    kbps, hz = BITRATES[first, layer][index - 1], RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples * 125 * kbps // hz + pad
    return Header(version, layer, not word[1] & 1, kbps, hz, word[3] >> 6 == 3, 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32, length, samples)


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[i >> 3] >> 7 - (i & 7) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def allocation(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a layer II frame."""
    if h.version != 3:
        return ALLOCATION["lsf"]
    each = h.kbps if h.mono else h.kbps // 2
    if each <= 48:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if each <= 80 or h.rate == 48000 else "b"]


def covered_bits(h: Header, body: bytes) -> int:
    """Bits after the checksum that it covers: side information (III), allocations (I, II) and selections (II)."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * 32 if h.mono else 4 * (32 + min(h.bound, 32))
    value, size = int.from_bytes(body), 8 * len(body)
    at = chosen = 0
    for k, n in enumerate(allocation(h)):
        shared = channels == 2 and k >= h.bound
        for _ in range(1 if shared else channels):
            if at + n <= size and value >> size - at - n & (1 << n) - 1:
                chosen += 2 if shared else 1
            at += n
    return at + 2 * chosen


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    crc_bad: int = 0
    skipped: int = 0
    vbr: str = ""
    vbr_at: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    #: (frame, byte after the table's frame began) as the table says, and how far a byte may lie before the frame.
    seeks: list[tuple[int, int]] = field(default_factory=list)
    seek_step: int = 0
    seek_bad: int = 0
    rates: set[int] = field(default_factory=set)
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""
    announced: int | None = None


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def unsafe(data: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(data, (21, 14, 7, 0), strict=True))


def tag_text(data: bytes) -> str:
    """Text of a tag's frame: a byte that names the encoding, then the text."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0] if data else 0, "latin-1")
    return data[1:].decode(kind, "replace").rstrip("\0")


def id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Bytes of the tag at the start; its text frames go to tags."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 0x7F:
        return 0
    version, flags = data[3], data[5]
    size = 10 + unsafe(data[6:10])
    body = data[10:size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = unsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4])
    name, long = (3, 3) if version == 2 else (4, 4)
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        n = unsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + name : at + name + long])
        own = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 2:
            own = own.replace(b"\xff\0", b"\xff")
        if body[at : at + 1] == b"T" and len(own) == n > 1:
            key, _, value = tag_text(own).rpartition("\0")
            tags[key or body[at : at + name].decode("latin-1")] = value.lstrip("\ufeff")
        at += head + n
    return size + (10 if version == 4 and flags & 0x10 else 0)


def seek_table(out: Stream, own: bytes, body: int) -> bool:
    """Reads the frame `own` as a table of a variable-bitrate stream, if it is one; body is where its side information ends."""
    if own[body : body + 4] in (b"Xing", b"Info") and len(own) >= body + 8:
        out.vbr = own[body : body + 4].decode()
        flags, at = int.from_bytes(own[body + 4 : body + 8]), body + 8
        for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
            if flags & bit and at + 4 <= len(own):
                setattr(out, name, int.from_bytes(own[at : at + 4]))
                at += 4
        if flags & 4 and at + 100 <= len(own) and out.vbr_frames and out.vbr_bytes:
            out.seek_step = out.vbr_bytes // 256 + 1
            out.seeks = [(-(-p * out.vbr_frames // 100), x * out.vbr_bytes // 256) for p, x in enumerate(own[at : at + 100])]
        return True
    if own[36:40] == b"VBRI" and len(own) >= 62:
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames, entries, scale, wide, each = struct.unpack(">IIHHHH", own[46:62])
        at = len(own)
        for i in range(entries if wide else 0):
            if 62 + (i + 1) * wide > len(own):
                break
            out.seeks.append((i * each, at))
            at += scale * int.from_bytes(own[62 + i * wide : 62 + (i + 1) * wide])
        out.seek_step = scale * each + 1
        return True
    return False


def parse(data: bytes | None) -> Stream:
    out = Stream()
    data = data or b""
    end = len(data)
    # An ID3v1 tag may begin here; it is one only where no frame covers it.
    tag = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else end
    at = min(id3v2(data, out.tags), end)
    parts: list[bytes] = []
    while at + 4 <= end and (at != tag or tag == end):
        h = header(data[at : at + 4])
        follows = h and (at + h.length in (tag, end) or at + h.length < end and header(data[at + h.length : at + h.length + 4]))
        if not follows:
            stop = tag if at < tag else end
            nxt = data.find(b"\xff", at + 1, stop)
            out.skipped += (nxt if nxt > 0 else stop) - at
            at = nxt if nxt > 0 else stop
            continue
        own = data[at : at + h.length]
        crc = 4 + 2 * h.protected
        body = crc + (h.side if h.layer == 3 else 0)
        if out.frames == 0 and not out.vbr and seek_table(out, own, body):
            out.vbr_at = at
        else:
            if h.protected:
                n = covered_bits(h, own[6:])
                if 6 + (n + 7) // 8 > len(own) or crc16(own[2:4] + own[6 : 6 + (n + 7) // 8], 16 + n) != int.from_bytes(own[4:6]):
                    out.crc_bad += 1
            out.offsets.append(at)
            out.frames += 1
            out.samples += h.samples
            out.rate = h.rate
            out.rates.add(h.kbps)
            parts.append(own[body:])
        at += h.length
    out.skipped += end - at if at < end and at != tag else 0
    if at == tag < end:
        out.tags["id3v1"] = data[-125:-95].rstrip(b"\0 ").decode("latin-1")
    longest = max((b - a for a, b in zip(out.offsets, [*out.offsets[1:], end])), default=0)
    for k, byte in out.seeks:
        if k < len(out.offsets) and abs(out.offsets[k] - out.vbr_at - byte) > out.seek_step + longest:
            out.seek_bad += 1
    known = out.tags.get("payload_bytes", "")
    out.payload = b"".join(parts)
    if known.isascii() and known.isdigit():
        out.announced = int(known)
        out.payload = out.payload[: out.announced]
    return out


def frame(index: int, content: bytes) -> bytes:
    """An MPEG-1 layer III mono frame at 48 kHz with checksum; its side information says that it is silent."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(SIDE)
    size = 3 * BITRATES[True, 3][index - 1] - HEAD
    return head + crc16(head[2:] + side).to_bytes(2) + side + content.ljust(size, b"\0")


def store(payload: bytes) -> bytes:
    """A whole stream: ID3v2 tag, Xing table, frames."""
    room = [3 * k - HEAD for k in BITRATES[True, 3]]
    whole, rest = divmod(len(payload), room[-1])
    shares = [(14, payload[i * room[-1] : (i + 1) * room[-1]]) for i in range(whole)]
    if rest:
        shares.append((next(i for i, r in enumerate(room, 1) if r >= rest), payload[whole * room[-1] :]))
    frames = [frame(i, x) for i, x in shares]
    first = 3 * BITRATES[True, 3][8]
    total = first + sum(map(len, frames))
    marks, at, k = [], first, 0
    for percent in range(100):
        while k < len(frames) and k * 100 < percent * len(frames):
            at += len(frames[k])
            k += 1
        marks.append(min(255, at * 256 // total))
    xing = frame(9, b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(marks))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\x00\x00" + syncsafe(len(tag)) + tag + xing + b"".join(frames)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, payload_missing long, frames int, crc_errors int, seek_errors int, skipped_bytes long, seek_offsets array<long>"


def describe(media: bytes | None) -> dict:
    s = parse(media)
    offsets = struct.pack(f"<{len(s.offsets)}q", *s.offsets)
    feature = f"layer3 frames={s.frames} samples={s.samples}/{s.rate} vbr={s.vbr}:{s.vbr_frames}:{s.vbr_bytes} seek_errors={s.seek_bad} kbps={'/'.join(map(str, sorted(s.rates)))} crc_errors={s.crc_bad} skipped={s.skipped} seek_crc32={zlib.crc32(offsets)}"
    return {
        "payload_bytes": len(s.payload),
        "payload_sha256": hashlib.sha256(s.payload).hexdigest(),
        "tail_crc32": zlib.crc32(s.payload[-16:]),
        "media_bytes": len(media or b""),
        "media_sha256": hashlib.sha256(media or b"").hexdigest(),
        "feature": feature,
        "duration_samples": s.samples,
        "sample_rate": s.rate,
        "payload_missing": max(0, (s.announced or 0) - len(s.payload)),
        "frames": s.frames,
        "crc_errors": s.crc_bad,
        "seek_errors": s.seek_bad,
        "skipped_bytes": s.skipped,
        "seek_offsets": s.offsets,
    }


def features(media: DataFrame) -> DataFrame:
    """Rows of media (doc_id, n_bytes, media) with what :func:`describe` reads back from the stored bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, "
    schema = to_arrow_schema(StructType.fromDDL(kept + FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                rows = [describe(m) for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "n_bytes": n} | r for d, n, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), rows, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, kept + FEATURES)


def op2_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = persisted(encode(read_table(spark, sf_dir, "documents")), "mpeg")
    short = F.raise_error(F.concat(F.col("payload_missing").cast("string"), F.lit(" payload bytes missing")))
    return features(stored).withColumn("payload_missing", F.when(F.col("payload_missing") > 0, short.cast("long")).otherwise(F.lit(0).cast("long")))
