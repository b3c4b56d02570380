"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

The reader takes any MPEG 1, 2 or 2.5 stream of layers I to III. It skips ID3v2 and finds ID3v1 tags, resynchronises on a
header whose frame is followed by another fitting header or the end, reads Xing, Info and VBRI tables with their seek
points, holds these against the frames found, and checks the CRC-16 of all frames that carry one. A stream's duration is its number of samples over its rate, both whole
numbers; every frame's offset and first sample are kept for seeking.

The writer stores bytes in silent layer III frames with checksums, of the largest bitrate and for the last frame of
the smallest that is enough: side information of zeros says that a frame's main data is all ancillary, so players
hear silence, and the bytes come back unchanged.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm.common import small_batches, table

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by bitrate index 1 to 14, and Hz by rate index.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int
    bound: int  # the first subband that joint stereo codes once for both channels; 32 if there is none

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        """What doesn't change within a stream."""
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def read_header(raw: bytes) -> Header | None:
    """Of 4 bytes; None if they aren't a header, or one of free format or reserved values."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbits, hertz, padding = KBITS[min(int(version), 2), layer][index - 1], RATES[version][rate], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples * 125 * kbits // hertz + padding
    bound = 4 * ((raw[3] >> 4 & 3) + 1) if raw[3] >> 6 == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbits, hertz, raw[3] >> 6 == 3, length, samples, bound)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, as frames carry it."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _allocation_widths(h: Header) -> list[int]:
    """Layer II: bits of each subband's allocation. Fixed values of the format, by rate and bitrate of a channel."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    kbits = h.kbits if h.mono else h.kbits // 2
    if kbits <= 48:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if h.rate != 48000 and kbits >= 96 else 4)


def protected_bits(data: bytes, at: int, h: Header) -> int:
    """Bits behind the checksum that it covers: side information, or allocations, and in layer II what they select."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * sum(channels if sb < h.bound else 1 for sb in range(32))
    raw = int.from_bytes(data[at + 6 : at + 46], "big")
    bits = chosen = 0
    for sb, width in enumerate(_allocation_widths(h)):
        shared = sb >= h.bound
        for _ in range(1 if shared else channels):
            used = raw >> (320 - bits - width) & (1 << width) - 1 if bits + width <= 320 else 0
            bits += width
            chosen += (channels if shared else 1) * (used > 0)
    return bits + 2 * chosen


def checksum(data: bytes, at: int, h: Header) -> int:
    """The CRC-16 that a frame should carry."""
    bits = protected_bits(data, at, h)
    c = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + bits // 8])
    rest = data[at + 6 + bits // 8 : at + 7 + bits // 8]
    for k in range(bits % 8 if rest else 0):
        one = c >> 15 ^ rest[0] >> 7 - k & 1
        c = (c << 1 ^ 0x8005 * one) & 0xFFFF
    return c


@dataclass
class Stream:
    """What was read: frames as (offset, header, first sample); the table's frame is not among them."""

    frames: list[tuple[int, Header, int]] = field(default_factory=list)
    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    #: The table's seek points, (share of the stream's samples, offset), where it has any, and how many are off.
    points: list[tuple[float, int]] = field(default_factory=list)
    points_off: int = 0
    samples: int = 0
    rate: int = 0
    channels: int = 0
    layer: int = 0
    version: float = 0
    crc_ok: int = 0
    crc_bad: int = 0
    junk: int = 0
    resyncs: int = 0

    def seek(self, sample: int) -> int | None:
        """Offset of the frame that holds a sample, exactly; None if none does."""
        if not 0 <= sample < self.samples:
            return None
        lo, hi = 0, len(self.frames) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.frames[mid][2] <= sample else (lo, mid - 1)
        return self.frames[lo][0]


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Reads the tag at a place; where it ends. Frames that don't fit in are left out."""
    size, major = _synchsafe(data[at + 6 : at + 10]), data[at + 3]
    stop = min(at + 10 + size, len(data))
    here = at + 10
    while major in (3, 4) and here + 10 <= stop and re.fullmatch(rb"[A-Z0-9]{4}", data[here : here + 4]):
        raw = data[here + 4 : here + 8]
        n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        if here + 10 + n > stop:
            break
        tags[data[here : here + 4].decode()] = data[here + 10 : here + 10 + n]
        here += 10 + n
    return stop + 10 * (data[at + 5] >> 4 & 1)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame is a table, and what it says."""
    x = at + 4 + 2 * h.protected + h.side
    name = data[x : x + 4]
    stop = at + h.length
    if name in (b"Xing", b"Info"):
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        values = []
        for bit, size in ((1, 4), (2, 4), (4, 100)):
            values.append(data[x : x + size] if flags & bit and x + size <= stop else None)
            x += size * bool(flags & bit)
        out.table, out.toc = name.decode(), values[2] or b""
        if values[1]:
            out.points = [(i / 100, at + x * int.from_bytes(values[1], "big") // 256) for i, x in enumerate(out.toc)]
    elif data[at + 36 : at + 40] == b"VBRI" and at + 54 <= stop:
        out.table, x = "VBRI", at + 36
        values = [data[x + 14 : x + 18], data[x + 10 : x + 14]]
        count, scale, size, each = struct.unpack(">4H", data[x + 18 : x + 26]) if x + 26 <= stop else (0, 0, 0, 0)
        here, frames = at + h.length, int.from_bytes(values[0], "big")
        for i in range(count if 1 <= size <= 4 and x + 26 + count * size <= stop and frames else 0):
            out.points.append((min(1.0, i * each / frames), here))
            here += scale * int.from_bytes(data[x + 26 + i * size : x + 26 + (i + 1) * size], "big")
    else:
        return False
    out.table_frames, out.table_bytes = (None if v is None else int.from_bytes(v, "big") for v in values[:2])
    return True


def read_stream(data: bytes) -> Stream:
    """Reads any bytes: what fits no frame or tag is counted as junk.

    TAG at byte -128 is an ID3v1 tag, unless a frame begins before it and ends with the stream: then it is of the frame.
    """
    out, at, end, kind = Stream(), 0, len(data), None
    tagged = end >= 128 and data[-128:-125] == b"TAG"
    if tagged:
        end -= 128
    lost = False
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end and max(data[at + 6 : at + 10]) < 128:
            at = min(_id3v2(data, at, out.tags), end)
            continue
        h = read_header(data[at : at + 4])
        whole = h is not None and at + h.length in (end, len(data))
        fits = h is not None and (whole or at + h.length <= end) and (kind is None or h.kind == kind)
        if fits and (kind is None or lost):  # at first, and after junk, the next frame must fit as well
            follower = read_header(data[at + h.length : at + h.length + 4])
            fits = whole or follower is not None and follower.kind == h.kind or data[at + h.length : at + h.length + 3] == b"ID3"
        if not fits:
            found = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end if found < 0 else found)
            found = tag if tag >= 0 else found
            out.junk += (end if found < 0 else found) - at
            out.resyncs += not lost
            lost, at = True, end if found < 0 else found
            continue
        if kind is None:
            kind = h.kind
            out.version, out.layer, out.rate, out.channels = h.version, h.layer, h.rate, 1 if h.mono else 2
        lost = False
        if h.protected:
            good = checksum(data, at, h) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_ok, out.crc_bad = out.crc_ok + good, out.crc_bad + (not good)
        if not (not out.frames and h.layer == 3 and not out.table and _table(data, at, h, out)):
            out.frames.append((at, h, out.samples))
            out.samples += h.samples
        at += h.length
    if tagged and at <= end:
        out.tags["ID3v1"] = data[-128:]
    if out.frames:
        # a point may be as far off as its unit, a 256th of the stream in Xing tables, and a frame
        unit = max(out.table_bytes or 0, 1) // 256 + 2 * max(h.length for _, h, _ in out.frames)
        out.points_off = sum(abs(out.seek(min(out.samples - 1, int(share * out.samples))) - where) > unit for share, where in out.points)
    return out


# ------------------------------------------------------------------ writer

_WRITE_RATE = 32000  # 32 kHz and one channel give the largest frames: 1440 bytes at 320 kbit/s
_SIDE = bytes(17)
_SIZES = [(i + 1, 144 * k * 1000 // _WRITE_RATE) for i, k in enumerate(KBITS[1, 3])]


@lru_cache(maxsize=32)
def _frame_start(index: int) -> bytes:
    """Header, checksum and silent side information of a frame of a bitrate index."""
    head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC4])
    return head + struct.pack(">H", crc16(head[2:] + _SIDE)) + _SIDE


def write_stream(payload: bytes) -> bytes:
    """An MPEG 1 layer III stream that holds the payload: an ID3v2.4 tag with its length and CRC-32, a Xing frame with a table of contents, and silent frames."""
    start = len(_frame_start(1))
    room = _SIZES[-1][1] - start
    frames, offsets, here = [], [], 0
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        index, size = next(x for x in _SIZES if x[1] - start >= len(part))
        frames.append(_frame_start(index) + part + bytes(size - start - len(part)))
        offsets.append(here)
        here += size
    first = _frame_start(_SIZES[6][0])  # 96 kbit/s: 432 bytes, enough for the table
    total, n = here + _SIZES[6][1], len(frames)
    toc = bytes(min(255, 256 * (_SIZES[6][1] + offsets[n * i // 100]) // total) for i in range(100))
    xing = first + b"Xing" + struct.pack(">III", 7, n, total) + toc
    tag = b"bytes\0" + struct.pack(">QI", len(payload), zlib.crc32(payload))
    body = b"PRIV" + _to_synchsafe(len(tag)) + b"\0\0" + tag
    return b"ID3\x04\0\0" + _to_synchsafe(len(body)) + body + xing + bytes(_SIZES[6][1] - len(xing)) + b"".join(frames)


def _to_synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def read_payload(data: bytes, stream: Stream | None = None) -> bytes:
    """The bytes that write_stream stored; ValueError if the stream holds none or they don't agree with their length and CRC-32."""
    stream = stream or read_stream(data)
    tag = stream.tags.get("PRIV", b"")
    if not tag.startswith(b"bytes\0") or len(tag) != 18:
        raise ValueError("the stream has no stored bytes")
    size, crc = struct.unpack(">QI", tag[6:])
    got = b"".join(data[at + 6 + h.side : at + h.length] for at, h, _ in stream.frames)[:size]
    if len(got) != size or zlib.crc32(got) != crc:
        raise ValueError("the stored bytes are damaged")
    return got


def pad(raw: bytes, multiple: int = 64) -> bytes:
    """raw with bytes 0 up to a positive multiple."""
    return raw + bytes(-len(raw) % multiple or (multiple if not raw else 0))


def feature(stream: Stream) -> str:
    """What a stream is: layer, rate, frames, exact samples, table, checksums, junk, and a digest of the seek offsets."""
    seeks = hashlib.md5(",".join(str(at) for at, _, _ in stream.frames).encode()).hexdigest()[:16]
    kbits = sorted({h.kbits for _, h, _ in stream.frames})
    return (
        f"mpeg={stream.version:g};layer={stream.layer};rate={stream.rate};channels={stream.channels};frames={len(stream.frames)};samples={stream.samples};"
        f"kbits={'/'.join(map(str, kbits))};table={stream.table}:{stream.table_frames}:{stream.table_bytes}:{len(stream.points)}:{stream.points_off};crc_ok={stream.crc_ok};crc_bad={stream.crc_bad};junk={stream.junk};seek={seeks}"
    )


# ------------------------------------------------------------------ columns


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media for each row of docs: the text as UTF-8 with bytes 0 up to a positive multiple of 64, in an MPEG stream.

    Null texts count as empty, null ids are kept, repeated rows are each stored, equal texts give equal bytes; other columns are dropped.
    An empty table gives no row; memory follows the longest text.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = docs.select("id").schema.add("n_bytes", "long").add("media", "binary")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for at in range(0, batch.num_rows, 200):
                raws = [(x.as_py() or "").encode() for x in texts[at : at + 200]]
                yield pa.RecordBatch.from_arrays([ids[at : at + 200], pa.array(list(map(len, raws)), pa.int64()), pa.array([write_stream(pad(r)) for r in raws], pa.binary())], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)


PROBED = "version double, layer int, rate int, channels int, n_frames long, samples long, seconds double, vbr_table string, seek_points long, seek_points_off long, crc_ok long, crc_bad long, junk_bytes long, resyncs long, seek_offsets array<long>, feature string"


def probe_media(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id and PROBED for each row: what read_stream finds. Null media count as empty: no frames, 0 samples. Other columns are dropped."""
    media = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = media.select("id").schema
    for x in media.sparkSession.createDataFrame([], PROBED).schema:
        schema = schema.add(x)
    kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for batch in batches:
            ids, column = batch.column("id"), batch.column("media")
            for at in range(0, batch.num_rows, 200):
                rows = []
                for x in column[at : at + 200]:
                    s = read_stream(x.as_py() or b"")
                    rows.append((s.version, s.layer, s.rate, s.channels, len(s.frames), s.samples, s.samples / s.rate if s.rate else 0.0, s.table, len(s.points), s.points_off, s.crc_ok, s.crc_bad, s.junk, s.resyncs, [a for a, _, _ in s.frames], feature(s)))
                yield pa.RecordBatch.from_arrays([ids[at : at + 200], *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return small_batches(media).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest_media(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes and the digests of stored media (id, n_bytes, media): payload read back, its last 64 bytes, the stream, and its feature.

    Null media give null in all these; streams without stored bytes, or with damaged ones, raise ValueError. Repeated rows are
    each read, equal media give equal digests, so ties can't be; other columns are dropped; an empty table gives no row.
    """
    media = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    schema = media.select("id", "n_bytes").schema.add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for x in part.column("media"):
                    data = x.as_py()
                    if data is None:
                        rows.append((None,) * 6)
                        continue
                    stream = read_stream(data)
                    payload = read_payload(data, stream)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return small_batches(media).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(store_texts(table(spark, sf_dir, "documents", "doc_id", "text")))
