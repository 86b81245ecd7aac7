"""MPEG audio media columns: write, resynchronise, parse and index Layer III streams.

``store`` keeps any payload losslessly as the ancillary bytes of silent MPEG-1 Layer III frames (32 kHz, mono,
checksums on, bitrate chosen per frame), behind an ID3v2.3 tag and a variable-bitrate (Xing) frame. ``inspect``
reads any MPEG-1/2/2.5 stream of layers I to III: it skips tags (ID3v2, ID3v1, APE), finds the first header that a
second header confirms, walks the frames, searches again where a header is lost, verifies CRC-16 (layer I: header and bit
allocation; II: these and the selection of scale factors; III: header and side information), reads Xing, Info and VBRI tables
with their seek points, and returns exact samples and the offset of each frame.

A null payload is an empty one. Rows are independent; equal payloads, repeated rows among them, give equal streams. A stream
without frames has 0 samples and no offsets; a long text has many frames; an empty table gives an empty one. Other columns stay;
those called like an added one are replaced, and any other name is safe.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, Hz by rate index.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of MPEG frames: polynomial 8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The same over the first bits of the data."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        top = crc >> 15 ^ data[k // 8] >> 7 - k % 8 & 1
        crc = (crc << 1 ^ 0x8005 if top else crc << 1) & 0xFFFF
    return crc


# Fixed values of ISO/IEC 11172-3 and 13818-3: widths of the layer II bit allocation by subband, as (width, subbands).
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def covered_bits(h: Header, audio: bytes) -> int:
    """How many bits after the checksum it covers, besides the two header bytes; audio starts behind the checksum."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + min(32, h.bound))
    each = h.kbps // channels
    table = "low" if h.version != 1 else ("d" if h.hz == 32000 else "c") if each <= 48 else "b" if each >= 96 and h.hz != 48000 else "a"
    widths = [w for w, n in ALLOCATION[table] for _ in range(n)]
    value, size, at, used = int.from_bytes(audio[:64], "big"), 8 * len(audio[:64]), 0, 0
    for k, w in enumerate(widths):
        shared = k >= h.bound and channels == 2
        for _ in range(1 if shared else channels):
            at += w
            if at <= size and value >> (size - at) & ((1 << w) - 1):
                used += channels if shared else 1
    return at + 2 * used


class Header:
    """The 4 header bytes of a frame; ``ok`` tells whether they are one."""

    __slots__ = ("ok", "version", "layer", "protected", "kbps", "hz", "size", "samples", "side", "mono", "bound")

    def __init__(self, raw: bytes):
        word = int.from_bytes(raw, "big")
        version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
        layer = {1: 3, 2: 2, 3: 1}.get(word >> 17 & 3)
        rate, speed = word >> 12 & 15, word >> 10 & 3
        self.ok = len(raw) == 4 and word >> 21 == 0x7FF and version is not None and layer is not None and 0 < rate < 15 and speed < 3
        if not self.ok:
            return
        self.version, self.layer, self.protected = version, layer, not word >> 16 & 1
        self.kbps, self.hz, self.mono = KBPS[1 if version == 1 else 2, layer][rate], HZ[version][speed], word >> 6 & 3 == 3
        self.bound = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32  # first subband that joint stereo shares
        pad = word >> 9 & 1
        if layer == 1:
            self.samples, self.size = 384, (12000 * self.kbps // self.hz + pad) * 4
        else:
            self.samples = 576 if layer == 3 and version != 1 else 1152
            self.size = self.samples // 8 * 1000 * self.kbps // self.hz + pad
        self.side = 0 if layer < 3 else (17 if self.mono else 32) if version == 1 else (9 if self.mono else 17)


_headers: dict[bytes, Header] = {}
_crcs: dict[bytes, int] = {}


def header(raw: bytes) -> Header:
    if (h := _headers.get(raw)) is None:
        if len(_headers) > 4096:
            _headers.clear()
        h = _headers[raw] = Header(raw)
    return h


def checksum(covered: bytes) -> int:
    if (c := _crcs.get(covered)) is None:
        if len(_crcs) > 4096:
            _crcs.clear()
        c = _crcs[covered] = crc16(covered)
    return c


_SIZES = [(9 * k // 2, i) for i, k in enumerate(KBPS[1, 3]) if k]  # bytes of a frame at 32 kHz, by bitrate index
_ROOM = 4 + 2 + 17


def _frame(index: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 0x08, 0xC0))
    side = bytes(17)
    size = 9 * KBPS[1, 3][index] // 2
    return head + checksum(head[2:] + side).to_bytes(2, "big") + side + body.ljust(size - _ROOM, b"\0")


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """An MPEG stream that holds the payload; its length stands in a TXXX field of the tag."""
    frames, at = [], 0
    largest, index = _SIZES[-1]
    while len(payload) - at > largest - _ROOM:
        frames.append(_frame(index, payload[at : at + largest - _ROOM]))
        at += largest - _ROOM
    if at < len(payload):
        frames.append(_frame(next(i for s, i in _SIZES if s - _ROOM >= len(payload) - at), payload[at:]))
    total = sum(map(len, frames))
    table = bytearray()
    for k in range(100):
        before = min(len(frames) - 1, k * len(frames) // 100) if frames else 0
        table.append(min(255, before * largest * 256 // max(total, 1)))
    vbr = next(i for s, i in _SIZES if s - _ROOM >= 120)
    first = _frame(vbr, b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(table))
    field = b"\0payload_bytes\0" + str(len(payload)).encode()
    field = b"TXXX" + struct.pack(">IH", len(field), 0) + field
    return b"ID3\x03\0\0" + _syncsafe(len(field)) + field + first + b"".join(frames)


def read_stream(media: bytes) -> dict:
    """Tags, frames and checks of a stream, and the bytes after the side information of its Layer III frames."""
    at, tags = 0, {}
    while media[at : at + 3] == b"ID3" and len(media) >= at + 10:
        size = sum((b & 0x7F) << s for b, s in zip(media[at + 6 : at + 10], (21, 14, 7, 0)))
        end, k = at + 10 + size, at + 10
        while k + 10 <= end and media[k : k + 4].strip(b"\0"):
            n = int.from_bytes(media[k + 4 : k + 8], "big")
            name, body = media[k : k + 4].decode("latin-1"), media[k + 11 : k + 10 + n].decode("latin-1")
            if name == "TXXX":
                name, _, body = body.partition("\0")
            tags[name] = body
            k += 10 + n
        at = end + (10 if media[at + 5 : at + 6] and media[at + 5] & 0x10 else 0)
    stop = len(media)
    if stop - at >= 128 and media[stop - 128 : stop - 125] == b"TAG":
        stop -= 128
        tags.setdefault("TIT2", media[stop + 3 : stop + 33].rstrip(b"\0 ").decode("latin-1"))
    if stop - at >= 32 and media[stop - 32 : stop - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", media[stop - 20 : stop - 8])
        stop = max(at, stop - size - (32 if flags & 0x80000000 else 0))
    offsets, bodies, table = [], [], None
    samples = checked = wrong = skipped = kbit = 0
    hz, sure = 0, False
    while at + 4 <= stop:
        h = header(media[at : at + 4])
        fits = h.ok and h.size > 4 and at + h.size <= stop
        if fits and not sure:  # a second header, or the end, must confirm the first
            nxt = header(media[at + h.size : at + h.size + 4]) if at + h.size + 4 <= stop else None
            fits = nxt is None and at + h.size == stop or nxt is not None and nxt.ok and (nxt.version, nxt.layer, nxt.hz) == (h.version, h.layer, h.hz)
        if not fits:
            nxt = media.find(b"\xff", at + 1, stop)
            nxt = stop if nxt < 0 else nxt
            skipped += nxt - at
            at, sure = nxt, False
            continue
        sure, frame = True, media[at : at + h.size]
        data = 4 + 2 * h.protected + h.side
        if h.protected:
            bits = covered_bits(h, frame[6:])
            covered = frame[2:4] + frame[6 : 6 + -(-bits // 8)]
            checked += 1
            wrong += (crc16_bits(covered, 16 + bits) if bits % 8 else checksum(covered)) != int.from_bytes(frame[4:6], "big")
        if not offsets and table is None and frame[data : data + 4] in (b"Xing", b"Info"):
            flags, k = int.from_bytes(frame[data + 4 : data + 8], "big"), data + 8
            table = {"kind": frame[data : data + 4].decode()}
            for bit, name, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    table[name] = frame[k : k + width] if name == "toc" else int.from_bytes(frame[k : k + width], "big")
                    k += width
        elif not offsets and table is None and frame[36:40] == b"VBRI":
            table = {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
            n, scale, width = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58))
            table["sizes"] = [scale * int.from_bytes(frame[k : k + width], "big") for k in range(62, 62 + n * width, width)] if width else []
        else:
            offsets.append(at)
            samples += h.samples
            kbit += h.kbps
            hz = hz or h.hz
            if h.layer == 3:
                bodies.append(frame[data:])
        at += h.size
    return {"tags": tags, "table": table, "offsets": offsets, "samples": samples, "hz": hz, "checked": checked, "wrong": wrong, "skipped": skipped + max(0, stop - at), "kbps": kbit / len(offsets) if offsets else 0.0, "data": b"".join(bodies)}


def seek_points(table: dict) -> list[int]:
    """Bytes after the table's frame at which its points lie: a hundredth of the duration each (Xing), or a group of frames (VBRI)."""
    if "sizes" in table:
        return [sum(table["sizes"][:k]) for k in range(len(table["sizes"]))]
    return [b * table["bytes"] // 256 for b in table["toc"]] if "toc" in table and "bytes" in table else []


def payload_of(text: bytes | None) -> bytes:
    """The bytes with zero bytes up to a positive multiple of 64."""
    raw = text or b""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


PIECE = 64


def _mapped(df: DataFrame, columns: list[str], added: list[T.StructField], row) -> DataFrame:
    """Add fields that ``row`` computes from the columns of a row; 64 rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name for f in added}
    others = [c for c in df.columns if c not in names]
    kinds = [f.type for f in to_arrow_schema(T.StructType(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                at = {c: part.column(part.schema.get_field_index(c)) for c in {*others, *columns}}
                found = [row(*x) for x in zip(*(at[c].to_pylist() for c in columns))]
                new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([at[c] for c in others] + new, names=[*others, *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in others] + added))


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add the stored form of the padded text as a binary column; the text column is replaced by its length ``n_bytes``."""
    others = [c for c in df.columns if c not in (text, "n_bytes", media)]
    rows, names = numbered(df.select(*others, F.col(text).cast("binary").alias(text)))
    out = _mapped(rows, [names[text]], [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())], lambda x: (len(x or b""), write_stream(payload_of(x))))
    return out.select(*(F.col(names[c]).alias(c) for c in others), "n_bytes", media)


INSPECTED = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("samples", T.LongType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("duration_us", T.LongType()),
    T.StructField("frame_offsets", T.ArrayType(T.LongType())),
    T.StructField("vbr_kind", T.StringType()),
    T.StructField("vbr_frames", T.LongType()),
    T.StructField("seek_points", T.ArrayType(T.LongType())),
    T.StructField("crc_checked", T.LongType()),
    T.StructField("crc_wrong", T.LongType()),
    T.StructField("skipped_bytes", T.LongType()),
    T.StructField("mean_kbps", T.DoubleType()),
]


def _inspected(media: bytes | None) -> tuple:
    s = read_stream(media or b"")
    size = s["tags"].get("payload_bytes", "")
    data = s["data"][: int(size)] if size.isdigit() else s["data"]
    table = s["table"] or {}
    micros = (s["samples"] * 1_000_000 + s["hz"] // 2) // s["hz"] if s["hz"] else 0
    return data, s["samples"], s["hz"], micros, s["offsets"], table.get("kind"), table.get("frames"), seek_points(table), s["checked"], s["wrong"], s["skipped"], s["kbps"]


def inspect(df: DataFrame, media: str = "media") -> DataFrame:
    """Add what a stream holds: payload, exact samples and duration, frame offsets, table, checks."""
    return _mapped(df, [media], INSPECTED, _inspected)


DIGEST = [T.StructField(n, T.LongType() if k == "l" else T.StringType()) for n, k in (("n_bytes", "l"), ("payload_bytes", "l"), ("payload_sha256", "s"), ("tail_crc32", "l"), ("media_bytes", "l"), ("media_sha256", "s"), ("feature", "s"))]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digests of the stored text of each row, all taken from the stored bytes: ``store`` and ``inspect`` in one step."""

    def row(text: bytes | None) -> tuple:
        media = write_stream(payload_of(text))
        data, samples, hz, micros, offsets, kind, frames, points, checked, wrong, skipped, kbps = _inspected(media)
        seek = zlib.crc32(struct.pack(f">{len(offsets)}Q", *offsets))
        feature = f"{kind}:frames={frames};samples={samples};hz={hz};us={micros};kbps={kbps:.3f};crc={checked - wrong}/{checked};skipped={skipped};seek={seek:08x}"
        return len(text or b""), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    return _mapped(docs.select("doc_id", F.col("text").cast("binary").alias("text")), ["text"], DIGEST, row).drop("text")
