"""MPEG audio columns: writing bytes into valid frames, and reading any stream's tags, tables, checksums and offsets.

A payload is carried losslessly as the ancillary data of silent MPEG-1 Layer III frames: side information of zeros
says that no main data is used, so a decoder plays silence and skips the rest of each frame. Reading makes no such
assumption: it skips tags, finds frame headers again after damage, checks CRCs, reads Xing, Info and VBRI tables and
counts samples, whatever version, layer and sampling rate the stream has.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1 or not, layer), index 1 to 14; Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1 ^ (0x8005 if x & 0x8000 else 0)) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    x = 0xFFFF
    for b in data:
        x = (x << 8 ^ _CRC[(x >> 8) ^ b]) & 0xFFFF
    return x


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    length: int  # bytes of the frame
    samples: int
    side: int  # bytes of Layer III side information


_headers: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    """None where the bytes are no frame header, and for free bit rates, whose frames have no known length."""
    if four in _headers:
        return _headers[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        index, rate = four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < index < 15 and rate != 3 and four[3] & 3 != 2:
            first = version == 3
            kbps, hz, pad = BITRATES[first, layer][index - 1], RATES[version][rate], four[2] >> 1 & 1
            mono = four[3] >> 6 == 3
            samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
            length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
            side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
            out = Header(version, layer, not four[1] & 1, kbps, hz, 1 if mono else 2, length, samples, side)
    if len(_headers) < 4096:
        _headers[four] = out
    return out


@dataclass
class Stream:
    """What a stream holds. ``seek``: the byte offset of each audio frame, so that frame i begins at sample
    i * samples a frame; ``skipped``: bytes that belong to no frame or tag."""

    tags: dict[str, str] = field(default_factory=dict)
    header: Header | None = None
    table: str = ""  # Xing, Info, VBRI or none
    table_frames: int | None = None
    table_bytes: int | None = None
    table_toc: bytes = b""
    seek: list[int] = field(default_factory=list)
    kinds: list[Header] = field(default_factory=list)
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0  # protected frames of Layer II
    delay: int = 0  # samples that the encoder put before the audio
    padding: int = 0  # and behind it
    resyncs: int = 0
    skipped: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds of audio, without what the encoder says that it added."""
        return Fraction(max(0, self.samples - self.delay - self.padding), self.header.rate) if self.header else Fraction(0)


def _syncsafe(x: bytes) -> int:
    return x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The offset behind the tag at ``at``; its text frames go to ``tags``."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    held, pos = data[at + 10 : end], 0
    if flags & 0x80 and major < 4:  # unsynchronised as a whole
        held = held.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and major >= 3:  # extended header
        pos = _syncsafe(held[:4].ljust(4, b"\0")) if major == 4 else 4 + int.from_bytes(held[:4], "big")
    # a name, a length and, but for version 2, two bytes of flags
    wide = 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    while 2 <= major <= 4 and pos + head <= len(held) and held[pos]:
        name, number = held[pos : pos + wide].decode("latin-1"), held[pos + wide : pos + 2 * wide]
        length = _syncsafe(number) if major == 4 else int.from_bytes(number, "big")
        body = held[pos + head : pos + head + length]
        if major == 4:
            how = held[pos + 9]
            body = body[4:] if how & 1 else body
            body = body.replace(b"\xff\0", b"\xff") if how & 2 or flags & 0x80 else body
        if name[0] == "T" and body:
            parts = body[1:].decode(_ENCODINGS.get(body[0], "latin-1"), "replace").rstrip("\0").split("\0")
            own = name in ("TXXX", "TXX") and len(parts) > 1
            tags[f"{name}:{parts[0]}" if own else name] = "/".join(parts[1:] if own else parts)
        pos += head + length
    return end + (10 if flags & 0x10 else 0)


def _tail_tags(data: bytes, end: int, tags: dict[str, str]) -> int:
    """The end of the audio: ID3v1 and APEv2 tags behind it are read and cut off."""
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        names = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97))
        for name, a, b in names:
            if value := data[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"ID3v1:{name}"] = value
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        version, size, count, flags = struct.unpack("<IIII", data[end - 24 : end - 8])
        begin = end - size
        if 0 <= begin <= end - 32:
            pos = begin
            for _ in range(count):
                if pos + 8 > end - 32 or (zero := data.find(b"\0", pos + 8, end - 32)) < 0:
                    break
                length = int.from_bytes(data[pos : pos + 4], "little")
                tags["APE:" + data[pos + 8 : zero].decode("latin-1")] = data[zero + 1 : zero + 1 + length].decode("utf-8", "replace")
                pos = zero + 1 + length
            end = begin - (32 if flags & 0x80000000 and begin >= 32 else 0)
    return end


def _allocation_bytes(fourth: int) -> int:
    """Bytes of bit allocation in a Layer I frame: four bits for each of 32 subbands and channels, which in joint stereo
    share theirs from a bound on. ``fourth``: the last byte of the header."""
    mode, bound = fourth >> 6, 4 * ((fourth >> 4 & 3) + 1)
    return 16 if mode == 3 else (32 + bound) // 2 if mode == 1 else 32


def _vbr_table(frame: bytes, h: Header, out: Stream) -> bool:
    """Whether a first frame holds a table instead of audio."""
    at = 4 + 2 * h.protected + h.side
    if h.layer != 3:
        return False
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out.table, flags, pos = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.table_frames, pos = int.from_bytes(frame[pos : pos + 4], "big"), pos + 4
        if flags & 2:
            out.table_bytes, pos = int.from_bytes(frame[pos : pos + 4], "big"), pos + 4
        if flags & 4:
            out.table_toc, pos = frame[pos : pos + 100], pos + 100
        pos += 4 if flags & 8 else 0
        if frame[pos : pos + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= pos + 24:
            trim = int.from_bytes(frame[pos + 21 : pos + 24], "big")
            out.delay, out.padding = trim >> 12, trim & 0xFFF
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        entries, width = int.from_bytes(frame[54:56], "big"), int.from_bytes(frame[58:60], "big")
        out.table_toc = frame[62 : 62 + entries * width]
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Everything about a stream. A header counts where the frame is whole and another frame of the same version,
    layer and sampling rate, or the end, follows; else the search goes on at the next byte. Bytes that are no MPEG
    audio give a stream without frames."""
    out, pos = Stream(), 0
    while data[pos : pos + 3] == b"ID3" and len(data) >= pos + 10:
        pos = _id3v2(data, pos, out.tags)
    end, synced, checked = _tail_tags(data, len(data), out.tags), True, {}
    while pos + 4 <= end:
        h = parse_header(data[pos : pos + 4])
        if h is not None and pos + h.length <= end and (out.header is None or (h.version, h.layer, h.rate) == (out.header.version, out.header.layer, out.header.rate)):
            after = pos + h.length
            follow = parse_header(data[after : after + 4]) if after + 4 <= end else None
            good = after == end or (follow is not None and (follow.version, follow.layer, follow.rate) == (h.version, h.layer, h.rate)) or (synced and out.header is not None)
            if good:
                out.resyncs += not synced and out.header is not None
                synced = True
                if h.protected:
                    covered = h.side if h.layer == 3 else _allocation_bytes(data[pos + 3]) if h.layer == 1 else 0
                    given = data[pos + 4 : pos + 6]
                    said = data[pos + 2 : pos + 4] + data[pos + 6 : pos + 6 + covered]
                    out.crc_unchecked += h.layer == 2  # what Layer II covers depends on its allocation tables
                    if h.layer != 2:
                        right = checked.get(said)
                        if right is None:
                            right = crc16(said)
                            if len(checked) < 4096:
                                checked[said] = right
                        fine = right == int.from_bytes(given, "big")
                        out.crc_ok += fine
                        out.crc_bad += not fine
                first = out.header is None
                out.header = out.header or h
                if not (first and _vbr_table(data[pos:after], h, out)):
                    out.seek.append(pos)
                    out.kinds.append(h)
                    out.samples += h.samples
                pos = after
                continue
        nxt = data.find(b"\xff", pos + 1, end)
        nxt = end if nxt < 0 else nxt
        out.skipped += nxt - pos
        pos, synced = nxt, False
    out.skipped += max(0, end - pos)
    return out


def _prefix(index: int) -> bytes:
    """Header, CRC and silent side information of a 48 kHz mono frame with the bit rate of an index."""
    header = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


_FRAMES = [(3 * kbps, _prefix(i)) for i, kbps in enumerate(BITRATES[True, 3], 1)]
_HEAD = len(_FRAMES[0][1])
_ROOM = _FRAMES[-1][0] - _HEAD
_COUNT = "payload_bytes"


def write_stream(payload: bytes) -> bytes:
    """A stream with an ID3v2.4 tag that says the payload's length, a Xing table, the payload in frames of the highest
    bit rate, the rest in a frame of the lowest that holds it, and an ID3v1 tag."""
    frames = []
    for at in range(0, len(payload), _ROOM):
        part = payload[at : at + _ROOM]
        size, prefix = next(x for x in _FRAMES if x[0] - _HEAD >= len(part))
        frames.append(prefix + part + bytes(size - _HEAD - len(part)))
    size, prefix = next(x for x in _FRAMES if x[0] - _HEAD >= 120)
    total = size + sum(map(len, frames))
    offsets, at = [], size
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * offsets[i * len(frames) // 100] // total) for i in range(100)) if frames else bytes(100)
    xing = b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + bytes(4)
    body = b"\x03" + f"{_COUNT}\0{len(payload)}".encode()
    frame = b"TXXX" + _safe(len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + _safe(len(frame)) + frame
    return b"".join([tag, prefix, xing, bytes(size - _HEAD - len(xing)), *frames, b"TAG", b"payload".ljust(125, b"\0")])


def _safe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def read_payload(data: bytes, stream: Stream) -> bytes:
    """What ``write_stream`` was given."""
    found = b"".join(data[at + _HEAD : at + h.length] for at, h in zip(stream.seek, stream.kinds, strict=True))
    return found[: int(stream.tags[f"TXXX:{_COUNT}"])]


def feature(s: Stream) -> str:
    """Format, exact duration, table, checks and a digest of the seek offsets in one line."""
    if s.header is None:
        return "none"
    name = {3: "1", 2: "2", 0: "2.5"}[s.header.version]
    seek = zlib.crc32(struct.pack(f"<{len(s.seek)}Q", *s.seek))
    return f"mpeg{name}-layer{s.header.layer};hz={s.header.rate};channels={s.header.channels};frames={len(s.seek)};samples={s.samples};duration={s.duration};table={s.table}:{s.table_frames}:{s.table_bytes};crc={s.crc_ok}/{s.crc_ok + s.crc_bad};resyncs={s.resyncs};skipped={s.skipped};seek={seek}"


def padded(text: str | None, unit: int = 192) -> tuple[int, bytes]:
    """(bytes of the text, its payload): UTF-8 and spaces up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")


def text_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_media: bool = False, with_seek: bool = False) -> DataFrame:
    """Stores each row's text as a stream, reads the stream back and returns (doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, samples, sample_rate[, seek][, media]).

    A null or empty text is 192 spaces. Rows are independent: repeated rows repeat, equal texts give equal values, a
    null doc_id stays null, and a text of any length is one stream.
    """
    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "n_frames": T.LongType(), "samples": T.LongType(), "sample_rate": T.LongType()}
    if with_seek:
        kinds["seek"] = T.ArrayType(T.LongType())
    if with_media:
        kinds["media"] = T.BinaryType()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(k, v) for k, v in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(v) for v in kinds.values()]
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for text in batch.column(1):
                n, payload = padded(text.as_py())
                media = write_stream(payload)
                stream = read_stream(media)
                back = read_payload(media, stream)
                row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), len(stream.seek), stream.samples, stream.header.rate]
                row += [stream.seek] * with_seek + [media] * with_media
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def media_index(table: DataFrame, *, media: str = "media") -> DataFrame:
    """``table`` with a struct ``audio`` about the streams in a binary column: tags, table, exact duration as
    samples and sample_rate, checksum counts and the seek offset of every frame. Null, empty and non-audio bytes give
    no frames. A column ``audio`` of ``table`` is replaced."""
    from pyspark.sql import functions as F

    schema = "struct<tags: map<string, string>, vbr_table: string, samples: bigint, sample_rate: bigint, crc_ok: bigint, crc_bad: bigint, resyncs: bigint, skipped: bigint, seek: array<bigint>>"

    @F.pandas_udf(schema)
    def index(column):
        import pandas as pd

        rows = []
        for data in column:
            s = read_stream(bytes(data) if data is not None else b"")
            rows.append((s.tags, s.table, s.samples, s.header.rate if s.header else None, s.crc_ok, s.crc_bad, s.resyncs, s.skipped, s.seek))
        return pd.DataFrame(rows, columns=["tags", "vbr_table", "samples", "sample_rate", "crc_ok", "crc_bad", "resyncs", "skipped", "seek"])

    return table.withColumn("audio", index(F.col(media)))
