"""Media columns: MPEG audio streams written, resynchronised, checked and indexed.

``write_stream`` stores any bytes losslessly in a variable-bitrate MPEG-1 Layer III stream: an ID3v2 tag, an information
frame with the variable-bitrate table, then frames whose main data is the payload (silent granules, payload as ancillary
data), each protected by the frame checksum, and an ID3v1 tag. The format's unit is the frame.

``read_stream`` takes any stream: it parses tags and tables, resynchronises over junk (a header counts if its checksum
holds and another header, a tag or the end follows its frame), verifies checksums, and returns exact duration (samples
over rate), frame seek offsets and the main data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lotflow.llm.arrow import only, small_batches

# Fixed values of the MPEG audio standards: bit rates in kbit/s by (version 1?, layer), sampling rates by version bits.
_BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SIDE = 17  # bytes of side information: version 1, one channel
_OVERHEAD = 4 + 2 + _SIDE
_POINTS = 100


@dataclass
class Header:
    version: int  # the two version bits
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    side: int


@lru_cache(maxsize=4096)
def parse_header(four: bytes) -> Header | None:
    """A frame header, or None if these four bytes are not one (free format is not taken for one)."""
    word = int.from_bytes(four, "big")
    version, layer, protected = word >> 19 & 3, 4 - (word >> 17 & 3), not word >> 16 & 1
    index, rate, pad, mode = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1, word >> 6 & 3
    if len(four) < 4 or word >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    bitrate, hertz = _BITRATES[version == 3, layer][index - 1], _RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * bitrate // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // hertz + pad
    side = 0 if layer != 3 else (17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)
    return Header(version, layer, protected, bitrate, hertz, length, samples, side)


def _crc_table() -> tuple[int, ...]:
    out = []
    for k in range(256):
        c = k << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return tuple(out)


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def frame_crc(covered: bytes) -> int:
    """Checksum over the last two header bytes and the side information."""
    c = 0xFFFF
    for x in covered:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    return c


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


@lru_cache(maxsize=16)
def _frame_start(index: int) -> bytes:
    """Header, checksum and empty side information of a one-channel 48 kHz frame with this bit-rate index."""
    header = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 1 << 10 | 3 << 6).to_bytes(4, "big")
    return header + frame_crc(header[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def write_stream(payload: bytes, title: str = "") -> bytes:
    """The payload as a stream; frames take the smallest bit rate that holds what is left, the largest until then."""
    room = [3 * b - _OVERHEAD for b in _BITRATES[True, 3]]
    frames, at = [], 0
    while at < len(payload) or not frames:
        left = len(payload) - at
        index = next((k for k, r in enumerate(room) if r >= left), len(room) - 1)
        part = payload[at : at + room[index]]
        frames.append(_frame_start(index + 1) + part + bytes(room[index] - len(part)))
        at += len(part)
    ends, total = [], 0
    for f in frames:
        ends.append(total)
        total += len(f)
    whole = total + 3 * _BITRATES[True, 3][5]
    table = bytes(min(255, 256 * (ends[len(frames) * k // _POINTS] + 240) // whole) for k in range(_POINTS))
    info = _frame_start(6) + b"Xing" + struct.pack(">III", 7, len(frames), whole) + table
    info += bytes(240 - len(info))
    text = b"\x03" + title.encode("utf-8", "replace")
    size = b"\x03bytes\x00" + str(len(payload)).encode()
    tag = b"".join(name + _syncsafe(len(body)) + b"\0\0" + body for name, body in ((b"TIT2", text), (b"TXXX", size)))
    old = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(94) + b"\xff"
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + info + b"".join(frames) + old


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    rate: int = 0
    channels_side: int = 0
    bitrates: dict[int, int] = field(default_factory=dict)
    crc_checked: int = 0
    crc_failed: int = 0
    junk: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    table: bytes = b""
    offsets: list[int] = field(default_factory=list)
    data: bytes = b""


def _tag_frames(body: bytes, version: int) -> dict[str, str]:
    out, at = {}, 0
    while at + 10 <= len(body) and body[at]:
        raw = body[at + 4 : at + 8]
        size = sum(b << s for b, s in zip(raw, (21, 14, 7, 0))) if version == 4 else int.from_bytes(raw, "big")
        name, value = body[at : at + 4].decode("latin-1"), body[at + 10 : at + 10 + size]
        if name[0] == "T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace")
            key, _, rest = text.partition("\0") if name == "TXXX" else (name, "", text)
            out[key] = rest.rstrip("\0")
        at += 10 + size
    return out


def _crc_holds(data: bytes, at: int, h: Header) -> bool | None:
    """Whether the frame's checksum holds; None where it has none, or one over a part that only decoding delimits."""
    if not h.protected or h.layer != 3:
        return None
    return frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")


def read_stream(data: bytes, seek_every: int = 1) -> Audio:
    """Everything a stream states about itself; never raises on damaged input."""
    out, at, end = Audio(), 0, len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        out.tags["title"] = data[-125:-95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
        out.tags |= _tag_frames(data[10 : 10 + size], data[3])
        at = 10 + size
    parts, first, locked = [], True, False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        good = _crc_holds(data, at, h) if h else None
        if h and (at + h.length > end or not locked and (good is False or at + h.length + 4 <= end and not parse_header(data[at + h.length : at + h.length + 4]))):
            h = None
        if not h:
            found = data.find(b"\xff", at + 1, end)
            out.junk += (found if found >= 0 else end) - at
            at, locked = (found if found >= 0 else end), False
            continue
        locked = True
        out.crc_checked += good is not None
        out.crc_failed += good is False
        body = at + 4 + 2 * h.protected + h.side
        if first and data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            if flags & 1:
                out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out.table = data[p : p + _POINTS]
        elif first and data[at + 36 : at + 40] == b"VBRI":
            out.table_bytes, out.table_frames = struct.unpack(">II", data[at + 46 : at + 54])
        else:
            if out.frames % seek_every == 0:
                out.offsets.append(at)
            out.frames += 1
            out.samples += h.samples
            out.rate = out.rate or h.rate
            out.bitrates[h.bitrate] = out.bitrates.get(h.bitrate, 0) + 1
            parts.append(data[body : at + h.length])
        first = False
        at += h.length
    out.junk += max(0, end - at)
    out.data = b"".join(parts)
    stated = out.tags.get("bytes", "")
    if stated.isdigit():
        out.data = out.data[: int(stated)]
    return out


@F.pandas_udf(BinaryType())
def _written(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in payloads:
        yield pd.Series([write_stream(bytes(p)) if p is not None else None for p in batch])


_READ = (
    "payload binary, frames long, samples long, rate long, duration_us long, bitrates string, crc_checked long, "
    "crc_failed long, junk long, table_frames long, table_bytes long, seek array<long>, title string"
)


def _read(streams: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in streams:
        rows = []
        for s in batch:
            a = read_stream(bytes(s)) if s is not None else Audio()
            rows.append((
                a.data if s is not None else None, a.frames, a.samples, a.rate, a.samples * 1_000_000 // a.rate if a.rate else 0, ",".join(f"{k}x{n}" for k, n in sorted(a.bitrates.items())),
                a.crc_checked, a.crc_failed, a.junk, a.table_frames, a.table_bytes, a.offsets, a.tags.get("TIT2", a.tags.get("title", "")),
            ))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])
        yield out.astype({"table_frames": "Int64", "table_bytes": "Int64"})


def to_audio(payload: Column) -> Column:
    """A binary column stored as audio streams; null stays null."""
    return _written(payload)


def read_audio(stream: Column) -> Column:
    """What is read back from a column of streams: main data, exact duration, seek offsets, tables, checksums, tags."""
    return F.pandas_udf(_read, _READ)(stream)


def text_audio(docs: DataFrame, unit: int = 192) -> DataFrame:
    """(doc_id, n_bytes, media, back) for every row of ``docs(doc_id, text)``.

    The UTF-8 text (null: empty) is filled with spaces to a positive multiple of ``unit`` and stored; ``back`` is what
    reading the stored bytes gives. Equal texts give equal bytes. Repeated rows stay; other columns are ignored.
    """
    small_batches(docs.sparkSession, rows=256)
    text = F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    fill = F.expr(f"greatest(cast(ceil(n_bytes / {unit}D) as int), 1) * {unit} - cast(n_bytes as int)")
    rows = only(docs, "doc_id", "text").withColumn("raw", text).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    rows = rows.select("doc_id", "n_bytes", to_audio(F.concat("raw", F.encode(F.repeat(F.lit(" "), fill), "UTF-8"))).alias("media"))
    return rows.withColumn("back", read_audio(F.col("media")))


def digests(stored: DataFrame) -> DataFrame:
    """The digest columns of ``text_audio``."""
    feature = F.concat_ws(
        ";", F.concat(F.lit("mpeg1-layer3;"), F.col("back.rate")), *[F.concat(F.lit(f"{n}="), F.col(f"back.{n}")) for n in ("frames", "samples", "duration_us", "bitrates", "crc_checked", "crc_failed", "junk", "table_frames", "table_bytes")],
        F.concat(F.lit("seek="), F.element_at("back.seek", 1), F.lit(".."), F.element_at("back.seek", -1), F.lit(":"), F.crc32(F.concat_ws(",", F.col("back.seek").cast("array<string>")).cast("binary"))),
    )
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("back.payload").cast("long").alias("payload_bytes"), F.sha2("back.payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(back.payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
