"""Media columns: MPEG audio streams, their frames, tags, tables, checksums and seek offsets."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, table

# Fixed values of the MPEG audio standards: kbit/s by index 1 to 14, samples a second by index, samples in a frame.
KBPS = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
LAYERS = {1: 3, 2: 2, 3: 1}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of layer III side information
    guarded: int  # bytes after the checksum that it covers; -1: not known (layer II)


@lru_cache(1 << 14)
def read_header(four: bytes) -> Header | None:
    """A frame header's meaning; None where the four bytes are none (free format counts as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), LAYERS.get(four[1] >> 1 & 3)
    rate_at, kbps_at = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer is None or rate_at == 3 or kbps_at in (0, 15) or four[3] & 3 == 2:
        return None
    kind = ("1" if version == "1" else "2", layer)
    kbps, rate, pad, mode = KBPS[kind][kbps_at - 1], RATES[version][rate_at], four[2] >> 1 & 1, four[3] >> 6
    samples, mono = SAMPLES[kind], mode == 3
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
    bound = ((four[3] >> 4 & 3) + 1) * 4 if mode == 1 else 32
    allocation = (32 if mono else 32 + bound) // 2
    return Header(version, layer, not four[1] & 1, kbps, rate, mono, size, samples, side, {1: allocation, 2: -1, 3: side}[layer])


def _crc_of(byte: int) -> int:
    crc = byte << 8
    for _ in range(8):
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_CRC = [_crc_of(byte) for byte in range(256)]


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, from 0xFFFF, over the header's last two bytes and what follows it."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


@dataclass
class Audio:
    """What a stream holds; ``offsets`` and ``sizes`` are those of its audio frames, without a table's frame."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # where the bytes after side information begin
    samples: int = 0
    duration: Fraction = Fraction(0)
    rates: set[int] = field(default_factory=set)
    skipped: int = 0  # bytes passed over to find the next frame
    checked: int = 0
    broken: int = 0  # frames whose checksum is wrong
    table: str | None = None  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)  # the table's own offsets, in bytes from its frame

    def offset_at(self, sample: int) -> int | None:
        """The offset of the frame that holds a sample, for streams of one frame length."""
        return self.offsets[min(len(self.offsets) - 1, sample * len(self.offsets) // max(1, self.samples))] if self.offsets else None


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Parse the tag at ``at`` and return where it ends."""
    major, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + _syncsafe(data[at + 6 : at + 10]))
    pos = at + 10
    if flags & 0x40 and major >= 3 and pos + 4 <= end:
        pos += _syncsafe(data[pos : pos + 4]) if major == 4 else 4 + int.from_bytes(data[pos : pos + 4])
    while pos + 10 <= end and data[pos] and major >= 3:
        name, raw = data[pos : pos + 4].decode("latin-1"), data[pos + 4 : pos + 8]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw)
        body = data[pos + 10 : min(end, pos + 10 + size)]
        if name.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags.setdefault(key, value.rstrip("\0"))
        pos += 10 + size
    return end + 10 * (major == 4 and bool(flags & 0x10))


def _read_tail(data: bytes, floor: int) -> tuple[int, dict[str, str]]:
    """Where the ID3v1 and APE tags at the end begin, and what they say; one that would begin before ``floor`` is none."""
    end, tags = len(data), {}
    if end - 128 >= floor and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, start, stop in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[end + start : end + stop].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, value)
    if end - 32 >= floor and data[end - 32 : end - 24] == b"APETAGEX":
        size, items, flags = struct.unpack_from("<III", data, end - 20)
        pos = end - size
        begin = pos - 32 * bool(flags & 0x80000000)
        if size < 32 or begin < floor:
            return end, tags
        for _ in range(items):
            if pos + 8 > end - 32:
                break
            length, _kind = struct.unpack_from("<II", data, pos)
            stop = data.find(b"\0", pos + 8, end)
            if stop < 0:
                break
            tags.setdefault(data[pos + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + length].decode("utf-8", "replace"))
            pos = stop + 1 + length
        end = begin
    return end, tags


def _read_table(frame: bytes, header: Header, out: Audio) -> bool:
    """Parse a Xing, Info or VBRI table, if the frame holds one."""
    at = 4 + 2 * header.protected + header.side
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        if flags & 1:
            out.table_frames, at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 2:
            out.table_bytes, at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 4 and out.table_bytes:
            out.seek = [b * out.table_bytes // 256 for b in frame[at : at + 100]]
    elif frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table_bytes, out.table_frames = struct.unpack_from(">II", frame, 46)
        entries, scale, width, _ = struct.unpack_from(">HHHH", frame, 54)
        place = len(frame)
        for i in range(entries):
            out.seek.append(place)
            place += int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale
        name = b"VBRI"
    else:
        return False
    out.table = name.decode()
    return True


def _checksum_holds(data: bytes, pos: int, header: Header) -> bool:
    return int.from_bytes(data[pos + 4 : pos + 6]) == crc16(data[pos + 2 : pos + 4] + data[pos + 6 : pos + 6 + header.guarded])


def _like(data: bytes, pos: int, last: bytes) -> bool:
    """Whether a header is of the kind of the last frame's: version, layer, protection, sampling rate, channels."""
    return data[pos + 1] == last[1] and (data[pos + 2] ^ last[2]) & 0x0C == 0 and (data[pos + 3] ^ last[3]) & 0xC0 == 0


def parse(data: bytes) -> Audio:
    """Walk a stream's frames. A frame is one that another one, or the end of the audio, follows; after a
    frame also one that foreign bytes follow, if it is of the same kind and its checksum, where it has one, holds.
    Elsewhere bytes are passed over. What looks like a tag at the end is audio if such a frame reaches into it."""
    out = Audio()
    pos = 0
    while data[pos : pos + 3] == b"ID3" and pos + 10 <= len(data):
        pos = _read_id3v2(data, pos, out.tags)
    end, tail = _read_tail(data, pos)
    last = None  # the header of the frame that ends here
    while pos + 4 <= len(data):
        header = read_header(data[pos : pos + 4])
        after = pos + header.size if header else 0
        if end < after <= len(data):
            begin, found = _read_tail(data, after)
            if after == begin or read_header(data[after : after + 4]):
                end, tail = begin, found
        if pos + 4 > end:
            break
        sound = header and after <= end
        if sound and after != end and not read_header(data[after : after + 4]):
            sound = last and _like(data, pos, last) and not (header.protected and header.guarded >= 0 and not _checksum_holds(data, pos, header))
        if not sound:
            following = data.find(b"\xff", pos + 1, end)
            following = end if following < 0 else following
            out.skipped += following - pos
            pos, last = following, None
            continue
        first, last = not (out.offsets or out.table), data[pos : pos + 4]
        if header.protected and header.guarded >= 0:
            out.checked += 1
            out.broken += not _checksum_holds(data, pos, header)
        if not (first and _read_table(data[pos:after], header, out)):
            out.offsets.append(pos)
            out.sizes.append(header.size)
            out.starts.append(pos + 4 + 2 * header.protected + header.side)
            out.samples += header.samples
            out.duration += Fraction(header.samples, header.rate)
            out.rates.add(header.rate)
        pos = after
    out.skipped += max(0, end - pos)
    out.tags = tail | out.tags
    return out


RATE_AT, MONO = 2, 0xC0
ROOM = {k: 144 * k * 1000 // 32000 - 23 for k in KBPS["1", 3]}
LENGTH_TAG = "payload_bytes"


@lru_cache(1024)
def _opening(kbps: int, protected: bool, number: int = 0) -> bytes:
    """Header, checksum and side information of a silent mono layer III frame at 32 kHz; the side information's
    five private bits count the frames."""
    head = bytes((0xFF, 0xFA if protected else 0xFB, KBPS["1", 3].index(kbps) + 1 << 4 | RATE_AT << 2, MONO))
    side = bytes((0, number % 32 << 2)) + bytes(15)
    return head + (crc16(head[2:] + side).to_bytes(2) if protected else b"") + side


def store(payload: bytes) -> bytes:
    """A variable-bitrate stream of silent layer III frames whose ancillary bytes are the payload.

    Side information says that no bits are audio, so a player hears silence and every
    byte after it is free. An ID3v2 tag has the payload's length, a Xing table the seek offsets.
    """
    full, largest = 320, ROOM[320]
    whole, rest = divmod(len(payload), largest)
    frames = [_opening(full, True, i % 32) + payload[i * largest : (i + 1) * largest] for i in range(whole)]
    if rest:
        kbps = next(k for k in KBPS["1", 3] if ROOM[k] >= rest)
        frames.append(_opening(kbps, True, whole % 32) + payload[whole * largest :] + bytes(ROOM[kbps] - rest))
    text = b"\x03" + f"{LENGTH_TAG}\0{len(payload)}".encode()
    syncsafe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    tag = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    sizes = [144] + [len(f) for f in frames]
    total, place, offsets = sum(sizes), 144, []
    for size in sizes[1:]:
        offsets.append(place)
        place += size
    toc = bytes(min(255, offsets[i * len(offsets) // 100] * 256 // total) if offsets else 0 for i in range(100))
    xing = _opening(32, False) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([b"ID3\x04\0\0", syncsafe(len(tag)), tag, xing.ljust(144, b"\0"), *frames])


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The payload that ``store`` put into a stream."""
    if audio.broken or LENGTH_TAG not in audio.tags:
        raise ValueError("the stream holds no payload, or a frame's checksum is wrong")
    parts = [data[start : at + size] for start, at, size in zip(audio.starts, audio.offsets, audio.sizes, strict=True)]
    payload = b"".join(parts)[: int(audio.tags[LENGTH_TAG])]
    if len(payload) != int(audio.tags[LENGTH_TAG]):
        raise ValueError("the stream is cut short")
    return payload


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes (null: none), zeros up to a positive
    multiple of 64, as an MPEG stream of any length. Repeated rows and null ids keep a row each, equal texts have equal
    streams; an empty table gives an empty result; other columns are ignored, whatever their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode("utf-8")
                sizes.append(len(raw))
                media.append(store(raw + bytes(-len(raw) % 64 if raw else 64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(write, "doc_id long, n_bytes long, media binary")


FRAME_COLUMNS = (
    "frames long, samples long, sample_rate int, duration double, duration_numerator long, duration_denominator long, frame_offsets array<long>, skipped_bytes long, "
    "crc_checked long, crc_broken long, vbr_table string, vbr_frames long, vbr_offsets array<long>, tags map<string,string>"
)


def read_audio(media: DataFrame) -> DataFrame:
    """``doc_id`` and what the stream in ``media`` holds, for any MPEG-1, 2 or 2.5 stream of layers I to III.

    Durations are exact sums of samples over rates, given as a fraction and as the nearest double;
    ``frame_offsets`` are bytes from the start. Null or foreign bytes: no frames. A stream of several
    rates has no ``sample_rate``. Layer II checksums, which need its allocation tables, are not verified.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                a = parse(data or b"")
                rate = next(iter(a.rates)) if len(a.rates) == 1 else None
                rows.append((doc_id, len(a.offsets), a.samples, rate, float(a.duration), a.duration.numerator, a.duration.denominator, a.offsets, a.skipped, a.checked, a.broken, a.table, a.table_frames, a.seek, list(a.tags.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=NAMES)

    return media.select("doc_id", "media").mapInArrow(read, f"doc_id long, {FRAME_COLUMNS}")


_LONGS = pa.list_(pa.int64())
ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), _LONGS, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _LONGS, pa.map_(pa.string(), pa.string())]
NAMES = ["doc_id", *[c.split()[0] for c in FRAME_COLUMNS.split(", ")]]


def read_back(media: DataFrame) -> DataFrame:
    """The stored payloads' digests and a summary of each stream, of what ``store_texts`` wrote."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()}
    kinds |= {"media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "duration": pa.float64(), "frame_offsets": _LONGS}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                audio = parse(data)
                payload = payload_of(data, audio)
                seek = hashlib.sha256(",".join(map(str, audio.offsets)).encode()).hexdigest()[:16]
                feature = (
                    f"mpeg1-layer3 frames={len(audio.offsets)} samples={audio.samples} seconds={audio.duration} "
                    f"crc={audio.checked - audio.broken}/{audio.checked} {audio.table}={audio.table_frames} offsets={seek}"
                )
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, float(audio.duration), audio.offsets))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration double, frame_offsets array<long>"
    return media.mapInArrow(read, schema)


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store_texts(table(spark, sf_dir, "documents"))
    return read_back(Workspace(spark, "media").save(media, "media"))
