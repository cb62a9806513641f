"""Media columns in Ogg: pages with checksums, packets in lacing values, multiplexed logical streams, granule positions."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import by_batch, utf8

#: Fixed values of the Ogg container.
MAGIC = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")

#: Fixed values of the sample stream kept here: 8-bit unsigned mono samples.
SAMPLES, MARKS = 0x53414D50, 0x4D41524B
RATE = 8000
PACKET = 4096
UNIT = 64

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC with polynomial 0x04c11db7, start 0, not reflected.

    zlib has the reflected form: reflecting each byte and the result gives this one at C speed."""
    reflected = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEADER.pack(MAGIC, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return blank[:22] + ogg_crc(blank).to_bytes(4, "little") + blank[26:]


def paginate(serial: int, packets: Iterable[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: (bytes, granule position after it). The first packet has a page of its own,
    as the header of a stream must; a packet that does not fit goes on in the next page."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), [], -1, FIRST

    def flush(last: bool = False, carried: bool = False) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(_page(serial, len(pages), flags | LAST * last, granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], -1, CONTINUED * carried

    rows = list(packets)
    for n, (data, at) in enumerate(rows):
        whole, rest = divmod(len(data), 255)
        values, done = [255] * whole + [rest], 0
        while values:
            room = 255 - len(lacing)
            if not room:
                flush(carried=done > 0 or len(values) <= whole)
                continue
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += bytes(now)
            body.append(data[done : done + size])
            done += size
            if values:
                flush(carried=True)
        granule = at
        if n == 0 and len(rows) > 1:
            flush()
    flush(last=True)
    return pages


@dataclass
class Stream:
    """A logical stream as read: whole packets with the granule position of the page that they end in (-1: none given)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    positions: list[tuple[int, int]] = field(default_factory=list)  # by page: granule position, packets that end in it
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _next: int | None = None
    _part: list[bytes] | None = None


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages failed their checksum or were cut short.

    A failed page is left out; the packet it held a part of is dropped, and reading goes on at the next page mark."""
    streams: dict[int, Stream] = {}
    at, failed, end = data.find(MAGIC), 0, len(data)
    while 0 <= at < end:
        if at + 27 > end:
            failed += 1
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        stop = at + 27 + n + sum(lacing)
        page = data[at:stop]
        if version or len(lacing) < n or stop > end or ogg_crc(page[:22] + bytes(4) + page[26:]) != crc:
            failed += 1
            at = data.find(MAGIC, at + 4)
            continue
        s = streams.setdefault(serial, Stream(serial))
        if s._next is not None and sequence != s._next:
            s.gaps += 1
            s._part = None
        s._next = sequence + 1
        s.pages += 1
        s.ended |= bool(flags & LAST)
        part, skip = (s._part, s._part is None) if flags & CONTINUED else ([], False)
        begin, before = 27 + n, len(s.packets)
        cursor = begin
        for value in lacing:
            cursor += value
            if value < 255:
                if not skip:
                    s.packets.append(b"".join([*(part or []), page[begin:cursor]]))
                    s.granules.append(granule)
                part, skip, begin = [], False, cursor
        s.positions.append((granule, len(s.packets) - before))
        s._part = None if skip else [*(part or []), page[begin:cursor]] if n and lacing[-1] == 255 else None
        at = stop if data[stop : stop + 4] == MAGIC else data.find(MAGIC, stop)
    return streams, failed


def store(payload: bytes) -> bytes:
    """The payload as an Ogg file: a stream of 8-bit samples, and one of marks (the CRC of each sample packet)."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    head = b"GNSAMP" + struct.pack("<HIQ", 8, RATE, len(payload))
    ends = [min(len(payload), (i + 1) * PACKET) for i in range(len(parts))]
    samples = paginate(SAMPLES, [(head, 0), *zip(parts, ends)])
    marks = paginate(MARKS, [(b"GNMARK", 0), (b"".join(zlib.crc32(p).to_bytes(4, "little") for p in parts), len(payload))])
    mixed = [samples[0], marks[0]]  # first pages of all streams lead
    rest, other = samples[1:], marks[1:]
    every = max(1, -(-len(rest) // max(1, len(other))))
    for i in range(0, max(len(rest), 1), every):
        mixed += rest[i : i + every] + other[i // every : i // every + 1]
    return b"".join(mixed + other[-(-max(len(rest), 1) // every) :])


def packet_starts(s: Stream, lengths: list[int] | None = None) -> list[int]:
    """Where each packet starts. A page's granule position is that of the last packet ending in it; earlier packets are
    counted back from it. lengths: samples that each packet stands for (its bytes, and none for the header, if not given).
    Raises ValueError if a page disagrees with the one before it, or has a position though no packet ends in it."""
    lengths = lengths or [0, *map(len, s.packets[1:])]
    starts: list[int] = []
    end = 0
    for granule, n in s.positions:
        if not n:
            if granule != -1:
                raise ValueError("damaged media: a granule position where no packet ends")
            continue
        own, at = [], granule
        for size in reversed(lengths[len(starts) : len(starts) + n]):
            at -= size
            own.append(at)
        if at != end:
            raise ValueError("damaged media: granule positions do not match")
        starts += own[::-1]
        end = granule
    return starts


def load(media: bytes) -> tuple[bytes, dict]:
    """The payload read back, and what the container says. Raises ValueError if anything is damaged or missing."""
    streams, failed = demultiplex(media)
    if failed or SAMPLES not in streams or MARKS not in streams:
        raise ValueError(f"damaged media: {failed} bad pages, streams {sorted(streams)}")
    samples, marks = streams[SAMPLES], streams[MARKS]
    if samples.gaps or marks.gaps or not samples.ended:
        raise ValueError("damaged media: pages are missing")
    bits, rate, size = struct.unpack("<HIQ", samples.packets[0][6:])
    parts = samples.packets[1:]
    kept = b"".join(parts)
    if len(kept) != size or b"".join(zlib.crc32(p).to_bytes(4, "little") for p in parts) != marks.packets[1]:
        raise ValueError("damaged media: samples do not match their marks")
    starts = packet_starts(samples)[1:]
    if packet_starts(marks, [0, size]) != [0, 0]:
        raise ValueError("damaged media: granule positions of the marks do not match")
    end = starts[-1] + len(parts[-1]) if parts else 0
    return kept, {"rate": rate, "bits": bits, "pages": samples.pages + marks.pages, "packets": len(parts), "seconds": end / rate, "last_start": starts[-1] / rate if starts else 0.0}


def features(samples: bytes, info: dict) -> str:
    """Duration, last packet's timestamp, pages, packets, mean, RMS about the middle, sign changes, entropy in bits."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    n = len(x)
    values = np.arange(256)
    mean = int((counts * values).sum()) / n
    rms = math.sqrt(int((counts * (values - 128) ** 2).sum()) / n)
    high = x >= 128
    changes = int(np.count_nonzero(high[1:] != high[:-1]))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    return f"seconds={info['seconds']:.6f};last={info['last_start']:.6f};pages={info['pages']};packets={info['packets']};mean={mean:.4f};rms={rms:.4f};turns={changes};entropy={entropy:.4f}"


def payload_of(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of 64."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    and, with keep_media, the stored file (media).

    Null and empty text: a payload of 64 bytes 0. Equal texts have equal values. Rows are independent: repeats, ties and
    an empty table need nothing special, and other columns are not read. A text of any length is stored whole."""
    kept = ", media binary" if keep_media else ""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
        for data in utf8(batch.column(1)):
            media = store(payload_of(data))
            back, info = load(media)
            row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(back, info), media)
            for k, v in zip(out, row):
                out[k].append(v)
        if not keep_media:
            del out["media"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], ["doc_id", *out])

    kind = docs.schema[doc_id].dataType.simpleString()
    return by_batch(docs.select(doc_id, text), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{kept}")
