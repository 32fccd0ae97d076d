"""Ogg media columns: mux, checksum verification, packet reassembly, demultiplexing, timestamps."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import each_run, utf8

RATE = 8000
UNIT = 192
PACKET = 1920
AUDIO, NOTES = b"\x01pcm-u8\0", b"\x01notes\0\0"
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """The bytes are not a well-formed Ogg file."""


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversion.

    zlib has the same polynomial with mirrored bits and inverted ends; mirroring every byte going in
    and the whole register coming out turns one into the other.
    """
    register = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """The pages of one logical stream; the first packet gets a page of its own."""
    number, flags = 0, FIRST
    lacing, body, granule = bytearray(), bytearray(), -1
    for k, (packet, position) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = 255 - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += now
            body += packet[at : at + size]
            at += size
            if not values:
                granule = position
            last = k == len(packets) - 1 and not values
            if len(lacing) == 255 or last or (k == 0 and not values):
                yield _page(serial, number, flags | (LAST if last else 0), granule, bytes(lacing), bytes(body))
                number, flags = number + 1, CONTINUED if values else 0
                lacing, body, granule = bytearray(), bytearray(), -1


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages, then the rest in turn."""
    waiting = [pages(serial, packets) for serial, packets in streams.items() if packets]
    out = []
    while waiting:
        for source in list(waiting):
            page = next(source, None)
            if page is None:
                waiting.remove(source)
            else:
                out.append(page)
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: bytearray | None = None

    def seconds(self, rate: int = RATE) -> list[float]:
        """Time at which each packet ends; a packet without a granule position takes the next one known."""
        out, after = [], 0
        for g in reversed(self.granules):
            after = g if g >= 0 else after
            out.append(after / rate)
        return out[::-1]


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises OggError on a bad checksum, gap or cut packet.

    Empty bytes give no stream. Pages of different streams may come in any mixture.
    """
    view, at, streams = memoryview(data), 0, {}
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError("truncated page header")
        magic, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should start")
        lacing = data[at + _HEAD.size : at + _HEAD.size + count]
        begin = at + _HEAD.size + count
        end = begin + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError("truncated page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("checksum differs")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or bool(flags & FIRST) != (number == 0) or s.ended:
            raise OggError("page out of sequence")
        if bool(flags & CONTINUED) != (s._open is not None):
            raise OggError("continuation flag disagrees")
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        done = len(s.packets)
        part = s._open if s._open is not None else bytearray()
        for value in lacing:
            part += view[begin : begin + value]
            begin += value
            if value < 255:
                s.packets.append(bytes(part))
                s.granules.append(-1)
                part = bytearray()
        s._open = part if count and lacing[-1] == 255 else None
        if len(s.packets) > done:
            s.granules[-1] = granule
        at = end
    if any(s._open is not None or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def payload(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """UTF-8 of a text, padded with spaces to a positive multiple of ``unit``, and its length before."""
    raw = utf8(text)
    return raw + b" " * (-len(raw) % unit or (0 if raw else unit)), len(raw)


def to_ogg(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit samples as one stream, with a second stream that holds their digest. Depends on the samples only."""
    digest = hashlib.sha256(samples).digest()
    serial = int.from_bytes(digest[:4], "little")
    packets = [(AUDIO + struct.pack("<IB", rate, 1), 0)]
    packets += [(samples[k : k + PACKET], min(k + PACKET, len(samples))) for k in range(0, len(samples), PACKET)]
    return mux({serial: packets, (serial + 1) % 2**32: [(NOTES, 0), (digest, len(samples))]})


def from_ogg(data: bytes) -> tuple[bytes, str]:
    """The samples read back and a line of features of them. Raises OggError if they differ from their digest."""
    streams = demux(data)
    audio = next((s for s in streams.values() if s.packets and s.packets[0].startswith(AUDIO)), None)
    notes = next((s for s in streams.values() if s.packets and s.packets[0] == NOTES), None)
    if audio is None or notes is None or len(audio.packets[0]) < len(AUDIO) + 5:
        raise OggError("a stream is missing")
    rate, _ = struct.unpack_from("<IB", audio.packets[0], len(AUDIO))
    samples = b"".join(audio.packets[1:])
    if hashlib.sha256(samples).digest() != notes.packets[-1]:
        raise OggError("samples differ from their digest")
    values = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((values[1:] >= 0) != (values[:-1] >= 0)))
    feature = {
        "us": round(audio.seconds(rate)[-1] * 1e6),
        "packets": len(audio.packets) - 1,
        "pages": sum(s.pages for s in streams.values()),
        "sum": int(values.sum()),
        "energy": int((values * values).sum()),
        "peak": int(np.abs(values).max(initial=0)),
        "turns": turns,
    }
    return samples, ";".join(f"{k}={v}" for k, v in feature.items())


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes as an Ogg file. Null texts are empty; rows are kept one to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_run(batches, "text", 8 << 20):
            both = [payload(x.as_py()) for x in t.column("text")]
            yield pa.RecordBatch.from_arrays(
                [t.column("key").combine_chunks(), pa.array([n for _, n in both], pa.int64()), pa.array([to_ogg(p) for p, _ in both], pa.binary())],
                ["key", "n_bytes", "media"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def read(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, samples, feature, error) of a column of Ogg files.

    A null or damaged file gives null samples and feature and says why in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_run(batches, "media", 8 << 20):
            rows = []
            for x in t.column("media"):
                try:
                    rows.append((*from_ogg(x.as_py() or b""), None))
                except OggError as e:
                    rows.append((None, None, str(e)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.binary()), (1, pa.string()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), *columns], ["key", "samples", "feature", "error"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(media[key].alias("key"), media[column].alias("media")).mapInArrow(run, f"key {kind}, samples binary, feature string, error string").withColumnRenamed("key", key)
