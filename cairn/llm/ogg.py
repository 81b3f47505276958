"""Ogg media columns: texts stored as 8-bit PCM in an Ogg container, read back and measured.

Stored form: two logical streams in one physical stream. The sample stream has a header packet and packets
of PACKET samples; the note stream has a packet with the number of bytes before padding. Both begin with
their header pages; data pages hold up to 255 lacing values, so packets run on from page to page. Serial
numbers come from the payload: equal texts have equal media.

The reader verifies capture pattern, version and checksum of each page, demultiplexes by serial number,
checks page sequence, puts packets together from lacing values (also across pages), takes each stream's
end from its last granule position and derives time stamps by the header's rate.

Defined cases: a null or empty text has no bytes and a payload of 192 spaces. Damaged media raise a
ValueError that names the fault. Rows are independent; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .encoding import small_batches

UNIT = 192
RATE = 8000
PACKET = 4096
# Fixed values of the container format.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, BEGIN, END = 1, 2, 4
NO_GRANULE = -1
SAMPLES_MAGIC, NOTE_MAGIC = b"\x80pcm8\0\0\0", b"\x80note\0\0\0"

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(data: bytes) -> int:
    """The format's CRC-32 (polynomial 04C11DB7, most significant bit first, from 0).

    It mirrors the usual CRC-32 bit by bit, so mirrored bytes go through zlib.
    """
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def build_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)))
    page = bytes(head) + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def _lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, first: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The data pages of a stream; the granule of a page is that of the last packet that ends on it."""
    lacing = b"".join(map(_lace, map(len, packets)))
    body = b"".join(packets)
    values = np.frombuffer(lacing, np.uint8)
    ends = np.flatnonzero(values < 255)  # segments that end a packet
    upto = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    pages = []
    for k, a in enumerate(range(0, len(lacing), 255)):
        b = min(a + 255, len(lacing))
        done = int(np.searchsorted(ends, b))
        granule = granules[done - 1] if done and ends[done - 1] >= a else NO_GRANULE
        flags = (CONTINUED if a and lacing[a - 1] == 255 else 0) | (END if b == len(lacing) else 0)
        pages.append(build_page(serial, first + k, flags, granule, lacing[a:b], body[upto[a] : upto[b]]))
    return pages


def encode(text: str | None) -> bytes:
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))
    serial = zlib.crc32(payload)
    note = serial ^ 0xFFFFFFFF
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    header = SAMPLES_MAGIC + struct.pack("<IBB", RATE, 1, 8)
    pages = stream_pages(serial, 1, packets, granules)
    out = [build_page(serial, 0, BEGIN, 0, _lace(len(header)), header), build_page(note, 0, BEGIN, 0, _lace(len(NOTE_MAGIC)), NOTE_MAGIC)]
    out += pages[:1] + stream_pages(note, 1, [struct.pack("<Q", len(raw))], [len(raw)]) + pages[1:]
    return b"".join(out)


def pages_of(media: bytes):
    """(serial, number, flags, granule, lacing, body) of each page, verified."""
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise ValueError("the media end within a page header")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError(f"no page begins at byte {at}")
        start = at + HEADER.size
        lacing = media[start : start + n]
        stop = start + n + sum(lacing)
        if stop > len(media):
            raise ValueError("the media end within a page")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            raise ValueError(f"the checksum of page {number} of stream {serial} differs")
        yield serial, number, flags, granule, lacing, media[start + n : stop]
        at = stop


def demultiplex(media: bytes) -> dict[int, dict]:
    """The packets of each logical stream with the granule that each page states, by serial number."""
    streams: dict[int, dict] = {}
    for serial, number, flags, granule, lacing, body in pages_of(media):
        s = streams.get(serial)
        if s is None:
            if not flags & BEGIN:
                raise ValueError(f"stream {serial} has no first page")
            s = streams[serial] = {"packets": [], "open": [], "next": 0, "granules": [], "ended": False}
        if number != s["next"] or s["ended"]:
            raise ValueError(f"page {s['next']} of stream {serial} is missing")
        if bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"a packet of stream {serial} is broken off")
        s["next"] += 1
        a = b = 0
        for value in lacing:
            b += value
            if value < 255:
                s["packets"].append(b"".join([*s["open"], body[a:b]]))
                s["open"] = []
                a = b
        if b > a:
            s["open"].append(body[a:b])
        elif lacing and lacing[-1] == 255 and not s["open"]:
            s["open"].append(b"")
        if granule != NO_GRANULE:
            s["granules"].append((len(s["packets"]), granule))
        s["ended"] = bool(flags & END)
    for serial, s in streams.items():
        if s["open"] or not s["ended"]:
            raise ValueError(f"stream {serial} has no end")
    return streams


def decode(media: bytes) -> dict:
    """payload, n_bytes, packets, rate and times (seconds at which pages end) of the stored form."""
    streams = demultiplex(media)
    samples = next(s for s in streams.values() if s["packets"][0].startswith(SAMPLES_MAGIC))
    note = next(s for s in streams.values() if s["packets"][0] == NOTE_MAGIC)
    rate, channels, bits = struct.unpack_from("<IBB", samples["packets"][0], len(SAMPLES_MAGIC))
    payload = b"".join(samples["packets"][1:])
    granule = samples["granules"][-1][1]
    if granule != len(payload) // (channels * bits // 8):
        raise ValueError("the last granule position differs from the number of samples")
    return {"payload": payload, "n_bytes": struct.unpack("<Q", note["packets"][1])[0], "packets": len(samples["packets"]) - 1, "rate": rate, "times": [g / rate for _, g in samples["granules"][1:]]}


def feature(found: dict) -> str:
    """Whole-number features of the samples, so that they read alike everywhere."""
    x = np.frombuffer(found["payload"], np.uint8)
    sums, squares = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    crossings = int(np.count_nonzero(np.diff(x >= 100)))
    return f"packets={found['packets']};ms={round(found['times'][-1] * 1000)};sum={sums};squares={squares};peak={int(x.max())};crossings={crossings}"


def _encode_rows(batches):
    for batch in small_batches(batches, "text", 4_000_000):
        media = [encode(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def _measure_rows(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in small_batches(batches, "media", 4_000_000):
        rows = []
        for media in batch.column("media").to_pylist():
            found = decode(media)
            p = found["payload"]
            rows.append((found["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of doc_id and media, the stored form of each text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cut(rows.mapInArrow(_encode_rows, "doc_id long, media binary"), "media")


def measure(media: DataFrame) -> DataFrame:
    """A row of digests and features per row of media, from the bytes that were stored."""
    return media.select("doc_id", "media").mapInArrow(_measure_rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
