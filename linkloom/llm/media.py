"""Operator 10: texts as MPEG audio, and the column of such streams read back.

Each text becomes an MPEG-1 Layer III stream of variable bitrate: an ID3v2 tag, a frame with the
table of the bitrate (Xing), then silent mono frames of 1152 samples at 48 kHz whose main data is
ancillary, which is where the payload is kept byte by byte. Every audio frame carries the standard's
CRC-16 over its header and side information. The reader resynchronises on frame headers, so junk
between frames is skipped, and derives exact durations and the byte offset of every frame.

Defined cases: a null text is empty; the payload is padded with zero bytes to a positive multiple of
64; equal texts give equal streams, so ties cannot arise; repeated rows stay repeated; a very long text is
one stream of as many frames as it takes, whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import batches, lean, table, utf8_rows

# Fixed values of the MPEG-1 Layer III frame header.
KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES_PER_FRAME = 1152
SIDE_INFO = 17  # bytes, mono
HEAD = 4 + 2 + SIDE_INFO  # header, CRC, side information
RATE_INDEX = 1
VBR_KBPS_INDEX = 5  # 64 kbit/s: room for the table


def crc16_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


CRC_TABLE = crc16_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ byte]
    return crc


def frame_bytes(kbps_index: int, rate_index: int = RATE_INDEX, padding: int = 0) -> int:
    return 144_000 * KBPS[kbps_index] // RATES[rate_index] + padding


def header(kbps_index: int, protected: bool) -> bytes:
    """Sync, MPEG-1, Layer III; mono."""
    return bytes((0xFF, 0xFA if protected else 0xFB, kbps_index << 4 | RATE_INDEX << 2, 0xC0))


def padded(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def id3(values: dict[str, str]) -> bytes:
    body = b""
    for key, value in values.items():
        text = b"\x00" + key.encode() + b"\x00" + value.encode()
        body += b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + synchsafe(len(body)) + body


LARGEST = len(KBPS) - 1
CAPACITY = [frame_bytes(k) - HEAD if k else 0 for k in range(len(KBPS))]


def write_stream(data: bytes) -> bytes:
    payload = padded(data)
    frames, offsets, at = [], [], 0
    room = CAPACITY[LARGEST]
    for start in range(0, len(payload), room):
        part = payload[start : start + room]
        k = next(i for i in range(1, len(KBPS)) if CAPACITY[i] >= len(part))
        head = header(k, True)
        side = bytes(SIDE_INFO)
        frames.append(head + crc16(head[2:] + side).to_bytes(2, "big") + side + part + bytes(CAPACITY[k] - len(part)))
        offsets.append(at)
        at += len(frames[-1])
    vbr_size = frame_bytes(VBR_KBPS_INDEX)
    total = vbr_size + at
    toc = bytes(min(255, (vbr_size + offsets[len(offsets) * i // 100]) * 256 // total) for i in range(100))
    vbr = header(VBR_KBPS_INDEX, False) + bytes(SIDE_INFO) + b"Xing" + struct.pack(">III", 0xF, len(frames), total) + toc + struct.pack(">I", 0)
    tag = id3({"payload_bytes": str(len(payload)), "payload_crc32": f"{zlib.crc32(payload):08x}"})
    return tag + vbr + bytes(vbr_size - len(vbr)) + b"".join(frames)


def parse_header(b: bytes, at: int) -> tuple[int, int, bool] | None:
    """(frame bytes, sample rate, has CRC) of an MPEG-1 Layer III mono header at a place, else None."""
    if at + 4 > len(b) or b[at] != 0xFF or (b[at + 1] & 0xFE) != 0xFA:
        return None
    k, rate = b[at + 2] >> 4, (b[at + 2] >> 2) & 3
    if k in (0, 15) or rate == 3 or b[at + 3] >> 6 != 3:
        return None
    return frame_bytes(k, rate, (b[at + 2] >> 1) & 1), RATES[rate], not b[at + 1] & 1


def read_tag(b: bytes) -> tuple[dict[str, str], int]:
    """The TXXX values of a leading ID3v2.3 tag, and where the audio begins."""
    if b[:3] != b"ID3" or len(b) < 10:
        return {}, 0
    size = 0
    for byte in b[6:10]:
        size = size << 7 | (byte & 0x7F)
    end, at, values = 10 + size, 10, {}
    while at + 10 <= end:
        n = struct.unpack(">I", b[at + 4 : at + 8])[0]
        if b[at : at + 4] == b"TXXX" and n:
            key, _, value = b[at + 11 : at + 10 + n].partition(b"\x00")
            values[key.decode("latin-1")] = value.decode("latin-1")
        at += 10 + n
    return values, end


def read_stream(b: bytes) -> dict:
    """Payload and timing of a stream; frames are found by resynchronising, bad checksums are counted and skipped."""
    tag, at = read_tag(b)
    out = {"offsets": [], "bad_crc": 0, "skipped": 0, "vbr_frames": None, "vbr_bytes": None, "toc": b"", "rate": 0, "start": at}
    parts = []
    while at < len(b):
        found = parse_header(b, at)
        fits = found and at + found[0] <= len(b)
        if not fits or not (at + found[0] == len(b) or parse_header(b, at + found[0]) or _good(b, at, found)):
            following = b.find(b"\xff", at + 1)
            out["skipped"] += (following if following > 0 else len(b)) - at
            at = following if following > 0 else len(b)
            continue
        size, rate, protected = found
        mark = at + 4 + 2 * protected + SIDE_INFO
        if not out["offsets"] and out["vbr_frames"] is None and b[mark : mark + 4] == b"Xing":
            _, out["vbr_frames"], out["vbr_bytes"] = struct.unpack(">III", b[mark + 4 : mark + 16])
            out["toc"] = b[mark + 16 : mark + 116]
        elif protected and not _good(b, at, found):
            out["bad_crc"] += 1
        else:
            out["rate"] = rate
            out["offsets"].append(at)
            parts.append(b[mark : at + size])
        at += size
    payload = b"".join(parts)[: int(tag.get("payload_bytes", 0))]
    out |= {"payload": payload, "samples": SAMPLES_PER_FRAME * len(out["offsets"])}
    out["whole"] = len(payload) == int(tag.get("payload_bytes", -1)) and f"{zlib.crc32(payload):08x}" == tag.get("payload_crc32")
    return out


def _good(b: bytes, at: int, found: tuple[int, int, bool]) -> bool:
    return found[2] and crc16(b[at + 2 : at + 4] + b[at + 6 : at + 6 + SIDE_INFO]) == int.from_bytes(b[at + 4 : at + 6], "big")


STREAMS = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, samples long, sample_rate int, frame_offsets array<long>, vbr_frames long, bad_crc long, whole boolean, feature string"


def to_mpeg_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes as an audio stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((i, len(t or b""), write_stream(t or b"")) for x in it for i, t in utf8_rows(x)), schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), STREAMS)


def read_mpeg_audio(streams: DataFrame) -> DataFrame:
    """Payload, exact duration (samples at sample_rate) and seek offsets of every stream in column media."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("samples", pa.int64()), ("sample_rate", pa.int32())]
        + [("frame_offsets", pa.list_(pa.int64())), ("vbr_frames", pa.int64()), ("bad_crc", pa.int64()), ("whole", pa.bool_()), ("feature", pa.string())]
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((_read_row(*row) for x in it for row in zip(*(c.to_pylist() for c in x.columns), strict=True)), schema)

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), READ)


def _read_row(doc_id: int | None, n: int, media: bytes) -> tuple:
    r = read_stream(media)
    seek = struct.pack(f">{len(r['offsets'])}Q", *r["offsets"])
    feature = (
        f"mpeg1-l3 frames={len(r['offsets'])} vbr_frames={r['vbr_frames']} vbr_bytes={r['vbr_bytes']} samples={r['samples']} rate={r['rate']} "
        f"ms={r['samples'] * 1000 // max(1, r['rate'])} bad_crc={r['bad_crc']} skipped={r['skipped']} whole={int(r['whole'])} "
        f"first={r['offsets'][0] if r['offsets'] else -1} seek_crc32={zlib.crc32(seek)} toc_crc32={zlib.crc32(r['toc'])}"
    )
    return doc_id, n, r["payload"], len(media), hashlib.sha256(media).hexdigest(), r["samples"], r["rate"], r["offsets"], r["vbr_frames"], r["bad_crc"], r["whole"], feature


def stored_digests(docs: DataFrame) -> DataFrame:
    """Digests of each text's stream and of what is read back from its bytes; both steps in one task, so streams stay there."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            for doc_id, text in utf8_rows(batch):
                _, n, payload, size, digest, *_, feature = _read_row(doc_id, len(text or b""), write_stream(text or b""))
                yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_media": op10_media}
SQL: dict[str, str] = {}
