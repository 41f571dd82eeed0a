import hashlib
import random
import zlib

from linkloom.llm import media
from linkloom.llm.media import crc16, frame_bytes, header, padded, read_stream, write_stream


def bitwise_crc(data):
    crc = 0xFFFF
    for byte in data:
        for i in range(7, -1, -1):
            top = (crc >> 15) ^ (byte >> i & 1)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def test_checksum_and_frame_sizes():
    rng = random.Random(3)
    for _ in range(50):
        data = rng.randbytes(rng.randint(0, 40))
        assert crc16(data) == bitwise_crc(data)
    assert frame_bytes(14) == 960 and frame_bytes(1) == 96


def test_every_size_survives():
    rng = random.Random(4)
    for n in [0, 1, 63, 64, 65, 900, 937, 938, 5000, 70_000]:
        data = rng.randbytes(n)
        r = read_stream(write_stream(data))
        assert r["payload"] == padded(data) and r["whole"] and r["bad_crc"] == 0 and r["skipped"] == 0
        assert r["vbr_frames"] == len(r["offsets"]) and r["samples"] == 1152 * len(r["offsets"])


def test_seek_offsets_point_at_frames():
    b = write_stream(bytes(range(256)) * 40)
    r = read_stream(b)
    assert all(b[o] == 0xFF and b[o + 1] == 0xFA for o in r["offsets"])
    assert r["vbr_bytes"] == len(b) - r["start"]


def test_junk_between_frames_is_skipped_and_damage_is_noticed():
    data = b"x" * 4000
    b = write_stream(data)
    at = read_stream(b)["offsets"][1]
    r = read_stream(b[:at] + b"\xff\x00junk\xff\xfa\xff" + b[at:])
    assert r["payload"] == padded(data) and r["skipped"] > 0
    broken = bytearray(b)
    broken[at + 10] ^= 1  # side information
    r = read_stream(bytes(broken))
    assert not r["whole"] and r["bad_crc"] == 1


def test_payload_that_looks_like_headers():
    data = header(14, True) * 900
    assert read_stream(write_stream(data))["payload"] == padded(data)


def test_query_against_the_definition(spark, tmp_path):
    rows = [(1, "añ" * 700), (2, ""), (3, None), (4, "añ" * 700), (None, "x"), (1, "añ" * 700)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS payload").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op10_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = next(x for x in got if x["doc_id"] == doc_id)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(write_stream(data)).hexdigest() and r["media_bytes"] == len(write_stream(data))
    assert len({r["feature"] for r in got if r["n_bytes"] == 2100}) == 1
    assert media.read_mpeg_audio(media.to_mpeg_audio(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
