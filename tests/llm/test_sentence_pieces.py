import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from linkloom.llm.sentence_pieces import decode_pieces, encode_pieces, op1_sentence_pieces, piece_model, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["'s", " ", "  ", "     ", "\n", "\t", "a", "Hello", "é", "ñ", "12", "٣", "!?", "...", "<s>", "<0x41>", "　", "漢字", "😀", "don't", "ing", "tion", "the", "▁", "▁▁", " " * 17, "aaaa", "zzzzzz", "er", "in", "on", "  x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return out + ["", " ", *(" " * n for n in range(2, 70)), *(" " * n + "x" for n in range(2, 70)), *(" " * n + "漢" for n in range(2, 40)), "é" * 300, "ab" * 400, "漢" * 50]


def test_encoding_is_that_of_the_library(library):
    model, sample = piece_model(PATH), texts(4000, 2)
    for a in range(0, len(sample), 500):
        part = sample[a : a + 500]
        for text, got, want in zip(part, model.encode([t.encode() for t in part]), library.encode(part, num_threads=1), strict=True):
            assert got == want, text


def test_decoding_is_that_of_the_library(library):
    sample = texts(500, 3)
    for ids, want in zip(ids_of := library.encode(sample, num_threads=1), library.decode(ids_of), strict=True):
        assert piece_model(PATH).decode(ids).decode() == want


def test_occurrences_are_all_and_only_those_of_the_text():
    model = piece_model(PATH)
    chunks = ["▁there".encode(), "▁the".encode(), "theé".encode()]
    data = b"\0".join([*chunks, b""])
    codes = np.frombuffer(data, np.uint8).astype(np.uint16) + 1
    codes[np.frombuffer(data, np.uint8) == 0] = 0
    place, piece = model.occurrences(data, codes)
    want = {(i, k) for k, p in enumerate(model.pieces) if model.usable[k] for i in range(len(data)) if data.startswith(p, i)}
    assert set(zip(place.tolist(), piece.tolist(), strict=True)) == want


def test_tables(spark, library, tmp_path):
    sample = texts(40, 4)
    rows = [(i, t) for i, t in enumerate(sample)] + [(900, None), (0, sample[0]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids").repartition(2)
    encoded = encode_pieces(df, PATH)
    got = sorted([(r["doc_id"], r["ids"]) for r in encoded.collect()], key=repr)
    assert got == sorted([(d, None if t is None else library.encode(t)) for d, t in rows], key=repr)
    back = {r["doc_id"]: r["text"] for r in decode_pieces(encoded, PATH).collect()}
    assert back[900] is None and all(back[d] == t.replace("▁", " ") for d, t in rows if t is not None)
    assert encode_pieces(df.limit(0), PATH).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_sentence_pieces(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for d, t in rows[:40]:
        ids, text = library.encode(t), t.replace("▁", " ")
        r = next(r for r in got if r["doc_id"] == d)
        assert (r["n_ids"], r["ids_crc32"], r["n_chars"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(text))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("bits", [["the", "ing", "tion", "er", "in", "s", "q"], ["a"], ["漢", "é", "x", "on", "😀"], [" ", "a", " the"]])
def test_very_long_texts_with_and_without_blanks(library, bits):
    rng = random.Random(len(bits))
    text = "".join(rng.choice(bits) for _ in range(2_000_000 // len("".join(bits)) * len(bits) // 2))
    began = time.perf_counter()
    got = piece_model(PATH).encode([text.encode(), b"short", b""])
    assert time.perf_counter() - began < 30
    assert got == library.encode([text, "short", ""])


def test_chunks_with_one_hash_are_told_apart(library, monkeypatch):
    model = piece_model(PATH)
    monkeypatch.setattr(model, "hasher", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    part = texts(50, 9)
    assert model.encode([t.encode() for t in part]) == library.encode(part)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_ids int")
    assert round_trip(df, PATH).columns == ["doc_id", "n_ids", "ids_crc32", "text"]
    assert round_trip(df.limit(0), PATH).count() == encode_pieces(df.limit(0), PATH).count() == 0
