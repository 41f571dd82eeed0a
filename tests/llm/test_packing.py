import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import byte_bpe as bpe_module
from linkloom.llm.byte_bpe import byte_bpe
from linkloom.llm import packing
from linkloom.llm.packing import op5_packing, pack, pack_documents, sweep_small

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", "a", "Hello", "é", "ñ", "12", "٣", "!?", "...", "<|endoftext|>", " ", "　", "漢字", "😀", "é", "don't", "''", "'re", "\x85", "​", "x'sy", "'S"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["", "\x00", " ", "\n " * 40]


def test_ids_are_those_of_the_library(plain, monkeypatch):
    monkeypatch.setattr(bpe_module, "CHUNK", 500)
    sample = [*texts(3000), "Many words of a text, don't cut  it \n here. " * 60]
    ids, counts = byte_bpe(PATH).encode([t.encode() for t in sample])
    ends = np.cumsum(counts)
    for text, a, b in zip(sample, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check(rows, capacity):
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values(), default=0) <= capacity
    return fill


def least_sequences(counts, capacity):
    """A bound below which no packing gets: large pieces need sequences of their own, whatever is left of them helps the rest."""
    best = 0
    for a in range(capacity // 2 + 1):
        big = sum(c for n, c in counts.items() if n > capacity - a)
        middle = [(n, c) for n, c in counts.items() if capacity / 2 < n <= capacity - a]
        room = sum(c * (capacity - n) for n, c in middle)
        small = sum(c * n for n, c in counts.items() if a <= n <= capacity / 2)
        best = max(best, big + sum(c for _, c in middle) + max(0, -((room - small) // capacity)))
    return best


@pytest.mark.parametrize("capacity", [10, 1024])
def test_best_fit_is_valid_and_tight(capacity):
    rng = random.Random(capacity)
    counts = {rng.randint(1, capacity): rng.randint(1, 300) for _ in range(capacity)}
    lengths = [n for n, c in counts.items() for _ in range(c)]
    big, small = ([n for n in lengths if (n * 2 > capacity) == x] for x in (True, False))
    rows = [{"sequence_id": k, "offset": 0, "length": n} for k, n in enumerate(big)]
    rows += [{"sequence_id": g, "offset": o, "length": small[i]} for i, g, o in sweep_small(small, [capacity - n for n in big], capacity)]
    fill = check(rows, capacity)
    assert sorted(r["length"] for r in rows) == sorted(n for n, c in counts.items() for _ in range(c))
    assert len(fill) <= 1.02 * least_sequences(counts, capacity) + 1


@pytest.mark.parametrize(("lengths", "capacity"), [(lambda r: r.randint(1, 1024), 1024), (lambda r: r.choice([1, 2, 700]), 1024), (lambda r: 341, 1024), (lambda r: int(1024 * r.random() ** 3) + 1, 1024), (lambda r: r.randint(1, 10), 10)])
def test_distributed_sweeps_are_valid_and_tight(spark, lengths, capacity, monkeypatch):
    monkeypatch.setattr(packing, "SMALL", 60)
    rng = random.Random(capacity)
    rows = [(i, min(capacity, lengths(rng))) for i in range(900)]
    got = pack(spark.createDataFrame(rows, "item long, length long").repartition(3), capacity).collect()
    assert sorted((r["item"], r["length"]) for r in got) == rows
    fill = check(got, capacity)
    counts = Counter(n for _, n in rows)
    assert len(fill) <= 1.02 * least_sequences(counts, capacity) + 1


def test_any_table_with_lengths(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 3, 3, 5, 8, 10])) for i in range(500)]
    df = spark.createDataFrame(rows, "item long, length long").repartition(4)
    got = pack(df, 10).collect()
    assert sorted((r["item"], r["length"]) for r in got) == rows
    check(got, 10)
    with pytest.raises(ValueError, match="lengths"):
        pack(spark.createDataFrame([(1, 11)], "item long, length long"), 10)


def test_documents_come_back_from_the_sequences(spark, plain):
    sample = texts(60) + ["word " * 1500, "x" * 9000] * 2
    rows = [(i, t) for i, t in enumerate(sample)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS ids").repartition(3)
    got = pack_documents(df).collect()
    check(got, 1024)
    for doc_id, text in rows:
        pieces = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert [i for r in pieces for i in r["ids"]] == want
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and all(r["length"] == 1024 for r in pieces[1:])
        for r in pieces:
            assert r["ids"] == want[r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_repeated_rows_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_packing(spark, str(tmp_path)).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3 and "ids" not in got[0].asDict()
    assert pack_documents(df.limit(0)).count() == 0
