import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import repeats
from linkloom.llm.repeats import covered, remove_repeats, repeat_report, without
from linkloom.llm.runindex import RunIndex

SCHEMA = "doc_id long, text string, source string"


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t, _ in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [words(30) for _ in range(6)]
    rows = []
    for d in range(150):
        parts = [rng.choice([words(rng.randint(1, 25)), rng.choice(shared), rng.choice(shared)[5:-7], shared[0][:50]]) for _ in range(rng.randint(0, 6))]
        rows.append((d, " ".join(parts) if rng.random() > 0.03 else None, "s"))
    return rows + rows[:5] + [(900, "ab" * 300, "s"), (901, "", None), (None, shared[1], "q")]


@pytest.mark.parametrize(("length", "spread"), [(40, 4000), (40, 3), (100, 2)])
def test_against_brute_force(spark, length, spread):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS spans", "2 AS ranges").repartition(3)
    assert sorted([tuple(r) for r in repeat_report(df, length, spread).collect()], key=repr) == brute(rows, length)


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PORTION", 700)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(2500))
    fill = lambda n: "".join(rng.choice("ghijkl ") for _ in range(n))
    rows = [(1, fill(300) + passage + fill(1000), "s"), (2, fill(901) + passage + fill(55), "s"), (3, fill(3000), "s")]
    found = list(repeats._scans(iter([_batch([r[1].encode() for r in rows])]), 400))
    assert sum(int(s.windows.sum()) for s, _, _ in found) == sum(len(r[1]) - 399 for r in rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted([tuple(r) for r in repeat_report(df).collect()], key=repr) == brute(rows, 400)


def _batch(texts):
    import pyarrow as pa

    return pa.record_batch([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], names=["text", "k"])


def test_match_lengths_of_the_index():
    rng = random.Random(3)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(1, 40)))
        texts = []
        for _ in range(rng.randint(1, 7)):
            x = bytearray(base[rng.randint(0, len(base) - 1) :])
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = rng.choice(b"abc")
            texts.append(bytes(x))
        got = RunIndex(texts).statistics()
        places = [(i, j) for i, t in enumerate(texts) for j in range(len(t) + 1)]
        for k, (i, j) in enumerate(places):
            best = 0
            for other in places:
                if other != (i, j):
                    a, b, n = texts[i][j:], texts[other[0]][other[1] :], 0
                    while n < min(len(a), len(b)) and a[n] == b[n]:
                        n += 1
                    best = max(best, n)
            assert got[k] == best


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 499, 500):
        assert (repeats._sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()


def test_ranges():
    assert covered([(0, 3), (8, 8), (20, 21)], 5) == [(0, 13), (20, 26)]
    assert without(b"0123456789", [(2, 4), (8, 10)]) == b"014567"


def test_removal_keeps_columns(spark):
    text = "é" + "x" * 450
    rows = [(1, text, "s", 451), (2, text + "tail", "s", 455), (3, "short", None, 5), (4, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[2]["text"] == "tail"
    assert got[3]["text"] == "short" and got[4]["text"] is None
    assert remove_repeats(df.limit(0)).count() == 0


def test_only_the_statistics_of_the_index_mark(spark, tmp_path):
    """In a session of its own: with statistics of zero nothing goes, copies and heavy minimizers included."""
    script = tmp_path / "zero.py"
    script.write_text(
        "import numpy as np\nfrom linkloom.llm import repeats\nfrom linkloom.llm.runindex import RunIndex\nfrom tests.llm.test_repeats import SCHEMA, corpus\n"
        "from pyspark.sql import SparkSession\nimport pyspark.cloudpickle as cp, linkloom.llm.runindex as m\n"
        "cp.register_pickle_by_value(repeats)\ncp.register_pickle_by_value(m)\nRunIndex.statistics = lambda self: np.zeros(self.n, np.int64)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 2).config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('REMOVED', sum(r['n_removed'] for r in repeats.repeat_report(spark.createDataFrame(corpus(), SCHEMA).repartition(2), 40, 4).collect()))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, str(script)], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert "REMOVED 0" in said.stdout, said.stderr[-2000:]


def test_index_finds_copies():
    index = RunIndex([b"abcd" * 30, b"something else", b""], np.array([True, False, False]))
    assert index.statistics()[:121].tolist() == list(range(120, -1, -1))
    assert repeats._marked([("a", b"0123456789" * 5), ("b", b"q" * 39 + b"r"), ("a", b"0123456789" * 5)], 40)[2][0].all()


def test_clashing_columns_and_an_empty_table(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(900))
    rows = [(1, text, "s", 7, 8, 9, 10), (2, "x" + text, "s", 7, 8, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int, _k1 int, _k2 int, Text2 int")
    got = remove_repeats(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "", "s", 7, 8, 9, 10), (2, "x", "s", 7, 8, 9, 10)]
    assert remove_repeats(df.limit(0)).count() == repeat_report(df.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "length", "spread"), [(40, 100, 4000), (40, 100, 3), (60, 70, 2), (40, 40, 50)])
def test_two_lengths_against_brute_force(spark, short, length, spread):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS spans", "2 AS spans1").repartition(3)
    wanted = [(*far, near[2]) for far, near in zip(brute(rows, length), brute(rows, short), strict=True)]
    assert any(r[5] > r[2] > 0 for r in wanted) or short == length
    assert sorted([tuple(r) for r in repeat_report(df, length, spread, short).collect()], key=repr) == sorted(wanted, key=repr)
    with pytest.raises(ValueError):
        repeat_report(df, short - 1, spread, short)


def test_the_query_tells_passages_of_fifty_words(spark, tmp_path):
    """Passages of 51 to 60 words in two documents each, most under 400 bytes, are told; what goes is still judged by 400 bytes."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passages = [words(rng.randint(51, 60)) for _ in range(20)]
    rows = [(i, f"{words(40)} {passages[i // 2]} {words(30)}", "s") for i in range(40)] + [(i, words(130), "s") for i in range(40, 80)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in repeats.op7_repeats(spark, str(tmp_path)).collect()}
    assert [d for d in sorted(got) if got[d]["repeated"]] == list(range(40))
    assert all(240 <= got[d]["n_repeated"] < 460 for d in range(40)) and sum(len(p) < 390 for p in passages) > 10
    assert sorted([tuple(r)[:5] for r in got.values()], key=repr) == brute(rows, 400)
    assert all(r["kept_bytes"] == r["n_bytes"] - r["n_removed"] for r in got.values())


def test_periodic_texts(spark):
    """Neighbours with equal bytes go as one row: periods that one text holds, that several share, that are cut off or broken."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(1, "anea. " * 90, "s"), (2, words(30) + "anea. " * 31 + words(9), "s"), (3, "x" * 41, "s"), (4, "y" * 300 + words(20) + "y" * 39, "s")]
    rows += [(5, "that is so. " * 20 + "that is no. " * 20 + "that is so. " * 9, "s"), (6, "z" * 40, "s"), (7, words(8) + "z" * 40, "s"), (8, None, "s")]
    for n in (1, 4):
        df = spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(n)
        for length in (40, 100):
            assert sorted([tuple(r) for r in repeat_report(df, length).collect()], key=repr) == brute(rows + rows[:2], length)
    scan = repeats.Scan([rows[0][1].encode()], 40)
    again = scan.again(np.arange(len(scan.start)), scan.digests(np.arange(len(scan.start))))
    assert again.sum() > 60 and scan.periodic(int(np.argmax(again)), 20) and not scan.periodic(len(again) - 3, 5)
