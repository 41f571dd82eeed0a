import random

import pytest

import corpus_pipeline
from linkloom.llm.near_dups import band_count, keep_one_each, near_duplicates

SCHEMA = "doc_id long, text string, source string"


def similar(rng, n, changed):
    """Two texts of n distinct words, with so many words changed far apart: a change costs five of n - 4 shingles."""
    words = [f"{rng.randrange(1 << 40):x}" for _ in range(n)]
    other = list(words)
    for k in range(changed):
        other[10 + 12 * k] = f"{rng.randrange(1 << 40):x}"
    return " ".join(words), " ".join(other), (n - 4 - 5 * changed) / (n - 4 + 5 * changed)


def rows_around(percent, pairs=60):
    rng = random.Random(percent)
    rows, links = [], set()
    for i in range(pairs):
        n = rng.randint(150, 260)
        a, b, s = similar(rng, n, rng.randint(1, (n - 20) // 12))
        rows += [(2 * i, a, "s"), (2 * i + 1, b, "s")]
        if 100 * s >= percent:
            links.add(2 * i)
    return rows, links


def test_bands_follow_the_threshold():
    assert band_count(85) == 24 and band_count(80) == 30
    for percent in (50, 70, 80, 85, 95):
        n = band_count(percent)
        assert 120 % n == 0 and (1 - (percent / 100) ** (120 // n)) ** n < 1e-6


@pytest.mark.parametrize("percent", [80, 85])
def test_links_against_brute_force(spark, percent):
    rows, links = rows_around(percent)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["component_id"] for r in near_duplicates(df, percent).filter("not kept").collect()} == links


def test_stage_links_at_80_percent(spark):
    rng = random.Random(5)
    rows, gone = [], set()
    for i in range(8):
        a, b, s = similar(rng, 204, 4)
        assert 0.8 < s < 0.85
        rows += [(10 * i, a, "s"), (10 * i + 1, b, "s")]
        gone.add(10 * i + 1)
    assert {r["doc_id"] for r in keep_one_each(spark.createDataFrame(rows, SCHEMA)).collect()} == {r[0] for r in rows} - gone


def test_one_row_of_repeated_rows_and_of_copies_without_ids_passes_all_stages(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(80))
    repeated, nameless, mixed, least = text(), text(), text(), text()
    rows = [(1, repeated, "en", "a", len(repeated))] * 3 + [(None, nameless, "en", h, len(nameless)) for h in "abb"]
    rows += [(None, mixed, "en", "a", 1), (7, mixed, "en", "b", 1), (7, mixed + " more", "en", "a", 1)]
    rows += [(9, least, "en", "c", 1), (8, least, "en", "b", 1), (2, text(), "en", "b", 1)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        got = [r["doc_id"] for r in docs.collect()]
        if name == "quality rules":
            assert len(got) == len(rows)
        elif name != "packing":
            assert sorted(got, key=str) == [1, 2, 7, 8, None]
            assert all(len(r["text"]) > 400 for r in docs.collect())
    assert set(got) == {1, 2, 7, 8, None} and docs.filter("length > 100").count() == 5


def test_repeated_empty_rows_stay(spark):
    rows = [(1, "", "s"), (1, "", "s"), (None, None, "s")]
    assert keep_one_each(spark.createDataFrame(rows, SCHEMA)).count() == 3
