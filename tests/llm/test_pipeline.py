import hashlib
import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(30)]
    passage = " ".join(word() for _ in range(120))
    rows = [(i, t, "en", f"h{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "h9", 1), (101, clean[4] + " more", "en", "h9", 1), (102, "too short", "en", "h1", 9), (103, None, None, None, None)]
    rows += [(200 + i, " ".join(word() for _ in range(130)) + "\n" + passage, "en", "h2", 1) for i in range(2)]
    rows += [(300, " ".join(word() for _ in range(80)) + " password=hunter2222", "en", "h2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == df.columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == {r[0] for r in rows} - {102, 103}
    assert set(kept[1]) == set(kept[0]) - {100, 101}
    assert set(kept[2]) == set(kept[1]) and all(passage not in t for t in kept[2].values())
    assert all(kept[2][i] == clean[i] for i in range(30))
    assert "hunter2222" not in kept[3][300] and "<secret>" in kept[3][300]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3]) and sum(r["length"] for r in packed) > 0
    digest = lambda rows: hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)).encode()).hexdigest()
    assert digest(packed) == digest(corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_defined_cases_pass_all_stages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n=80: " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(n))
    copy = text()
    rows = [(1, copy, "s", 7, 1, 2), (1, copy, "s", 7, 1, 2), (None, text(), None, None, 3, 4), (2, None, "s", 7, 5, 6), (3, "", "s", 7, 5, 6), (4, text(9000), "s", 7, 8, 9)]
    schema = "doc_id long, text string, source string, spans int, _k1 long, node long"
    docs = spark.createDataFrame(rows, schema)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        out = stage(spark, docs, "")
        if number < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{number}")
            docs = spark.read.parquet(f"{tmp_path}/{number}")
            assert {r["_k1"]: (r["spans"], r["node"]) for r in docs.collect()} == {1: (7, 2), 3: (None, 4), 8: (7, 9)}
        else:
            assert {r["doc_id"] for r in out.collect()} == {1, 4, None} and out.filter("doc_id = 4").count() > 10
