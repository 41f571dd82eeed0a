import zlib
from array import array

import corpus_pipeline
from linkloom.llm import packing


def test_pipeline_returns_the_tokens_of_every_piece(spark):
    rows = [(1, "some words to pack " * 700), (2, "a few"), (None, None)]
    got = corpus_pipeline.packing(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(got) > 3 and {r["doc_id"] for r in got} == {1, 2, None}
    for r in got:
        assert len(r["ids"]) == r["length"] and zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"]


def test_query_returns_digests_of_the_operators_ids(spark, tmp_path):
    rows = [(1, "a text"), (2, None), (3, "some words to pack " * 700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op5_packing(spark, str(tmp_path))
    assert "ids" not in got.columns
    full = packing.pack_documents(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["piece"], zlib.crc32(array("I", r["ids"]).tobytes())) for r in full)
