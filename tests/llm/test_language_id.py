import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import language_id
from linkloom.llm.language_id import FEATURES, Ftrl, counts_of, fit, learn_languages, op3_language_id, predict_languages

ALPHABETS = {"aa": "abcdeé", "bb": "fghijü", "cc": "klmnoñ"}


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(list(ALPHABETS))
        word = lambda: "".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 7)))  # noqa: B023, E731
        rows.append((d, " ".join(word() for _ in range(rng.randint(3, 60))), None if rng.random() < 0.1 else lang, lang))
    return rows


def test_held_out_accuracy_and_defined_cases(spark, tmp_path):
    rows = corpus()
    truth = {r[0]: r[3] for r in rows}
    extra = [(9001, None, "aa"), (9002, "", "aa"), (9003, "123 !?\n", "bb"), (None, "abc", None)]
    df = spark.createDataFrame([r[:3] for r in rows] + extra, "doc_id long, text string, lang string").selectExpr("*", "'x' AS source", "1 AS score").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (d in set(held)) for d in truth)
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (9001, 9002, 9003)) and got[None]["held_out"] is False


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(200, 2)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    out = []
    for wrong in ("aa", "zz"):
        df = spark.createDataFrame([(d, t, wrong if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang, _ in rows], "doc_id long, text string, lang string")
        model = learn_languages(df, ~held)
        out.append(sorted(predict_languages(df, model).collect()))
    assert out[0] == out[1]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = learn_languages(df, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in predict_languages(df, model).collect()} == {("und", 0.0)}
    assert predict_languages(df.limit(0), model).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["Añb  c", "", "x\0y", "123", "añb c", "L'été."]
    together = list(counts_of(texts))
    for text, (at, count) in zip(texts, together, strict=True):
        alone = next(iter(counts_of([text])))
        assert (alone[0] == at).all() and (alone[1] == count).all()
    assert (together[0][0] == together[4][0]).all() and not len(together[3][0])


def test_the_penalty_leaves_weights_zero():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        label = i % 2
        at = np.unique(np.append(rng.integers(10, FEATURES, 20), label))
        rows.append(("ab"[label], at, np.ones(len(at), np.int64)))
    model = fit(rows, np.ones(FEATURES))
    assert (model.weights == 0).mean() > 0.8 and model.weights[0, 0] > 0 > model.weights[0, 1]
    assert Ftrl(3, 2).weights(slice(None)).sum() == 0 and language_id.UNKNOWN == "und"


def test_training_steps_against_plain_loops():
    rng = random.Random(5)
    model, rate, beta, l1, l2 = Ftrl(6, 3), 0.5, 1.0, 0.05, 0.1
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]
    weight = lambda f, c: 0.0 if abs(z[f][c]) <= l1 else -(z[f][c] - math.copysign(l1, z[f][c])) / ((beta + math.sqrt(n[f][c])) / rate + l2)
    for _ in range(200):
        at = sorted(rng.sample(range(6), rng.randint(1, 4)))
        x, label = [rng.random() for _ in at], rng.randrange(3)
        model.learn(np.array(at), np.array(x), label)
        w = [[weight(f, c) for c in range(3)] for f in at]
        e = [math.exp(sum(v * row[c] for v, row in zip(x, w, strict=True))) for c in range(3)]
        for i, f in enumerate(at):
            for c in range(3):
                g = x[i] * (e[c] / sum(e) - (c == label))
                sigma = (math.sqrt(n[f][c] + g * g) - math.sqrt(n[f][c])) / rate
                z[f][c] += g - sigma * w[i][c]
                n[f][c] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(slice(None)), [[weight(f, c) for c in range(3)] for f in range(6)])


def test_weights_are_tf_idf_of_unit_length():
    x = language_id.weights_of(np.array([0, 2]), np.array([1, 5]), np.array([2.0, 9.0, 0.5]))
    want = [1 * 2.0, (1 + math.log(5)) * 0.5]
    assert np.allclose(x, np.array(want) / math.hypot(*want))


def test_very_long_texts_are_counted_in_parts(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice("abcé  xyz\n1") for _ in range(5000))
    whole = next(iter(counts_of([text])))
    monkeypatch.setattr(language_id, "PART", 97)
    parts = next(iter(counts_of([text])))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert not len(next(iter(counts_of(["1 " * 300])))[0])


def test_empty_table_copies_and_too_many_languages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_language_id(spark, str(tmp_path)).count() == 0
    rows = [(1, "many copies of a text", "aa")] * 3000 + [(i, "eine andere sache " + "x" * (i % 7), "bb") for i in range(2, 300)]
    model = learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample_rows=100)
    assert model.languages == ["aa", "bb"] or model.languages == ["bb"]
    with pytest.raises(ValueError, match="languages"):
        fit([(str(i), np.array([1]), np.array([1])) for i in range(600)], np.ones(FEATURES))
