import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import toxicity
from linkloom.llm.toxicity import STRETCH, Words, learn_toxicity, op8_toxicity, score_toxicity, stretches, train

BAD = ["grumblor", "snazzvik", "quelfrat"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8)))
    rows = []
    for d in range(n):
        w = [word() for _ in range(rng.randint(4, 150))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        rows.append((d, " ".join(w), toxic))
    return rows


def test_held_out_accuracy_misspellings_and_defined_cases(spark, tmp_path):
    rows = corpus()
    extra = [(9001, None), (9002, ""), (9003, " .!"), (9004, "xabc grumblorr and snazvik quelfraat"), (None, "abc")]
    spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").selectExpr("*", "1 AS toxic").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, t) for d, _, t in rows] + [(5, 0, None), (None, 0, 1), (77777, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op8_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[d]["held_out"] for d, *_ in held) and got[None]["held_out"] is False
    assert np.mean([got[d]["predicted"] == t for d, _, t in held]) > 0.93
    assert got[9004]["predicted"] == 1 and got[9001]["score"] == got[9002]["score"] == got[9003]["score"]


def test_held_out_labels_change_nothing(spark):
    rows = corpus(200, 2)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    out = []
    for wrong in (0, 1):
        labels = spark.createDataFrame([(d, wrong if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, _, t in rows], "doc_id long, toxic int")
        out.append(sorted(score_toxicity(df, learn_toxicity(df, labels, ~held)).collect()))
    assert out[0] == out[1]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    model = learn_toxicity(df, spark.createDataFrame([(1, None)], "doc_id long, toxic int"), F.lit(True))
    assert score_toxicity(df, model).first()["score"] == 0.5 and score_toxicity(df.limit(0), model).count() == 0


def test_one_insult_decides_however_long_the_text():
    rows = corpus(500, 3)
    model = train([t.encode() for _, t, _ in rows], np.array([t for *_, t in rows]))
    rest = " ".join(t for _, t, toxic in rows[:60] if not toxic)
    clean, bad = model.margins([rest.encode(), (rest + " grumblor grumblor " + rest).encode()])
    assert bad > clean


def test_words_and_stretches():
    words = Words(["Ab ab, ÄB! x".encode(), b"", b"..."])
    assert len(words.hashes) == 3 and words.first.tolist() == [0, 4, 4, 4]
    buckets, begin = words.subwords(np.arange(3))
    assert len(begin) == 3 and begin[0] == 0 and len(buckets) > 3
    starts, text = stretches(np.array([0, 5, 5, 5 + 3 * STRETCH]))
    assert starts[0] == 0 and text.tolist() == [0, 2, 2, 2]


def plain_training(texts, labels, epochs, rate):
    """The training of embeddings and softmax, one number at a time."""
    rng = np.random.default_rng(11)
    emb = ((rng.random((toxicity.BUCKETS, toxicity.WIDTH), np.float32) - 0.5) / toxicity.WIDTH).astype(float)
    soft, bias = (rng.random((toxicity.WIDTH, 2)) - 0.5), np.zeros(2)
    past, past_soft, past_bias = np.full(toxicity.BUCKETS, 1e-6), np.full((toxicity.WIDTH, 2), 1e-6), np.full(2, 1e-6)
    words = toxicity.Words(texts)
    buckets, begin = words.subwords(np.arange(len(words.hashes)))
    bags = [b.tolist() for b in np.split(buckets, begin[1:])]
    starts, text = toxicity.stretches(words.first)
    spans = [words.word[a:b].tolist() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words.word)], strict=True)]
    for epoch in range(epochs):
        vector = [emb[b].mean(axis=0) for b in bags]
        mean = [sum(vector[w] for w in s) / len(s) for s in spans]
        logits = [m @ soft + bias for m in mean]
        weight = {k: 4.0 / sum(1 for t in text if t == text[k]) for k in range(len(spans))}
        if epoch:
            weight = {max((k for k in range(len(spans)) if text[k] == t), key=lambda k: (logits[k][1] - logits[k][0], -k)): 1.0 for t in set(text.tolist())}
        grad, grad_bias, to_bucket = np.zeros_like(soft), np.zeros(2), {}
        for k, share in weight.items():
            e = np.exp(logits[k])
            p = e / e.sum()
            p[labels[text[k]]] -= 1
            p *= share
            grad += np.outer(mean[k], p)
            grad_bias += p
            for w in spans[k]:
                for b in bags[w]:
                    to_bucket[b] = to_bucket.get(b, 0) + (soft @ p) / len(spans[k]) / len(bags[w])
        past_soft += grad**2
        past_bias += grad_bias**2
        soft -= 0.1 * grad / np.sqrt(past_soft)
        bias -= 0.1 * grad_bias / np.sqrt(past_bias)
        for b, step in to_bucket.items():
            past[b] += (step**2).mean()
            emb[b] -= rate * step / np.sqrt(past[b])
    return emb, soft, bias


def test_training_steps_against_plain_loops():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 60))).encode() for _ in range(20)]
    labels = np.array([rng.randint(0, 1) for _ in texts])
    model = toxicity.train(texts, labels, epochs=3, rate=0.3)
    emb, soft, bias = plain_training(texts, labels, 3, 0.3)
    assert np.allclose(model.embeddings, emb, atol=1e-4) and np.allclose(model.softmax, soft, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-4)


def test_very_long_texts_are_scored_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)).encode() for _ in range(10)]
    model = toxicity.train(texts, np.arange(10) % 2)
    long = b" ".join(texts)
    whole = model.scores([long])
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert np.allclose(model.scores([long]), whole)


def test_an_empty_table_and_a_sample_bounded_by_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op8_toxicity(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, f"copy number {i}") for i in range(2000)] + [(2, "kind words")] * 50, "doc_id long, text string")
    taken = []
    real = toxicity.train
    toxicity.train = lambda texts, toxic: taken.append(len(texts)) or real(texts, toxic)
    try:
        toxicity.learn_toxicity(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True), sample_rows=40)
    finally:
        toxicity.train = real
    assert taken[0] <= 40
