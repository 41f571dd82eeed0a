"""Operator 8: toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 bytes of ``<word>``) and itself, hashed; its vector is
the mean of their embeddings, so a misspelling that was never seen still shares most of its vector. A
stretch of a dozen words is the mean of its words, and a linear softmax tells toxic ones. The
document's score is that of its most toxic stretch: a few insults decide, however long the text is.
Embeddings and softmax are trained together, first on all stretches, then on the stretch that decides.

Training takes a sample of ``sample_rows`` labelled documents at most (half of them toxic, as far as there
are), with SAMPLE_BYTES of text at most, drawn by hash. A part of it that is not trained on calibrates
the score, corrected for the share of toxic labels among all that may be learned from.

Defined cases: a null or empty text, or one without words, gets the score of the bare bias, as does every
text where there is nothing to learn from; a null doc_id is not held out; a document with several labels
is toxic if one says so; repeated rows stay repeated, but are drawn once; equal stretches score alike, so
ties do not matter; the words of a very long text are looked up in parts, all of them; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.byte_bpe import mixed
from linkloom.llm.common import bounded_sample, held_out, lean, table
from linkloom.llm.packing import _portions
from linkloom.llm.shingles import LOWER, cut_words, mix

BUCKETS = 1 << 16
WIDTH = 10
GRAMS = (3, 4, 5)
STRETCH = 12  # words
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20  # of the sample's texts together
PIECE = 1 << 19  # bytes of a long text whose words are looked up at a time
EPOCHS = 6
THRESHOLD = 0.3
CALIBRATION_SHARE = 5
CACHE_WORDS = 200_000

PART = np.ones(256, bool)  # bytes that part words: all ASCII but letters, digits and signs that stand for letters
PART[[*range(48, 58), *range(65, 91), *range(97, 123), *b"@$*"]] = False
PART[128:] = False
BYTE_MIX = mixed(LOWER + 30_000)
GRAM_MIX = mixed(np.arange(40_000, 40_010)) | np.uint64(1)


class Words:
    """Distinct words of some texts: their hashes, which word is at each place, and the subwords of each."""

    def __init__(self, texts: list[bytes]):
        self.data, self.starts, self.ends, hashes, self.first = cut_words(texts, PART, BYTE_MIX)
        self.word, self.hashes = pd.factorize(hashes)
        place = np.empty(len(self.hashes), np.int64)
        place[self.word[::-1]] = np.arange(len(self.word))[::-1]
        self.place = place

    def subwords(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the subwords of the picked distinct words, end to end, and where each word's begin."""
        a, b = self.starts[self.place[pick]], self.ends[self.place[pick]]
        size = b - a + 2
        edge = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(pick)), size)
        within = np.arange(edge[-1]) - edge[owner]
        codes = np.full(edge[-1], ord("<"))
        inner = (within > 0) & (within < size[owner] - 1)
        codes[inner] = LOWER[self.data[(a[owner] + within - 1)[inner]]]
        codes[edge[1:] - 1] = ord(">")
        symbols = mixed(codes)
        buckets, owners = [(mix(self.hashes[pick] ^ GRAM_MIX[0]) >> np.uint64(48)).astype(np.int64)], [np.arange(len(pick))]
        for n in GRAMS:
            with np.errstate(over="ignore"):
                h = np.full(max(0, len(codes) - n + 1), GRAM_MIX[n])
                for k in range(n):
                    h = mix(h * GRAM_MIX[1] + symbols[k : k + len(h)])
            whole = np.flatnonzero(within[: len(h)] + n <= size[owner[: len(h)]])
            buckets.append((h[whole] >> np.uint64(48)).astype(np.int64))
            owners.append(owner[whole])
        owners, buckets = np.concatenate(owners), np.concatenate(buckets)
        by = np.argsort(owners, kind="stable")
        return buckets[by], np.searchsorted(owners[by], np.arange(len(pick)))


def stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of words begin, and the text of each; a short rest joins the stretch before it."""
    starts, texts = [], []
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = max(1, round((b - a) / STRETCH)) if b > a else 0
        starts += [a + (b - a) * i // n for i in range(n)]
        texts += [t] * n
    return np.array(starts, np.int64), np.array(texts, np.int64)


@dataclass
class ToxicityModel:
    """Embeddings and softmax; scale and shift calibrate the difference of the two logits."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def word_vectors(self, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros((0, self.embeddings.shape[1]), np.float32)
        size = np.diff(np.append(begin, len(buckets)))
        return np.add.reduceat(self.embeddings[buckets], begin, axis=0) / size[:, None]

    def word_values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The difference of logits of every word, and for each text (and the end) the number of words before it."""
        words = Words(texts)
        direction = self.softmax[:, 1] - self.softmax[:, 0]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        hashes = words.hashes.tolist()
        new = np.array([i for i, h in enumerate(hashes) if h not in self.known], np.int64)
        if len(new):
            self.known.update(zip((hashes[i] for i in new.tolist()), (self.word_vectors(*words.subwords(new)) @ direction).tolist(), strict=True))
        return np.array([self.known[h] for h in hashes])[words.word] if hashes else np.empty(0), words.first

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """For each text the largest difference of logits of its stretches; the bias of a text without words."""
        if len(texts) == 1 and len(texts[0]) > PIECE:
            value = np.concatenate([self.word_values([x])[0] for x in _pieces(texts[0])])
            first = np.array([0, len(value)])
        else:
            value, first = self.word_values(texts)
        out = np.full(len(texts), -np.inf)
        starts, text = stretches(first)
        if len(starts):
            size = np.diff(np.append(starts, len(value)))
            np.maximum.at(out, text, np.add.reduceat(value, starts) / size)
        return np.where(np.isinf(out), 0.0, out) + self.bias[1] - self.bias[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(texts) + self.shift, -50, 50)))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not PART[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3) -> ToxicityModel:
    """Embeddings and softmax together, by gradients scaled per row."""
    rng = np.random.default_rng(11)
    model = ToxicityModel((rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH, (rng.random((WIDTH, 2)) - 0.5), np.zeros(2))
    past, past_softmax, past_bias = np.full(BUCKETS, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)
    batches = [np.arange(a, min(len(texts), a + 64)) for a in range(0, len(texts), 64)]
    prepared = []
    for rows in batches:
        words = Words([texts[i] for i in rows])
        starts, text = stretches(words.first)
        if len(starts):
            buckets, begin = words.subwords(np.arange(len(words.hashes)))
            prepared.append((labels[rows], words.word.astype(np.int32), buckets.astype(np.uint16), begin.astype(np.int32), starts, text))
    for epoch in range(epochs):
        for k in rng.permutation(len(prepared)):
            label, word, buckets, begin, starts, text = prepared[k]
            begin = begin.astype(np.int64)
            vectors = model.word_vectors(buckets, begin)
            size = np.diff(np.append(starts, len(word)))
            mean = np.add.reduceat(vectors[word], starts, axis=0) / size[:, None]
            logits = mean @ model.softmax + model.bias
            if epoch:
                order = np.lexsort((-(logits[:, 1] - logits[:, 0]), text))
                pick = order[np.flatnonzero(np.diff(text[order], prepend=-1))]  # each text's deciding stretch
                share = np.ones(len(pick))
            else:
                pick = np.arange(len(starts))
                share = 4.0 / np.bincount(text)[text]
            p = np.exp(logits[pick] - logits[pick].max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), label[text[pick]]] -= 1
            p *= share[:, None]
            to_mean = p @ model.softmax.T
            grad, grad_bias = mean[pick].T @ p, p.sum(axis=0)
            past_softmax += grad**2
            past_bias += grad_bias**2
            model.softmax -= 0.1 * grad / np.sqrt(past_softmax)
            model.bias -= 0.1 * grad_bias / np.sqrt(past_bias)
            spans = size[pick]
            which = np.repeat(np.arange(len(pick)), spans)
            at = np.repeat(starts[pick], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
            to_word = np.zeros_like(vectors, dtype=np.float64)
            np.add.at(to_word, word[at], to_mean[which] / spans[which][:, None])
            touched = np.flatnonzero(np.bincount(word[at], minlength=len(begin)))
            count = np.diff(np.append(begin, len(buckets)))[touched]
            own = np.repeat(np.arange(len(touched)), count)
            sub = buckets[np.repeat(begin[touched], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            rows, place = np.unique(sub, return_inverse=True)
            step = np.zeros((len(rows), WIDTH))
            np.add.at(step, place, (to_word[touched] / count[:, None])[own])
            past[rows] += (step**2).mean(axis=1)
            model.embeddings[rows] -= (rate * step / np.sqrt(past[rows])[:, None]).astype(np.float32)
    return model


def calibrate(model: ToxicityModel, texts: list[bytes], labels: np.ndarray, prior: float) -> None:
    """Scale and shift by logistic regression on the margins, each class weighted to its share among all labels."""
    if len(set(labels.tolist())) < 2:
        model.shift = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))) if not len(labels) else 0.0
        return
    x = np.column_stack([model.margins(texts), np.ones(len(texts))])
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - labels)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.scale, model.shift = max(float(w[0]), 1e-3), float(w[1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, learnable, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) of the rows for which learnable holds."""
    known = labels.filter(F.col("toxic").isNotNull() & learnable).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not counts:
        return ToxicityModel(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 2)), np.zeros(2))
    half = sample_rows / 2
    share = {t: min(1.0, half / n) for t, n in counts.items()}
    draw = F.xxhash64(F.lit("draw"), "doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    chosen = known.withColumn("_draw", draw).filter(F.when(F.col("toxic") == 1, F.col("_draw") < share.get(1, 0.0)).otherwise(F.col("_draw") < share.get(0, 0.0)))
    chosen = chosen.orderBy("_draw", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = bounded_sample(rows, sample_rows, SAMPLE_BYTES).select("_draw", "text", "toxic").toArrow()
    order = np.argsort(rows.column("_draw").to_numpy(), kind="stable")
    texts = [t.encode() for t in rows.column("text").take(pa.array(order)).to_pylist()]
    toxic = rows.column("toxic").to_numpy()[order]
    prior = counts.get(1, 0) / sum(counts.values())
    held = np.arange(len(texts)) % CALIBRATION_SHARE == 0
    if len(texts) < 10 * CALIBRATION_SHARE:
        model = train(texts, toxic)
        calibrate(model, texts, toxic, prior)
    else:
        model = train([t for t, h in zip(texts, held, strict=True) if not h], toxic[~held])
        calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], toxic[held], prior)
    model.known.clear()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in it:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _portions(texts):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(known.scores(texts[a:b]))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
