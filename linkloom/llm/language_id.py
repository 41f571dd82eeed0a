"""Operator 3: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 4 letters, lower case, words bounded by a
blank). Document frequencies come from all documents that may be learned from, in one distributed pass.
The weights are trained with follow-the-regularised-leader (per-coordinate rates, elastic net), which
leaves most of them zero, on a sample of ``sample_rows`` labelled documents at most, with SAMPLE_BYTES of
text at most, spread evenly over the languages and drawn by hash; a part of the sample that is not trained
on sets the temperature that calibrates the scores.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every text where there
is nothing to learn from; a null doc_id is not held out; repeated rows stay repeated, but are drawn once;
of equal scores the language first in the alphabet is named; the n-grams of a very long text are counted in
parts, all of them; more than MAX_LANGUAGES languages are refused with an error; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.byte_bpe import LETTER, Classes, mixed
from linkloom.llm.common import bounded_sample, held_out, lean, table
from linkloom.llm.packing import _portions
from linkloom.llm.shingles import mix

FEATURES = 1 << 15
GRAMS = (1, 2, 3, 4)
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20  # of the sample's texts together
MAX_LANGUAGES = 512  # weights are FEATURES by languages, on the driver and sent to every task
EPOCHS = 3
CALIBRATION_SHARE = 5  # one document of so many
UNKNOWN = "und"
PART = 1 << 18  # n-grams of a long text that are hashed at a time
GRAM_MIX = mixed(np.arange(100, 100 + len(GRAMS) + 1)) | np.uint64(1)
_classes = Classes()


def counts_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its features and how often it has each; none for a text without letters."""
    codes = np.frombuffer("\0".join([t.lower() for t in texts] + [""]).encode("utf-32-le"), np.uint32)
    codes = np.where(_classes(codes) == LETTER, codes, np.where(codes == 0, 0, 32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] > 32)  # one blank between words, none at the start
    codes = codes[keep]
    ends = np.flatnonzero(codes == 0)
    if len(ends) != len(texts):  # texts with zero characters of their own
        for t in texts:
            yield from counts_of([t.replace("\0", " ")])
        return
    if len(texts) == 1 and len(codes) > PART:
        yield _sparse(sum(np.bincount(np.concatenate(_grams(codes[a : min(a + PART + max(GRAMS) - 1, len(codes) - 1)], PART)), minlength=FEATURES) for a in range(0, len(codes) - 1, PART)), codes)
        return
    found = _grams(codes, len(codes))
    start = 0
    for end in ends.tolist():
        total = np.bincount(np.concatenate([f[start : max(start, end - n + 1)] for n, f in zip(GRAMS, found, strict=True)]), minlength=FEATURES)
        yield _sparse(total, codes[start:end])
        start = end + 1


def _grams(codes: np.ndarray, starts: int) -> list[np.ndarray]:
    """Features of the n-grams that begin at the first so many places, for each n."""
    hashes = mixed(codes)
    found = []
    for n in GRAMS:
        m = min(starts, max(0, len(codes) - n + 1))
        with np.errstate(over="ignore"):
            h = np.full(m, GRAM_MIX[n])
            for k in range(n):
                h = mix(h * GRAM_MIX[1] + hashes[k : k + m])
        found.append((h >> np.uint64(64 - 15)).astype(np.int64))
    return found


def _sparse(total: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(total) if (codes > 32).any() else np.empty(0, np.int64)
    return at, total[at]


def weights_of(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return (x / norm if norm else x).astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader with elastic net."""

    def __init__(self, features: int, classes: int, rate: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.rate * w
        self.n[at] = more


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, at: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(weights_of(at, count, self.idf) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = EPOCHS) -> LanguageModel:
    """Train on (language, features, counts) rows in a fixed order; every fifth calibrates."""
    languages = sorted({r[0] for r in rows})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; {MAX_LANGUAGES} at most")
    number = {l: i for i, l in enumerate(languages)}
    data = [(at, weights_of(at, count, idf), number[l]) for l, at, count in rows if len(at)]
    few = len(data) < 10 * CALIBRATION_SHARE
    train = data if few else [d for i, d in enumerate(data) if i % CALIBRATION_SHARE]
    model = Ftrl(len(idf), max(1, len(languages)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            model.learn(*train[i])
    w = model.weights(slice(None))
    held = [] if few else data[::CALIBRATION_SHARE]
    scores = [(x @ w[at], y) for at, x, y in held]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 60):
        loss = -sum(np.log(softmax(s / t)[y] + 1e-12) for s, y in scores)
        best = min(best, (loss, float(t)))
    return LanguageModel(languages, w, idf, best[1])


def _features(it: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, int, list]]:
    for batch in it:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        for a, b in _portions(texts):
            yield batch, a, b, list(counts_of(texts[a:b]))


def learn_languages(docs: DataFrame, learnable, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from the rows of docs (doc_id, text, lang) for which learnable holds."""
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for _, _, _, found in _features(it, 0):
            for at, _ in found:
                total[at] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"])

    df = rows.select("text").mapInArrow(lean(frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # FEATURES rows at most
    feature, n = df.column("feature").to_numpy(), df.column("n").to_numpy()
    seen = np.zeros(FEATURES)
    seen[feature[feature >= 0]] = n[feature >= 0]
    idf = np.log((1 + n[feature < 0].sum()) / (1 + seen)) + 1

    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(sample_rows)) / F.col("_n") / F.col("_langs")
    quota = sizes.crossJoin(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("_langs")))).select("lang", share.alias("_share"))
    draw = (F.xxhash64(F.lit("draw"), "doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).alias("_draw")
    sample = rows.select("doc_id", "lang", "text", draw).join(F.broadcast(quota), "lang").filter("_draw < _share")
    sample = bounded_sample(sample.dropDuplicates(["doc_id", "lang", "text"]), sample_rows, SAMPLE_BYTES).select("text", "lang", "_draw")
    sample = sample.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)  # the limit has left one partition
    schema = pa.schema([("lang", pa.string()), ("draw", pa.float64()), ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int32()))])

    def sampled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, found in _features(it, 0):
            yield pa.record_batch([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], schema=schema)

    got = sample.mapInArrow(lean(sampled), "lang string, draw double, at array<int>, count array<int>").toArrow()
    order = np.argsort(got.column("draw").to_numpy(), kind="stable")
    langs, ats, counts = got.column("lang").to_pylist(), got.column("at"), got.column("count")
    return fit([(langs[i], ats[i].values.to_numpy(), counts[i].values.to_numpy()) for i in order.tolist()], idf)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch, a, b, found in _features(it, 1):
            said = [known.predict(at, count) for at, count in found]
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    return predict_languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
