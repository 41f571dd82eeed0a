"""Operator 4: quality rules with cross-document line frequency.

Every document gets word, symbol and repetition counts from its whole text. Its lines are normalised
(ASCII lower case, white space runs as one space) and hashed together with the host, which is the
document's source. A line that more than ``min_docs`` distinct documents of a host hold, and more than
``max_share`` of the host's documents, is boilerplate there; a document that would lose more than
``max_removed`` of its words with such lines is depleted and rejected. The report counts, and
``keep_good`` also cuts the lines out of the documents that stay.

Distinct documents are distinct texts: exact copies count once, so a clean text is not rejected for
having copies; telling copies apart is the near-duplicate operator's task.

Plan: one scan counts line hashes with map-side combining and keeps those at or above the smallest
limit, a superset of the frequent ones; a bitmap of fixed size tells a second scan which lines to
emit, and only these are counted exactly by distinct text and joined back. Texts are shuffled only of
documents that are rejected or hold boilerplate.

Defined cases: a null text has no words and is rejected; a null host is a host of its own; repeated
rows get equal verdicts; a share equal to a limit is within it; a very long text is counted whole, line
by line; other columns are ignored (quality_report) or kept, whatever their names (keep_good); an empty
table gives no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import batches, cut, drop_rows, in_bitmap, keep_rows, key_bitmap, lean, plain, row_keys, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 2  # a line in at most so many distinct documents of a host is never boilerplate: a floor against chance, so that the share decides on small hosts too
MAX_SHARE_PERCENT = 2  # of the host's distinct documents
MAX_REMOVED_PERCENT = 70  # of a document's words
SALTS = 64
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    marked = bytearray(len(words))
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked[i : i + 3] = b"\1\1\1"
    return sum(marked)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes((c,))) for c in SPACES)
    symbols = sum(text.count(bytes((c,))) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def line_words(text: bytes, host: bytes | None) -> dict[int, int]:
    """For each distinct normalised line with a word: its signed 64-bit hash with the host, and its words in the text."""
    salt = b"\x00" if host is None else b"\x01" + host + b"\x00"
    found: dict[int, int] = {}
    for line in text.split(b"\n"):
        words = line.lower().split()
        if words:
            h = xxhash.xxh3_64_intdigest(salt + b" ".join(words))
            h -= (h >> 63) << 64
            found[h] = found.get(h, 0) + len(words)
    return found


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    binary = [batch.column(n).cast(pa.binary()).to_pylist() for n in ("text", "source")]
    yield from zip(*binary, *(c.to_pylist() for c in batch.columns[2:]), strict=True)


def _count_scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        hashes = array("q")
        for text, host in _texts(batch):
            if text:
                hashes.extend(line_words(text, host))
        yield pa.record_batch([pa.array(np.frombuffer(hashes, np.int64))], names=["line"])


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_report(docs: DataFrame, min_docs: int = MIN_DOCS, max_share_percent: float = MAX_SHARE_PERCENT, max_removed_percent: float = MAX_REMOVED_PERCENT) -> DataFrame:
    """One row per document row: doc_id, the five counts, base_failed, n_removed_words, kept, the row's _k1 and _k2, and removed_lines (hashes)."""
    keyed = row_keys(docs.select("doc_id", "text", "source"))
    lines = docs.select("text", "source").mapInArrow(lean(_count_scan), "line long")
    often = cut(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs).select("line"))
    sent = key_bitmap(often, "line")

    schema = pa.schema([("doc_id", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("_fp", pa.int64()), ("_host", pa.int64())] + [(m, pa.int64()) for m in MEASURES] + [("_lines", pa.list_(pa.int64())), ("_words", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bitmap = sent.value
        for batch in it:
            for text, host, doc_id, k1, k2, fp, host_key in _texts(batch):
                found = line_words(text or b"", host)
                keys = np.fromiter(found, np.int64, len(found))
                hit = keys[in_bitmap(bitmap, keys)].tolist()
                yield doc_id, k1, k2, fp, host_key, *base_counts(text or b""), hit, [found[h] for h in hit]

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    ddl = "doc_id long, _k1 long, _k2 long, _fp long, _host long, " + ", ".join(f"{m} long" for m in MEASURES) + ", _lines array<long>, _words array<long>"
    base = cut(keyed.select("text", "source", "doc_id", "_k1", "_k2", F.xxhash64("text").alias("_fp"), F.xxhash64("source").alias("_host")).mapInArrow(lean(scan), ddl))

    held = base.select("_k1", "_k2", "_fp", "_host", F.explode(F.arrays_zip("_lines", "_words")).alias("x"))
    held = held.select("_k1", "_k2", "_fp", "_host", F.col("x._lines").alias("line"), F.col("x._words").alias("words"))
    spread = held.select("_host", "line", "_fp").distinct().groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = base.select("_host", "_fp").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"))
    boilerplate = spread.filter(F.col("n_docs") > min_docs).join(sizes, "_host").filter(F.col("n_docs") * 100 > F.col("host_docs") * max_share_percent).select("line")
    salted = boilerplate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a frequent line's holders go to many tasks
    hit = held.withColumn("salt", F.pmod("_k1", F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"], "left_semi")
    removed = hit.select("_k1", "_k2", "line", "words").distinct().groupBy("_k1", "_k2").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))
    out = base.drop("_lines", "_words", "_fp", "_host").join(removed, ["_k1", "_k2"], "left").fillna(0, ["n_removed_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * F.col("n_removed_words") > max_removed_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def cut_lines(text: bytes, host: bytes | None, removed: set[int]) -> bytes:
    """The text without its lines whose normalised hash (see line_words) is in removed."""
    return b"\n".join(x for x in text.split(b"\n") if line_words(x, host).keys().isdisjoint(removed))


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without the rows that quality_report rejects and without boilerplate lines in the others, whose n_chars, where there is one, is counted anew."""
    user, docs = docs.columns, plain(docs, "doc_id", "source", "text", "n_chars")
    report = quality_report(docs, min_docs)
    verdicts = cut(report.filter(~F.col("kept") | (F.col("n_removed_words") > 0)).select("_k1", "_k2", "kept", "removed_lines").dropDuplicates(["_k1", "_k2"]))
    good = drop_rows(docs, verdicts.select("_k1", "_k2"))
    schema = docs.schema
    names = schema.names
    place = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, hosts = (batch.column(n).cast(pa.binary()).to_pylist() for n in ("text", "source"))
            clean = [cut_lines(t, h, set(gone)) for t, h, gone in zip(texts, hosts, batch.column("removed_lines").to_pylist(), strict=True)]
            columns = [batch.column(n) for n in names]
            columns[place] = pa.array(clean, pa.binary()).cast(columns[place].type)
            yield pa.record_batch(columns, names=names)

    held = keep_rows(docs, verdicts.filter("kept").select("_k1", "_k2", "removed_lines")).mapInArrow(lean(run), schema)
    if "n_chars" in names:
        held = held.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return good.unionByName(held).toDF(*user)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", *MEASURES, "n_removed_words", "base_failed", "kept")


QUERIES = {"op4_quality": op4_quality}

SQL = {
    "op4_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
tri AS (SELECT rid, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL),
repeated AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, doc_id, source, text, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l),
good AS (SELECT *, array_to_string(ws, ' ') AS norm FROM lw WHERE len(ws) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM good GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
spread AS (SELECT source, norm, count(DISTINCT text) AS n_docs FROM good GROUP BY source, norm),
frequent AS (SELECT s.source, s.norm FROM spread s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
             WHERE n_docs > {MIN_DOCS} AND n_docs * 100 > host_docs * {MAX_SHARE_PERCENT}),
removed AS (SELECT rid, sum(len(ws)) AS n FROM good g JOIN frequent f ON g.source IS NOT DISTINCT FROM f.source AND g.norm = f.norm GROUP BY rid),
r AS (
  SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN removed USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND NOT 100 * n_removed_words > {MAX_REMOVED_PERCENT} * n_words AS kept
FROM r"""
}
