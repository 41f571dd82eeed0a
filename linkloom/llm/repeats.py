"""Operator 7: removal of long byte strings that the corpus holds more than once, by run-length indexes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

1. Sampling. Each window of ``length`` bytes has a minimizer, the least hash of its 32-byte strings, so
   equal windows have equal minimizers at equal offsets. Windows whose minimizer occurs once are unique;
   counting minimizers is one small aggregation.
2. Snippets. The other windows go, by minimizer, to index tasks as snippets: the text under neighbouring
   windows with the same minimizer. A task sends a snippet's text once and a mark of its second copy, both
   told from the others by their bytes; of further copies it keeps a reference to what it has sent.
3. Index. A task lays its distinct snippets end to end, about half a megabyte at a time, builds a
   run-length compressed Burrows-Wheeler transform with the suffixes sampled at run ends, streams the
   matching statistics, and marks windows with a match of full length. Nothing else marks a window. Of
   equal snippets the index holds one: suffixes of a copy stand next to those of its text, so a copy makes
   runs longer and adds one sample, at its first byte. References take the marks of what they refer to.
4. A minimizer with very many occurrences is spread over several index tasks. Windows that are unique in
   their own task go with their text to a second round, where a fingerprint of the whole window decides
   which index they meet in; so no task holds all that one minimizer has.
5. Two lengths. For passages that are repeated but shorter than ``length``, a report can take a shorter length
   too. Steps 1 to 4 run for that one, and again for ``length`` over the text under long enough runs of windows
   they have marked, where alone longer strings can be repeated. What goes is judged by ``length`` alone.

Defined cases: a null text is empty and loses nothing; texts shorter than ``length`` lose nothing; equal
rows are different documents, so whatever they hold in windows goes from both; every one of several
equal strings goes, so there are no ties; very long texts are scanned in pieces that overlap; other columns
are ignored (repeat_report) or kept, whatever their names (remove_repeats); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.byte_bpe import BASE, mixed
from linkloom.llm.common import batches, cut, in_bitmap, key_bitmap, lean, plain, release, row_keys, table
from linkloom.llm.packing import _portions
from linkloom.llm.runindex import RunIndex
from linkloom.llm.shingles import _Powers, mix

LENGTH = 400
STAGE_LENGTH = 240  # of the pipeline's stage and the query's n_repeated: passages of 50 words or more, which may have fewer than 400 bytes
GRAM = 32  # bytes, at least, of the strings that minimizers are taken from; twice as many for long windows
PORTION = 1 << 18  # bytes of text scanned at a time
INDEX_BYTES = 1 << 19  # snippet text of one index
SPREAD = 2_000  # occurrences of a minimizer that one index task takes
BUCKET_PRINTS = 1 << 18  # window fingerprints that are compared at a time
PLACE_BITS = np.uint64(20)  # of a place in a portion; a gram hash gives up so many bits
MET_BYTES = 16 << 20  # of snippets that a task remembers
BYTE_MIX = mixed(np.arange(256) + 70_000)


class Scan:
    """Snippets of texts laid end to end: for each, its text's number, first window (place in the text),
    number of windows, minimizer and a fingerprint of its bytes."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.data, self.length = b"".join(texts), length
        raw = np.frombuffer(self.data, np.uint8)
        gram = max(GRAM, min(2 * GRAM, length // 4))  # longer strings recur less by chance, but make more snippets
        n, wide = len(raw), length - gram + 1
        empty = np.empty(0, np.int64)
        self.text = self.first = self.windows = self.start = empty
        self.minimizer = self.digest = np.empty(0, np.int64)
        if n < length:
            return
        up, self.down = _Powers.upto(n + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_MIX[raw] * up[:n], out=self.total[1:])
            grams = mix((self.total[gram:] - self.total[:-gram]) * self.down[: n - gram + 1])
        assert n < 1 << int(PLACE_BITS)
        low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
        order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = (_sliding_min(order, wide) & low).astype(np.int64)  # for each window start, where its minimizer is
        whole = np.maximum(sizes - length + 1, 0)  # windows of each text; they come first among the places of its bytes
        inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([whole, sizes - whole], axis=1).ravel())[: len(least)]
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        at = self.start = np.flatnonzero(new)
        self.text = np.searchsorted(self.edges, at, "right") - 1
        self.windows = np.minimum(np.append(at[1:], n), (self.edges[:-1] + whole)[self.text]) - at
        self.first = at - self.edges[self.text]
        self.minimizer = grams[least[at]].astype(np.int64)

    def digests(self, pick: np.ndarray) -> np.ndarray:
        return self.fingerprints(self.start[pick], self.start[pick] + self.windows[pick] + self.length - 1)

    def fingerprints(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(BASE)).astype(np.int64)

    def again(self, pick: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Which of the picked snippets begin where the windows of the one before end, and are equal to it by their digests."""
        out = np.zeros(len(pick), bool)
        a, b = pick[:-1], pick[1:]
        out[1:] = (self.start[b] == self.start[a] + self.windows[a]) & (self.windows[b] == self.windows[a]) & (self.minimizer[b] == self.minimizer[a]) & (digests[1:] == digests[:-1])
        return out

    def periodic(self, i: int, n: int) -> bool:
        """Whether n snippets from i on, with as many windows each, have equal bytes."""
        a, period = int(self.start[i]), int(self.windows[i])
        size = (n - 1) * period + self.length - 1
        return self.data[a : a + size] == self.data[a + period : a + period + size]

    def snippet(self, i: int) -> bytes:
        a = int(self.start[i])
        return self.data[a : a + int(self.windows[i]) + self.length - 1]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many neighbours, from least-so-far arrays of both directions in blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _scans(it: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[Scan, list[list], list[int]]]:
    """Scans of the first column's texts, portion by portion, with the rows' other columns and where in its
    text each piece begins. A long text is scanned in pieces that overlap by a window less one byte."""
    for batch in it:
        texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        rest = [c.to_pylist() for c in batch.columns[1:]]
        pieces = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), PORTION)]
        cut_texts = [texts[i] if len(texts[i]) <= PORTION else texts[i][a : a + PORTION + length - 1] for i, a in pieces]
        for a, b in _portions(cut_texts, PORTION):
            yield Scan(cut_texts[a:b], length), [[c[i] for i, _ in pieces[a:b]] for c in rest], [x for _, x in pieces[a:b]]


TEXT, SECOND, FURTHER = 0, 1, 2  # kinds of rows: a snippet's text, its second copy in a task, a further copy
SNIPPETS = "minimizer long, kind int, rep long, k1 long, k2 long, first long, windows int, digest long, bytes binary"


class Copies:
    """How often a task has met something, and a number for it; forgets now and then, which only costs sending it again."""

    def __init__(self, most: int = MET_BYTES):
        self.met: dict = {}
        self.size, self.most, self.given = 0, most, 0

    def before(self, key, size: int) -> tuple[int, int]:
        entry = self.met.get(key)
        if entry is None:
            if self.size > self.most:
                self.met.clear()
                self.size = 0
            entry = self.met[key] = [0, self.given]
            self.given += 1
            self.size += size
        entry[0] += 1
        return entry[0] - 1, entry[1]


def snippets(texts: DataFrame, length: int, spread: int) -> DataFrame:
    """The snippets of texts (text, _k1, _k2, _at: its place in its document) whose minimizer occurs twice or more. part: which of
    its index tasks a minimizer's occurrence goes to.

    rep: a task's number for a snippet. Of a snippet's copies a task sends two to the index; the others go, as
    part -1, wherever there is room, and those of a periodic text that follow one another as one row of all their windows.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = Copies()
        for scan, _, _ in _scans(it, length):
            pick = np.arange(len(scan.start))
            digests = scan.digests(pick) if len(pick) else pick
            again = scan.again(pick, digests)
            again[1:] &= again[:-1]  # two of a row of neighbours tell as much as all
            keys = zip(scan.minimizer[~again].tolist(), digests[~again].tolist(), strict=True)
            yield pa.record_batch([pa.array([k[0] for k in keys if copies.before(k, 80)[0] < 2], pa.int64())], names=["minimizer"])

    counts = texts.select("text").mapInArrow(lean(count), "minimizer long").groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counts.filter("n > 1"))
    sent = key_bitmap(often, "minimizer", 32)  # what passes by chance is text for the index
    schema = pa.schema([("minimizer", pa.int64()), ("kind", pa.int32()), ("rep", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("digest", pa.int64()), ("bytes", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bitmap, copies, own = sent.value, Copies(), TaskContext.get().partitionId() << 40
        for scan, (k1, k2, at), base in _scans(it, length):
            pick = np.flatnonzero(in_bitmap(bitmap, scan.minimizer))
            digests = scan.digests(pick) if len(pick) else pick
            columns = [c.tolist() for c in (pick, scan.minimizer[pick], scan.text[pick], scan.first[pick], scan.windows[pick], digests)]
            heads = np.flatnonzero(~scan.again(pick, digests)).tolist()
            for x, y in pairwise([*heads, len(pick)]):
                whole = y - x > 2 and scan.periodic(columns[0][x], y - x)
                for j in range(x, y):
                    i, h, t, first, windows, digest = (c[j] for c in columns)
                    text = scan.snippet(i)
                    n, rep = copies.before((h, text), len(text))
                    kind = min(n, FURTHER)
                    place = at[t] + base[t] + first
                    yield k1[t] if kind == FURTHER else h, kind, own + rep, k1[t], k2[t], place, windows, digest, None if n else text
                    if whole and n and j + 1 < y:  # the others are further copies too, side by side
                        yield k1[t], FURTHER, own + rep, k1[t], k2[t], place + windows, (y - j - 1) * windows, digest, None
                        break

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema, 4096, 2 << 20)

    found = texts.select("text", "_k1", "_k2", "_at").mapInArrow(lean(run), SNIPPETS)
    heavy = often.filter(F.col("n") > spread).select("minimizer", F.ceil(F.col("n") / spread).cast("int").alias("parts"))
    parts = found.join(heavy, "minimizer", "left")
    further = F.col("kind") == FURTHER
    part = F.when(further, F.lit(-1)).otherwise(F.coalesce(F.pmod(F.col("digest"), F.col("parts")), F.lit(0)))
    return parts.select("minimizer", part.cast("int").alias("part"), "kind", "rep", "k1", "k2", "first", "windows", "bytes", (F.col("parts").isNotNull() & ~further).alias("heavy"))


def _looked_up(keyed: list[tuple], length: int) -> tuple[list[int], list[bytes], list[int], np.ndarray]:
    """For (group, text) keys: the number of each one's text, the distinct texts, where each of these begins in their index,
    and which of the index's places begin a window that it finds elsewhere."""
    number: dict[tuple, int] = {}
    copied: list[bool] = []
    of: list[int] = []
    for key in keyed:
        k = number.setdefault(key, len(number))
        if k == len(copied):
            copied.append(False)
        else:
            copied[k] = True
        of.append(k)
    texts = [text for _, text in number]
    index = RunIndex(texts, np.array(copied))
    return of, texts, (index.ends - index.lengths).tolist(), index.statistics() >= length


def _marked(keyed: list[tuple], length: int) -> tuple[list[int], list[bytes], list[np.ndarray]]:
    """For (group, text) keys: the number of each one's text, the distinct texts, and for each of these which of its windows
    the index finds elsewhere among all."""
    of, texts, begin, long = _looked_up(keyed, length)
    return of, texts, [long[a : a + len(t) - length + 1] for a, t in zip(begin, texts, strict=True)]


def _marked_runs(keyed: list[tuple], length: int) -> tuple[list[int], list[bytes], list[list[tuple[int, int]]]]:
    """Like _marked, with the runs of marked windows of each text."""
    of, texts, begin, long = _looked_up(keyed, length)
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    found = _runs(long)  # none goes beyond its text, whose last places begin no window
    for k, (a, b) in zip((np.searchsorted(begin, [a for a, _ in found], "right") - 1).tolist(), found, strict=True):
        runs[k].append((a - begin[k], b - begin[k]))
    return of, texts, runs


def _gaps(runs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The runs of what is between runs, of n places."""
    edges = [-1, *(x for run in runs for x in run), n]
    return [(a + 1, b - 1) for a, b in zip(edges[0::2], edges[1::2], strict=True) if a + 1 < b]


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


FOUND = "k1 long, k2 long, first long, last long, rep long, bytes binary"


def repeated_windows(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """k1, k2 (of row_keys), first, last: runs of window starts in a document that have an equal window elsewhere."""
    return _repeated(row_keys(docs.select("doc_id", "source", "text")).withColumn("_at", F.lit(0).cast("long")), length, spread)


def longer_windows(docs: DataFrame, windows: DataFrame, short: int, length: int, spread: int = SPREAD) -> DataFrame:
    """What repeated_windows finds for length, from its result for a shorter length.

    All short windows inside a repeated long one are repeated, so only the text under long enough runs of them is
    searched again. No place is in two such texts with a whole window.
    """
    schema = pa.schema([("text", pa.binary()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("_at", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text, k1, k2, spans in zip(texts, *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                for a, b in covered([(s["first"], s["last"]) for s in spans or []], 1):  # runs of window starts, end exclusive
                    if b - a + short > length:
                        yield text[a : b + short - 1], k1, k2, a

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    _, hit = _with_spans(docs.select("doc_id", "source", "text"), windows)
    texts = cut(hit.select("text", "_k1", "_k2", "spans").mapInArrow(lean(run), "text binary, _k1 long, _k2 long, _at long"))
    found = _repeated(texts, length, spread)
    release(texts)
    return found


def _repeated(texts: DataFrame, length: int, spread: int) -> DataFrame:
    order = ["minimizer", "part"]
    names = ["minimizer", "part", "kind", "rep", "k1", "k2", "first", "windows", "bytes", "heavy"]
    rows = snippets(texts, length, spread).repartition(*order).sortWithinPartitions(*order, "kind").select(*names)
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("rep", pa.int64()), ("bytes", pa.binary())])

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group, size, at = [], 0, None
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != at and (size > INDEX_BYTES or (group and (row[9] or group[-1][9]))):
                    yield group
                    group, size = [], 0
                at = row[:2]
                group.append(row)
                size += len(row[8] or b"")
        if group:
            yield group

    def marks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Runs of a document's windows (k1, k2, first, last), further copies (k1, k2, first, last, rep), which of those they
        refer to are marked (rep), and text that goes to the second round (k1, k2, first, bytes or, of marked windows, bytes)."""
        for together in groups(it):
            group = []
            for row in together:
                if row[2] == FURTHER:
                    yield row[4], row[5], row[6], row[6] + row[7] - 1, row[3], None
                else:
                    group.append(row)
            if not group:
                continue
            text_of = {row[3]: (row[0], row[8]) for row in group if row[2] == TEXT}
            of, texts, runs = _marked_runs([text_of[row[3]] for row in group], length)
            shown: set[int] = set()
            for row, k in zip(group, of, strict=True):
                _, _, kind, rep, k1, k2, first, windows, _, heavy = row
                for a, b in runs[k]:
                    yield k1, k2, first + a, first + b, None, None
                if kind == SECOND and runs[k] == [(0, windows - 1)]:  # as a copy's always are
                    yield None, None, None, None, rep, None
                if heavy:
                    for a, b in _gaps(runs[k], windows):
                        yield k1, k2, first + a, None, None, texts[k][a : b + length]
                    if k not in shown:
                        for a, b in runs[k]:
                            yield None, None, None, None, None, texts[k][a : b + length]
                    shown.add(k)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(marks(it), schema, 4096, 2 << 20)

    found = cut(rows.mapInArrow(lean(run), FOUND))
    spans = found.filter("k1 is not null and last is not null and rep is null").select("k1", "k2", "first", "last")
    verdicts = found.filter("k1 is null and rep is not null").select("rep")
    copies = found.filter("k1 is not null and rep is not null").select("rep", "k1", "k2", "first", "last").join(verdicts, "rep", "left_semi").drop("rep")
    return spans.unionByName(copies).unionByName(_across(found.filter("bytes is not null").select("k1", "k2", "first", "bytes"), length))


def _across(texts: DataFrame, length: int) -> DataFrame:
    """Windows of heavy minimizers that are unique in their index task but have an equal one in another's texts."""

    total = texts.agg(F.coalesce(F.sum(F.octet_length("bytes") - length + 1), F.lit(0))).first()[0]
    buckets = total // BUCKET_PRINTS + 1

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's distinct fingerprints of windows, those of a bucket in one row; such as it has twice go twice."""
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                every = np.sort(np.concatenate(held))
                third = np.zeros(len(every), bool)
                third[2:] = every[2:] == every[:-2]
                every = every[~third]
                bucket = np.mod(every, buckets)
                by = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.diff(bucket[by], prepend=-1))
                own = [x.tobytes() for x in np.split(every[by], edge[1:])]
                yield pa.record_batch([pa.array(bucket[by][edge]), pa.array(own, pa.binary())], names=["bucket", "prints"])

        for batch in it:
            for x in batch.column(0).to_pylist():
                held.append(window_prints(x, length))
                size += len(held[-1])
                if size > BUCKET_PRINTS:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    def repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def twice_in(held: list[np.ndarray]) -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            return pa.record_batch([pa.array(np.unique(every[1:][every[1:] == every[:-1]]))], names=["print"])

        at, held = None, []
        for batch in it:
            for bucket, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and held:
                    yield twice_in(held)
                    held = []
                at = bucket
                held.append(np.frombuffer(x, np.int64))
        if held:
            yield twice_in(held)

    by_bucket = texts.select("bytes").mapInArrow(lean(dealt), "bucket long, prints binary").repartition("bucket").sortWithinPartitions("bucket")
    twice = cut(by_bucket.mapInArrow(lean(repeated), "print long"))
    sent = key_bitmap(twice, "print")
    schema = pa.schema([("print", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            marked = Copies()  # of windows that are marked already two in a task are enough
            for batch in it:
                for k1, k2, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = window_prints(data, length)
                    for w in np.flatnonzero(in_bitmap(sent.value, own)).tolist():
                        text = data[w : w + length]
                        if k1 is not None or marked.before(text, length)[0] < 2:
                            yield int(own[w]), k1, k2, None if k1 is None else first + w, text

        yield from batches(rows(), schema, 4096, 2 << 20)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(group: list[tuple]) -> Iterator[tuple]:
            of, _, marked = _marked([(row[0], row[4]) for row in group], length)
            for (_, k1, k2, first, _), k in zip(group, of, strict=True):
                if k1 is not None and marked[k][0]:
                    yield k1, k2, first

        def rows() -> Iterator[tuple]:
            group: list[tuple] = []
            for batch in it:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if len(group) * length > INDEX_BYTES and row[0] != group[-1][0]:
                        yield from decided(group)
                        group = []
                    group.append(row)
            if group:
                yield from decided(group)

        yield from batches(rows(), pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64())]), 4096)

    late = texts.mapInArrow(lean(near), "print long, k1 long, k2 long, first long, bytes binary").join(twice, "print", "left_semi")
    late = late.repartition("print").sortWithinPartitions("print").select("print", "k1", "k2", "first", "bytes")
    return late.mapInArrow(lean(run), "k1 long, k2 long, first long").select("k1", "k2", "first", F.col("first").alias("last"))


def window_prints(text: bytes, length: int) -> np.ndarray:
    """64-bit fingerprints of all windows of a snippet."""
    raw = np.frombuffer(text, np.uint8)
    up, down = _Powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_MIX[raw] * up[: len(raw)], out=total[1:])
        return mix((total[length:] - total[:-length]) * down[: len(raw) - length + 1]).astype(np.int64)


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (start, end) under runs of windows (first, last)."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _with_spans(docs: DataFrame, *windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that surely have none of the first windows, and others with columns spans, spans1, ..: for each of
    the frames the runs (first, last) of a document, or null. Both with row_keys.

    Documents of the first kind are told by a bitmap and pass without a shuffle. Further windows lie in documents with some of the first.
    """
    names = ["spans", *(f"spans{i}" for i in range(1, len(windows)))]
    every = [w.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.struct("first", "last").alias("s"), F.lit(n).alias("n")) for n, w in zip(names, windows, strict=True)]
    spans = reduce(DataFrame.unionByName, every).groupBy("_k1", "_k2").agg(*(F.collect_set(F.when(F.col("n") == n, F.col("s"))).alias(n) for n in names))
    sent = key_bitmap(windows[0].select("k1").distinct(), "k1")
    keyed = row_keys(docs)

    def side(hit: bool):
        def run(it):
            bitmap = sent.value
            for batch in it:
                yield batch.filter(pa.array(in_bitmap(bitmap, batch.column("_k1").to_numpy()) == hit))

        return run

    clear = keyed.mapInArrow(lean(side(False)), keyed.schema)
    return clear, keyed.mapInArrow(lean(side(True)), keyed.schema).join(spans, ["_k1", "_k2"], "left")


def _ranges(batch: pa.RecordBatch, column: str, length: int) -> list[list[tuple[int, int]]]:
    spans = batch.column(batch.schema.get_field_index(column)).to_pylist()
    return [covered([(s["first"], s["last"]) for s in x], length) if x else [] for x in spans]


def _each(it: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[list]]]:
    for batch in it:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        yield batch, texts, _ranges(batch, "spans", length)


def remove_repeats(docs: DataFrame, length: int = STAGE_LENGTH, spread: int = SPREAD) -> DataFrame:
    """docs with the repeated bytes cut out of text (what is left of a cut character goes too), n_chars counted anew."""
    user, docs = docs.columns, plain(docs, "doc_id", "source", "text", "n_chars")
    names = docs.columns
    clear, hit = (side.drop("_k1", "_k2") for side in _with_spans(docs, cut(repeated_windows(docs, length, spread))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, ranges in _each(it, length):
            clean = [t if not r else without(t, r).decode("utf-8", "ignore").encode() for t, r in zip(texts, ranges, strict=True)]
            columns = [pa.array(clean, pa.binary()).cast(batch.schema.field(n).type) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.record_batch(columns, names=names)

    out = clear.unionByName(hit.mapInArrow(lean(run), docs.schema))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*user)


def repeat_report(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, short: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with a shorter length n_repeated too: the bytes that
    go at that length."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())])
    least = short or length
    if least > length:
        raise ValueError(f"short: {short} is more than {length}")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch, texts, near in _each(it, least):
            gone = _ranges(batch, "spans1", length) if short else near
            for doc_id, text, r, n in zip(batch.column(0).to_pylist(), texts, gone, near, strict=True):
                text = text or b""
                yield doc_id, len(text), sum(b - a for a, b in r), len(r), hashlib.sha256(without(text, r)).hexdigest(), sum(b - a for a, b in n)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    docs = docs.select("doc_id", "source", "text")
    windows = [cut(repeated_windows(docs, least, spread))]
    if short:
        windows.append(cut(longer_windows(docs, windows[0], short, length, spread)))
    clear, hit = _with_spans(docs, *windows)
    text, nothing = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = clear.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), nothing.alias("n_repeated"))
    spans = ["spans", "spans1"][: len(windows)]
    report = whole.unionByName(hit.select("doc_id", "text", *spans).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"))
    return report if short else report.drop("n_repeated")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = repeat_report(table(spark, sf_dir, "documents"), short=STAGE_LENGTH)
    return report.select("*", (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), (F.col("n_repeated") > 0).alias("repeated"))


QUERIES = {"op7_repeats": op7_repeats}
SQL: dict[str, str] = {}
