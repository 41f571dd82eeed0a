"""Operator 5: best-fit packing of tokenized documents into sequences.

Documents are cut into pieces of at most ``capacity`` tokens and packed bulk-synchronously. A piece over
half the capacity opens a sequence, since no two of these share one; what the sequences have left are gaps.
Then rounds follow. A round opens as many empty sequences as the pieces need beyond the room of all gaps,
range-sorts pieces and gaps by size, and sweeps once: going up, a gap takes the largest piece below it
that no smaller gap has taken, so a piece goes to its successor among the gaps. In the sorted order
this is the matching of brackets: ranks (a running count of pieces less gaps, summed over the ranges)
tell which piece meets which gap, and settle all conflicts at once. Gaps are updated, and rounds repeat
until all pieces are placed. While there are many more pieces than gaps, pieces of one length go in
bundles. The last rows, SMALL at most, are one range, whose rounds run in one task.

Texts are tokenized in one pass; sweeps carry lengths and numbers only. Special strings of the vocabulary
inside a text are ordinary text.

Defined cases: a null text is empty and packs as the closing token alone; repeated rows are packed
separately; pieces of one length are interchangeable, the one that was numbered last goes first; very long
texts are tokenized in parts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.byte_bpe import byte_bpe
from linkloom.llm.common import batches, cut, lean, table
from linkloom.lineage import stored, with_prefix_sum

CAPACITY = 1024
CLOSING_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless with_ids): texts' ids and a closing id, in pieces.

    Only documents over the capacity are cut; all pieces but the first are full.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in it:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _portions(texts):
                ids, counts = bpe.encode(texts[a:b])
                out: list[list] = [[] for _ in schema]
                at = 0
                for doc_id, n in zip(doc_ids[a:b], counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], closing_id).astype("<u4")
                    at += n
                    start, k = 0, 0
                    while start < len(own):
                        end = start + (((len(own) - 1) % capacity + 1) if k == 0 else capacity)
                        part = own[start:end]
                        for column, value in zip(out, (doc_id, k, start, end - start, zlib.crc32(part.tobytes()), part.view("<i4") if with_ids else None), strict=True):
                            column.append(value)
                        start, k = end, k + 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECES)


def _portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


SMALL = 1 << 14  # pieces and gaps that are one range
BUNDLED = 8  # pieces for each gap from which on they go in bundles


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any table with a column length, 1 to capacity) with sequence_id and offset."""
    spark, names = pieces.sparkSession, pieces.columns
    kept = stored(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    low, high = kept.agg(F.min("length"), F.max("length")).first()
    if low is not None and not 1 <= low <= high <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    own = kept.filter(F.col("length") * 2 > capacity).select("_piece", "length")
    placed = [own.select("_piece", F.col("_piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = kept.filter(F.col("length") * 2 <= capacity).select("_piece", F.col("length").cast("long").alias("length"))
    gaps = own.select(F.col("_piece").alias("sequence_id"), (capacity - F.col("length")).cast("long").alias("gap")).filter("gap > 0")
    opened = 0  # sequences that began empty have negative numbers
    while True:
        n, room, least = left.agg(F.count(F.lit(1)), F.sum("length"), F.min("length")).first()
        if not n:
            break
        gaps = gaps.filter(F.col("gap") >= least)
        n_gaps, there = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum("gap"), F.lit(0))).first()
        if n + n_gaps <= SMALL:
            placed.append(cut(_one_range(left, gaps, capacity, opened)))
            break
        more = max(0, -((there - room) // capacity))
        if more:
            gaps = gaps.unionByName(spark.range(more).select((-1 - opened - F.col("id")).alias("sequence_id"), F.lit(capacity).cast("long").alias("gap")))
            opened += more
        swept = _sweep(left, gaps, max(1, n * 2 // (BUNDLED * (n_gaps + more))), capacity)
        met = swept.filter("kind = 0 AND other_kind = 1").select("sequence_id", F.posexplode("pieces").alias("i", "_piece"), "other_size", "length")
        placed.append(met.select("_piece", "sequence_id", (capacity - F.col("other_size") + F.col("i") * F.col("length")).alias("offset")))
        left = swept.filter("kind = 0 AND other_kind IS DISTINCT FROM 1").select(F.explode("pieces").alias("_piece"), "length")
        gaps = swept.filter("kind = 1").select("sequence_id", (F.col("size") - F.when(F.col("other_kind") == 0, F.col("other_size")).otherwise(0)).alias("gap")).filter("gap > 0")
    places = cut(reduce(DataFrame.unionByName, placed))
    return kept.join(places, "_piece").select(*names, "sequence_id", "offset")


def _bundles(left: DataFrame, size: int, capacity: int) -> DataFrame:
    """length, pieces: up to so many pieces of one length, as they come in a task."""
    schema = pa.schema([("length", pa.int64()), ("pieces", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_: dict[int, list[int]] = {}
        for batch in it:
            for piece, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = open_.setdefault(length, [])
                held.append(piece)
                if len(held) >= min(size, capacity // length):
                    yield length, open_.pop(length)
        yield from open_.items()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    return left.select("_piece", "length").mapInArrow(lean(run), "length long, pieces array<long>")


def _sweep(left: DataFrame, gaps: DataFrame, bundle: int, capacity: int) -> DataFrame:
    """One sweep: rows of pieces (kind 0: size, length, pieces) and gaps (kind 1: size, sequence_id), each with what it met.

    Of a piece sequence_id, other_kind and other_size are those of the next row of its level, its gap if that is one; of a
    gap other_kind and other_size are those of the row before, its piece if that is one.
    """
    few = left.select("length", F.array("_piece").alias("pieces")) if bundle == 1 else _bundles(left, bundle, capacity)
    items = few.select((F.col("length") * F.size("pieces")).alias("size"), F.lit(0).alias("kind"), F.element_at("pieces", 1).alias("number"), "length", "pieces")
    rooms = gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("sequence_id").alias("number"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("array<long>").alias("pieces"))
    step = F.when(F.col("kind") == 0, 1).otherwise(-1).cast("long")
    order = ["size", "kind", "number"]  # a piece before the gaps of its size
    ranked = with_prefix_sum(items.unionByName(rooms).withColumn("step", step), order, "step", "before")
    level = Window.partitionBy(F.col("before") + F.col("kind").isin(0).cast("long")).orderBy(*order)  # of a size a level has two rows at most
    piece = F.col("kind") == 0
    meets = {
        "other_kind": F.when(piece, F.lead("kind").over(level)).otherwise(F.lag("kind").over(level)),
        "other_size": F.when(piece, F.lead("size").over(level)).otherwise(F.lag("size").over(level)),
        "sequence_id": F.when(piece, F.lead("number").over(level)).otherwise(F.col("number")),
    }
    return cut(ranked.withColumns(meets).select("kind", "size", "length", "pieces", "sequence_id", "other_kind", "other_size"))


def sweep_small(pieces: list[int], gaps: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """All rounds over one range. For each piece (by place in the list) its sequence, a place in gaps or, from the
    length of gaps on, a new one, and its offset."""
    room, out = list(gaps), []
    left = sorted(range(len(pieces)), key=lambda i: (pieces[i], i))
    open_ = list(range(len(gaps)))
    while left:
        least = pieces[left[0]]
        open_ = [g for g in open_ if room[g] >= least]
        for _ in range(max(0, -((sum(room[g] for g in open_) - sum(pieces[i] for i in left)) // capacity))):
            open_.append(len(room))
            room.append(capacity)
        waiting: list[int] = []
        at = 0
        for g in sorted(open_, key=lambda g: (room[g], g)):
            while at < len(left) and pieces[left[at]] <= room[g]:
                waiting.append(left[at])
                at += 1
            if waiting:
                i = waiting.pop()
                out.append((i, g, capacity - room[g]))
                room[g] -= pieces[i]
        left = waiting + left[at:]
    return out


def _one_range(left: DataFrame, gaps: DataFrame, capacity: int, opened: int) -> DataFrame:
    """_piece, sequence_id and offset of the last pieces, SMALL rows with their gaps at most."""
    rows = left.select(F.lit(0).alias("kind"), F.col("_piece").alias("number"), F.col("length").alias("size")).unionByName(gaps.select(F.lit(1).alias("kind"), F.col("sequence_id").alias("number"), F.col("gap").alias("size")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        split = sum(1 for kind, _, _ in got if kind == 0)
        numbers, sizes = [n for _, n, _ in got], [x for _, _, x in got]
        met = sweep_small(sizes[:split], sizes[split:], capacity)
        there = len(got) - split
        ids = [numbers[split + g] if g < there else -1 - opened - (g - there) for _, g, _ in met]
        yield pa.record_batch([pa.array([numbers[i] for i, _, _ in met], pa.int64()), pa.array(ids, pa.int64()), pa.array([o for _, _, o in met], pa.int64())], names=["_piece", "sequence_id", "offset"])

    return rows.repartition(1).mapInArrow(lean(run), "_piece long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset, and with their ids unless these are not wanted."""
    import public_tokenizers

    pieces = tokenized_pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), capacity, with_ids=with_ids)
    return pack(pieces if with_ids else pieces.drop("ids"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece goes, with the digest of its ids; the ids themselves stay in the task that made them."""
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
