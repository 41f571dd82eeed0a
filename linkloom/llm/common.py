"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.lineage import cut, ensure_checkpoint_dir, release

__all__ = ["cut", "ensure_checkpoint_dir", "release"]
HELD_OUT_BUCKET = 2  # crc32(doc_id as text) mod 4 that is never learned from


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_BUCKET, F.lit(False))


def bounded_sample(rows: DataFrame, most: int, max_bytes: int) -> DataFrame:
    """The first rows by _draw (and text): so many at most, whose texts have together no more than so many bytes."""
    order = [F.col("_draw"), F.xxhash64("text")]
    first = rows.withColumn("_size", F.octet_length("text")).orderBy(*order).limit(most)
    upto = F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over `most` rows
    return first.withColumn("_upto", upto).filter(F.col("_upto") <= max_bytes).drop("_size", "_upto")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks get rows in Arrow batches of a few megabytes, unless the application has set another size."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4m")


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into record batches of bounded row count and (roughly) bounded bytes."""
    columns: list[list] = [[] for _ in schema]
    weight = 0
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
            if hasattr(value, "__len__"):
                weight += len(value)
        if len(columns[0]) >= size or weight >= max_bytes:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns, weight = [[] for _ in schema], 0
    if columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def utf8_rows(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int | None, bytes | None]]:
    """(first column, UTF-8 bytes of the text column) of each row, without decoding; null stays None."""
    ids = batch.column(0).to_pylist()
    column = batch.column(text)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    yield from zip(ids, column.cast(pa.large_binary() if wide else pa.binary()).to_pylist(), strict=True)


def lean(run):
    """A function for mapInArrow that, at a task's end, gives the memory its Python worker no longer uses back to the machine."""

    @wraps(run)
    def wrapped(it):
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def settle(spark: SparkSession) -> None:
    """Let the executors' JVMs collect what earlier stages left and give the memory they no longer use back to the machine.

    Like lean() for Python workers: a heap that is grown by one stage stays so, beside all that the next one takes. A task a core
    reaches every idle executor; no rows are read, and nothing depends on it.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of a bitmap: 128 KB to 32 MB


def key_bitmap(keys: DataFrame, column: str, each: int = 8):
    """A broadcast bitmap of 64-bit keys, with so many bits or more a key up to MOST_BITS. Beyond that more rows pass it; an exact
    join or the index always follows."""
    import numpy as np

    count = keys.count()
    bits = LEAST_BITS
    while bits < min(each * count, MOST_BITS):
        bits *= 2
    bit = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("bits"))
    got = words.toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))


def in_bitmap(bitmap, keys):
    """Boolean array: which of the int64 keys may be in the bitmap (no false negatives)."""
    import numpy as np

    bit = np.mod(keys, 64 * len(bitmap)).astype(np.uint64)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def plain(docs: DataFrame, *known: str) -> DataFrame:
    """docs with every column but the known ones under a name that no operator uses (extra 0, extra 1, ...), whatever it was called."""
    names = [n if n in known and n not in docs.columns[:i] else f"extra {i}" for i, n in enumerate(docs.columns)]
    return docs.toDF(*names)


def row_keys(docs: DataFrame) -> DataFrame:
    """Add _k1, _k2: 128 bits that identify a row's doc_id, source and text; equal rows share them."""
    return docs.withColumns({"_k1": F.xxhash64("doc_id", "source", "text"), "_k2": F.xxhash64(F.lit("second"), "text", "doc_id", "source")})


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose (_k1, _k2) are in keys.

    Rows that miss a bitmap of the keys pass without a shuffle; only the others meet the keys in an
    exact anti-join, so the texts of kept documents stay where they were read.
    """
    schema = docs.schema
    sent = key_bitmap(keys, "_k1")
    keyed = row_keys(docs)

    def side(hit: bool):
        def run(it):
            bitmap = sent.value
            for batch in it:
                yield batch.filter(pa.array(in_bitmap(bitmap, batch.column("_k1").to_numpy()) == hit))

        return run

    clear = keyed.mapInArrow(lean(side(False)), keyed.schema)
    maybe = keyed.mapInArrow(lean(side(True)), keyed.schema).join(keys.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_anti")
    return clear.unionByName(maybe).select(*schema.names)


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose (_k1, _k2) are in keys, once each there, with keys' columns."""
    sent = key_bitmap(keys, "_k1")
    keyed = row_keys(docs)

    def run(it):
        bitmap = sent.value
        for batch in it:
            yield batch.filter(pa.array(in_bitmap(bitmap, batch.column("_k1").to_numpy())))

    return keyed.mapInArrow(lean(run), keyed.schema).join(keys, ["_k1", "_k2"])
