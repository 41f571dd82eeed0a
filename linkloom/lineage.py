"""Cutting the lineage of iterative plans in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none a temporary folder is used, on a local master only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkloom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


FILES_PER_CORE = 2  # of a frame that is written, at least
FILE_BYTES = 32 << 20  # of what it is made from, for one file more


def _read_bytes(df: DataFrame) -> int:
    """How many bytes the files hold that a frame is made from; checkpoints count as what they are, not as Spark's guess."""
    total, leaves = 0, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            total += int(str(leaf.stats().sizeInBytes()))
        elif kind == "LogicalRDD" and (file := leaf.rdd().getCheckpointFile()).isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            total += path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def files_of(df: DataFrame) -> int:
    """In how many files a frame is written: in proportion to what it is made from, and a few for each core at least."""
    return max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-_read_bytes(df) // FILE_BYTES))


def cut(df: DataFrame, as_it_is: bool = False) -> DataFrame:
    """Materialise in the checkpoint folder and forget how it was made.

    Many small partitions become fewer files, unless the frame is to be written as it is: every file costs requests to the
    store, or processes that set its mode.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if as_it_is else df.coalesce(files_of(df))).checkpoint(eager=True)


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """For long chains of stages whose partitions are chosen already: no new plan after each stage."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table: for wide rows of which most readers want few columns."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.coalesce(files_of(df)).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*spent: DataFrame) -> None:
    """Delete the files of frames that cut() returned and nothing reads any more."""
    for df in spent:
        with suppress(Py4JError, AttributeError):  # what is not a checkpoint has no such file
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                remove_folder(df.sparkSession, file.get())


def _sorted_parts(df: DataFrame, order: list[str]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(files_of(df), *order).sortWithinPartitions(*order)
    return parts.withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)  # not cut(): partitions must stay in order


def with_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Number the rows from 0 in a total order without bringing them into one partition.

    Rows are range-sorted; only one count per partition is summed across partitions.
    """
    parts = _sorted_parts(df, order)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, local.cast("long")).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def with_prefix_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of a column over all earlier rows of a total order, as with_index does it."""
    parts = _sorted_parts(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn(name, local).join(F.broadcast(offsets), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")
