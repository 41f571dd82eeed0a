"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, and each but the last returns the columns of documents:
documents that fail the quality rules go, and boilerplate lines go from the others; of each group of
near-duplicates one stays; byte strings that the rest holds more than once are cut out; secrets are
replaced; what is left is tokenized and packed.

Defined cases, as in the operators: a null text fails the quality rules; of repeated rows one stays; a
document whose whole text is cut packs as its closing token; equal rows, null ids and hosts, texts of any
length and further columns of any name pass all stages, and those columns are kept up to packing; an
empty table gives no rows. Every stage's rows are deleted once the next one's are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkloom.lineage import files_of, remove_folder
from linkloom.llm.common import ensure_checkpoint_dir, settle, small_batches
from linkloom.llm.near_dups import keep_one_each
from linkloom.llm.packing import pack_documents
from linkloom.llm.quality import keep_good
from linkloom.llm.repeats import remove_repeats
from linkloom.llm.secrets import redact


def begin(spark: SparkSession) -> None:
    """Executors start a stage without what the one before has left in their memory."""
    small_batches(spark)
    settle(spark)


def compact(rows: DataFrame) -> DataFrame:
    """rows in files in proportion to what they are made from, not one for each task of the last shuffle.

    What has run by now to prepare them is cleared away before they are made and written.
    """
    settle(rows.sparkSession)
    return rows.coalesce(files_of(rows))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return compact(keep_good(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return compact(keep_one_each(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return compact(remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return compact(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return compact(pack_documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the table documents; each stage's rows are written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs


ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
