"""The run manifest: one block of text a run, appended to a folder, and read back as a table."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.hashing import list_hash
from linkloom.schema import MANIFEST

SEPARATOR = "-" * 60
#: Names of a section's counts in the text.
LABELS = {"elapsed_ms": "Elapsed", "seeds_added": "Seeds added", "discovered": "Discovered", "fetched": "Fetched", "nodes": "Graph nodes", "edges": "Graph edges"}


@dataclass(frozen=True)
class Run:
    """What a crawl came to."""

    elapsed_ms: float
    seeds_added: int
    discovered: int
    fetched: int
    nodes: int
    edges: int


def block(settings: dict[str, object], seeds: list[str], runs: dict[str, Run], at: datetime | None = None) -> str:
    """A run's text: settings (mode, profile, threads, max_depth, max_pages), hash of the seeds, a section for each run, and
    for THREADED and MANUAL how they compare."""
    head = {"timestamp": (at or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")} | settings | {"seed_hash": list_hash(seeds)}
    lines = [SEPARATOR, *(f"{k}={v}" for k, v in head.items())]
    for name, run in runs.items():
        lines += ["", f"[{name}]", *(f"{LABELS[k]}: {f'{v:.2f} ms' if k == 'elapsed_ms' else v}" for k, v in asdict(run).items())]
    if {"THREADED", "MANUAL"} <= runs.keys():
        a, b = runs["THREADED"].elapsed_ms, runs["MANUAL"].elapsed_ms
        ratio = f"{b / a:.2f}x" if a else "-"
        lines += ["", "[COMPARISON]", f"Threaded time: {a:.2f} ms", f"Manual time: {b:.2f} ms", f"Speedup (manual/threaded): {ratio}"]
    return "\n".join([*lines, ""])


def append_manifest(spark: SparkSession, path: str, settings: dict[str, object], seeds: list[str], runs: dict[str, Run], at: datetime | None = None) -> None:
    """Add a run's block; a block is one file, so appending never tears one."""
    spark.createDataFrame([(block(settings, seeds, runs, at),)], "value string").coalesce(1).write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each section of each run, with the run's settings; files that hold many blocks are read as well."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^-{10,}\r?$")).alias("run")).filter(F.col("run").contains("="))
    sections = F.expr(r"regexp_extract_all(run, '(?ms)^\\[([A-Z]+)\\]', 1)")
    parts = files.select("run", F.posexplode(sections).alias("i", "section"), F.split("run", r"(?m)^\[[A-Z]+\]\r?$").alias("parts")).filter("section <> 'COMPARISON'")
    body = parts.select("run", "section", F.element_at("parts", F.col("i") + 2).alias("body"))
    setting = lambda k: F.nullif(F.regexp_extract("run", rf"(?m)^{k}=([^\r\n]*)", 1), F.lit(""))
    count = lambda k: F.nullif(F.regexp_extract("body", rf"(?m)^{LABELS[k]}: ([0-9.]+)", 1), F.lit(""))
    fields = [x.split(" ", 1) for x in MANIFEST.split(", ")]
    return body.select(*((F.col("section") if n == "section" else (count(n) if n in LABELS else setting(n)).cast(kind)).alias(n) for n, kind in fields))
