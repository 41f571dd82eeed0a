"""The frontier as unbounded keyed state: what was seen, and where each URL stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.lineage import ensure_checkpoint_dir
from linkloom.operators.links import crawlable_links
from linkloom.operators.policy import url_key

#: What an event does to a URL; an event that does not fit the state changes nothing.
TRANSITIONS = {
    ("UNSEEN", "PUSH"): "QUEUED",
    ("QUEUED", "POP"): "FETCHING",
    ("FETCHING", "OK"): "DONE",
    ("FETCHING", "REDIRECT"): "DONE",
    ("FETCHING", "FAIL"): "FAILED",
}


def link_stream(pages: DataFrame) -> DataFrame:
    """url of every kept link of a stream of pages."""
    return pages.select(F.explode(crawlable_links(F.coalesce("html", F.lit("")))).alias("url"))


def unseen(urls: DataFrame, ttl: str | None = None, time: str | None = None) -> DataFrame:
    """A stream of URLs without those seen before; with a time column and ttl, state older than ttl is dropped."""
    keyed = urls.withColumn("url_key", url_key(F.col("url")))
    if ttl and time:
        return keyed.withWatermark(time, ttl).dropDuplicatesWithinWatermark(["url_key"])
    return keyed.dropDuplicates(["url_key"])


def url_states(events: DataFrame) -> DataFrame:
    """A stream of events (url, event, at) to url_key, state, changes: where each URL stands after a batch, events in order of
    at, those of one time by name."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, changes = state.get if state.exists else ("UNSEEN", 0)
        events = pd.concat(list(frames)).drop_duplicates(["at", "event"]).sort_values(["at", "event"])
        for event in events["event"].to_numpy():
            after = TRANSITIONS.get((now, event))
            if after:
                now, changes = after, changes + 1
        state.update((now, changes))
        yield pd.DataFrame({"url_key": [key[0]], "state": [now], "changes": [changes]})

    keyed = events.withColumn("url_key", url_key(F.col("url")))
    return keyed.groupBy("url_key").applyInPandasWithState(advance, "url_key string, state string, changes long", "state string, changes long", "update", GroupStateTimeout.NoTimeout)


def shared_path(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all there is and return its output with column batch; each may change a batch."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/part={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/progress").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("part")
