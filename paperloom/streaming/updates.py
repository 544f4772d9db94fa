"""Streams: fetched pages into the knowledge base, and event counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import ensure_importable
from ..operators.changes import latest
from ..plans.engine import Engine


def index_stream(engine: Engine, pages: DataFrame, software: str, version: str, checkpoint: str) -> StreamingQuery:
    """Indexes a stream of pages (url, html, seq) until what is there now is taken in.

    Each micro-batch keeps the last row of a URL and upserts, so a batch that is replayed changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        last = latest(batch, ["url"], "seq").drop("seq")
        if not last.isEmpty():
            engine.index(software, version, pages=last)

    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and values by type in tumbling or sliding windows; rows later than the watermark are dropped."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window), "event_type")
    out = own.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each user in sessions that a gap ends."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(urls: DataFrame) -> DataFrame:
    """A stateful filter: each URL of a stream (url, depth) the first time it comes, the frontier of a streamed crawl."""
    ensure_importable(urls.sparkSession)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        depth = min(int(f["depth"].min()) for f in frames)
        if not state.exists:
            state.update((depth,))
            yield pd.DataFrame({"url": [key[0]], "depth": [depth]})

    return urls.groupBy("url").applyInPandasWithState(keep, "url string, depth int", "depth int", "append", "NoTimeout")


def to_completion(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table in memory; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


