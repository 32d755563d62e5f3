"""Crawl logs as streams: windows by domain, deduplication, and adaptive rate limits as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.session import shared_dir


def monitor(log: DataFrame, domain: str = "domain", ts: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, domain, events, errors): counts by domain and time window; late rows beyond the delay are left out."""
    return log.withWatermark(ts, delay).groupBy(F.window(ts, window), domain).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") >= 400).alias("errors"))


def first_seen(urls: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each url once within the watermark."""
    return urls.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def rate_limit(log: DataFrame, domain: str = "domain", base: float = 1000.0, low: float = 100.0, high: float = 30000.0) -> DataFrame:
    """(domain, delay_ms, fails) after each micro-batch: doubled by 429 and 503, cut by a quarter by 2xx, else as it was.

    log has (domain, seq, status); within a micro-batch responses are taken in the order of seq.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay, fails = state.get if state.exists else (base, 0)
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.status in (429, 503):
                delay, fails = min(delay * 2, high), fails + 1
            elif 200 <= row.status < 300:
                delay, fails = max(delay * 0.75, low), 0
        state.update((float(delay), int(fails)))
        yield pd.DataFrame({domain: [key[0]], "delay_ms": [float(delay)], "fails": [int(fails)]})

    return log.select(domain, "seq", "status").groupBy(domain).applyInPandasWithState(update, f"`{domain}` {log.schema[domain].dataType.simpleString()}, delay_ms double, fails int", "delay double, fails int", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream to the end of what its source holds now, into a memory table; for tests and replays of bounded size."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def bounded_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files of a folder or pattern as a stream that takes at most so many a micro-batch, so that a backlog can't flood it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Results as they come, appended to a table in the shared folder until the source holds no more, and that table.

    The checkpoint lies beside it, so a lost driver goes on where it was; nothing is gathered on the driver.
    """
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", where).option("checkpointLocation", where + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(where)


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Each micro-batch handed to `send` with its number, as server-sent results would be, until the source holds no more."""
    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def as_events(results: DataFrame, kind: str = "result") -> DataFrame:
    """(value): results as the lines of an event stream."""
    return results.select(F.concat(F.lit(f"event: {kind}\ndata: "), F.to_json(F.struct(*results.columns)), F.lit("\n\n")).alias("value"))
