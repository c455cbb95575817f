"""View events as a stream: one event by user, url and day, and daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduped(events: DataFrame, keys: tuple[str, ...], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each key and day; the watermark is a day at least, so state for a day outlives it."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withColumn("day", F.to_date(at))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, "day"])


def daily(events: DataFrame, series: dict[str, str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts by day of each series, a condition in SQL."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 day")).agg(*(F.count_if(F.expr(c)).alias(k) for k, c in series.items())).select(F.to_date("window.start").alias("day"), *series)


def take_in(frame: DataFrame, path: str, state: str) -> StreamingQuery:
    """Take in what has arrived since the last call, add the finished rows to the files at path, and end.

    frame: a stream that appends. Offsets, watermark and state lie at `state`, so a call goes on where the last one ended, also
    after a lost driver: a day is written once, when the watermark has passed its end; events of a day that ended before the
    watermark of the calls before are late and dropped; those of unfinished days stay in the state.
    """
    query = frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
