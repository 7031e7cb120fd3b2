"""Structured Streaming over append-only tables: windows, first sights, touched runs.

Each function reads a folder as a stream, runs it over what is there and ends
(``availableNow``); on a cluster the same query may run on. State and progress
live in the shared folder given, so a lost executor or driver goes on from the
last batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A table's folder or file as a stream, ``files`` new files per batch at most."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def finish(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream to the end of its input; its result as a table in ``folder``.

    append: rows are written as they are final. complete: the whole result
    replaces the former after each batch; it must stay small, as counts do.
    """
    out = f"{folder}/table"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{number}")

        query = writer.outputMode("complete").foreachBatch(keep).start()
        query.awaitTermination()
        last = query.lastProgress
        return stream.sparkSession.read.parquet(f"{out}/{last['batchId']}") if last else stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def tumbling_counts(events: DataFrame, time: str, every: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    """(start, by, events, total) per window; events later than ``late`` are dropped once the watermark has passed them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, every).alias("_w"), *by).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return w.select(F.col("_w.start").alias("start"), *by, "events", "total")


def sliding_counts(events: DataFrame, time: str, size: str, step: str, by: list[str], late: str = "1 day") -> DataFrame:
    w = events.withWatermark(time, late).groupBy(F.window(time, size, step).alias("_w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return w.select(F.col("_w.start").alias("start"), *by, "events")


def sessions(events: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    """(by, start, events) per session: events with less than ``gap`` between neighbours; batch or stream."""
    return events.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(F.count(F.lit(1)).alias("events")).select(*by, F.col("_w.start").alias("start"), "events")


def first_sights(events: DataFrame, key: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once: what a frontier admits. With ``time`` the seen set forgets keys older than ``late``."""
    if time is None:
        return events.select(*key).dropDuplicates(key)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def rederive(stream: DataFrame, folder: str, key: str, derive: Callable[[DataFrame], None]) -> None:
    """Calls ``derive`` with the distinct keys each batch touched, once per batch, until the input's end."""
    def touched(batch: DataFrame, number: int) -> None:
        derive(batch.select(key).distinct())

    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(touched).start().awaitTermination()
