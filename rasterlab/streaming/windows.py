"""Cells and intensity per event-time window: one plan for a table and for a stream.

Two aggregates follow each other, first per track, then per condition, so that distinct tracks are
counted exactly without a set per window: the state of a stream holds one row for each open window,
condition and track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_activity(
    events: DataFrame, size: str, slide: str | None = None, late: str | None = None, time: str = "ts",
    condition: str = "condition", track: str = "track_id", value: str = "value",
) -> DataFrame:
    """Tracks seen, events and mean value in every window of every condition that has events.

    Windows are ``[window_start, window_end)``, ``size`` long, and start every ``slide`` (default:
    every ``size``), counted from 1970. Rows without a time belong to no window; a null track is no
    track and a null value no value, but both are events; a null condition is a condition.

    On a stream, ``late`` is how far behind the latest time an event may arrive; a window comes out
    once the latest time is that far beyond its end, and what arrives for it afterwards is left out
    and counted (``late_rows``). On a table nothing is late.
    """
    if events.isStreaming and late is None:
        raise ValueError("a stream needs to know how late events may be")
    timed = events.where(F.col(time).isNotNull())
    if late is not None and events.isStreaming:
        timed = timed.withWatermark(time, late)
    span = F.window(time, size, slide or size)
    number = F.col(value).cast("double")
    tracks = timed.groupBy(span.alias("window"), F.col(condition).alias("condition"), F.col(track).alias("_track")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(number).alias("_values"), F.sum(number).alias("_sum"))
    found = tracks.groupBy("window", "condition").agg(
        F.count("_track").alias("n_cells"), F.sum("_n").alias("n_events"),
        # sums of one window taken in another order agree to nine digits
        (F.round(F.sum("_sum"), 9) / F.nullif(F.sum("_values"), F.lit(0))).alias("mean_intensity"))
    return found.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "condition", "n_cells", "n_events", "mean_intensity")


def follow_activity(
    spark: SparkSession, folder: str, schema: str, columns: dict[str, str | Column], out: str, checkpoint: str, size: str,
    slide: str | None = None, late: str = "1 hour", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Appends the finished windows of the Parquet files that arrive in ``folder`` to ``out``.

    ``columns`` names the event's ts, condition, track_id and value as expressions over ``schema``.
    All files there are read in batches, then the query ends; started again with the same checkpoint
    it goes on with open windows and new files, and no window comes out twice.
    """
    made = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).select(*made)
    return (
        windowed_activity(arriving, size, slide, late).writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows for (window, track) cells that had already come out, over the batches the query still remembers.

    The largest figure of a batch's operators: rows left out of the first aggregate reach no other.
    A row of several sliding windows counts once for each of them.
    """
    return sum(max([0, *(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])]) for p in query.recentProgress)
