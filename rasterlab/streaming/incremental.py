"""Skip-existing processing as a stream: image sets announced in a folder are measured once.

The batch counterpart is :func:`rasterlab.sources.files.pending`.  The stream reads small
announcement files (condition, image_set), so that an image is only picked up when all its
pixels are in place, and restarts from its own checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterlab.sources.files import pending

ANNOUNCEMENT = "condition string, image_set bigint"


def measure_arrivals(
    spark: SparkSession,
    announcements: str,
    pixels: Callable[[], DataFrame],
    measure: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Runs ``measure`` on the pixels of every newly announced image set and appends to ``out``.

    ``measure`` returns rows with Condition and ImageSet.  A batch overwrites its own folder, so
    a replayed batch leaves no duplicates; images already in earlier folders are skipped.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        todo = batch.distinct()
        if batch_id > 0:
            earlier = batch.sparkSession.read.option("basePath", out).parquet(out).where(f"batch < {batch_id}")
            todo = pending(todo, earlier.selectExpr("Condition as condition", "ImageSet as image_set"))
        work = pixels().join(todo, ["condition", "image_set"], "left_semi")
        measure(work).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(ANNOUNCEMENT).json(announcements)
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
