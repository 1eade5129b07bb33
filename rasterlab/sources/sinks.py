"""Saved masks, results and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.operators.tables import drop_outliers
from rasterlab.schema import IMAGE


def save_masks(px: DataFrame, path: str, keys: Sequence[str] = IMAGE) -> None:
    """Label pixels as Parquet by condition, with the integer type each image needs."""
    kind = px.groupBy(*keys).agg(F.when(F.max("label") < 65535, "uint16").otherwise("int32").alias("dtype"))
    attach(px.select(*keys, "y", "x", "label"), kind, keys).write.mode("overwrite").partitionBy("condition").parquet(path)


def load_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(results: DataFrame, path: str, include_outliers: bool = False) -> None:
    """Result rows as CSV, without flagged rows unless asked for."""
    kept = results if include_outliers else drop_outliers(results)
    kept.write.mode("overwrite").option("header", True).csv(path)


def export_by_segmentation(results: DataFrame, path: str) -> None:
    """One CSV folder per segmentation type."""
    results.write.mode("overwrite").option("header", True).partitionBy("SegmentationType").csv(path)


def export_tracks(tracks: DataFrame, path: str) -> None:
    """Track rows by condition, each file in (track, frame) order."""
    ordered = tracks.repartition("condition", "track_id").sortWithinPartitions("condition", "track_id", "frame")
    ordered.write.mode("overwrite").option("header", True).partitionBy("condition").csv(path)


def export_lineage(tracks: DataFrame, path: str) -> None:
    """Daughter and parent ids by condition."""
    pairs = tracks.where("parent_id is not null").select(
        "condition", F.col("track_id").alias("DaughterID"), F.col("parent_id").alias("ParentID")).distinct()
    pairs.write.mode("overwrite").option("header", True).partitionBy("condition").csv(path)


def export_track_ctcf(ctcf: DataFrame, path: str) -> None:
    """Per-condition and all-conditions measurements: one folder per condition under a common root."""
    ordered = ctcf.repartition("condition", "track_id").sortWithinPartitions("condition", "track_id", "frame")
    ordered.write.mode("overwrite").option("header", True).partitionBy("condition").csv(path)
