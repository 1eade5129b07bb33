"""File catalogues: experiments, saved masks, completeness and work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths under a folder, one row each; file contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(root).select("path")
    )


def experiment_files(paths: DataFrame) -> DataFrame:
    """(condition, name) of the TIFF files in each condition folder, hidden folders and files left out."""
    parts = F.split("path", "/")
    named = paths.select(
        F.element_at(parts, -2).alias("condition"), F.element_at(parts, -1).alias("name"), "path")
    return named.where(
        F.lower("name").rlike(r"\.tiff?$") & ~F.col("condition").startswith(".") & ~F.col("name").startswith("."))


def scan_experiment(spark: SparkSession, root: str) -> DataFrame:
    return experiment_files(list_files(spark, root))


def saved_masks(paths: DataFrame) -> DataFrame:
    """(condition, base, path) of saved mask files named ``*_masks*.tif`` or ``*_masks.npy``."""
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    base = F.regexp_replace(F.regexp_replace(stem, "_masks", ""), "_cellular", "")
    return paths.where(F.col("path").rlike(r"_masks[^/]*\.tif$") | F.col("path").rlike(r"_masks\.npy$")).select(
        F.element_at(parts, -2).alias("condition"), base.alias("base"), "path")


def pending(images: DataFrame, done: DataFrame, keys=("condition", "image_set")) -> DataFrame:
    """Images without a finished result."""
    return images.join(done.select(*keys), list(keys), "left_anti")


def mask_completeness(catalog: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks found and expected per condition, and overall (condition NULL), with ``is_complete``."""
    have = masks.select("condition", "base").distinct().withColumn("_m", F.lit(True))
    joined = catalog.select("condition", "base").distinct().join(have, ["condition", "base"], "left")
    return joined.rollup("condition").agg(
        F.count("base").alias("expected"), F.count("_m").alias("found")
    ).withColumn("is_complete", (F.col("found") >= F.col("expected")) & (F.col("expected") > 0))
