"""What several operators share: words, reading tables, values evaluated once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without the six ASCII white space characters.
SPACES = " \t\n\x0b\f\r"
NO_WORD = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession) -> None:
    """Has whole texts sent to Python a few megabytes at a time.

    The session keeps the setting, as tables are computed later. It changes no result: Python
    workers and executors hold less at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def packed(df: DataFrame) -> Column:
    """All columns of a table as one, so that helper columns cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
