"""Joins of large tables with one row per group, where a group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = 64


def attach(rows: DataFrame, per_group: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Joins values of each group (one row per key) to its rows; ``how`` is inner or left.

    The key is salted by a hash of the other columns and the values are copied to every salt. Where
    the values are not small enough to be broadcast, a group is spread over many tasks. The copies
    are a join, whose size the planner knows: of an explode it counts the rows before it, and would
    send 64 times a table just below the broadcast limit through the driver. Meant for groups of
    many rows; groups of a few rows are joined plainly.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*others), F.lit(_SALTS)).cast("int") if others else F.lit(0)
    salts = per_group.sparkSession.range(_SALTS).select(F.col("id").cast("int").alias("_salt"))
    copies = per_group.crossJoin(F.broadcast(salts))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def _own_label(label: str, places: Sequence[str]) -> Column:
    """The label of a cell's pixel; background gets one of many keys below zero."""
    return F.when(F.col(label) > 0, F.col(label).cast("bigint")).otherwise(-1 - F.pmod(F.xxhash64(*places), F.lit(4096)))


def attach_labels(px: DataFrame, per_cell: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Left join of values of cells (labels above 0) to pixels; background pixels stay spread out."""
    keys = list(keys)
    cells = per_cell.where(F.col(label) > 0).withColumn("_own", F.col(label).cast("bigint")).drop(label)
    places = [c for c in ("y", "x") if c in px.columns] or px.columns
    joined = px.withColumn("_own", _own_label(label, places)).join(cells, [*keys, "_own"], "left").drop("_own")
    added = [c for c in cells.columns if c not in (*keys, "_own")]
    return joined.select(*px.columns, *added)


def attach_pixels(px: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Joins values of single pixels (one row per key, y, x) to pixels; ``how`` is left or inner.

    Sorted and merged, which spills: a written table of pixels takes a few bytes a row in its file, so
    the planner would broadcast millions of rows and every executor would hold all of them.
    """
    return px.join(values.hint("merge"), [*keys, "y", "x"], how)
