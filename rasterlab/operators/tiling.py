"""Bounded spatial partitions.

An image is not a safe shuffle key: one mosaic scan can hold a third of all pixels.
Neighbourhood operators therefore shuffle once by tile, with a halo of copied pixels
around each tile, and run all their windows inside that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TILE = 512


def _div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("int")


def tiles(px: DataFrame, keys: Sequence[str], halo: int = 0, tile: int = TILE) -> DataFrame:
    """Adds ``_ty``, ``_tx`` and ``_core`` (false for halo copies); one exchange, hashed by tile."""
    if halo > 0:
        for axis, col in (("_ty", "y"), ("_tx", "x")):
            first = F.greatest(F.lit(0), _div(F.col(col) - halo, tile))
            px = px.withColumn(axis, F.explode(F.sequence(first, _div(F.col(col) + halo, tile))))
        core = (_div(F.col("y"), tile) == F.col("_ty")) & (_div(F.col("x"), tile) == F.col("_tx"))
        px = px.withColumn("_core", core)
    else:
        px = px.withColumns({
            "_ty": _div(F.col("y"), tile), "_tx": _div(F.col("x"), tile), "_core": F.lit(True),
        })
    return px.repartition(*keys, "_ty", "_tx")


def along_x(keys: Sequence[str]) -> WindowSpec:
    """Rows of a tile in x order; satisfied by the partitioning of :func:`tiles`."""
    return Window.partitionBy(*keys, "_ty", "_tx", "y").orderBy("x")


def along_y(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_ty", "_tx", "x").orderBy("y")


def core_only(df: DataFrame) -> DataFrame:
    """Drops halo copies and the tile columns."""
    return df.where("_core").drop("_core", "_ty", "_tx")


def square_max(tiled: DataFrame, keys: Sequence[str], source: str, radii: Mapping[str, int]) -> DataFrame:
    """Maximum over the (2r+1)-square around each pixel, one column per named radius.

    Rows first, then columns: all radii share the two orderings.
    """
    rows = tiled.withColumns({
        f"_row_{out}": F.max(source).over(along_x(keys).rangeBetween(-r, r)) for out, r in radii.items()})
    return rows.withColumns({
        out: F.max(f"_row_{out}").over(along_y(keys).rangeBetween(-r, r)) for out, r in radii.items()
    }).drop(*[f"_row_{out}" for out in radii])


def four_neighbours(
    tiled: DataFrame, keys: Sequence[str], source: str, prefix: str = "_n", outside: int | None = 0
) -> DataFrame:
    """Adds ``{prefix}_left/right/up/down``, with ``outside`` beyond the image."""
    wx, wy = along_x(keys), along_y(keys)
    return tiled.withColumns({
        f"{prefix}_left": F.lag(source, 1, outside).over(wx),
        f"{prefix}_right": F.lead(source, 1, outside).over(wx),
        f"{prefix}_up": F.lag(source, 1, outside).over(wy),
        f"{prefix}_down": F.lead(source, 1, outside).over(wy),
    })
