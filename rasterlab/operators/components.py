"""Connected components of rasters of any size.

Each tile is labelled on its own, in memory bounded by the tile.  Only pixels on tile
seams are then joined to find parts that continue next door; the seam graph is a small
fraction of the raster and is solved by :func:`rasterlab.functions.graph.connected_components`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.functions.graph import connected_components, smallest_roots
from rasterlab.functions.grouped import stream_groups
from rasterlab.operators.tiling import TILE


def _links(grid: np.ndarray, value: np.ndarray | None, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of touching pixels; ``grid`` holds row numbers, -1 where absent."""
    pairs = [(grid[:, :-1], grid[:, 1:]), (grid[:-1], grid[1:])]
    if diagonal:
        pairs += [(grid[:-1, :-1], grid[1:, 1:]), (grid[:-1, 1:], grid[1:, :-1])]
    a = np.concatenate([p.ravel() for p, _ in pairs])
    b = np.concatenate([q.ravel() for _, q in pairs])
    keep = (a >= 0) & (b >= 0)
    a, b = a[keep], b[keep]
    if value is not None:
        same = value[a] == value[b]
        a, b = a[same], b[same]
    return a, b


def components(
    px: DataFrame, keys: Sequence[str], same: str | None = None, diagonal: bool = False, tile: int = TILE
) -> DataFrame:
    """Adds ``component`` to every given pixel: the code ``y * 2^31 + x`` of its smallest pixel.

    The rows passed in are the foreground.  With ``same``, pixels connect only if that column
    agrees.  Neighbours are the four straight ones, or all eight with ``diagonal``.
    """
    keys = list(keys)
    tiled = px.withColumns({"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")})

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        grid = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), -1, dtype=np.int64)
        grid[y - y.min(), x - x.min()] = np.arange(len(pdf))
        a, b = _links(grid, pdf[same].to_numpy() if same else None, diagonal)
        root = smallest_roots(len(pdf), a, b)
        code = y.astype(np.int64) * 2**31 + x
        return pdf.assign(component=code[root])

    schema = T.StructType(tiled.schema.fields + [T.StructField("component", T.LongType())])
    local = stream_groups(tiled, [*keys, "_ty", "_tx"], kernel, schema)

    tag = [same] if same and same not in keys else []
    extent = px.agg(F.max("y").alias("h"), F.max("x").alias("w")).first()
    if extent.h is None or (extent.h < tile and extent.w < tile):
        return local.drop("_ty", "_tx")  # every image is a single tile

    # seam pixels meet their neighbours across the tile edge
    y, x = F.col("y"), F.col("x")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    last = lambda c: c % tile == tile - 1
    first = lambda c: c % tile == 0
    on_seam = local.where(last(y) | last(x) | first(y) | first(x)).select(*keys, *tag, "y", "x", "_ty", "_tx", "component")
    here = on_seam.select(
        *keys, *tag, "component", F.col("_ty").alias("_hy"), F.col("_tx").alias("_hx"),
        F.explode(F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy, dx in steps])).alias("_to"),
    ).select(*keys, *tag, "_hy", "_hx", F.col("component").alias("src"), "_to.y", "_to.x")
    edges = (
        here.join(on_seam, [*keys, *tag, "y", "x"])
        .where((F.col("_hy") != F.col("_ty")) | (F.col("_hx") != F.col("_tx")))
        .select(*keys, *tag, "src", F.col("component").alias("dst"))
    )
    roots = connected_components(edges, [*keys, *tag], "src", "dst").withColumnRenamed("node", "component")
    return (
        local.join(roots, [*keys, *tag, "component"], "left")
        .withColumn("component", F.coalesce("root", "component"))
        .select(*px.columns, "component")
    )
