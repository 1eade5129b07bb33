"""Shape of every labelled cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.functions.grouped import group_ends, stream_batches
from rasterlab.operators.spatial import image_size
from rasterlab.operators.tiling import along_x, along_y, core_only, tiles
from rasterlab.schema import IMAGE

# Contribution of a border pixel to the perimeter, by neighbour code.
_PERIMETER_WEIGHTS = {
    1.0: (5, 7, 15, 17, 25, 27),
    2.0 ** 0.5: (21, 33),
    (1 + 2.0 ** 0.5) / 2: (13, 23),
}


def moments(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Area, centroid, bounding box, eccentricity and aspect ratio from second moments."""
    a, c, b = F.col("_a"), F.col("_c"), F.col("_b")
    mid, half = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    big, small = mid + half, F.greatest(mid - half, F.lit(0.0))
    # a straight line of pixels leaves rounding noise instead of a zero minor axis
    small = F.when(small < 1e-12 * big, 0.0).otherwise(small)
    sums = px.where("label <> 0").groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.avg("y").alias("y_centroid"), F.avg("x").alias("x_centroid"),
        F.var_pop("y").alias("_a"), F.var_pop("x").alias("_c"), F.covar_pop("y", "x").alias("_b"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )
    return sums.withColumns({
        "major_axis": 4 * F.sqrt(big), "minor_axis": 4 * F.sqrt(small),
        "eccentricity": F.when(big > 0, F.sqrt(1 - small / big)).otherwise(0.0),
        "aspect_ratio": F.when(small > 0, F.sqrt(big) / F.sqrt(small)).otherwise(999.0),
    }).drop("_a", "_b", "_c")


def perimeters(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Perimeter per label from the neighbour pattern of its border pixels."""
    t = tiles(px.select(*keys, "y", "x", "label"), keys, halo=2)
    wx, wy = along_x(keys), along_y(keys)
    same = [F.lag("label", 1, 0).over(wx), F.lead("label", 1, 0).over(wx),
            F.lag("label", 1, 0).over(wy), F.lead("label", 1, 0).over(wy)]
    on_border = sum(((F.col("label") != s).cast("int") for s in same), F.lit(0)) > 0
    t = t.withColumn("_e", F.when((F.col("label") != 0) & on_border, F.col("label")).otherwise(0))
    t = t.withColumns({"_el": F.lag("_e", 1, 0).over(wx), "_er": F.lead("_e", 1, 0).over(wx)})
    straight = [F.col("_el"), F.col("_er"), F.lag("_e", 1, 0).over(wy), F.lead("_e", 1, 0).over(wy)]
    diagonal = [f(c, 1, 0).over(wy) for f in (F.lag, F.lead) for c in ("_el", "_er")]

    def hits(cols):
        return sum(((F.col("_e") == c).cast("int") for c in cols), F.lit(0))

    t = core_only(t.withColumn("_code", 1 + 2 * hits(straight) + 10 * hits(diagonal)))
    weight = F.lit(0.0)
    for w, codes in _PERIMETER_WEIGHTS.items():
        weight = F.when(F.col("_code").isin(list(codes)), F.lit(w)).otherwise(weight)
    edge_weight = F.when(F.col("_e") != 0, weight).otherwise(0.0)
    return t.where("label <> 0").groupBy(*keys, "label").agg(F.sum(edge_weight).alias("perimeter"))


def _lower_chain(cell: np.ndarray, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of the convex hull of every cell's points on the side of small ``v``; one point for each ``t``, in order.

    A point on or above the line between its neighbours is none. All such points of all cells go at
    once, until there are none: that takes a few passes, and no loop over cells.
    """
    while True:
        run, rise = t[1:-1] - t[:-2], v[1:-1] - v[:-2]
        inside = rise * (t[2:] - t[:-2]) >= (v[2:] - v[:-2]) * run
        gone = np.flatnonzero(inside & (cell[:-2] == cell[2:])) + 1
        if not len(gone):
            return cell, t, v
        cell, t, v = np.delete(cell, gone), np.delete(t, gone), np.delete(v, gone)


def _hull_pixels(cell: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pixels whose centre lies in the convex hull of each cell, given by its row extremes.

    Rows come by cell (0, 1, ...) and y. Works in half-pixel units, so every comparison is exact
    integer arithmetic.
    """
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    y, left, right = y.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
    y = y - y[first][cell]
    height = y[np.append(first[1:], len(y)) - 1] + 1
    # the rows of all cells, also those a cell of several parts skips
    of = np.repeat(np.arange(len(first)), height)
    rows = 2 * (np.arange(len(of)) - np.repeat(np.cumsum(height) - height, height))
    span = 2 * int(height.max()) + 4

    def bound(side: np.ndarray) -> np.ndarray:
        """The smallest whole number at or above the hull's lower side, for each row."""
        points = np.concatenate([
            np.stack([cell, 2 * y, 2 * side - 1]), np.stack([cell, 2 * y - 1, 2 * side]), np.stack([cell, 2 * y + 1, 2 * side])], axis=1)
        points = points[:, np.lexsort((points[2], points[1], points[0]))]
        same = (points[0, 1:] == points[0, :-1]) & (points[1, 1:] == points[1, :-1])
        c, t, v = _lower_chain(*points[:, np.append(True, ~same)])
        i = np.searchsorted(c * span + t, of * span + rows, side="right") - 1
        num, den = v[i] * (t[i + 1] - t[i]) + (v[i + 1] - v[i]) * (rows - t[i]), 2 * (t[i + 1] - t[i])
        return -np.floor_divide(-num, den)

    # the far side is the near side of the mirrored cell
    return np.add.reduceat(np.maximum(1 - bound(-right) - bound(left), 0), np.cumsum(height) - height)


def solidity(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Area over convex-hull area per label.

    Only row extremes reach Python; a batch of them holds many cells, whose hulls are found together.
    """
    keys = list(keys)
    on = [*keys, "label"]
    rows = px.where("label <> 0").groupBy(*on, "y").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = np.repeat(np.arange(len(ends := group_ends(pdf, on))), np.diff(ends, prepend=0))
        hull = _hull_pixels(cell, pdf.y.to_numpy(), pdf.lo.to_numpy(), pdf.hi.to_numpy())
        first = np.append(0, ends[:-1])
        return pdf.iloc[first][on].assign(solidity=np.add.reduceat(pdf.n.to_numpy().astype(float), first) / hull)

    schema = T.StructType([rows.schema[c] for c in on] + [T.StructField("solidity", T.DoubleType())])
    return stream_batches(rows, on, ["y"], kernel, schema)


def morphology(px: DataFrame, keys: Sequence[str] = IMAGE, pieces: DataFrame | None = None) -> DataFrame:
    """The full shape table.

    ``pieces`` (keys, label, is_border), from :func:`border_of_pieces`, replaces the bounding-box
    border rule for masks whose labels may consist of several parts.
    """
    keys = list(keys)
    on = [*keys, "label"]
    shape = moments(px, keys).join(perimeters(px, keys), on).join(solidity(px, keys), on)
    p = F.col("perimeter")
    roundness = F.when(p > 0, F.least(4 * F.lit(np.pi) * F.col("area") / (p * p), F.lit(1.0))).otherwise(0.0)
    shape = shape.join(image_size(px, keys), keys).withColumns({
        "circularity": roundness,
        "is_border": (F.col("y_min") == 0) | (F.col("x_min") == 0)
        | (F.col("y_max") == F.col("height") - 1) | (F.col("x_max") == F.col("width") - 1),
    })
    if pieces is not None:
        shape = shape.drop("is_border").join(pieces, on)
    return shape.select(*on, "area", "y_centroid", "x_centroid", "perimeter", "solidity", "eccentricity",
                        "circularity", "aspect_ratio", "is_border")


def border_of_pieces(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Border rule for fragmented labels: a label counts only if all its pieces touch the border."""
    from rasterlab.operators.components import components

    keys = list(keys)
    parts = components(px.where("label <> 0").select(*keys, "y", "x", "label"), keys, same="label", diagonal=True)
    touches = (F.min("y") == 0) | (F.min("x") == 0) | (F.max("y") == F.first("height") - 1) | (
        F.max("x") == F.first("width") - 1)
    return (
        parts.join(image_size(px, keys), keys).groupBy(*keys, "label", "component").agg(touches.alias("_t"))
        .groupBy(*keys, "label").agg(F.bool_and("_t").alias("is_border"))
    )
