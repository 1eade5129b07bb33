"""Contours, region metadata, tile pyramids and model inference."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.functions.graph import connected_components
from rasterlab.functions.joins import attach, attach_pixels
from rasterlab.operators.pixels import label_colours, normalise
from rasterlab.operators.spatial import image_size
from rasterlab.operators.tables import match_suffix
from rasterlab.functions.order import positions
from rasterlab.operators.tiling import along_x, core_only, four_neighbours, tiles
from rasterlab.schema import IMAGE
from rasterlab.session import cut_lineage

TILE = 256


def contour_vertices(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Half-level contour points of every cell: midway between each inside and outside 4-neighbour.

    Rows (keys, label, cy, cx).  Nothing lies beyond the image, so the outline of a cell at the
    edge is open there.
    """
    t = core_only(four_neighbours(tiles(px.select(*keys, "y", "x", "label"), keys, halo=1), keys, "label", outside=None))
    ends = []
    for side, dy, dx in (("left", 0.0, -0.5), ("right", 0.0, 0.5), ("up", -0.5, 0.0), ("down", 0.5, 0.0)):
        other = F.col(f"_n_{side}")
        ends.append(F.when(other.isNotNull() & (other != F.col("label")),
                           F.struct((F.col("y") + dy).alias("cy"), (F.col("x") + dx).alias("cx"))))
    return t.where("label > 0").select(*keys, "label", F.explode(F.array_compact(F.array(*ends))).alias("_v")).select(
        *keys, "label", "_v.cy", "_v.cx")


#: Sides of a pixel in walking order round a cell, with the step outwards and the step onwards.
_WALK = (("up", (-1, 0), (0, 1)), ("right", (0, 1), (1, 0)), ("down", (1, 0), (0, -1)), ("left", (0, -1), (-1, 0)))


def _contour_steps(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every contour point with the next one: rows (keys, label, node, next), next null at an open end.

    A point is a side of a cell's pixel that faces another label. Going round with the cell on the
    right, the next point lies in the square of four pixels ahead: the same pixel's next side if the
    pixel ahead is not the cell's (so that diagonal neighbours are not joined), else that pixel's
    same side, else the side of the pixel across.
    """
    t = four_neighbours(tiles(px.select(*keys, "y", "x", "label"), keys, halo=1), keys, "label", outside=None)
    wx = along_x(keys)
    t = t.withColumns({f"{c}_{side}": move(c, 1).over(wx) for c in ("_n_up", "_n_down") for side, move in (("left", F.lag), ("right", F.lead))})
    t = core_only(t).where("label > 0")
    at = {
        (0, -1): F.col("_n_left"), (0, 1): F.col("_n_right"), (-1, 0): F.col("_n_up"), (1, 0): F.col("_n_down"),
        (-1, -1): F.col("_n_up_left"), (-1, 1): F.col("_n_up_right"), (1, -1): F.col("_n_down_left"), (1, 1): F.col("_n_down_right"),
    }

    def code(dy: int, dx: int, side: int):
        """A number for a side of the pixel (dy, dx) away: place, then side."""
        place = F.shiftleft((F.col("y") + dy).cast("bigint"), 31) + (F.col("x") + dx)
        return place * 4 + side

    points = []
    for k, (_, out, on) in enumerate(_WALK):
        across = (out[0] + on[0], out[1] + on[1])
        ahead, over = at[on], at[across]
        mine = lambda c: c == F.col("label")
        following = (
            F.when(ahead.isNull(), F.lit(None))
            .when(~mine(ahead), code(0, 0, (k + 1) % 4))
            .when(~mine(over), code(*on, k))
            .otherwise(code(*across, (k + 3) % 4))
        )
        there = at[out].isNotNull() & ~mine(at[out])
        points.append(F.when(there, F.struct(code(0, 0, k).alias("node"), following.cast("bigint").alias("next"))))
    return t.select(*keys, "label", F.explode(F.array_compact(F.array(*points))).alias("p")).select(*keys, "label", "p.node", "p.next")


def contour_rings(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Contours that can be drawn: rows (keys, label, ring, position, cy, cx).

    The points of :func:`contour_vertices` in walking order, the cell on the right; ``ring`` 0 is the
    longest contour of a cell (of equal ones that of the uppermost, then leftmost point), then the
    others, holes among them; ``position`` counts from its first point. A contour that meets the
    image's edge is open and starts where no point leads to it. Nothing is gathered per cell: rings
    are connected components and positions come from pointer jumping, which doubles the way known to
    each point in every round.
    """
    keys = list(keys)
    per = [*keys, "label"]
    steps = cut_lineage(_contour_steps(px, keys))
    roots = connected_components(steps.where("next is not null").select(*keys, "node", "next"), keys, "node", "next")
    rung = cut_lineage(steps.join(roots.select(*keys, "node", "root"), [*keys, "node"], "left").withColumn("_ring", F.coalesce("root", "node")).drop("root"))
    # a ring begins at its smallest point, an open contour at the point without one before it
    led = rung.where("next is not null").select(*keys, F.col("next").alias("node"), F.lit(True).alias("_led"))
    heads = rung.join(led, [*keys, "node"], "left").groupBy(*per, "_ring").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.min(F.when(F.col("_led").isNull(), F.col("node"))), F.min("node")).alias("_head"))
    known = rung.join(heads, [*per, "_ring"])
    # the way to the end of the contour, cut before its head: so many steps so far, and the point they lead to
    way = cut_lineage(known.select(
        *per, "_ring", "_n", "node", F.when(F.col("next") != F.col("_head"), F.col("next")).alias("_to")
    ).withColumn("_steps", F.col("_to").isNotNull().cast("bigint")))
    while not way.where("_to is not null").isEmpty():
        ahead = way.select(*keys, F.col("node").alias("_to"), F.col("_to").alias("_far"), F.col("_steps").alias("_more"))
        way = cut_lineage(way.join(ahead, [*keys, "_to"], "left").select(
            *per, "_ring", "_n", "node", F.col("_far").alias("_to"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("_steps")))
    order = Window.partitionBy(*per).orderBy(F.desc("_n"), "_ring")
    numbered = heads.select(*per, "_ring", (F.row_number().over(order) - 1).alias("ring"))
    side, place = F.col("node") % 4, F.floor(F.col("node") / 4)
    shift = lambda axis: F.element_at(F.array(*[F.lit(out[axis] / 2) for _, out, _ in _WALK]), (side + 1).cast("int"))
    return way.join(numbered, [*per, "_ring"]).select(
        *per, "ring", (F.col("_n") - 1 - F.col("_steps")).alias("position"),
        (F.shiftright(place, 31) + shift(0)).alias("cy"), (place.bitwiseAND(F.lit((1 << 31) - 1)) + shift(1)).alias("cx"))


def roi_metadata(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Region table: CellID, name, area and centroid to two decimals."""
    return px.where("label > 0").groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("Area"), F.avg("y").alias("_y"), F.avg("x").alias("_x")
    ).select(
        *keys, F.col("label").alias("CellID"), F.format_string("Cell_%03d", F.col("label")).alias("ROI_Name"), "Area",
        F.format_string("%.2f", F.col("_y")).alias("Centroid_Y"), F.format_string("%.2f", F.col("_x")).alias("Centroid_X"))


def contour_summary(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Per cell: contour length in vertices, name, area and centroid."""
    counts = contour_vertices(px, keys).groupBy(*keys, F.col("label").alias("CellID")).agg(
        F.count(F.lit(1)).alias("n_vertices"))
    return roi_metadata(px, keys).join(counts, [*keys, "CellID"], "left").fillna(0, ["n_vertices"])


def _levels(px: DataFrame, keys: Sequence[str], size: tuple[int, int] | None) -> DataFrame:
    """Adds image size and ``_top``, the number of the full-resolution level."""
    longest = F.greatest("width", "height", F.lit(1)).cast("double")
    if size is None:
        sized = attach(px, image_size(px, keys), keys)
    else:
        sized = px.withColumns({"height": F.lit(size[0]), "width": F.lit(size[1])})
    return sized.withColumn("_top", F.ceil(F.log2(longest)).cast("int"))


def mask_pyramid(
    px: DataFrame, keys: Sequence[str] = IMAGE, tile: int = TILE, size: tuple[int, int] | None = None
) -> DataFrame:
    """Label pixels of every pyramid level, nearest sampling, with tile numbers and colours.

    Each source pixel lists only the levels that sample it (about 1.3), so the table is
    exploded once and nothing is shuffled but the image size.  ``size`` (height, width) is that of
    the camera, where pixels of an image may be missing; else the pixels' extent is taken.
    """
    def sampled(c: str, n: str):
        # target i takes source floor((i + 1/2) n / m), so a source serves at most one target
        def at(level):
            m = F.greatest(F.lit(1), F.floor(F.col(n) / F.pow(F.lit(2.0), F.col("_top") - level)).cast("int"))
            i = F.ceil((2 * F.col(c) * m - F.col(n)) / (2.0 * F.col(n))).cast("int")
            hit = F.floor((2 * i + 1) * F.col(n) / (2.0 * m)) == F.col(c)
            return F.when(hit & (i >= 0) & (i < m), i)
        return at

    levels = F.transform(
        F.sequence(F.lit(0), F.col("_top")),
        lambda lv: F.struct(lv.alias("level"), sampled("y", "height")(lv).alias("y"), sampled("x", "width")(lv).alias("x")))
    kept = F.filter(levels, lambda s: s["y"].isNotNull() & s["x"].isNotNull())
    out = _levels(px.select(*keys, "y", "x", "label"), keys, size).select(*keys, "label", F.explode(kept).alias("_s")).select(
        *keys, "_s.level", "_s.y", "_s.x", "label")
    return label_colours(out).withColumns({
        "tile_y": F.floor(F.col("y") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")})


def image_pyramid(
    px: DataFrame, keys: Sequence[str] = IMAGE, tile: int = TILE, size: tuple[int, int] | None = None
) -> DataFrame:
    """Normalised image at every pyramid level as box means 0..255, with tile numbers.

    Blocks of a level are the source pixels sharing ``x div scale``; leftovers join the last
    block.  Sums are taken map-side, so levels beyond the finest add little to the exchange.
    ``size`` is as in :func:`mask_pyramid`.
    """
    norm = normalise(px.select(*keys, "y", "x", "value"), keys)
    n = _levels(norm.select(*keys, "y", "x", "norm"), keys, size).withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.col("_top")))
    ).withColumn("_scale", F.pow(F.lit(2.0), F.col("_top") - F.col("level")))

    def block(c: str, size: str):
        return F.least(F.floor(F.col(c) / F.col("_scale")), F.greatest(F.floor(F.col(size) / F.col("_scale")) - 1, F.lit(0))).cast("int")

    level = n.groupBy(*keys, "level", block("y", "height").alias("y"), block("x", "width").alias("x")).agg(
        F.floor(F.round(F.avg(F.col("norm")) * 255, 6)).cast("int").alias("gray"))
    return level.withColumns({
        "tile_y": F.floor(F.col("y") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")})


def segmentation_input(
    px: DataFrame, files: DataFrame, wanted: DataFrame, keys: Sequence[str] = IMAGE
) -> DataFrame:
    """Chosen channels, each normalised, as one ordered array per pixel.

    ``files`` (keys, suffix, path) lists what exists, ``wanted`` (keys, pos, suffix) what to use;
    suffix spelling is matched exactly, then in upper, then in lower case.  ``px`` carries ``path``.
    """
    found = match_suffix(wanted.select(*keys, "suffix"), files, keys).join(wanted, [*keys, "suffix"])
    norm = attach(normalise(px, [*keys, "path"]), found.select(*keys, "path", "pos"), [*keys, "path"])
    stack = F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda s: s["norm"])
    return norm.groupBy(*keys, "y", "x").agg(stack.alias("channels"))


def default_channels(files: DataFrame, nuclear: str, cyto: str, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The default choice where none is made: the cyto channel, or the nuclear one if there is no cyto."""
    lower = F.lower("suffix")
    return files.where(lower.isin(nuclear.lower(), cyto.lower())).groupBy(*keys).agg(
        F.min_by("suffix", F.when(lower == cyto.lower(), 0).otherwise(1)).alias("suffix")
    ).withColumn("pos", F.lit(0))


def segment(
    inputs: DataFrame,
    model: Callable[[np.ndarray, Mapping[str, object]], np.ndarray],
    params: Sequence[str] = (),
    keys: Sequence[str] = IMAGE,
    tile: int | None = None,
    halo: int = 128,
) -> DataFrame:
    """Labels every image of a table with a user's model.

    ``inputs`` has one row per pixel with ``channels`` (array, at most three) and the parameter
    columns named in ``params``.  ``model(image, params)`` gets a whole image as a (channel, y, x)
    array and returns integer labels, which are numbered from 1 in their order.  An image must fit
    into a task, as the model needs all of it.

    With ``tile`` the model gets overlapping tiles instead, whatever the size of an image, and
    objects are stitched: labels of neighbouring tiles that share a pixel in the overlap are one
    object, however many tiles it crosses. Objects are numbered from 1 by their first pixel, row by
    row. ``halo`` is how much of its surroundings the model needs to label a pixel.
    """
    keys = list(keys)
    params = list(params)
    if tile is not None:
        return _segment_tiles(inputs, model, params, keys, tile, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        y, x = (pdf.y - y0).to_numpy(), (pdf.x - x0).to_numpy()
        data = np.stack(pdf.channels.to_numpy())
        if data.shape[1] > 3:
            raise ValueError("a segmentation input has at most three channels")
        image = np.zeros((data.shape[1], y.max() + 1, x.max() + 1))
        image[:, y, x] = data.T
        labels = np.asarray(model(image, {p: pdf[p].iloc[0] for p in params}))[y, x]
        found = np.unique(labels[labels > 0])
        number = np.where(labels > 0, np.searchsorted(found, labels) + 1, 0)
        return pdf[[*keys, "y", "x"]].assign(label=number.astype("int32"))

    schema = T.StructType([inputs.schema[c] for c in (*keys, "y", "x")] + [T.StructField("label", T.IntegerType())])
    return inputs.groupBy(*keys).applyInPandas(run, schema=schema)


def _segment_tiles(
    inputs: DataFrame, model: Callable[[np.ndarray, Mapping[str, object]], np.ndarray], params: list[str], keys: list[str],
    tile: int, halo: int,
) -> DataFrame:
    tiled = tiles(inputs, keys, halo=halo, tile=tile)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        y, x = (pdf.y - y0).to_numpy(), (pdf.x - x0).to_numpy()
        data = np.stack(pdf.channels.to_numpy())
        if data.shape[1] > 3:
            raise ValueError("a segmentation input has at most three channels")
        image = np.zeros((data.shape[1], y.max() + 1, x.max() + 1))
        image[:, y, x] = data.T
        labels = np.asarray(model(image, {p: pdf[p].iloc[0] for p in params}))[y, x]
        found = pdf.assign(_local=labels)[labels > 0]
        return found[[*keys, "y", "x", "_ty", "_tx", "_core", "_local"]].astype({"_local": "int64"})

    fields = [tiled.schema[c] for c in (*keys, "y", "x", "_ty", "_tx", "_core")]
    found = tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema=T.StructType([*fields, T.StructField("_local", T.LongType())]))
    # one number per object of a tile: tiles stay below 2^15 a side, labels of a tile below 2^32
    code = F.shiftleft(F.shiftleft(F.col("_ty").cast("bigint"), 15) + F.col("_tx"), 32) + F.col("_local")
    found = cut_lineage(found.select(*keys, "y", "x", "_core", code.alias("_code")))
    own = found.where("_core").drop("_core")
    # a pixel links its own tile's object with those that other tiles see there
    links = own.join(found.where("not _core").select(*keys, "y", "x", F.col("_code").alias("_other")), [*keys, "y", "x"])
    roots = connected_components(links.select(*keys, "_code", "_other").distinct(), keys, "_code", "_other")
    joined = own.join(roots.select(*keys, F.col("node").alias("_code"), "root"), [*keys, "_code"], "left").withColumn(
        "_code", F.coalesce("root", "_code")).drop("root")
    place = F.shiftleft(F.col("y").cast("bigint"), 31) + F.col("x")
    first = cut_lineage(joined.groupBy(*keys, "_code").agg(F.min(place).alias("_first")))
    numbered = first.join(positions(first, keys, "_first").select(*keys, "_first", (F.col("_rank0") + 1).cast("int").alias("_label")), [*keys, "_first"])
    labels = joined.join(numbered.select(*keys, "_code", "_label"), [*keys, "_code"]).select(*keys, "y", "x", "_label")
    return attach_pixels(inputs.select(*keys, "y", "x"), labels, keys).select(
        *keys, "y", "x", F.coalesce("_label", F.lit(0)).alias("label"))
