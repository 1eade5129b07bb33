"""Batch edits of label masks: many images and many requests in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.functions.joins import attach, attach_labels, attach_pixels
from rasterlab.functions.grouped import stream_groups
from rasterlab.operators.components import components
from rasterlab.operators.spatial import image_size
from rasterlab.operators.tables import labels_at, relabel_sequential
from rasterlab.operators.tiling import TILE, core_only, four_neighbours, tiles
from rasterlab.schema import IMAGE
from rasterlab.session import cut_lineage

UNDO_DEPTH = 20
_NOBODY = 1 << 62
_SIDES = ("left", "right", "up", "down")
_CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


def _with_label(px: DataFrame, label: Column, columns: Sequence[str]) -> DataFrame:
    return px.withColumn("label", label.cast(px.schema["label"].dataType)).select(*columns)


def _top_label(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    return px.groupBy(*keys).agg(F.max("label").alias("_top"))


def remove_cells(px: DataFrame, edits: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Sets the listed labels (keys, label) to background."""
    gone = edits.select(*keys, "label").where("label <> 0").distinct().withColumn("_gone", F.lit(True))
    return _with_label(attach_labels(px, gone, keys),
                       F.when(F.col("_gone"), 0).otherwise(F.col("label")), px.columns)


def remove_cells_at(px: DataFrame, points: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Removes the cell under each point (keys, y, x)."""
    return remove_cells(px, labels_at(px, points.select(*keys, "y", "x"), keys), keys)


def merge_cells(px: DataFrame, edits: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Gives all labels of each request (keys, labels array) the smallest of them; single labels stay."""
    moves = edits.where(F.size("labels") >= 2).select(
        *keys, F.explode("labels").alias("label"), F.array_min("labels").alias("_to")
    ).groupBy(*keys, "label").agg(F.min("_to").alias("_to"))
    return _with_label(attach_labels(px, moves, keys), F.coalesce("_to", "label"), px.columns)


def polygon_pixels(polygons: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels inside or on each polygon (keys, seq, vertices array of (y, x)): rows (keys, seq, y, x).

    The even-odd crossing rule in integer-friendly column arithmetic, over the bounding box only.
    """
    ys = F.transform("vertices", lambda p: p["y"])
    xs = F.transform("vertices", lambda p: p["x"])
    grid = (
        polygons.select(*keys, "seq", "vertices", F.explode(F.sequence(
            F.ceil(F.array_min(ys)).cast("int"), F.floor(F.array_max(ys)).cast("int"))).alias("y"),
            F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"))
        .withColumn("x", F.explode(F.sequence(F.ceil("_x0").cast("int"), F.floor("_x1").cast("int"))))
    )
    edges = F.transform(
        F.sequence(F.lit(0), F.size("vertices") - 1),
        lambda i: F.struct(
            F.col("vertices")[i].alias("a"), F.col("vertices")[(i + 1) % F.size("vertices")].alias("b")),
    )
    y, x = F.col("y"), F.col("x")

    def turn(e):
        return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    def on_edge(e):
        a, b = e["a"], e["b"]
        return (turn(e) == 0) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])) & x.between(
            F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))

    def crosses(e):
        a, b = e["a"], e["b"]
        rising = b["y"] > a["y"]
        return ((a["y"] > y) != (b["y"] > y)) & F.when(rising, turn(e) > 0).otherwise(turn(e) < 0)

    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e).cast("int")) % 2 == 1
    return grid.where(odd | F.exists(edges, on_edge)).select(*keys, "seq", "y", "x")


def add_cells(px: DataFrame, polygons: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Draws polygons (keys, seq, vertices, overwrite) as new cells, in seq order per image.

    New labels continue after the highest one.  Without ``overwrite`` only background is written.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    named = polygons.join(_top_label(px, keys), list(keys)).withColumn(
        "_new", F.col("_top") + F.row_number().over(order))
    drawn = polygon_pixels(polygons, keys).join(named.select(*keys, "seq", "_new", "overwrite"), [*keys, "seq"])
    per_pixel = drawn.groupBy(*keys, "y", "x").agg(
        F.max(F.when(F.col("overwrite"), F.col("_new"))).alias("_over"),
        F.min(F.when(~F.col("overwrite"), F.col("_new"))).alias("_first"),
    )
    label = F.coalesce("_over", F.when(F.col("label") == 0, F.coalesce("_first", F.lit(0))), "label")
    return _with_label(attach_pixels(px, per_pixel, keys), label, px.columns)


def grow_from_seeds(
    px: DataFrame, seeds: DataFrame, keys: Sequence[str] = IMAGE, tolerance: float = 0.3, tile: int = TILE
) -> DataFrame:
    """Grows a new cell from each background seed (keys, seq, y, x) through similar intensities.

    The region is the 4-connected set around the seed whose values differ from it by at most
    ``tolerance`` times its value; only background pixels of it are written, and where regions
    meet the smallest seq writes.

    Regions flood tile by tile (see :func:`_flooded`): a pixel meets only the seeds that reach its tile.
    """
    keys = list(keys)
    start = seeds.select(*keys, "seq", "y", "x").join(px, [*keys, "y", "x"]).where("label = 0").select(
        *keys, "seq", F.col("value").cast("double").alias("_v0"), "y", "x")
    region = _flooded(px.select(*keys, "y", "x", "label", F.col("value").cast("double").alias("value")), start, keys, tolerance, tile)
    # a seed that writes nothing takes no label, so labels count the seeds that do
    first = region.groupBy(*keys, "y", "x").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy(*keys).orderBy("seq")
    numbers = first.select(*keys, "seq").distinct().join(_top_label(px, keys), keys).select(
        *keys, "seq", (F.col("_top") + F.row_number().over(order)).alias("_new"))
    written = attach(first, numbers, [*keys, "seq"]).select(*keys, "y", "x", "_new")
    return _with_label(attach_pixels(px, written, keys), F.coalesce("_new", "label"), px.columns)


def _flooded(px: DataFrame, start: DataFrame, keys: Sequence[str], tolerance: float, tile: int) -> DataFrame:
    """Background pixels that seeds (keys, seq, _v0, y, x) reach, with the smallest seq of a round and tile.

    A round floods every tile that a front has entered, each seed by itself, and writes three kinds of
    rows: background pixels reached, reached pixels on the tile's rim, and the places beyond the rim
    where the seed goes on. Places already reached are dropped, so a region is flooded once in each
    tile it connects in, and the rounds end when no front crosses a seam. A task holds a tile and
    the fronts that enter it.
    """
    keys = list(keys)
    group = [*keys, "_ty", "_tx"]
    pixel, beyond, rim = 0, 1, 2
    schema = T.StructType([
        *[px.schema[k] for k in keys], start.schema["seq"], T.StructField("_v0", T.DoubleType()),
        T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("_kind", T.IntegerType()),
    ])

    def at_tile(df: DataFrame) -> DataFrame:
        return df.withColumns({"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")})

    def flood(fronts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(own) and len(fronts):
            y0, x0 = int(own._ty.iat[0]) * tile - 1, int(own._tx.iat[0]) * tile - 1
            value, label = np.full((tile + 2, tile + 2), np.nan), np.ones((tile + 2, tile + 2), dtype=np.int64)
            y, x = own.y.to_numpy() - y0, own.x.to_numpy() - x0
            value[y, x], label[y, x] = own.value.to_numpy(dtype=float), own.label.to_numpy()
            writer = np.full(label.shape, -1)
            groups = list(fronts.sort_values("seq").groupby("seq", sort=True))
            for number, (seq, mine) in enumerate(groups):
                v0 = float(mine._v0.iat[0])
                open_ = np.abs(value - v0) <= v0 * tolerance
                ys, xs = mine.y.to_numpy() - y0, mine.x.to_numpy() - x0
                reached = np.zeros(open_.shape, dtype=bool)
                while len(ys):
                    new = open_[ys, xs] & ~reached[ys, xs]
                    ys, xs = ys[new], xs[new]
                    reached[ys, xs] = True
                    place = np.unique(np.concatenate([(ys + dy) * (tile + 2) + xs + dx for dy, dx in _CROSS[1:]])) if len(ys) else ys
                    ys, xs = place // (tile + 2), place % (tile + 2)
                writer[reached & (label == 0) & (writer < 0)] = number
                edge = np.zeros_like(reached)
                edge[1], edge[-2], edge[:, 1], edge[:, -2] = True, True, True, True
                out = np.zeros_like(reached)
                out[0], out[-1], out[:, 0], out[:, -1] = reached[1], reached[-2], reached[:, 1], reached[:, -2]
                for kind, mask in ((rim, reached & edge), (beyond, out)):
                    ys2, xs2 = np.nonzero(mask)
                    parts.append(pd.DataFrame({"seq": seq, "_v0": v0, "y": ys2 + y0, "x": xs2 + x0, "_kind": kind}))
            ys2, xs2 = np.nonzero(writer >= 0)
            order = np.array([seq for seq, _ in groups])
            parts.append(pd.DataFrame({"seq": order[writer[ys2, xs2]], "_v0": 0.0, "y": ys2 + y0, "x": xs2 + x0, "_kind": pixel}))
        if not parts:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})
        found = pd.concat(parts, ignore_index=True)
        for k in keys:
            found[k] = own[k].iat[0]
        return found[schema.fieldNames()]

    tiled = at_tile(px)
    front, rounds = cut_lineage(start.dropDuplicates([*keys, "seq", "y", "x"])), []
    while not front.isEmpty():
        entered = at_tile(front)
        mine = tiled.join(entered.select(*group).distinct(), group, "left_semi")
        after = cut_lineage(entered.groupBy(*group).cogroup(mine.groupBy(*group)).applyInPandas(flood, schema=schema))
        rounds.append(after)
        known = [r.where(F.col("_kind") == rim).select(*keys, "seq", "y", "x") for r in rounds]
        reached = known[0]
        for more in known[1:]:
            reached = reached.unionByName(more)
        front = cut_lineage(
            after.where(F.col("_kind") == beyond).select(*keys, "seq", "_v0", "y", "x").distinct().join(reached, [*keys, "seq", "y", "x"], "left_anti"))
    if not rounds:
        return start.limit(0).select(*keys, "seq", "y", "x")
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every.where(F.col("_kind") == pixel).select(*keys, "seq", "y", "x")


def clean_small_objects(px: DataFrame, keys: Sequence[str] = IMAGE, min_size: int = 50) -> DataFrame:
    """Drops connected groups of cell pixels (touching cells count together) below a size, then relabels."""
    keys = list(keys)
    parts = components(px.where("label > 0").select(*keys, "y", "x", "label"), keys)
    big = parts.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    kept = parts.join(big, [*keys, "component"]).select(*keys, "y", "x", F.lit(True).alias("_kept"))
    cleaned = _with_label(attach_pixels(px, kept, keys),
                          F.when(F.col("_kept"), F.col("label")).otherwise(0), px.columns)
    return relabel_sequential(cleaned, keys)


def fill_holes(px: DataFrame, keys: Sequence[str] = IMAGE, max_hole_size: int | None = None) -> DataFrame:
    """Fills the holes of every cell; what lies inside is overwritten, and later labels win.

    A cell whose holes together exceed ``max_hole_size`` is left as it is.
    """
    keys = list(keys)
    per = [*keys, "label"]
    mask = px.where("label > 0").select(*per, "y", "x")
    box = mask.groupBy(*per).agg(
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    around = (
        box.withColumn("y", F.explode(F.sequence(F.col("_y0") - 1, F.col("_y1") + 1)))
        .withColumn("x", F.explode(F.sequence(F.col("_x0") - 1, F.col("_x1") + 1)))
        .join(mask, [*per, "y", "x"], "left_anti")
        .withColumn("_rim", (F.col("y") < F.col("_y0")) | (F.col("y") > F.col("_y1"))
                    | (F.col("x") < F.col("_x0")) | (F.col("x") > F.col("_x1")))
        # tiles count from 0, the rim of an edge cell from -1
        .withColumns({"y": F.col("y") + 1, "x": F.col("x") + 1})
    )
    parts = components(around.select(*per, "y", "x", "_rim"), per)
    open_ = parts.where("_rim").select(*per, "component").distinct()
    holes = parts.join(open_, [*per, "component"], "left_anti").select(
        *per, (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"))
    filled = mask
    if max_hole_size is not None:
        sizes = holes.groupBy(*per).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_hole_size)
        holes, filled = holes.join(sizes, per, "left_anti"), mask.join(sizes, per, "left_anti")
    top = filled.unionByName(holes).groupBy(*keys, "y", "x").agg(F.max("label").alias("_top"))
    return _with_label(attach_pixels(px, top, keys), F.coalesce("_top", "label"), px.columns)


def dilate(
    px: DataFrame, keys: Sequence[str] = IMAGE, iterations: int = 1, only: DataFrame | None = None, tile: int = TILE
) -> DataFrame:
    """Grows cells into background, smallest label first, each finishing its steps before the next.

    One step needs only the four neighbours; for more see :func:`_settled`.
    """
    keys = list(keys)
    source = F.col("label")
    px_cols = px.columns
    if only is not None:
        chosen = only.select(*keys, "label").distinct().withColumn("_grow", F.lit(True))
        px = attach_labels(px, chosen, keys).withColumn("_grow", F.coalesce("_grow", F.lit(False)))
    else:
        px = px.withColumn("_grow", F.col("label") > 0)
    if iterations == 1:
        t = px.withColumn("_src", F.when(F.col("_grow"), source).otherwise(0))
        t = core_only(four_neighbours(tiles(t, keys, halo=1), keys, "_src"))
        near = F.least(*[F.when(F.col(f"_n_{s}") > 0, F.col(f"_n_{s}")) for s in _SIDES])
        return _with_label(t, F.when(source == 0, F.coalesce(near, F.lit(0))).otherwise(source), px_cols)

    # owner and steps as one number, so that the least number is the smallest label, then the nearest
    start = F.when(F.col("_grow"), source.cast("bigint") * (iterations + 1)).otherwise(_NOBODY)
    state = px.select(*keys, "y", "x", (source == 0).alias("_free"), start.alias("_value"))
    owned = _settled(state, keys, iterations, tile)
    grown = owned.where(F.col("_free") & (F.col("_value") < _NOBODY)).select(
        *keys, "y", "x", F.floor(F.col("_value") / (iterations + 1)).alias("_new"))
    return _with_label(attach_pixels(px, grown, keys), F.coalesce("_new", "label"), px_cols)


def _settled(state: DataFrame, keys: Sequence[str], steps: int, tile: int = TILE) -> DataFrame:
    """Owners of free pixels: rows (keys, y, x, _free, _value), ``_value`` = label * (steps + 1) + steps taken.

    A free pixel belongs to the smallest label that a neighbour passes on, which it does if it has
    taken fewer than ``steps`` steps itself. These rules have one solution, the one of growing the
    labels in order: the smallest label's pixels depend on no other, and so on. Rounds solve the
    rules in every tile and its halo, with the rim of the halo as the round before has left it, and
    end when no pixel changes. A round settles all chains of labels shorter than the halo, so few
    rounds do, however many cells touch; a task holds one tile.
    """
    keys, group, halo = list(keys), [*keys, "_ty", "_tx"], 2 * steps

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf._ty.iat[0]) * tile - halo, int(pdf._tx.iat[0]) * tile - halo
        y, x = pdf.y.to_numpy() - y0 + 1, pdf.x.to_numpy() - x0 + 1
        size = tile + 2 * halo
        value = np.full((size + 2, size + 2), _NOBODY, dtype=np.int64)
        value[y, x] = pdf._value.to_numpy()
        free = np.zeros(value.shape, dtype=bool)
        free[y, x] = pdf._free.to_numpy()
        rim = np.ones(value.shape, dtype=bool)
        rim[2:-2, 2:-2] = False
        open_ = free & ~rim
        while True:
            passed = np.where((value < _NOBODY) & (value % (steps + 1) < steps), value + 1, _NOBODY)
            best = np.minimum(np.minimum(passed[:-2, 1:-1], passed[2:, 1:-1]), np.minimum(passed[1:-1, :-2], passed[1:-1, 2:]))
            after = value.copy()
            after[1:-1, 1:-1] = np.where(open_[1:-1, 1:-1], best, value[1:-1, 1:-1])
            if (after == value).all():
                break
            value = after
        core = pdf[pdf._core.to_numpy()]
        new = value[core.y.to_numpy() - y0 + 1, core.x.to_numpy() - x0 + 1]
        return core[[*keys, "y", "x", "_free"]].assign(_value=new, _before=core._value)

    fields = [state.schema[c] for c in (*keys, "y", "x", "_free")]
    schema = T.StructType([*fields, T.StructField("_value", T.LongType()), T.StructField("_before", T.LongType())])
    while True:
        after = cut_lineage(stream_groups(tiles(state, keys, halo, tile), group, solve, schema))
        state = after.drop("_before")
        if after.where("_value <> _before").isEmpty():
            return state


def erode(
    px: DataFrame, keys: Sequence[str] = IMAGE, iterations: int = 1, only: DataFrame | None = None
) -> DataFrame:
    """Shrinks cells by cross steps; the image edge does not erode.  All steps share one exchange."""
    keys = list(keys)
    cols = px.columns
    if only is not None:
        chosen = only.select(*keys, "label").distinct().withColumn("_grow", F.lit(True))
        px = attach_labels(px, chosen, keys).withColumn("_grow", F.coalesce("_grow", F.lit(False)))
    else:
        px = px.withColumn("_grow", F.lit(True))
    t = tiles(px.withColumn("_now", F.col("label")), keys, halo=iterations)
    for _ in range(iterations):
        t = four_neighbours(t, keys, "_now", outside=None)
        same = F.lit(True)
        for s in _SIDES:
            same = same & (F.coalesce(f"_n_{s}", "_now") == F.col("_now"))
        t = t.withColumn("_now", F.when(same | ~F.col("_grow"), F.col("_now")).otherwise(0))
        t = t.drop(*[f"_n_{s}" for s in _SIDES])
    return _with_label(core_only(t), F.col("_now"), cols)


def smooth_boundaries(px: DataFrame, keys: Sequence[str] = IMAGE, sigma: float = 1.0) -> DataFrame:
    """Closes then opens every cell by ``max(1, int(sigma))`` cross steps; later labels win overlaps."""
    keys = list(keys)
    steps = max(1, int(sigma))
    size = image_size(px, keys)
    cells = px.where("label > 0").select(*keys, "label", "y", "x")
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _CROSS])
    place = [*keys, "label", "y", "x"]

    def spread(s: DataFrame) -> DataFrame:
        return s.select(*keys, "label", "y", "x", F.explode(offsets).alias("o")).select(
            *keys, "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))

    def grow(s: DataFrame) -> DataFrame:
        inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
        return attach(spread(s).distinct(), size, keys).where(inside).select(*place)

    def shrink(s: DataFrame) -> DataFrame:
        return spread(s).groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where("_n = 5").select(*place)

    for move in (grow, shrink, shrink, grow):
        for _ in range(steps):
            cells = move(cells)
    top = cells.groupBy(*keys, "y", "x").agg(F.max("label").alias("_top"))
    return _with_label(attach_pixels(px, top, keys), F.coalesce("_top", F.lit(0)), px.columns)


def merge_masks(a: DataFrame, b: DataFrame, keys: Sequence[str] = IMAGE, mode: str = "union") -> DataFrame:
    """Combines two masks of the same images and relabels.

    ``union`` (and ``mask1_priority``) fills the gaps of the first with the second, renumbered
    after it; ``intersection`` keeps the first where both have a cell.
    """
    keys = list(keys)
    place = [*keys, "y", "x"]
    both = a.select(*place, "label").join(b.select(*place, F.col("label").alias("_b")), place)
    if mode in ("union", "mask1_priority"):
        both = attach(both, _top_label(a, keys), keys)
        label = F.when(F.col("label") > 0, F.col("label")).when(F.col("_b") > 0, F.col("_b") + F.col("_top")).otherwise(0)
    elif mode == "intersection":
        label = F.when((F.col("label") > 0) & (F.col("_b") > 0), F.col("label")).otherwise(0)
    else:
        raise ValueError(f"unknown merge mode: {mode}")
    return relabel_sequential(_with_label(both, label, [*place, "label"]), keys)


def eroded_component_counts(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Connected components of the mask eroded once (image edge included): (keys, n_components)."""
    keys = list(keys)
    t = px.select(*keys, "y", "x", (F.col("label") > 0).cast("int").alias("_b"))
    t = core_only(four_neighbours(tiles(t, keys, halo=1), keys, "_b"))
    inner = t.where(F.least("_b", *[f"_n_{s}" for s in _SIDES]) > 0).select(*keys, "y", "x")
    return components(inner, keys).groupBy(*keys).agg(F.countDistinct("component").alias("n_components"))


def edit_summary(before: DataFrame, after: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Cells before and after, added, removed, and pixels changed, per image."""
    keys = list(keys)
    place = [*keys, "y", "x"]
    both = before.select(*place, F.col("label").alias("_a")).join(
        after.select(*place, F.col("label").alias("_b")), place)
    pixels = both.groupBy(*keys).agg(
        F.count_if(F.col("_a") != F.col("_b")).alias("pixels_changed"), F.count(F.lit(1)).alias("_total"))

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.where("label > 0").select(*keys, "label").distinct().groupBy(*keys).agg(
            F.count(F.lit(1)).alias(name))

    a, b = F.col("original_cells"), F.col("edited_cells")
    return (
        pixels.join(cells(before, "original_cells"), keys, "left").join(cells(after, "edited_cells"), keys, "left")
        .fillna(0, ["original_cells", "edited_cells"])
        .select(*keys, "original_cells", "edited_cells",
                F.greatest(b - a, F.lit(0)).alias("cells_added"), F.greatest(a - b, F.lit(0)).alias("cells_removed"),
                "pixels_changed", (100 * F.col("pixels_changed") / F.col("_total")).alias("percent_changed"))
    )


def edit_log_status(log: DataFrame, keys: Sequence[str] = ("image_set",)) -> DataFrame:
    """Per edited image: the version preserved at the first edit, the last operation, undo depth."""
    return log.groupBy(*keys).agg(
        F.min_by("seq", F.struct("ts", "seq")).alias("original_seq"),
        F.max_by("operation", F.struct("ts", "seq")).alias("last_operation"),
        F.least(F.count(F.lit(1)), F.lit(UNDO_DEPTH)).alias("undo_depth"),
    )


def training_manifest(log: DataFrame, keys: Sequence[str] = ("condition", "image_set")) -> DataFrame:
    """Current training pairs: the last entry per key, unless it removed the pair."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).where("action <> 'remove'")


def train_test_split(manifest: DataFrame, keys: Sequence[str] = ("condition", "image_set"), seed: int = 42) -> DataFrame:
    """Marks a fifth of the pairs, at least one, as ``is_test``; the order is a seeded hash."""
    from rasterlab.functions.order import positions

    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    hashed = manifest.withColumn("_h", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"))
    placed = positions(hashed, [], "_h").select("_h", "_before", "_n")
    test = F.col("_before") < F.greatest(F.lit(1), F.floor(F.col("_n") / 5))
    return hashed.join(placed, "_h").withColumn("is_test", test).drop("_h", "_before", "_n")
