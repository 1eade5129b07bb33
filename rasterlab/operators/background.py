"""Background estimates per image and per cell.

Input masks are expected after quality control, so pixels of rejected cells count as
background.  Medians and percentiles go by the type of the pixels (``order.levels``): camera
counts keep at most 65,536 counters per group, corrected pixels are selected by radix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.functions.order import fits_one_task, levels, medians, whole_numbers
from rasterlab.operators.spatial import (
    cell_surroundings,
    image_size,
    median_filtered_background,
    nearest_label,
    opened_surface,
)
from rasterlab.operators.tiling import core_only, square_max, tiles
from rasterlab.schema import IMAGE
from rasterlab.session import cut_lineage

BINS = 256


def _bg():
    return F.when(F.col("label") == 0, F.col("value").cast("double"))


def global_background(px: DataFrame, keys: Sequence[str] = IMAGE, statistic: str = "median") -> DataFrame:
    """One statistic and the population std of the label-0 pixels; 0 and 0 where there are none."""
    if statistic == "mode":
        return mode_background(px, keys)
    prob = 0.05 if statistic == "percentile5" else 0.5
    spread = F.coalesce(F.stddev_pop(_bg()), F.lit(0.0)).alias("bg_std")
    if statistic == "mean" or whole_numbers(px, "value"):
        stat = F.avg(_bg()) if statistic == "mean" else F.percentile(_bg(), prob)
        return px.groupBy(*keys).agg(F.coalesce(stat, F.lit(0.0)).alias("background"), spread)
    level = levels(px.where("label = 0"), keys, "value", {"background": prob})
    return px.groupBy(*keys).agg(spread).join(level, list(keys), "left").select(
        *keys, F.coalesce("background", F.lit(0.0)).alias("background"), "bg_std")


def mode_background(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Centre of the fullest of 256 equal bins between the lowest and highest background pixel."""
    keys = list(keys)
    bg = px.where("label = 0").withColumn("_v", F.col("value").cast("double"))
    span = bg.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_pop("_v").alias("bg_std")
    ).withColumns({  # an empty range widens by half a unit on each side
        "_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
    })
    bin_no = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1)
    )
    peak = (
        attach(bg, span, keys)
        .groupBy(*keys, "_lo", "_hi", "bg_std", bin_no.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(*keys, "_lo", "_hi", "bg_std")
        .agg(F.min_by("_bin", F.struct(-F.col("_c"), F.col("_bin"))).alias("_bin"))
    )
    centre = F.col("_lo") + (F.col("_bin") + 0.5) * (F.col("_hi") - F.col("_lo")) / BINS
    empty = px.groupBy(*keys).agg(F.lit(0.0).alias("_zero"))
    return empty.join(peak, keys, "left").select(
        *keys, F.coalesce(centre, "_zero").alias("background"), F.coalesce("bg_std", "_zero").alias("bg_std")
    )


def legacy_background(px: DataFrame, keys: Sequence[str] = IMAGE, method: str = "median") -> DataFrame:
    """As :func:`global_background`, but images with < 1 % background use their own 5th percentile."""
    scarce = F.count(_bg()) < 0.01 * F.count(F.lit(1))
    few = px.groupBy(*keys).agg(scarce.alias("_scarce")).join(levels(px, keys, "value", {"_own": 0.05}), list(keys))
    return global_background(px, keys, method).join(few, list(keys)).select(
        *keys, F.when(F.col("_scarce"), F.col("_own")).otherwise(F.col("background")).alias("background")
    )


def legacy_auto(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Median where background is plentiful and even (CV < .3), else the 5th percentile."""
    figures = px.groupBy(*keys).agg(
        (F.count(_bg()) < 0.05 * F.count(F.lit(1))).alias("_scarce"),
        (F.stddev_pop(_bg()) / (F.avg(_bg()) + 1e-8)).alias("cv"),
    )
    cv = F.col("cv")
    # Method names and wording of the published selector.
    return figures.select(
        *keys,
        F.when(F.col("_scarce"), "percentile5").when(cv < 0.3, "median").otherwise("percentile5").alias("method"),
        F.when(F.col("_scarce"), "Limited background area (<5%), using 5th percentile")
        .when(cv < 0.1, "Uniform background (CV < 0.1), using median")
        .when(cv < 0.3, "Moderately uniform background, using median")
        .otherwise(F.format_string("Variable background (CV=%.2f), using 5th percentile", cv)).alias("reason"),
    )


def corner_background(px: DataFrame, keys: Sequence[str] = IMAGE, fraction: float = 0.1) -> DataFrame:
    """Median of the four corner blocks; a pixel in two blocks counts twice."""
    keys = list(keys)
    size = px.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")).withColumns({
        "_ch": F.floor(F.col("_h") * fraction), "_cw": F.floor(F.col("_w") * fraction),
    })
    y, x = F.col("y"), F.col("x")
    # a block of height (or width) 0 taken from the far end is the whole image, as in array slicing
    top, left = y < F.col("_ch"), x < F.col("_cw")
    bottom = (F.col("_ch") == 0) | (y >= F.col("_h") - F.col("_ch"))
    right = (F.col("_cw") == 0) | (x >= F.col("_w") - F.col("_cw"))
    times = sum(((a & b).cast("int") for a, b in
                 [(top, left), (top, right), (bottom, left), (bottom, right)]), F.lit(0))
    corners = attach(px, size, keys).withColumn("_times", times).where("_times > 0")
    return levels(corners, keys, "value", {"background": 0.5}, "_times")


def coverage(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Share of labelled pixels, background pixel count and background CV (999 if unknown)."""
    n_bg = F.count(_bg())
    mean = F.avg(_bg())
    return px.groupBy(*keys).agg(
        (F.count_if(F.col("label") != 0) / F.count(F.lit(1))).alias("coverage"),
        n_bg.alias("bg_pixels"),
        F.when((n_bg < 100) | (mean < 1e-8), 999.0).otherwise(F.stddev_pop(_bg()) / mean).alias("bg_cv"),
    )


def choose_method(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Method and reason per image from coverage and background unevenness."""
    cv, cov = F.col("bg_cv"), F.col("coverage")
    # Method names and wording of the published selector.
    return coverage(px, keys).withColumns({
        "method": F.when(cov > 0.80, "masked_annular_ring").when(cv > 0.30, "polynomial_surface").otherwise("voronoi"),
        "reason": F.when(cov > 0.80, F.format_string(
            "High cell coverage (%.0f%%); using masked annular ring to sample intercellular gaps", cov * 100))
        .when(cv > 0.30, F.format_string(
            "High background non-uniformity (CV=%.2f); using polynomial surface fit", cv))
        .when(cv > 0.15, F.format_string(
            "Moderate background non-uniformity (CV=%.2f); using Voronoi-partitioned local background", cv))
        .otherwise(F.format_string(
            "Uniform background (CV=%.2f); using Voronoi-partitioned local background", cv)),
    })


# ---------------------------------------------------------------- per-cell methods
# Each returns (keys, label, background, bg_std): one value per cell plus the image's spread.


def _cell_list(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    return px.where("label > 0").select(*keys, F.col("label").cast("bigint").alias("label")).distinct()


def annular_ring(px: DataFrame, keys: Sequence[str] = IMAGE, ring_width: int = 5, gap: int = 2) -> DataFrame:
    """Median of background pixels in a square ring around each cell.

    A contested ring pixel belongs to the highest label; pixels within the gap of any cell
    are left out; cells without a ring use the median of all background pixels.  Both
    dilations run on one tiled exchange.
    """
    keys = list(keys)
    outer = gap + ring_width
    t = tiles(px.select(*keys, "y", "x", "label", "value"), keys, halo=outer)
    t = square_max(t, keys, "label", {"_outer": outer, "_inner": gap})
    ring = core_only(t).where("label = 0 and _outer > 0 and _inner = 0")
    local = levels(ring.withColumn("label", F.col("_outer").cast("bigint")), [*keys, "label"], "value", {"_ring": 0.5})
    whole = global_background(px, keys)
    return (
        _cell_list(px, keys).join(local, [*keys, "label"], "left").join(whole, keys)
        .select(*keys, "label", F.coalesce("_ring", "background").alias("background"), "bg_std")
    )


def voronoi(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Median of the background pixels nearest to each cell.

    Pixels closer than 10 to a cell are left out; with fewer than 100 left in an image the
    limit drops to 5, 3, 1 and then to nothing.
    """
    keys = list(keys)
    free = nearest_label(px.select(*keys, "y", "x", "label", "value"), keys).where("label = 0")
    # the distance transform is dear, and the limit, the cells and the whole image read it
    free = cut_lineage(free.select(*keys, "nearest", "d2", "value"))
    ladder = (10, 5, 3, 1)  # fixed values: distance steps of the method
    counts = free.groupBy(*keys).agg(*[F.count_if(F.col("d2") >= d * d).alias(f"_c{d}") for d in ladder])
    limit = F.lit(0)
    for d in reversed(ladder):
        limit = F.when(F.col(f"_c{d}") >= 100, d * d).otherwise(limit)
    usable = attach(free, counts.select(*keys, limit.alias("_limit")), keys).where(F.col("d2") >= F.col("_limit"))
    value = F.col("value").cast("double")
    local = levels(usable.withColumn("label", F.col("nearest")), [*keys, "label"], "value", {"_local": 0.5})
    if whole_numbers(px, "value"):
        whole = usable.groupBy(*keys).agg(F.median(value).alias("_whole"), F.stddev_pop(value).alias("_std"))
    else:
        whole = usable.groupBy(*keys).agg(F.stddev_pop(value).alias("_std")).join(levels(usable, keys, "value", {"_whole": 0.5}), keys)
    return (
        _cell_list(px, keys).join(local, [*keys, "label"], "left").join(whole, keys, "left")
        .select(*keys, "label", F.coalesce("_local", "_whole", F.lit(0.0)).alias("background"),
                F.coalesce("_std", F.lit(0.0)).alias("bg_std"))
    )


def rolling_ball(px: DataFrame, keys: Sequence[str] = IMAGE, radius: int = 50) -> DataFrame:
    """Median under each cell of the opened image; std of that surface on background.

    The white top-hat variant subtracts (image - opening) from the image, which is the same surface.
    """
    keys = list(keys)
    surface = opened_surface(px.select(*keys, "y", "x", "label", "value"), keys, radius)
    inside = surface.where("label > 0").withColumn("label", F.col("label").cast("bigint"))
    local = levels(inside, [*keys, "label"], "surface", {"background": 0.5})
    spread = surface.where("label = 0").groupBy(*keys).agg(F.stddev_pop("surface").alias("bg_std"))
    return local.join(spread, keys, "left").fillna(0.0, ["bg_std"])


def polynomial_surface(px: DataFrame, keys: Sequence[str] = IMAGE, order: int = 3) -> DataFrame:
    """Median under each cell of a polynomial fitted to the background pixels.

    The fit is exact least squares over all background pixels: power sums are one partial
    aggregate, and only a small system per image is solved in Python.  Coordinates run from
    -1 to 1, which spans the same polynomials as [0, 1] with a better-conditioned system.
    Images with fewer than 50 background pixels use their median and a spread of 0.
    """
    keys = list(keys)
    px = px.select(*keys, "y", "x", "label", F.col("value").cast("double").alias("value"))
    size = image_size(px, keys)
    placed = attach(px, size, keys).withColumns({
        "_u": 2 * F.col("x") / F.greatest(F.col("width") - 1, F.lit(1)) - 1,
        "_v": 2 * F.col("y") / F.greatest(F.col("height") - 1, F.lit(1)) - 1,
    }).drop("width", "height")
    terms = [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]
    powers = [(p, q) for p in range(2 * order + 1) for q in range(2 * order + 1 - p)]

    def mono(p: int, q: int):
        out = F.lit(1.0)
        for c, n in (("_v", p), ("_u", q)):
            for _ in range(n):
                out = out * F.col(c)
        return out

    sums = placed.where("label = 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.sum(mono(p, q)) for p, q in powers]).alias("_s"),
        F.array(*[F.sum(F.col("value") * mono(p, q)) for p, q in terms]).alias("_r"),
    )

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series, r: pd.Series) -> pd.Series:
        at = {pq: i for i, pq in enumerate(powers)}
        pick = np.array([[at[p1 + p2, q1 + q2] for p2, q2 in terms] for p1, q1 in terms])
        return pd.Series([np.linalg.lstsq(np.asarray(a)[pick], np.asarray(b), rcond=None)[0] for a, b in zip(s, r)])

    # of images with fewer than 50 values only
    rest = attach(px.where("label = 0"), sums.where("_n < 50").select(*keys), keys).groupBy(*keys).agg(F.median("value").alias("_med"))
    fit = sums.select(*keys, F.when(F.col("_n") >= 50, solve("_s", "_r")).alias("_k")).join(rest, keys, "left")
    value = sum((F.col("_k")[i] * mono(p, q) for i, (p, q) in enumerate(terms)), F.lit(0.0))
    surface = attach(placed, fit, keys, "left").withColumn(
        "_surface", F.when(F.col("_k").isNotNull(), value).otherwise(F.coalesce("_med", F.lit(0.0)))
    )
    local = medians(
        surface.where("label > 0").select(*keys, F.col("label").cast("bigint").alias("label"), "_surface"),
        [*keys, "label"], "_surface", "background", small=fits_one_task(px),
    )
    spread = surface.where("label = 0 and _k is not null").groupBy(*keys).agg(
        F.stddev_pop(F.col("value") - F.col("_surface")).alias("bg_std")
    )
    return local.join(spread, keys, "left").fillna(0.0, ["bg_std"])


def median_filter_background(px: DataFrame, keys: Sequence[str] = IMAGE, size: int = 50) -> DataFrame:
    """Median over background of a wide median filter: the older stand-in for a rolling ball."""
    surface = median_filtered_background(px.select(*keys, "y", "x", "label", "value"), keys, size)
    return levels(surface, keys, "surface", {"background": 0.5})


def surroundings(px: DataFrame, keys: Sequence[str] = IMAGE, steps: int = 5, box: int = 50) -> DataFrame:
    """Median of background pixels within five city-block steps of each cell.

    A cell without any takes the mean of the box around its centroid, mirrored at the edges.
    """
    keys = list(keys)
    value = F.col("value").cast("double")
    near = levels(cell_surroundings(px, keys, steps), [*keys, "label"], "value", {"background": 0.5})
    centre = px.where("label > 0").groupBy(*keys, F.col("label").cast("bigint").alias("label")).agg(
        F.floor(F.avg("y")).alias("_cy"), F.floor(F.avg("x")).alias("_cx")
    )
    closed = centre.join(near, [*keys, "label"], "left_anti").join(image_size(px, keys), keys)

    def mirrored(c: str, n: str):
        m = F.pmod(F.col(c), 2 * F.col(n))
        return F.when(m < F.col(n), m).otherwise(2 * F.col(n) - 1 - m).cast("int")

    span = F.sequence(F.lit(-(box // 2)), F.lit(box - box // 2 - 1))
    boxes = (
        closed.withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span))
        .withColumns({"_yy": F.col("_cy") + F.col("_dy"), "_xx": F.col("_cx") + F.col("_dx")})
        .select(*keys, "label", mirrored("_yy", "height").alias("y"), mirrored("_xx", "width").alias("x"))
    )
    fallback = boxes.join(px.select(*keys, "y", "x", "value"), [*keys, "y", "x"]).groupBy(*keys, "label").agg(
        F.avg(value).alias("background")
    )
    return near.unionByName(fallback)


# ---------------------------------------------------------------- dispatcher

# Published method names and wording.
_REASONS = {
    "annular_ring": "Annular ring per cell",
    "masked_annular_ring": "Masked annular ring (neighbours excluded)",
    "voronoi": "Voronoi-partitioned intercellular space",
    "rolling_ball": "Rolling ball (radius={ball_radius})",
    "white_tophat": "White top-hat (radius={ball_radius})",
    "polynomial_surface": "Polynomial surface (order={poly_order})",
    "global_roi": "Global ROI ({global_statistic})",
    "manual": "User-supplied manual background value",
    "negative_control": "Background from negative-control reference image",
}
_SCARCE = (" | WARNING: <5% background area — using 1st percentile as approximation. "
           "Provide a negative control for accuracy.")


def estimate(
    px: DataFrame,
    keys: Sequence[str] = IMAGE,
    method: str = "auto",
    manual: float | None = None,
    negative_control: DataFrame | None = None,
    ring_width: int = 5,
    ring_gap: int = 2,
    ball_radius: int = 50,
    poly_order: int = 3,
    global_statistic: str = "median",
) -> tuple[DataFrame, DataFrame]:
    """Background by any method: (per-image table, per-cell table).

    The image table has ``background`` (the median over cells for per-cell methods), ``bg_std``,
    ``method_used``, ``method_reason`` and ``low_confidence``; the cell table lists every cell.
    Each method runs only on the images that chose it.
    """
    keys = list(keys)
    cells = _cell_list(px, keys)
    params = {"ball_radius": ball_radius, "poly_order": poly_order, "global_statistic": global_statistic}

    def same_everywhere(value, std, used: str) -> tuple[DataFrame, DataFrame]:
        images = px.select(*keys).distinct().select(
            *keys, value.alias("background"), std.alias("bg_std"), F.lit(used).alias("method_used"),
            F.lit(_REASONS[used]).alias("method_reason"), F.lit(False).alias("low_confidence"),
        )
        return images, cells.join(images.select(*keys, "background", "bg_std"), keys)

    if manual is not None:
        return same_everywhere(F.lit(float(manual)), F.lit(0.0), "manual")
    if negative_control is not None:
        level = levels(negative_control, [], "value", {"m": 0.5}).first()
        spread = negative_control.agg(F.stddev_pop(F.col("value").cast("double"))).first()
        return same_everywhere(F.lit(level and level[0]).cast("double"), F.lit(spread[0]).cast("double"), "negative_control")
    if method != "auto" and method not in _REASONS:
        raise ValueError(f"unknown background method: {method}")

    if method == "auto":
        plan = choose_method(px, keys)
    else:
        plan = coverage(px, keys).withColumns({
            "method": F.lit(method), "reason": F.lit(""),
        })
    n_cells = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    plan = plan.join(n_cells, keys, "left").withColumn(
        "scarce",
        (F.col("coverage") > 0.95) & (F.col("bg_pixels") < 50 * F.greatest(F.coalesce("_cells", F.lit(1)), F.lit(1))),
    ).select(*keys, "method", "reason", "scarce")
    # one small row per image, read by every branch below; it also tells which branches are needed
    plan = cut_lineage(plan)
    chosen = {(r["method"], r["scarce"]) for r in plan.select("method", "scarce").distinct().collect()}

    fns = {
        "annular_ring": lambda p: annular_ring(p, keys, ring_width, ring_gap),
        "masked_annular_ring": lambda p: annular_ring(p, keys, ring_width, ring_gap),
        "voronoi": lambda p: voronoi(p, keys),
        "rolling_ball": lambda p: rolling_ball(p, keys, ball_radius),
        "white_tophat": lambda p: rolling_ball(p, keys, ball_radius),
        "polynomial_surface": lambda p: polynomial_surface(p, keys, poly_order),
    }
    images_out, cells_out = [], []

    low = None
    if any(s for _, s in chosen):
        crowded = attach(px, plan.where("scarce").select(*keys), keys)
        spread = crowded.groupBy(*keys).agg(F.coalesce(F.stddev_pop(_bg()), F.lit(0.0)).alias("bg_std"))
        low = levels(crowded, keys, "value", {"background": 0.01}).join(spread, keys).join(plan, keys).select(
            *keys, "background", "bg_std", F.concat("method", F.lit("_fallback_p1")).alias("method_used"),
            F.concat("reason", F.lit(_SCARCE)).alias("method_reason"), F.lit(True).alias("low_confidence"),
        )
        images_out.append(low)
        cells_out.append(cells.join(low.select(*keys, "background", "bg_std"), keys))

    for name in sorted({m for m, s in chosen if not s}):
        mine = plan.where((F.col("method") == name) & ~F.col("scarce"))
        part = px if len(chosen) == 1 else attach(px, mine.select(*keys), keys)
        text = F.when(F.col("reason") == "", F.lit(_REASONS[name].format(**params))).otherwise(F.col("reason"))
        if name == "global_roi":
            level = global_background(part, keys, global_statistic)
            local = _cell_list(part, keys).join(level, keys)
        else:
            local = fns[name](part)
            level = medians(local, keys, "background", "background", small=fits_one_task(px)).join(
                local.groupBy(*keys).agg(F.first("bg_std").alias("bg_std")), keys)
        images_out.append(level.join(mine, keys).select(
            *keys, "background", "bg_std", F.lit(name).alias("method_used"), text.alias("method_reason"),
            F.lit(False).alias("low_confidence")))
        cells_out.append(local.select(*keys, "label", "background", "bg_std"))

    if not images_out:  # no images at all
        return same_everywhere(F.lit(0.0), F.lit(0.0), "global_roi")

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p.select(*out.columns))
        return out

    return union([p.select(*keys, "background", "bg_std", "method_used", "method_reason", "low_confidence")
                  for p in images_out]), union([p.select(*keys, "label", "background", "bg_std") for p in cells_out])


def region_map(px: DataFrame, cell_values: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Every background pixel with the value of its nearest cell, scaled to [0, 1] per image.

    ``cell_values`` holds (keys, label, value); cells it lacks count as 0 and set no limit.
    """
    keys = list(keys)
    values = cell_values.select(*keys, F.col("label").cast("bigint").alias("nearest"), F.col("value").alias("_cv"))
    lo, hi = F.min("_cv"), F.max("_cv")
    limits = values.groupBy(*keys).agg(lo.alias("vmin"), F.when(lo == hi, hi + 1).otherwise(hi).alias("vmax"))
    near = nearest_label(px.select(*keys, "y", "x", "label"), keys).where("label = 0")
    cv = F.coalesce(F.col("_cv"), F.lit(0.0))
    return near.join(values, [*keys, "nearest"], "left").join(limits, keys).select(
        *keys, "y", "x", "nearest", cv.alias("value"),
        ((cv - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))).alias("norm"),
    )


def subtract(px: DataFrame, background: str = "background", clip: bool = True) -> DataFrame:
    """Takes a background column off ``value``; negative results become 0 unless ``clip`` is off."""
    diff = F.col("value").cast("double") - F.col(background)
    return px.withColumn("value", F.greatest(diff, F.lit(0.0)) if clip else diff)
