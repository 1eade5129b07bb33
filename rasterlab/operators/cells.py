"""Per-cell intensity measurement: one hash aggregate, then column arithmetic.

The label aggregate keeps partial sums on the map side, so a cell, image or condition
holding a third of all pixels still reaches the reducers as one small row per task.
Image-level figures are aggregated and joined back rather than computed over an
image-wide window, for the same reason; the joins carry no broadcast hint, so AQE
broadcasts only tables it has measured to be small and splits skewed keys otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.functions.order import levels, medians, quantiles
from rasterlab.schema import IMAGE, METRIC_SUFFIX

# Full scale of the integer image types, and the share of it that counts as saturated.
FULL_SCALE = {"uint8": 255.0, "uint16": 65535.0}
SATURATED_SHARE = 0.99
DIM_PERCENTILE = 0.05
DIM_MIN_CELLS = 10


def label_stats(px: DataFrame, keys: Sequence[str] = IMAGE, nuclear: bool = False) -> DataFrame:
    """Area, integrated density, mean, population std, min and max of every label except 0.

    With ``nuclear`` also ``nuclear_sum``, the signal under ``nuclear_label`` within the cell.
    """
    value = F.col("value").cast("double")
    aggs = [
        F.count(F.lit(1)).alias("area"),
        F.sum(value).alias("int_den"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    if nuclear:
        aggs.append(F.sum(F.when(F.col("nuclear_label") > 0, value).otherwise(0.0)).alias("nuclear_sum"))
    return px.where("label <> 0").groupBy(*keys, "label").agg(*aggs)


def with_background(cells: DataFrame, backgrounds: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Joins one background value per image (and marker); absent images get 0."""
    cols = [c for c in ("background", "bg_std") if c in backgrounds.columns]
    joined = cells.join(backgrounds.select(*keys, *cols), list(keys), "left")
    return joined.fillna(0.0, subset=cols)


def with_cell_background(cells: DataFrame, cell_bg: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Joins a background value per cell."""
    return cells.join(cell_bg.select(*keys, "label", "background"), [*keys, "label"], "left")


def add_ctcf(cells: DataFrame, nuclear_markers: Iterable[str] = ()) -> DataFrame:
    """Corrected total fluorescence, floored at 0, and its mean per pixel.

    For markers named in ``nuclear_markers`` the signal over the nucleus is taken out first.
    """
    nucleus: Column = F.lit(0.0)
    names = list(nuclear_markers)
    if names:
        nucleus = F.when(F.col("marker").isin(names), F.col("nuclear_sum")).otherwise(0.0)
    ctcf = F.greatest(F.lit(0.0), F.col("int_den") - F.col("area") * F.col("background") - nucleus)
    return cells.withColumn("ctcf", ctcf).withColumn(
        "mcf", F.when(F.col("area") > 0, F.col("ctcf") / F.col("area")).otherwise(0.0)
    )


def add_ctcf_sigma(cells: DataFrame) -> DataFrame:
    """Propagated error of CTCF; NULL where the background spread is unknown or 0."""
    a = F.col("area").cast("double")
    sigma = F.sqrt(a * F.col("std") * F.col("std") + a * a * F.col("bg_std") * F.col("bg_std"))
    return cells.withColumn("ctcf_sigma", F.when(F.col("bg_std") > 0, sigma))


def saturation_limits(
    px: DataFrame, keys: Sequence[str] = IMAGE, dtype: str | None = None, threshold: float | None = None
) -> DataFrame:
    """Intensity from which a cell counts as saturated, per image.

    ``dtype`` names an integer type with a known full scale, or a column holding it; any
    other type uses the brightest pixel of the image.
    """
    if threshold is not None:
        limit: Column = F.lit(float(threshold))
    elif dtype in FULL_SCALE:
        limit = F.lit(FULL_SCALE[dtype] * SATURATED_SHARE)
    else:
        limit = F.max(F.col("value").cast("double")) * SATURATED_SHARE
        if dtype in px.columns:
            kind = F.first(dtype)
            for name, scale in FULL_SCALE.items():
                limit = F.when(kind == name, F.lit(scale * SATURATED_SHARE)).otherwise(limit)
    return px.groupBy(*keys).agg(limit.alias("saturation_limit"))


def flag_saturated(cells: DataFrame, limits: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return (
        attach(cells, limits, keys)
        .withColumn("is_saturated", F.col("max") >= F.col("saturation_limit"))
        .drop("saturation_limit")
    )


def flag_dim(cells: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Cells strictly below the 5th percentile of the cell means of their image, if it has > 10 cells."""
    cut = quantiles(cells, keys, "mean", {"_cut": DIM_PERCENTILE})
    dim = (F.col("_n") > DIM_MIN_CELLS) & (F.col("mean") < F.col("_cut"))
    return attach(cells, cut, keys).withColumn("is_dim", dim).drop("_cut", "_n")


def wide_results(
    cell_marker: DataFrame,
    markers: Sequence[str],
    metrics: Sequence[str] = ("ctcf", "int_den", "mean", "background"),
    keys: Sequence[str] = IMAGE,
    morphology: DataFrame | None = None,
    pixel_size_um: float | None = None,
    segmentation_type: str = "cellular",
) -> DataFrame:
    """One row per cell with ``{marker}_{metric}`` columns and the flags of the first marker.

    The marker list is explicit, so the pivot is a plain conditional aggregate.
    """
    aggs = [F.max("area").alias("Area")]
    for m in markers:
        for metric in metrics:
            picked = F.max(F.when(F.col("marker") == m, F.col(metric)))
            aggs.append(picked.alias(f"{m}_{METRIC_SUFFIX[metric]}"))
    for flag in ("is_saturated", "is_dim"):
        if flag in cell_marker.columns:
            aggs.append(F.max(F.when(F.col("marker") == markers[0], F.col(flag))).alias(flag))
    wide = cell_marker.where(F.col("marker").isin(list(markers))).groupBy(*keys, "label").agg(*aggs)
    if morphology is not None:
        shape = [c for c in ("x_centroid", "y_centroid", "circularity", "solidity", "eccentricity",
                             "perimeter", "aspect_ratio", "is_border") if c in morphology.columns]
        wide = wide.join(morphology.select(*keys, "label", *shape), [*keys, "label"], "left")
        wide = wide.fillna(0.0, subset=[c for c in shape if c != "is_border"])
        if "is_border" in shape:
            wide = wide.fillna(False, subset=["is_border"])
    if pixel_size_um is not None:
        wide = wide.withColumn("area_um2", F.col("Area") * F.lit(float(pixel_size_um) ** 2))
    return (
        wide.withColumn("SegmentationType", F.lit(segmentation_type))
        .withColumnRenamed("condition", "Condition")
        .withColumnRenamed("image_set", "ImageSet")
        .withColumnRenamed("label", "CellID")
    )


def mask_stats(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Cell count and smallest, largest and mean area per image; zeros for an image without cells."""
    per_label = px.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"))
    area = F.when(F.col("label") != 0, F.col("area"))
    return per_label.groupBy(*keys).agg(
        F.count(area).alias("n_cells"),
        F.coalesce(F.min(area), F.lit(0)).alias("min_area"),
        F.coalesce(F.max(area), F.lit(0)).alias("max_area"),
        F.coalesce(F.avg(area), F.lit(0.0)).alias("mean_area"),
    )


def mask_issues(px: DataFrame, keys: Sequence[str] = IMAGE, components: DataFrame | None = None) -> DataFrame:
    """Validation messages per image: tiny cells, huge cells, label gaps, fragmented cells.

    ``components`` (keys, n_components of the eroded mask) switches the last check on.
    """
    per_label = px.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"))
    cells = per_label.where("label <> 0")
    typical = medians(cells, keys, "area", "_median")
    is_cell = F.col("label") != 0
    area = F.when(is_cell, F.col("area"))
    summary = (
        per_label.join(typical, list(keys), "left")
        .groupBy(*keys)
        .agg(
            F.count(area).alias("n_cells"),
            F.coalesce(F.min(area), F.lit(0)).alias("min_area"),
            F.coalesce(F.max(area), F.lit(0)).alias("max_area"),
            F.coalesce(F.avg(area), F.lit(0.0)).alias("mean_area"),
            F.sum("area").alias("_pixels"),
            F.count_if(is_cell & (F.col("area") < 50)).alias("_small"),
            F.count_if(is_cell & (F.col("area") > 10 * F.col("_median"))).alias("_large"),
            F.max(F.when(is_cell, F.col("label"))).alias("_max_label"),
            F.count_if(~is_cell).alias("_background"),
        )
    )
    n = F.col("n_cells")
    # The published wording of each message.
    rules = [
        F.when(n == 0, F.lit("No cells found in mask")),
        F.when(F.col("_small") > 0,
               F.format_string("%d cells with area < 50 pixels (possible noise)", F.col("_small"))),
        F.when(F.col("_large") > 0,
               F.format_string("%d cells with area > 10x median (possible merged cells)", F.col("_large"))),
        F.when((F.col("_background") > 0) & (n > 0) & (F.col("_max_label") > n),
               F.format_string("Gap in label numbering: %d cells but max label is %d", n, F.col("_max_label"))),
    ]
    if components is not None:
        summary = summary.join(components, list(keys), "left").fillna(0, subset=["n_components"])
        rules.append(F.when(
            (n > 0) & (F.col("n_components") > 1.2 * n),
            F.format_string("Possible touching/fragmented cells: %d labels but ~%d components",
                            n, F.col("n_components")),
        ))
    return summary.withColumn("issues", F.array_compact(F.array(*rules))).select(
        *keys, "n_cells", "min_area", "max_area", "mean_area", "issues",
        (F.size("issues") == 0).alias("is_valid"),
    )


def fill_missing_markers(cell_marker: DataFrame, markers: Sequence[str], keys: Sequence[str] = IMAGE) -> DataFrame:
    """Every cell gets a row for every listed marker; unmeasured ones read 0."""
    cells = cell_marker.groupBy(*keys, "label").agg(F.max("area").alias("_area"))
    wanted = cells.select("*", F.explode(F.array(*[F.lit(m) for m in markers])).alias("marker"))
    metrics = ["ctcf", "int_den", "mean", "background"]
    return (
        wanted.join(cell_marker.select(*keys, "label", "marker", *metrics), [*keys, "label", "marker"], "left")
        .fillna(0.0, subset=metrics)
        .withColumnRenamed("_area", "area")
    )


def legacy_ctcf(px: DataFrame, backgrounds: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Area, integrated density, mean and CTCF with one background value; no error terms."""
    cells = add_ctcf(with_background(label_stats(px, keys), backgrounds.select(*keys, "background"), keys))
    return cells.select(*keys, "label", "area", "int_den", "mean", "background", "ctcf")


def background_above_cells(
    px: DataFrame, backgrounds: DataFrame, keys: Sequence[str] = IMAGE
) -> DataFrame:
    """Median cell pixel per image and whether the background estimate exceeds it.

    An image without cells has no median and counts as not exceeded.
    """
    signal = levels(px.where("label > 0"), keys, "value", {"cell_median": 0.5})
    return backgrounds.select(*keys, "background").join(signal, list(keys), "left").select(*keys, "cell_median", "background").withColumn(
        "above_cells", F.coalesce(F.col("background") > F.col("cell_median"), F.lit(False))
    )
