"""Whole analyses composed from the operators, each one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlab.operators import filenames as fn
from rasterlab.operators.background import estimate, global_background
from rasterlab.operators.cells import (
    add_ctcf,
    add_ctcf_sigma,
    flag_dim,
    flag_saturated,
    label_stats,
    saturation_limits,
    wide_results,
    with_background,
)
from rasterlab.operators.morphology import morphology
from rasterlab.operators.pixels import correct
from rasterlab.operators.qc import apply_gates, gates
from rasterlab.operators.stats import kruskal_wallis, mann_whitney, pearson
from rasterlab.operators.summary import (
    clean_ratio,
    flag_outliers,
    fov_summary,
    hierarchical_summary,
    ratio_summary,
    remove_iqr_outliers,
)
from rasterlab.operators.tracking import detections, track, track_ctcf, with_lineage
from rasterlab.schema import IMAGE, METRIC_SUFFIX
from rasterlab.session import cut_lineage

RATIO_METRICS = ("Red_CTCF", "GFP_CTCF", "ratio")
RATIO_PARTS = ("clean", "summary", "two_groups", "all_groups", "correlation")

# Keyword lists of the ratio study, in priority order.
RATIO_KEYWORDS = {
    "condition": ["condition", "treatment", "group", "sample"],
    "red": ["mrfp_ctcf", "rfp_ctcf", "red_ctcf", "jc1_red_ctcf", "jc-1_red_ctcf", "aggregate_ctcf"],
    "green": ["gfp_ctcf", "green_ctcf", "jc1_green_ctcf", "jc-1_green_ctcf", "monomer_ctcf"],
    "area": ["area", "cell_area", "size"],
}


def experiment_channels(files: DataFrame, wavelengths: DataFrame | None = None) -> DataFrame:
    """Channels of every condition with role, colour and image-set count, from file names alone.

    ``wavelengths`` (suffix, wavelength) takes precedence over names when colouring.
    """
    grouped = fn.dominant_group(fn.tokenise(files))
    position = fn.channel_position(fn.score_positions(fn.position_tokens(grouped)))
    sets = fn.build_image_sets(grouped, position)
    channels = sets.groupBy("condition", "suffix").agg(F.count(F.lit(1)).alias("_files")).drop("_files")
    counts = sets.groupBy("condition").agg(F.countDistinct("base").alias("n_image_sets"))
    roles = fn.suggest_roles(channels)
    roles = roles.join(wavelengths, "suffix", "left") if wavelengths is not None else roles.withColumn(
        "wavelength", F.lit(None).cast("double"))
    return fn.channel_colours(roles).join(counts, "condition").select(
        "condition", "suffix", "natural_key", "role", "n_image_sets", "colour")


def quantify(
    px: DataFrame,
    markers: Sequence[str],
    keys: Sequence[str] = IMAGE,
    dark: DataFrame | None = None,
    flat: DataFrame | None = None,
    thresholds: Mapping[str, float | None] | None = None,
    qc_enabled: bool = True,
    background: str = "auto",
    nuclear_markers: Sequence[str] = (),
    pixel_size_um: float | None = None,
    outlier_threshold: float | None = 3.5,
    dtype: str | None = None,
    segmentation_type: str = "cellular",
    **background_options,
) -> DataFrame:
    """The full measurement: calibration, shape, quality gates, background, CTCF, flags, wide table.

    ``px`` is long over markers (keys, marker, y, x, label, [nuclear_label], value).  Rejected
    cells count as background.  Three tables are written on the way, the gated shapes, the gated and
    corrected pixels and the measurements, because several later steps read each.
    """
    keys = list(keys)
    mk = [*keys, "marker"]
    px = px.where(F.col("marker").isin(list(markers)))
    mask = px.where(F.col("marker") == markers[0]).select(*keys, "y", "x", "label")
    shape = morphology(mask, keys)
    if qc_enabled:
        gated = cut_lineage(gates(shape, thresholds))
        shape = gated
        px = apply_gates(px, gated, keys)
    # read by every estimate and measurement below
    signal = cut_lineage(correct(px, dark, flat) if dark is not None or flat is not None else px)

    images, cell_bg = estimate(signal, mk, background, **background_options)
    stats = label_stats(signal, mk, nuclear=bool(nuclear_markers))
    measured = stats.withColumn("label", F.col("label").cast("bigint")).join(cell_bg, [*mk, "label"])
    measured = add_ctcf_sigma(add_ctcf(measured, nuclear_markers))
    measured = cut_lineage(flag_saturated(measured, saturation_limits(signal, mk, dtype), mk))
    measured = flag_dim(measured, mk)

    wide = wide_results(
        measured, markers, metrics=list(METRIC_SUFFIX), keys=keys,
        morphology=shape.withColumn("label", F.col("label").cast("bigint")),
        pixel_size_um=pixel_size_um, segmentation_type=segmentation_type,
    )
    # a run over several markers reports the method of the last one
    method = images.where(F.col("marker") == markers[-1]).select(
        F.col(keys[0]).alias("Condition"), F.col(keys[1]).alias("ImageSet"),
        F.col("method_used").alias("background_method"))
    wide = wide.join(method, ["Condition", "ImageSet"], "left")
    return wide if outlier_threshold is None else flag_outliers(wide, threshold=outlier_threshold)


def qc_report(results: DataFrame, rounded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Field-of-view table and the condition summary built on it."""
    fov = fov_summary(results)
    return fov, hierarchical_summary(fov, rounded)


def batch_analysis(px: DataFrame, markers: Sequence[str], keys: Sequence[str] = IMAGE) -> DataFrame:
    """Result table without quality control, one background value per image and marker."""
    mk = [*keys, "marker"]
    px = px.where(F.col("marker").isin(list(markers)))
    cells = add_ctcf(with_background(label_stats(px, mk), global_background(px, mk), mk))
    return wide_results(cells, markers, keys=keys)


def both_segmentations(px: DataFrame, markers: Sequence[str], keys: Sequence[str] = IMAGE) -> DataFrame:
    """Cellular and nuclear masks measured in one run, stacked with ``SegmentationType``."""
    cellular = batch_analysis(px, markers, keys)
    nuclear = batch_analysis(px.withColumn("label", F.col("nuclear_label")), markers, keys)
    return cellular.unionByName(nuclear.withColumn("SegmentationType", F.lit("nuclear")))


def timelapse(px: DataFrame, radius: float = 50) -> tuple[DataFrame, DataFrame]:
    """Tracks with lineage, and CTCF per track, frame and marker (px: condition, frame, marker, y, x, label, value).

    Tracks are cut to storage once because both outputs and every later summary read them.
    """
    first = px.groupBy("condition").agg(F.min("marker").alias("marker"))
    det = detections(px.join(first, ["condition", "marker"]))
    tracks = cut_lineage(with_lineage(track(det, radius)))
    return tracks, track_ctcf(tracks, px)


def ratio_study(
    table: DataFrame, keywords: Mapping[str, Sequence[str]] | None = None, parts: Sequence[str] = RATIO_PARTS
) -> dict[str, DataFrame]:
    """Two-marker ratio study of a result table: column roles, cleaning, outliers, summary, tests.

    ``parts`` names the tables wanted; large tables are ranked only for the test that applies.
    """
    names = roles_of(table.columns, keywords or RATIO_KEYWORDS)
    renamed = table.select(*[
        F.col(found).alias(role) for role, found in
        (("Condition", names["condition"]), ("Red_CTCF", names["red"]), ("GFP_CTCF", names["green"]),
         ("Area", names["area"])) if found])
    clean = clean_ratio(renamed, area="Area" if names["area"] else None)
    kept = remove_iqr_outliers(clean, RATIO_METRICS)
    # two conditions get the two-sample test, more of them the test over all
    conditions = kept.agg(F.countDistinct("Condition")).first()[0] if {"two_groups", "all_groups"} & set(parts) else 0
    tables = {
        "clean": lambda: kept,
        "summary": lambda: ratio_summary(kept),
        "two_groups": lambda: mann_whitney(kept if conditions == 2 else kept.limit(0), RATIO_METRICS),
        "all_groups": lambda: kruskal_wallis(kept if conditions > 2 else kept.limit(0), RATIO_METRICS),
        "correlation": lambda: pearson(kept, "Red_CTCF", "GFP_CTCF"),
    }
    return {part: tables[part]() for part in parts}


def roles_of(columns: Sequence[str], keywords: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """First column containing the first keyword that any column contains; marker roles want CTCF columns."""
    out: dict[str, str | None] = {}
    for role, words in keywords.items():
        pool = [c for c in columns if role not in ("red", "green") or "ctcf" in c.lower()]
        out[role] = next((c for w in words for c in pool if w in c.lower()), None)
    return out
