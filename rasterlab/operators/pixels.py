"""Pixel arithmetic: calibration, normalisation, colour and value maps.

Image-level figures are partial aggregates joined back on the image key without a
broadcast hint; see :mod:`rasterlab.operators.cells` for why.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.functions.order import levels, quantiles, quantiles_of_counts, whole_numbers
from rasterlab.schema import IMAGE

FLAT_FLOOR = 0.01

# Default false colours per channel position (cyan, green, magenta, yellow, orange).
CHANNEL_COLOURS = [(0.0, 1.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.6), (1.0, 1.0, 0.0), (1.0, 0.4, 0.0)]


def _one_shape(frames: DataFrame, frame: str) -> Column:
    """True if all frames have the same height and width."""
    shapes = frames.groupBy(frame).agg(F.max("y").alias("h"), F.max("x").alias("w"))
    return shapes.agg(F.countDistinct("h", "w").alias("n")).scalar() <= 1


def master_dark(frames: DataFrame, frame: str = "frame_no") -> DataFrame:
    """Pixel-wise median over dark frames; frames of differing shape are an error."""
    median = F.median(F.col("value").cast("double"))
    return frames.groupBy("y", "x").agg(median.alias("dark")).withColumn(
        "dark", F.when(_one_shape(frames, frame), F.col("dark")).otherwise(
            F.raise_error(F.lit("calibration frames differ in shape")).cast("double"))
    )


def master_flat(frames: DataFrame, frame: str = "frame_no") -> DataFrame:
    """Pixel-wise median over flat frames divided by its own median, at least 0.01."""
    per_pixel = master_dark(frames, frame).withColumnRenamed("dark", "flat")
    level = quantiles(per_pixel, [], "flat", {"m": 0.5}).select("m").scalar()
    return per_pixel.withColumn(
        "flat",
        F.when(level > 0, F.greatest(F.col("flat") / level, F.lit(FLAT_FLOOR))).otherwise(
            F.raise_error(F.lit("flat-field median must be positive")).cast("double")),
    )


def calibration_issues(
    image: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None
) -> DataFrame:
    """One row with the list of problems of a calibration set against a sample image."""

    def shape(df: DataFrame, p: str) -> DataFrame:
        return df.agg((F.max("y") + 1).alias(f"{p}_h"), (F.max("x") + 1).alias(f"{p}_w"))

    def size(p: str) -> Column:
        return F.format_string("(%d, %d)", F.col(f"{p}_h"), F.col(f"{p}_w"))

    facts = shape(image, "i")
    rules = []
    for name, df in (("dark", dark), ("flat", flat)):
        if df is None:
            continue
        # aggregates of one row each
        facts = facts.join(shape(df, name), how="cross")
        rules.append(F.when(
            (F.col(f"{name}_h") != F.col("i_h")) | (F.col(f"{name}_w") != F.col("i_w")),
            F.concat(F.lit(f"{name} shape "), size(name), F.lit(" does not match image "), size("i"))))
    if flat is not None:
        level = quantiles(flat, [], "flat", {"flat_median": 0.5}).drop("_n")
        low = flat.agg((F.count_if(F.col("flat") < 0.5) / F.count(F.lit(1))).alias("low_share"))
        facts = facts.join(level, how="cross").join(low, how="cross")
        rules.append(F.when(F.abs(F.col("flat_median") - 1) > 0.05,
                            F.format_string("flat median %.3f is not 1", F.col("flat_median"))))
        rules.append(F.when(F.col("low_share") > 0.1,
                            F.format_string("%.1f%% of flat pixels are below 0.5", F.col("low_share") * 100)))
    return facts.select(F.array_compact(F.array(*rules)).alias("issues"))


def correct(px: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None) -> DataFrame:
    """``max((value - dark) / flat, 0)`` by pixel position, each step optional."""
    out = px.withColumn("value", F.col("value").cast("double"))
    if dark is not None:
        out = out.join(dark, ["y", "x"]).withColumn("value", F.col("value") - F.col("dark")).drop("dark")
    if flat is not None:
        out = out.join(flat, ["y", "x"]).withColumn("value", F.col("value") / F.col("flat")).drop("flat")
    return out.withColumn("value", F.greatest("value", F.lit(0.0))).select(*px.columns)


def _limits(px: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    of = quantiles_of_counts if whole_numbers(px, "value") else levels
    q = of(px, keys, "value", {"_lo": low, "_hi": high})
    v = F.col("value").cast("double")
    ends = px.groupBy(*keys).agg(F.min(v).alias("_min"), F.max(v).alias("_max"))
    narrow = F.col("_hi") <= F.col("_lo")
    return q.join(ends, list(keys)).select(
        *keys, "_min", "_max",
        F.when(narrow, F.col("_min")).otherwise(F.col("_lo")).alias("_lo"),
        F.when(narrow, F.col("_max")).otherwise(F.col("_hi")).alias("_hi"),
    )


def normalise(
    px: DataFrame, keys: Sequence[str] = IMAGE, low: float = 0.01, high: float = 0.99,
    legacy: bool = False,
) -> DataFrame:
    """Adds ``norm``: value scaled to [0, 1] between two percentiles of its image.

    An image of one value becomes 0 if that value is 0, else 0.5 (0 with ``legacy``).
    """
    flat = F.when(F.col("value") == 0, 0.0).otherwise(0.0 if legacy else 0.5)
    scaled = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    norm = F.when(F.col("_min") == F.col("_max"), flat).otherwise(
        F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    return attach(px, _limits(px, keys, low, high), keys).withColumn("norm", norm).drop(
        "_lo", "_hi", "_min", "_max")


def auto_contrast(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Adds ``gray`` 0..255: 0.35 % saturation at each end; flat images are black."""
    scaled = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    gray = F.when(F.col("_hi") <= F.col("_lo"), 0).otherwise(
        F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * 255)).cast("int")
    return attach(px, _limits(px, keys, 0.0035, 0.9965), keys).withColumn("gray", gray).drop(
        "_lo", "_hi", "_min", "_max")


def false_colour(df: DataFrame, colour: str = "colour", gray: str = "gray") -> DataFrame:
    """Adds ``r, g, b``: gray/255 times the hex colour, in single precision, truncated."""
    share = (F.col(gray) / 255.0).cast("float")
    parts = {}
    for i, c in enumerate("rgb"):
        level = F.conv(F.substring(F.ltrim(F.col(colour), F.lit("#")), 1 + 2 * i, 2), 16, 10).cast("int")
        parts[c] = (share.cast("double") * level).cast("float").cast("int")
    return df.withColumns(parts)


def composite(px: DataFrame, channels: Sequence[str], keys: Sequence[str] = IMAGE) -> DataFrame:
    """RGB composite: normalised channels weighted by their colour, summed, clipped, times 255."""
    norm = normalise(px.where(F.col("marker").isin(list(channels))), [*keys, "marker"])
    sums = []
    for i, c in enumerate("rgb"):
        weight: Column = F.lit(0.0)
        for name, colour in zip(channels, CHANNEL_COLOURS):
            weight = F.when(F.col("marker") == name, F.lit(colour[i])).otherwise(weight)
        total = F.round(F.sum(F.col("norm") * weight), 9)
        sums.append(F.floor(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias(c))
    return norm.groupBy(*keys, "y", "x").agg(*sums)


def channel_sum(px: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Sum over channels per pixel, auto-contrasted."""
    return auto_contrast(px.groupBy(*keys, "y", "x").agg(F.sum("value").alias("value")), keys)


def id_map(px: DataFrame) -> DataFrame:
    """Label packed into two colour bytes: ``r`` high byte, ``g`` low byte, ``b`` 0."""
    low = F.col("label").bitwiseAND(F.lit(65535))
    return px.withColumns({
        "r": F.shiftright(low, 8).cast("int"), "g": low.bitwiseAND(F.lit(255)).cast("int"), "b": F.lit(0),
    })


def label_from_id_map(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.shiftleft("r", 8) + F.col("g"))


# Multiplier and offset of each colour channel.
_COLOUR_RULE = {"r": (67, 13), "g": (137, 43), "b": (209, 97)}


def label_colours(df: DataFrame, label: str = "label") -> DataFrame:
    """Deterministic colour of a label or track id."""
    return df.withColumns({
        c: ((F.col(label).cast("bigint") * m + o) % 256).cast("int") for c, (m, o) in _COLOUR_RULE.items()
    })


def overlay(px: DataFrame, keys: Sequence[str] = IMAGE, alpha: float = 0.5) -> DataFrame:
    """Label colours blended over the min-max scaled image, as ``r, g, b`` 0..255."""
    ends = px.groupBy(*keys).agg(
        F.min("value").cast("double").alias("_lo"), F.max("value").cast("double").alias("_hi"))
    grey = F.when(F.col("_hi") > F.col("_lo"),
                  (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    coloured = label_colours(attach(px, ends, keys).withColumn("_grey", grey))
    blend = {
        c: F.floor(F.round(F.when(
            F.col("label") > 0, F.col(c) / 255.0 * alpha + F.col("_grey") * (1 - alpha)
        ).otherwise(F.col("_grey")), 9) * 255).cast("int")
        for c in "rgb"
    }
    return coloured.withColumns(blend).drop("_lo", "_hi", "_grey")


def value_map(px: DataFrame, cell_values: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Cell pixels painted with their cell's ``value``, and ``norm`` scaled to [0, 1] per image.

    ``cell_values`` holds (keys, label, value); pixels of cells without a value are left out.
    """
    lo, hi = F.min("cell_value"), F.max("cell_value")
    values = cell_values.select(*keys, "label", F.col("value").alias("cell_value"))
    limits = values.groupBy(*keys).agg(lo.alias("_lo"), F.when(lo == hi, hi + 1).otherwise(hi).alias("_hi"))
    painted = px.where("label > 0").select(*keys, "y", "x", "label").join(values, [*keys, "label"])
    return attach(painted, limits, keys).withColumn(
        "norm", (F.col("cell_value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
