"""Outlier flags, roll-ups from cells to fields to conditions, ratios and distributions.

Conditions are few and may each hold a third of all cells, so no statistic here gathers
a condition: sums are partial aggregates, and medians, quantiles and ranks come from
:mod:`rasterlab.functions.order`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.functions.order import medians, pick, positions, quantiles, to_long, to_wide

FIELD = ("Condition", "ImageSet")


def marker_names(df: DataFrame) -> list[str]:
    """Markers of a wide result table, from its ``_CTCF`` columns."""
    return [c[: -len("_CTCF")] for c in df.columns if c.endswith("_CTCF")]


def mad_outliers(long: DataFrame, keys: Sequence[str], value: str = "value", threshold: float = 3.5) -> DataFrame:
    """Adds ``is_outlier``: modified z-score beyond the threshold, in either direction.

    Groups of fewer than 3 rows or without spread flag nothing.
    """
    keys = list(keys)
    centre = quantiles(long, keys, value, {"_med": 0.5})
    away = attach(long, centre, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = medians(away, keys, "_dev", "_mad")
    z = 0.6745 * F.col("_dev") / F.col("_mad")
    flagged = (F.col("_n") >= 3) & (F.col("_mad") >= 1e-12) & (z > threshold)
    return attach(away, mad, keys).withColumn("is_outlier", flagged).drop("_med", "_mad", "_dev", "_n")


def flag_outliers(results: DataFrame, group: str = "Condition", threshold: float = 3.5) -> DataFrame:
    """``is_outlier_area`` and ``is_outlier_{marker}`` per condition on a wide result table.

    Only the limits travel: per condition and metric they are two numbers, joined back
    to the wide rows, which are never unpivoted and pivoted.
    """
    metrics = {"area": "Area", **{m: f"{m}_CTCF" for m in marker_names(results)}}
    long = to_long(results, [group], list(metrics.values()))
    keys = [group, "metric"]
    centre = quantiles(long, keys, "value", {"_med": 0.5})
    away = attach(long, centre, keys).withColumn("_dev", F.abs(F.col("value") - F.col("_med")))
    limits = centre.join(medians(away, keys, "_dev", "_mad"), keys)
    wide = to_wide(limits, [group], {
        f"_{stat}_{name}": (col, f"_{stat}") for name, col in metrics.items() for stat in ("med", "mad", "n")
    })
    out = attach(results, wide, group, "left")
    for name, col in metrics.items():
        med, mad, n = (F.col(f"_{s}_{name}") for s in ("med", "mad", "n"))
        far = 0.6745 * F.abs(F.col(col) - med) / mad > threshold
        out = out.withColumn(
            f"is_outlier_{name}", F.coalesce((n >= 3) & (mad >= 1e-12) & far, F.lit(False))
        )
    return out.select(*results.columns, *[f"is_outlier_{name}" for name in metrics])


def any_outlier(df: DataFrame) -> Column:
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in df.columns if c.startswith("is_outlier_")]
    return reduce(or_, flags, F.lit(False))


def any_flag(df: DataFrame) -> Column:
    """True where any outlier or quality flag of a row is set."""
    extra = [F.coalesce(F.col(c), F.lit(False)) for c in
             ("is_saturated", "is_dim", "low_confidence_background") if c in df.columns]
    return reduce(or_, extra, any_outlier(df))


def flag_totals(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.countDistinct("Condition").alias("conditions"),
        F.count_if(any_outlier(flagged)).alias("outliers_flagged"),
    )


def fov_summary(results: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """Cell count, median area, and median and mean CTCF per marker for every field of view."""
    keys = list(keys)
    marks = marker_names(results)
    values = ["Area", *[f"{m}_CTCF" for m in marks]]
    mid = to_wide(
        medians(to_long(results, keys, values), [*keys, "metric"], "value"), keys,
        {("median_area" if v == "Area" else f"{v[:-5]}_median_CTCF"): (v, "median") for v in values},
    )
    sums = results.groupBy(*keys).agg(
        F.count("Area").alias("n_cells"), *[F.avg(f"{m}_CTCF").alias(f"{m}_mean_CTCF") for m in marks]
    )
    return sums.join(mid, keys)


def hierarchical_summary(fov: DataFrame, rounded: bool = False) -> DataFrame:
    """Spread of field medians per condition and marker; the field, not the cell, is the unit."""
    marks = [c[: -len("_median_CTCF")] for c in fov.columns if c.endswith("_median_CTCF")]
    long = fov.select("Condition", "n_cells", F.explode(F.array(*[
        F.struct(F.lit(m).alias("Marker"), F.col(f"{m}_median_CTCF").alias("v")) for m in marks
    ])).alias("_m")).select("Condition", "n_cells", "_m.Marker", "_m.v")
    out = long.groupBy("Condition", "Marker").agg(
        F.sum("n_cells").alias("N_cells"),
        F.count(F.lit(1)).alias("N_FOVs"),
        F.avg("v").alias("mean_of_fov_medians"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd_of_fov_medians"),
    )
    mean, sd = F.col("mean_of_fov_medians"), F.col("sd_of_fov_medians")
    out = out.withColumns({
        "cv_percent": F.when(mean > 0, sd / mean * 100).otherwise(0.0),
        "sem": sd / F.sqrt(F.col("N_FOVs").cast("double")),
    })
    if rounded:
        digits = {"mean_of_fov_medians": 2, "sd_of_fov_medians": 2, "cv_percent": 1, "sem": 2}
        out = out.withColumns({c: F.bround(c, d) for c, d in digits.items()})
    return out


def condition_summary(results: DataFrame, batch: bool = False) -> DataFrame:
    """Per-condition cell count, area and CTCF figures; ``batch`` adds Std_Area and its own names."""
    marks = marker_names(results)
    mid = medians(to_long(results, ["Condition"], [f"{m}_CTCF" for m in marks]), ["Condition", "metric"], "value")
    n, mean, std, median = (
        ("N_Cells", "{}_Mean_CTCF", "{}_Std_CTCF", "{}_Median_CTCF") if batch
        else ("n_cells", "{}_mean", "{}_std", "{}_median")
    )
    aggs = [F.count(F.lit(1)).alias(n), F.avg("Area").alias("Mean_Area" if batch else "mean_area")]
    if batch:
        aggs.append(F.stddev_samp("Area").alias("Std_Area"))
    for m in marks:
        aggs += [F.avg(f"{m}_CTCF").alias(mean.format(m)), F.stddev_samp(f"{m}_CTCF").alias(std.format(m))]
    wide = to_wide(mid, ["Condition"], {median.format(m): (f"{m}_CTCF", "median") for m in marks})
    return results.groupBy("Condition").agg(*aggs).join(wide, "Condition")


def counters(results: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return results.agg(
        F.count(F.lit(1)).alias("total_cells"),
        distinct("Condition").alias("n_conditions"),
        distinct("ImageSet").alias("n_image_sets"),
    )


def remove_iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Keeps rows inside the quartile fences of each column in turn, over the whole table.

    Later fences see only the rows kept so far; each is one small job returning two numbers.
    """
    for c in columns:
        q = quantiles(df, [], c, {"q1": 0.25, "q3": 0.75}).first()
        if q is None or q["q1"] is None:
            return df
        margin = factor * (q["q3"] - q["q1"])
        df = df.where(F.col(c).between(q["q1"] - margin, q["q3"] + margin))
    return df


def chart_iqr_filter(df: DataFrame, value: str, group: str = "Condition") -> DataFrame:
    """Quartile fences per condition with quartile = sorted[floor(n q)]; under 4 values all stay."""
    n = F.col("_n")
    q = pick(positions(df, [group], value), [group], value,
             {"_q1": F.floor(n * 0.25), "_q3": F.floor(n * 0.75)})
    margin = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = F.col(value).between(F.col("_q1") - margin, F.col("_q3") + margin)
    return attach(df, q, group).where((n < 4) | inside).select(*df.columns)


def add_ratio(df: DataFrame, red: str = "Red_CTCF", green: str = "GFP_CTCF", out: str = "ratio") -> DataFrame:
    """Red over green; NULL where green is not positive."""
    return df.withColumn(out, F.when(F.col(green) > 0, F.col(red) / F.col(green)))


def clean_ratio(
    df: DataFrame, red: str = "Red_CTCF", green: str = "GFP_CTCF", area: str | None = "Area", min_area: float = 50
) -> DataFrame:
    """Drops small cells and cells without positive signal in both markers, then adds a finite ratio."""
    if area is not None:
        df = df.where(F.col(area) >= min_area)
    df = add_ratio(df.where((F.col(red) > 0) & (F.col(green) > 0)), red, green)
    return df.where(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.abs("ratio") < F.lit(float("inf"))))


def ratio_summary(df: DataFrame, red: str = "Red_CTCF", green: str = "GFP_CTCF") -> DataFrame:
    mid = medians(to_long(df, ["Condition"], [red, green, "ratio"]), ["Condition", "metric"], "value")
    wide = to_wide(mid, ["Condition"], {
        "Red_median": (red, "median"), "Green_median": (green, "median"), "Ratio_median": ("ratio", "median"),
    })
    return df.groupBy("Condition").agg(
        F.count(F.lit(1)).alias("N_cells"),
        F.avg(red).alias("Red_mean"), F.avg(green).alias("Green_mean"),
        F.avg("ratio").alias("Ratio_mean"), F.stddev_samp("ratio").alias("Ratio_std"),
    ).join(wide, "Condition")


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log10(x + 1) of positive values; zero and negative rows are left out."""
    for c in columns:
        df = df.where(F.col(c) > 0).withColumn(c, F.log10(F.greatest(F.lit(0.0), F.col(c)) + 1))
    return df


def box_plot(df: DataFrame, value: str, group: str = "Condition") -> DataFrame:
    """Quartiles, mean and whiskers (furthest values within 1.5 IQR of the box) per group."""
    q = quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("_n")
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    return attach(df, q, group).groupBy(group).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("lower_whisker"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("upper_whisker"),
        F.avg(v).alias("mean"), F.count(v).alias("n"),
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Counts and density over equal bins of each group's own range; the last bin is closed."""
    keys = list(keys)
    named = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    by = keys or ["_all"]
    span = named.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n")
    ).withColumns({
        "_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
    })
    # a few numbers per group, and groups here are conditions: at most one row per bin of the result
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    out = attach(named, span, by).groupBy(*by, "_lo", "_hi", "_n", bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return out.select(
        *keys, F.col("bin").cast("int").alias("bin"), (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        "count", (F.col("count") / (F.col("_n") * width)).alias("density"),
    )


def value_range(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Colour-scale limits: min and max, with max one higher if they coincide."""
    lo, hi = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(
        lo.cast("double").alias("vmin"),
        F.when(lo == hi, hi + 1).otherwise(hi).cast("double").alias("vmax"),
    )


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of numeric columns whose name lacks ``ID``, in long form.

    All pairs come from one pass over the table.
    """
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    cols = [c for c, t in df.dtypes if t in numeric and "ID" not in c]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
                   for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for p, q in ([(a, b)] if a == b else [(a, b), (b, a)]):
            rows.append(F.struct(F.lit(p).alias("row"), F.lit(q).alias("col"), F.col(str(i)).alias("r")))
    return one.select(F.explode(F.array(*rows)).alias("_c")).select("_c.row", "_c.col", "_c.r")
