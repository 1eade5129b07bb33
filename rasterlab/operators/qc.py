"""Quality gates on cell shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach_labels
from rasterlab.functions.order import quantiles
from rasterlab.schema import IMAGE

GATES = ("border", "area_small", "area_large", "solidity", "eccentricity", "circularity", "aspect_ratio")

# Thresholds that older callers always sent; read as "not set" on request.
OLD_DEFAULTS = {"min_solidity": 0.80, "max_eccentricity": 0.90, "min_circularity": 0.40, "max_aspect_ratio": 3.0}


def gates(
    morph: DataFrame, thresholds: Mapping[str, float | None] | None = None,
    remove_border: bool = True, legacy_defaults: bool = False,
) -> DataFrame:
    """Adds a boolean ``rejects_{gate}`` per gate and ``rejected``; an unset threshold rejects nothing."""
    given = dict(thresholds or {})
    if legacy_defaults:
        given = {k: None if OLD_DEFAULTS.get(k) == v else v for k, v in given.items()}

    def gate(name: str, col: str, below: bool):
        limit = given.get(name)
        if limit is None:
            return F.lit(False)
        return F.col(col) < limit if below else F.col(col) > limit

    rules = {
        "border": F.col("is_border") if remove_border else F.lit(False),
        "area_small": gate("min_area", "area", True),
        "area_large": gate("max_area", "area", False),
        "solidity": gate("min_solidity", "solidity", True),
        "eccentricity": gate("max_eccentricity", "eccentricity", False),
        "circularity": gate("min_circularity", "circularity", True),
        "aspect_ratio": gate("max_aspect_ratio", "aspect_ratio", False),
    }
    return morph.withColumns({f"rejects_{g}": c for g, c in rules.items()}).withColumn(
        "rejected", reduce(or_, [F.col(f"rejects_{g}") for g in GATES]))


def _counts():
    return [F.count_if(F.col(f"rejects_{g}")).alias(g) for g in GATES] + [
        F.count_if("rejected").alias("total_rejected"), F.count_if(~F.col("rejected")).alias("total_kept"),
    ]


def rejection_counts(gated: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Rejections per gate (a cell may count in several), rejected and kept cells per image."""
    return gated.groupBy(*keys).agg(*_counts())


def qc_totals(gated: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """As :func:`rejection_counts`, with subtotals per condition and a grand total (NULL keys)."""
    return gated.rollup(*keys).agg(*_counts())


def apply_gates(px: DataFrame, gated: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The mask with rejected labels set to 0."""
    out = gated.where("rejected").select(*keys, "label", F.lit(True).alias("_out"))
    return attach_labels(px, out, keys).withColumn(
        "label", F.when(F.col("_out"), 0).otherwise(F.col("label")).cast(px.schema["label"].dataType)
    ).select(*px.columns)


def kept_cells(cells: DataFrame, gated: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Cell rows without the rejected labels."""
    return cells.join(gated.where("rejected").select(*keys, "label"), [*keys, "label"], "left_anti")


def area_fences(morph: DataFrame, keys: Sequence[str] = IMAGE, factor: float = 1.5) -> DataFrame:
    """Area limits per image from its quartiles, the lower one at least 1."""
    q = quantiles(morph, keys, "area", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *keys, F.greatest(F.col("q1") - factor * iqr, F.lit(1.0)).alias("min_area"),
        (F.col("q3") + factor * iqr).alias("max_area"),
    )
