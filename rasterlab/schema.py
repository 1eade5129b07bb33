"""Column names shared by all operators.

pixels        condition, image_set, [frame], [marker], y, x, label, [nuclear_label], value
cell_marker   keys, label, [marker], area, int_den, mean, std, min, max, background, ctcf, mcf, ctcf_sigma
cells_morph   keys, label, area, y_centroid, x_centroid, perimeter, solidity, eccentricity,
              circularity, aspect_ratio, is_border
results       Condition, ImageSet, CellID, Area, <marker>_<metric>..., is_outlier_<metric>...
tracks        condition, frame, track_id, label, cy, cx, mean_intensity, parent_id
"""

from __future__ import annotations

IMAGE = ("condition", "image_set")
CELL = (*IMAGE, "label")

# Result-table metrics in their published spelling: long column -> wide suffix.
METRIC_SUFFIX = {
    "ctcf": "CTCF",
    "int_den": "IntegratedDensity",
    "mean": "MeanIntensity",
    "background": "Background",
    "mcf": "MCF",
    "ctcf_sigma": "CTCF_sigma",
    "min": "MinIntensity",
    "max": "MaxIntensity",
    "std": "StdIntensity",
}
