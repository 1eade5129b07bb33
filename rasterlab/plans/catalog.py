"""Imports every query module so that the registry is complete."""

from rasterlab.plans import (  # noqa: F401
    queries_background,
    queries_cells,
    queries_export,
    queries_files,
    queries_masks,
    queries_pixels,
    queries_shape,
    queries_stats,
    queries_summary,
    queries_tables,
    queries_tracking,
    queries_windows,
)
from rasterlab.plans.registry import ORACLES, QUERIES  # noqa: F401
