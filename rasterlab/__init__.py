"""rasterlab: labelled-raster analytics on Spark DataFrames.

Every public function takes DataFrames and returns a DataFrame, so steps chain
with ``df.transform``.  Tables are long: one row per pixel, per cell and marker,
or per detection; see :mod:`rasterlab.schema` for the column names.
"""

__version__ = "0.1.0"
