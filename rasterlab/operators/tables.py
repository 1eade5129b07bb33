"""Result-table projections, lookups, paging and ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach_labels
from rasterlab.functions.order import positions
from rasterlab.operators.summary import any_flag, any_outlier
from rasterlab.schema import IMAGE

# Columns of the chart projection and of the marker subset.
_CHART = ("Condition", "ImageSet", "CellID", "Area", "x_centroid", "y_centroid", "is_saturated", "is_dim")
_BASE = ("Condition", "SegmentationType", "ImageSet", "CellID", "Area")


def chart_projection(results: DataFrame) -> DataFrame:
    """The columns charts need; the scan reads no others."""
    return results.select([
        c for c in results.columns
        if c in _CHART or c.endswith(("_CTCF", "_Background")) or c.startswith("is_outlier_")
    ])


def filter_results(
    results: DataFrame, conditions: Sequence[str] = ("All",), min_area: float = 0, marker: str | None = None
) -> DataFrame:
    """Rows of the listed conditions and minimum area; columns of one marker if named."""
    if "All" not in conditions:
        results = results.where(F.col("Condition").isin(list(conditions)))
    results = results.where(F.col("Area") >= min_area)
    if marker and marker != "All":
        results = results.select([c for c in results.columns if c in _BASE or c.startswith(marker)])
    return results


def drop_outliers(results: DataFrame) -> DataFrame:
    return results.where(~any_outlier(results))


def flagged(results: DataFrame) -> DataFrame:
    return results.withColumn("flagged", any_flag(results))


def cell_records(results: DataFrame, condition: str, image_set) -> DataFrame:
    """One JSON record per cell of an image: numbers as doubles, NaN as null, no identifiers."""
    rows = results.where((F.col("Condition") == condition) & (F.col("ImageSet") == image_set))
    fields = []
    for c, t in results.dtypes:
        if c in ("Condition", "ImageSet", "SegmentationType"):
            continue
        if t in ("double", "float"):
            fields.append(F.when(~F.isnan(c), F.col(c).cast("double")).alias(c))
        elif t in ("int", "bigint", "smallint"):
            fields.append(F.col(c).cast("double").alias(c))
        else:
            fields.append(F.col(c))
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select(F.col("CellID").cast("string").alias("cell_id"), record.alias("record"))


def labels_at(px: DataFrame, points: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Adds the ``label`` under each point; 0 outside the image."""
    return points.join(px.select(*keys, "y", "x", "label"), [*keys, "y", "x"], "left").fillna(0, ["label"])


def distinct_markers(cell_marker: DataFrame) -> DataFrame:
    return cell_marker.select("marker").distinct()


def detect_columns(
    columns: DataFrame, keywords: Mapping[str, Sequence[str]], only_ctcf: Sequence[str] = ()
) -> DataFrame:
    """Column name per role: the first keyword that occurs in any column, then the first such column.

    ``columns`` holds (pos, name).  Roles in ``only_ctcf`` look at fluorescence columns only.
    """
    words = [
        F.struct(F.lit(role).alias("role"), F.lit(i).alias("kw_pos"), F.lit(word.lower()).alias("word"),
                 F.lit(role in only_ctcf).alias("ctcf"))
        for role, list_ in keywords.items() for i, word in enumerate(list_)
    ]
    name = F.lower("name")
    hits = columns.select("pos", "name", F.explode(F.array(*words)).alias("k")).select("pos", "name", "k.*").where(
        name.contains(F.col("word")) & (~F.col("ctcf") | name.contains("ctcf")))
    return hits.groupBy("role").agg(F.min_by("name", F.struct("kw_pos", "pos")).alias("name"))


def finite_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed values are all positive and finite."""
    for c in columns:
        v = F.col(c).cast("double")
        df = df.where((v > 0) & ~F.isnan(v) & (v < F.lit(float("inf"))))
    return df


def page(df: DataFrame, order: str, page_no: int, per_page: int = 1000) -> DataFrame:
    """One page of the table in the order of a unique numeric column.

    The row number comes from the sliced ordering, so a page deep inside a large table
    costs no more than the first and nothing is gathered in one task.
    """
    placed = positions(df, [], order)
    start = page_no * per_page
    wanted = placed.where((F.col("_before") >= start) & (F.col("_before") < start + per_page)).select(
        order, F.col("_before").alias("row_no"))
    return df.join(wanted, order)


def page_counts(df: DataFrame, per_page: int = 1000) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_rows"), F.ceil(n / per_page).alias("total_pages"))


def relabel_sequential(px: DataFrame, keys: Sequence[str] = IMAGE, order: str = "label") -> DataFrame:
    """Labels renumbered 1..n in label order, 0 kept."""
    ranked = positions(px.where(F.col(order) > 0), keys, order).select(
        *keys, order, (F.col("_rank0") + 1).cast("int").alias("_new"))
    return attach_labels(px, ranked, keys, order).withColumn(
        order, F.coalesce("_new", F.lit(0)).cast(px.schema[order].dataType)).select(*px.columns)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key, as a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def most_recent(df: DataFrame, keys: Sequence[str], order: str, n: int = 20) -> DataFrame:
    """The ``n`` rows with the highest ``order`` per key.

    ``order`` is unique; Spark keeps only n rows per key and task before the exchange
    (a limit under the window), so a busy key does not travel whole.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def natural_order(df: DataFrame, col: str) -> DataFrame:
    """Adds ``natural_key``: the first integer in a name, 999 if there is none."""
    return df.withColumn("natural_key", F.expr(f"coalesce(cast(nullif(regexp_extract({col}, '([0-9]+)', 1), '') as int), 999)"))


def union_results(*parts: DataFrame) -> DataFrame:
    """Stacks result tables whose columns differ; absent ones are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_overrides(images: DataFrame, overrides: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Parameters per image: the value of its condition where one is set, else the global one."""
    out = images.join(overrides, "condition", "left")
    for name, value in defaults.items():
        fallback = F.lit(value)
        out = out.withColumn(name, F.coalesce(F.col(name), fallback) if name in overrides.columns else fallback)
    return out


def match_suffix(wanted: DataFrame, files: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """File per wanted suffix: exact spelling first, then upper case, then lower case."""
    named = files.select(*keys, F.lower("suffix").alias("_k"), F.col("suffix").alias("_found"), "path")
    rank = (
        F.when(F.col("_found") == F.col("suffix"), 0)
        .when(F.col("_found") == F.upper("suffix"), 1)
        .when(F.col("_found") == F.lower("suffix"), 2)
    )
    return (
        wanted.withColumn("_k", F.lower("suffix")).join(named, [*keys, "_k"]).withColumn("_rank", rank)
        .where("_rank is not null").groupBy(*keys, "suffix").agg(F.min_by("path", "_rank").alias("path"))
    )


def zip_lists(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs two array columns, stopping at the shorter."""
    n = F.least(F.size(a), F.size(b))
    return df.withColumn("_z", F.explode(F.arrays_zip(F.slice(a, 1, n).alias(a), F.slice(b, 1, n).alias(b)))).select(
        *[c for c in df.columns if c not in (a, b)], F.col(f"_z.{a}").alias(a), F.col(f"_z.{b}").alias(b))


def missing_channels(sets: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected suffixes absent from each image set (``sets``: condition, base, suffix; ``expected``: condition, suffix)."""
    bases = sets.select("condition", "base").distinct()
    return bases.join(expected, "condition").join(sets, ["condition", "base", "suffix"], "left_anti")
