"""Exact ranks and quantiles of groups of any size.

``percentile`` and ordered windows put one group into one task.  Quantiles are selected by radix
instead (``functions/select.py``).  For ranks, a group whose distinct values make up a large share
of the table is first cut into slices of nearly equal size, so the sort behind a rank never meets
more than a slice:

1. rows collapse to distinct values with their counts (map-side combined), written once;
2. if every group fits a task, a plain window per group finishes the work; otherwise the few dominant groups get 1,023 cut points from a mergeable sketch;
3. slice totals, at most 1,024 per group, become slice start positions;
4. a window per (group, slice) adds the position inside the slice.

The cut points only balance the work, so their error never reaches the result.

A plan whose whole input is a few megabytes by Catalyst's statistics takes the built-in
aggregate or a plain window instead; both ways give the same bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.functions.select import quantiles_by_radix
from rasterlab.session import cut_lineage

_STEPS = [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]
# one text literal: cheaper to analyse than an array of 1,023 literal nodes
_CUTS = "cast(split('" + " ".join(str(i / 1024) for i in range(1, 1024)) + "', ' ') as array<double>)"
# A group is sliced when it holds more than 1/4096 of all distinct values, which
# bounds the broadcast cut table to 4,096 rows of 1,023 numbers (32 MB).
_MAX_HOT_GROUPS = 4096
HOT_VALUES = 1 << 20
_SMALL_INPUT = 64 << 20
_SPLIT = float((1 << 27) + 1)


def _slice_of(value: Column, cuts: Column) -> Column:
    """Number of cut points at or below ``value``, by binary search in the sorted array."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _STEPS]),
        F.lit(0),
        lambda found, step: F.when(F.element_at(cuts, found + step) <= value, found + step).otherwise(found),
    )


def fits_one_task(df: DataFrame, limit: int = _SMALL_INPUT) -> bool:
    """Whether everything a plan reads is small enough for one task.

    Uses the leaf sizes Catalyst already knows (file sizes); nothing runs.
    """
    if not hasattr(df, "_jdf"):  # a remote session shows no statistics
        return False
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total <= limit


def _placed_in_groups(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Positions when every group fits a task."""
    up = Window.partitionBy(*keys).orderBy(value)
    return counts.select(
        *keys, value, "_w",
        (F.sum("_w").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")).alias("_before"),
        (F.row_number().over(up) - 1).cast("bigint").alias("_rank0"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias("_n"),
    )


def positions(
    df: DataFrame, keys: Sequence[str], value: str, hot_values: int = HOT_VALUES, small: bool | None = None
) -> DataFrame:
    """Distinct ``(keys, value)`` rows with their place in the order of ``value``.

    Adds ``_w`` (rows holding the value), ``_before`` (rows below it), ``_rank0``
    (distinct values below it) and ``_n`` (rows in the group).
    """
    keys = list(keys)
    if not keys:
        out = positions(df.select(F.lit(0).alias("_all"), value), ["_all"], value, hot_values, small)
        return out.drop("_all")

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    if fits_one_task(df) if small is None else small:
        return _placed_in_groups(counts, keys, value)

    counts = cut_lineage(counts)  # read several times below
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    widest, total = sizes.agg(F.max("_d"), F.sum("_d")).first()
    if (widest or 0) <= max(hot_values, total / _MAX_HOT_GROUPS):
        return _placed_in_groups(counts, keys, value)

    hot = sizes.where(F.col("_d") > max(hot_values, total / _MAX_HOT_GROUPS)).select(*keys)
    cuts = cut_lineage(
        counts.join(F.broadcast(hot), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.expr(f"percentile_approx(`{value}`, {_CUTS}, 10000)").alias("_cuts"))
    )
    sliced = counts.join(F.broadcast(cuts), keys, "left").withColumn(
        "_slice",
        F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_slice_of(F.col(value), F.col("_cuts"))),
    ).drop("_cuts")

    by_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_w").alias("_sw"), F.count(F.lit(1)).alias("_sd"))
        .select(
            *keys, "_slice",
            F.coalesce(F.sum("_sw").over(by_slice), F.lit(0)).alias("_w0"),
            F.coalesce(F.sum("_sd").over(by_slice), F.lit(0)).alias("_d0"),
            F.sum("_sw").over(whole).alias("_n"),
        )
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(starts, [*keys, "_slice"]).select(
        *keys, value, "_w",
        (F.col("_w0") + F.coalesce(F.sum("_w").over(below), F.lit(0))).alias("_before"),
        (F.col("_d0") + F.row_number().over(inside) - 1).alias("_rank0"),
        "_n",
    )


def sliced(
    counts: DataFrame, keys: Sequence[str], value: str, hot_values: int = HOT_VALUES, small: bool | None = None
) -> DataFrame:
    """Adds ``_slice``: values of later slices are higher, and equal values share one.

    For a table that is cheap to read again, with few groups. Groups of at most ``hot_values`` rows
    stay whole, larger ones get up to 1,024 slices of nearly equal size.
    """
    keys = list(keys)
    whole = counts.withColumn("_slice", F.lit(0))
    if fits_one_task(counts) if small is None else small:
        return whole
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    widest, total = sizes.agg(F.max("_d"), F.sum("_d")).first()
    most = max(hot_values, (total or 0) / _MAX_HOT_GROUPS)
    if (widest or 0) <= most:
        return whole
    cuts = cut_lineage(
        counts.join(F.broadcast(sizes.where(F.col("_d") > most).select(*keys)), keys, "left_semi")
        .groupBy(*keys).agg(F.expr(f"percentile_approx(`{value}`, {_CUTS}, 10000)").alias("_cuts")))
    found = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_slice_of(F.col(value), F.col("_cuts")))
    return counts.join(F.broadcast(cuts), keys, "left").withColumn("_slice", found).drop("_cuts")


def pick(placed: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, Column]) -> DataFrame:
    """The value at each zero-based place (an expression over ``_n``) of every group."""
    holds = {
        name: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_w"))
        for name, place in places.items()
    }
    wanted = F.lit(False)
    for cond in holds.values():
        wanted = wanted | cond
    return placed.where(wanted).groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *[F.max(F.when(cond, F.col(value))).alias(name) for name, cond in holds.items()],
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], small: bool | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name, plus ``_n``.

    Radix selection, or the built-in aggregate where everything the plan reads fits a task; both
    give the same bits.
    """
    if not (fits_one_task(df) if small is None else small):
        return quantiles_by_radix(df, keys, value, probs)
    v = F.col(value).cast("double")
    both = df.groupBy(*keys).agg(
        F.count(v).alias("_n"), F.percentile(v, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q")
    ).where("_n > 0")
    return both.select(*keys, "_n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def quantiles_of_counts(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of camera counts (below 2^26), one column per name, without a rounding in between.

    ``low * (1 - share) + high * share`` with the first product exact, as SQL engines with fused
    multiplication give it. The built-in aggregate rounds it and may differ in the last bit; where a
    level falls on a whole number, a rounding down shows it. A window holds the distinct counts of a group.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    at = {name: (F.col("_n") - 1).cast("double") * F.lit(float(p)) for name, p in probs.items()}
    places = {f"_{end}{i}": round_(p) for i, p in enumerate(at.values()) for end, round_ in (("a", F.floor), ("b", F.ceil))}
    picked = pick(_placed_in_groups(counts, keys, value), keys, value, places)
    low, high = ([F.col(f"_{end}{i}").cast("double") for i in range(len(at))] for end in "ab")
    out = []
    for i, (name, p) in enumerate(at.items()):
        share = p - F.floor(p)
        rest = 1.0 - share
        # two halves of the weight, so that each product with a count is exact
        front = rest * _SPLIT - (rest * _SPLIT - rest)
        a, b, c = low[i] * front, low[i] * (rest - front), high[i] * share
        total = a + c
        lost = (a - (total - (total - a))) + (c - (total - a))
        out.append((total + (lost + b)).alias(name))
    return picked.select(*keys, *out)


def whole_numbers(df: DataFrame, value: str) -> bool:
    """Whether a column's type holds whole numbers only, as camera counts are."""
    return df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")


def levels(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None, small: bool | None = None
) -> DataFrame:
    """Quantiles of pixel values, one column per name; groups without values have no row.

    Whole numbers are camera counts: the built-in aggregate keeps at most 65,536 counters of a
    group. Real values (corrected pixels, fitted surfaces) are as many as pixels and are selected.
    """
    if not whole_numbers(df, value) and not (fits_one_task(df) if small is None else small):
        return quantiles_by_radix(df, keys, value, probs, weight).drop("_n")
    times = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(*[F.lit(float(p)) for p in probs.values()]), times)
    return df.where(v.isNotNull() & (times > 0)).groupBy(*keys).agg(q.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def medians(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", small: bool | None = None
) -> DataFrame:
    """Exact median per group."""
    return quantiles(df, keys, value, {name: 0.5}, small=small).drop("_n")


def to_long(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric") -> DataFrame:
    """One row per (row, value column): lets one ordering pass serve many columns."""
    return df.select(
        *keys,
        F.explode(
            F.array(*[
                F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias("value")) for v in values
            ])
        ).alias("_m"),
    ).select(*keys, f"_m.{name}", "_m.value")


def to_wide(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, str]], name: str = "metric"
) -> DataFrame:
    """Back from long: ``columns`` maps an output name to (metric, stat column)."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(name) == metric, F.col(stat))).alias(out)
        for out, (metric, stat) in columns.items()
    ])
