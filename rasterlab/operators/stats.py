"""Rank tests, correlation tests and density estimates between conditions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.functions import special
from rasterlab.functions.order import HOT_VALUES, fits_one_task, pick, positions, sliced, to_long
from rasterlab.session import cut_lineage

# exp(-z^2 / 2) is exactly 0 in double precision beyond this many bandwidths
_REACH = 38.7
_DENSITY_ROWS = 1 << 18  # rows that a task holds for one pass over the cells


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def rank_sums(
    df: DataFrame, metrics: Sequence[str], group: str = "Condition", with_medians: bool = False,
    hot_values: int = HOT_VALUES, small: bool | None = None,
) -> DataFrame:
    """Per metric and group: ``n``, mid-rank sum ``r``, and over all groups ``total`` and ``ties`` = sum(t^3 - t).

    Ranks run over the whole table.  The table is read once, for counts of (metric, value, group);
    a task ranks one slice of a metric's values, and per slice and group a few sums are left, to
    which the rows below the slice are added.  ``with_medians`` adds each group's ``median``, looked
    up among the counts of the slice that holds it.
    """
    long = to_long(df, [group], metrics).where("value is not null")
    counts = long.groupBy("metric", "value", group).agg(F.count(F.lit(1)).alias("_c"))
    small = fits_one_task(df) if small is None else small
    if not small:
        counts = cut_lineage(counts)
    part = Window.partitionBy("metric", "_slice")
    upto, t = F.col("_upto"), F.col("_t").cast("double")
    ranked = sliced(counts, ["metric"], "value", hot_values, small).withColumns({
        "_upto": F.sum("_c").over(part.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "_t": F.sum("_c").over(Window.partitionBy("metric", "_slice", "value")),
    })
    parts = ranked.groupBy("metric", "_slice", group).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_c") * (upto - F.col("_t") + (F.col("_t") + 1) / 2)).alias("_r"),
        F.sum(F.col("_c") * (t * t - 1)).alias("_ties"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    if not small:
        parts = cut_lineage(parts)  # at most 1,024 rows of a metric and group
    earlier = Window.partitionBy("metric").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("metric", "_slice").agg(F.sum("_n").alias("_rows")).select(
        "metric", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    sums = parts.join(starts, ["metric", "_slice"]).groupBy("metric", group).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_r") + F.col("_start") * F.col("_n")).alias("r"))
    over_all = parts.groupBy("metric").agg(F.sum("_n").alias("total"), F.sum("_ties").alias("ties"))
    out = sums.join(over_all, "metric")
    return out.join(_medians_of_counts(counts, parts, group), ["metric", group]) if with_medians else out


def _medians_of_counts(counts: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """Median of each metric and group, with the bits of ``percentile``; ``parts`` says which values lie around it."""
    by = Window.partitionBy("metric", group)
    place = (F.col("_all") - 1) * F.lit(0.5)
    ends = {"_a": F.floor(place), "_b": F.ceil(place)}
    placed = parts.withColumns({
        "_all": F.sum("_n").over(by),
        "_g0": F.coalesce(F.sum("_n").over(by.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    holds = {k: (F.col("_g0") <= at) & (at < F.col("_g0") + F.col("_n")) for k, at in ends.items()}
    around = placed.where(holds["_a"] | holds["_b"]).groupBy("metric", group).agg(
        F.min("_low").alias("_from"), F.max("_high").alias("_to"), F.min("_g0").alias("_g0"), F.max("_all").alias("_all"))
    near = counts.join(around, ["metric", group]).where(F.col("value").between(F.col("_from"), F.col("_to")))
    last = F.col("_g0") + F.sum("_c").over(by.orderBy("value"))
    placed = near.withColumn("_last", last)
    low, high = (F.max(F.when((F.col("_last") - F.col("_c") <= at) & (at < F.col("_last")), F.col("value"))).alias(k)
                 for k, at in ends.items())
    found = placed.groupBy("metric", group, "_all").agg(low, high)
    between = (F.ceil(place) - place) * F.col("_a") + (place - F.floor(place)) * F.col("_b")
    return found.select("metric", group, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("median"))


def mann_whitney(
    df: DataFrame, metrics: Sequence[str], group: str = "Condition", pair: tuple[str, str] | None = None
) -> DataFrame:
    """Two-sided U test between two conditions: ``pair``, or the first and second in name order.

    Only their rows are ranked; further conditions do not count. The normal approximation is corrected for continuity and ties; samples whose smaller
    side has at most 8 values and no ties get the exact probability.
    """
    if pair is None:
        first_two = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(2)
        df = df.join(F.broadcast(first_two), group, "left_semi")
    else:
        df = df.where(F.col(group).isin(*pair))
    s = rank_sums(df, metrics, group, with_medians=True)
    lo, hi = F.min(F.struct(group, "n", "r", "median")), F.max(F.struct(group, "n", "r", "median"))
    both = s.groupBy("metric").agg(lo.alias("a"), hi.alias("b"), F.first("total").alias("total"),
                                   F.first("ties").alias("ties"))
    n1, n2, n = F.col("a.n").cast("double"), F.col("b.n").cast("double"), F.col("total").cast("double")
    both = both.withColumns({
        "U": F.col("a.r") - n1 * (n1 + 1) / 2,
        "_sd": F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))),
    })
    z = (F.greatest("U", n1 * n2 - F.col("U")) - n1 * n2 / 2 - 0.5) / F.col("_sd")
    both = both.withColumns({
        "_approx": special.normal_two_sided(z),
        "_exact": special.mann_whitney_small("U", n1, n2),
    })
    p = F.when((F.col("ties") == 0) & F.col("_exact").isNotNull(), F.col("_exact")).otherwise(F.col("_approx"))
    return both.withColumn("p_value", p).select(
        "metric", F.col(f"a.{group}").alias("group_a"), F.col(f"b.{group}").alias("group_b"),
        F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), "U", "p_value",
        stars(F.col("p_value")).alias("stars"),
        F.when(F.col("a.median") > F.col("b.median"), "higher").otherwise("lower").alias("direction"),
    )


def kruskal_wallis(df: DataFrame, metrics: Sequence[str], group: str = "Condition") -> DataFrame:
    """Tie-corrected H over all conditions and its chi-square tail."""
    n, total = F.col("n").cast("double"), F.first("total").cast("double")
    h = (12 / (total * (total + 1)) * F.sum(F.col("r") * F.col("r") / n) - 3 * (total + 1)) / (
        1 - F.first("ties") / (total * total * total - total))
    out = rank_sums(df, metrics, group).groupBy("metric").agg(
        h.alias("H"), (F.count(F.lit(1)) - 1).alias("df"), F.first("total").alias("n"))
    return out.withColumn("p_value", special.chi2_tail("H", F.col("df").cast("double")))


def pearson(df: DataFrame, a: str, b: str, log10: bool = False) -> DataFrame:
    """Correlation of two columns (optionally of their logarithms), its t-test and reading."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    if log10:
        df = df.where((x > 0) & (y > 0))
        x, y = F.log10(x), F.log10(y)
    out = df.agg(F.corr(x, y).alias("r"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"))
    r, dof = F.col("r"), F.col("n").cast("double") - 2
    t = r * F.sqrt(dof / ((1 - r) * (1 + r)))
    # Cut-offs of the published reading.
    reading = F.when(r > 0.7, "strong positive").when(r < -0.3, "negative").otherwise("weak")
    return out.withColumns({"p_value": special.t_two_sided(t, dof), "reading": reading})


def _grid_density(df: DataFrame, group: str, value: str, shape: DataFrame, points: int) -> DataFrame:
    """Kernel sums on each group's grid; ``shape`` holds (group, n, h, x0, step).

    Values collapse to counts first.  Each then touches only the grid points its kernel can
    reach, and the sums are taken map-side: what travels is at most one row per grid point
    and task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    # each value becomes up to `points` rows, so small partitions are kept apart
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.repartition(n_parts, group, "_v")
    first = F.greatest(F.ceil((F.col("_v") - _REACH * F.col("h") - F.col("x0")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((F.col("_v") + _REACH * F.col("h") - F.col("x0")) / F.col("step")), F.lit(points - 1))
    x = F.col("x0") + F.col("i") * F.col("step")
    z = (x - F.col("_v")) / F.col("h")
    sums = (
        attach(counts, shape, group)
        .withColumn("i", F.explode(F.sequence(first, F.greatest(first, last))))
        .where((F.col("i") <= points - 1))
        .groupBy(group, "i").agg(F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias("_s"))
    )
    grid = shape.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))
    density = F.coalesce(F.col("_s"), F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return grid.join(sums, [group, "i"], "left").select(
        group, F.col("i").cast("int").alias("i"), x.alias("x"), density.alias("density"))


def kde_silverman(df: DataFrame, value: str, group: str = "Condition", points: int = 200) -> DataFrame:
    """Density curve with bandwidth 1.06 min(sd, IQR/1.34) n^-0.2, padded by three bandwidths."""
    n = F.col("_n")
    q = pick(positions(df, [group], value), [group], value,
             {"_q1": F.floor(n * 0.25), "_q3": F.floor(n * 0.75)})
    v = F.col(value).cast("double")
    ends = df.groupBy(group).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.stddev_samp(v).alias("_sd"))
    iqr = F.col("_q3") - F.col("_q1")
    spread = F.least(F.col("_sd"), F.when(iqr != 0, iqr).otherwise(F.col("_sd")) / 1.34)
    shape = (
        q.join(ends, group).where("_n >= 2").withColumn("h", 1.06 * spread * F.pow(n.cast("double"), F.lit(-0.2)))
        .where("h > 0")
        .select(group, n.alias("n"), "h", (F.col("_lo") - 3 * F.col("h")).alias("x0"),
                ((F.col("_hi") - F.col("_lo") + 6 * F.col("h")) / (points - 1)).alias("step"))
    )
    return _grid_density(df, group, value, shape, points)


def kde_scott(df: DataFrame, value: str, group: str = "Condition", points: int = 200) -> DataFrame:
    """Density curve with bandwidth sd n^-1/5 over the value range, for groups of more than 10 rows."""
    v = F.col(value).cast("double")
    shape = df.groupBy(group).agg(
        F.count(v).alias("n"), F.min(v).alias("x0"), F.max(v).alias("_hi"), F.stddev_samp(v).alias("_sd")
    ).where("n > 10 and _sd > 0").select(
        group, "n", (F.col("_sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"), "x0",
        ((F.col("_hi") - F.col("x0")) / (points - 1)).alias("step"))
    return _grid_density(df, group, value, shape, points)


def kde_2d(df: DataFrame, a: str, b: str, group: str = "Condition", points: int = 150) -> DataFrame:
    """Joint density of two columns on one grid for all groups, range padded by 10 %.

    The kernel has the group's covariance times n^-1/3.  Grid and kernels are a handful of
    numbers per condition, carried next to the rows; each task adds its distinct rows into one
    grid per condition, cell by cell as products of matrices, and Spark sums the grids.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = df.where(x.isNotNull() & y.isNotNull()).select(F.col(group), x.alias("_x"), y.alias("_y"))
    box = rows.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if box[0] is None:
        return rows.select(group, F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("_x").alias("x"),
                           F.col("_y").alias("y"), F.lit(0.0).alias("density")).limit(0)
    x0, x1, y0, y1 = box
    px, py = 0.1 * (x1 - x0), 0.1 * (y1 - y0)
    gx = np.linspace(x0 - px, x1 + px, points)
    gy = np.linspace(y0 - py, y1 + py, points)
    n = F.col("n").cast("double")
    shrink = F.pow(n, F.lit(-1 / 3))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    kernel = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("_x").alias("_xx"), F.var_samp("_y").alias("_yy"),
        F.covar_samp("_x", "_y").alias("_xy"),
    ).where((F.col("n") > 10) & (det > 0)).select(
        group, (F.col("_yy") / det / shrink).alias("ia"), (-F.col("_xy") / det / shrink).alias("ib"),
        (F.col("_xx") / det / shrink).alias("ic"),
        (1.0 / (2 * math.pi * F.sqrt(det) * shrink * n)).alias("scale"),
    )

    def of_cells(k, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Kernel sums of one condition's rows on the grid.

        With u, v from a cell's centre to a grid point and a, b to a row, the exponent is that of
        the centre, one term in (u, a, b), one in (v, a, b) and one in (a, b). So a row takes two
        vectors and a cell one product of matrices, not an exponential per row and grid point.
        Cells are so small that no exponent passes 600 (doubles end at 709).
        """
        total = np.zeros((points, points))
        wide, high = gx[-1] - gx[0], gy[-1] - gy[0]
        half_x = 150 / max(wide * k.ia, high * abs(k.ib), 1e-300)
        half_y = 150 / max(wide * abs(k.ib), high * k.ic, 1e-300)
        cell = np.stack([np.floor((x - gx[0]) / (2 * half_x)), np.floor((y - gy[0]) / (2 * half_y))])
        order = np.lexsort(cell)
        x, y, times, cell = x[order], y[order], times[order], cell[:, order]
        starts = np.append(np.flatnonzero(np.append(True, (np.diff(cell) != 0).any(axis=0))), len(x))
        for start, end in zip(starts[:-1], starts[1:]):
            cx, cy = gx[0] + (2 * cell[0, start] + 1) * half_x, gy[0] + (2 * cell[1, start] + 1) * half_y
            a, b, u, v = x[start:end] - cx, y[start:end] - cy, gx - cx, gy - cy
            along = np.outer(u, k.ia * a + k.ib * b) - (0.5 * k.ia * a * a + k.ib * a * b + 0.5 * k.ic * b * b)
            across = np.outer(k.ib * a + k.ic * b, v)
            sums = (np.exp(along) * times[start:end]) @ np.exp(across)
            # half the centre's exponent at a time: small sums are not lost on the way
            centre = np.exp(-0.25 * (k.ia * u * u)[:, None] - 0.5 * k.ib * np.outer(u, v) - 0.25 * (k.ic * v * v)[None])
            total += centre * sums * centre
        return k.scale * total

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        held: list[pd.DataFrame] = []

        def settle() -> None:
            if not held:
                return
            for name, g in pd.concat(held, ignore_index=True).groupby(group, sort=False):
                more = of_cells(g.iloc[0], g._x.to_numpy(), g._y.to_numpy(), g._times.to_numpy(dtype=float))
                sums[name] = sums.get(name, 0.0) + more
            held.clear()

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= _DENSITY_ROWS:  # many rows share a cell's product
                settle()
        settle()
        i, j = np.divmod(np.arange(points * points), points)
        for name, total in sums.items():
            yield pd.DataFrame({group: name, "i": i, "j": j, "s": total.ravel()})

    # the work per row is even, so rows spread by value rather than by condition; equal rows are one
    spark = df.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = rows.groupBy(group, "_x", "_y").agg(F.count(F.lit(1)).alias("_times"))
    joined = attach(counted, kernel, group).repartition(n_parts, "_x", "_y")
    schema = f"`{group}` {dict(df.dtypes)[group]}, i int, j int, s double"
    dens = joined.mapInPandas(add_up, schema).groupBy(group, "i", "j").agg(F.sum("s").alias("density"))
    return dens.select(
        group, "i", "j",
        (F.lit(float(gx[0])) + F.col("i") * float(gx[1] - gx[0])).alias("x"),
        (F.lit(float(gy[0])) + F.col("j") * float(gy[1] - gy[0])).alias("y"), "density")


# Contour percentiles of the published density plot.
CONTOURS = (10, 25, 40, 55, 70, 85, 95)


def contour_levels(density: DataFrame, group: str = "Condition") -> DataFrame:
    """Density percentiles over the positive grid points; at most points^2 rows per group."""
    q = F.percentile("density", F.array(*[F.lit(c / 100) for c in CONTOURS]))
    return density.where("density > 0").groupBy(group).agg(q.alias("_q")).select(
        group, F.posexplode("_q").alias("_i", "level")).select(
        group, F.element_at(F.array(*[F.lit(c) for c in CONTOURS]), F.col("_i") + 1).alias("percentile"), "level")
