"""Exact quantiles of real values in groups of any size, by radix selection.

A double has an order-preserving 64-bit code. Four passes over 16 bits each narrow the place of a
wanted rank down: a pass counts the values of each of the 65,536 cells below the cell that the pass
before has chosen, and chooses the next. Counts are mergeable and combined before the shuffle, no
task meets more than the 65,536 cells of a group, and nothing is sorted but cells. A cell with one
distinct value needs no further pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach
from rasterlab.session import cut_lineage

_MANTISSA = 52
# Up to this many wanted ranks are copied to every salt; more of them are joined plainly.
_SALTED_RANKS = 4096


def ordered_code(value: Column) -> Column:
    """A long for each double, in the same order: sign, exponent and mantissa as one number.

    Zero is 0 whatever its sign, NaN the largest of all, null null.
    """
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("int")

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e)  # exact for whole exponents

    # the logarithm may round across a power of two
    low, high = size < power(guess), size / power(guess) >= 2
    exponent = guess - low.cast("int") + high.cast("int")
    normal = (exponent + 1023).cast("long") * (1 << _MANTISSA) + ((size / power(exponent) - 1) * float(1 << _MANTISSA)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    infinite = 2047 << _MANTISSA
    bits = (
        F.when(F.isnan(value), F.lit(infinite + 1))
        .when(size == float("inf"), F.lit(infinite))
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def quantiles_by_radix(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name, plus ``_n``; the bits of the built-in ``percentile``.

    ``weight`` names a column that says how often a row counts. Null values don't count; a group
    without values has no row. Null keys form a group like any other.
    """
    keys, names = list(keys), list(probs)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    number = F.col(value).cast("double") + 0.0
    rows = df.select(group.alias("_g"), number.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    counts = rows.where("_v is not null and _w > 0").groupBy("_g", "_v").agg(F.sum("_w").alias("_w"))
    # read by every pass
    counts = cut_lineage(counts.withColumn("_code", ordered_code(F.col("_v"))))

    def at(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    ranks = [F.struct(F.lit(2 * i + j).alias("want"), end(at(probs[c])).cast("long").alias("_rank"))
             for i, c in enumerate(names) for j, end in enumerate((F.floor, F.ceil))]
    wanted = cut_lineage(counts.groupBy("_g").agg(F.sum("_w").alias("_n")).select("_g", "_n", F.explode(F.array(*ranks)).alias("r")).select("_g", "_n", "r.*"))
    below, found = ["_g"], []
    n_wanted = None
    for shift in (48, 32, 16, 0):
        part = counts
        if found:
            # of few groups each may hold many values; many groups hold few, and AQE splits one that does not
            join = attach if n_wanted <= _SALTED_RANKS else DataFrame.join
            below = ["_g", "_up"]
            part = join(counts.withColumn("_up", F.shiftright("_code", shift + 16)), wanted.select(*below).distinct(), below)
        cells = part.groupBy(*below, F.shiftright("_code", shift).alias("_cell")).agg(
            F.sum("_w").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        earlier = Window.partitionBy(*below).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        holds = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
        hit = cut_lineage(wanted.join(placed, below).where(holds).select(
            "_g", "_n", "want", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_cell").alias("_up"), "_low", "_high"))
        found.append(hit.where("_low = _high"))
        wanted = hit.where("_low <> _high").drop("_low", "_high")
        n_wanted = wanted.count()
        if n_wanted == 0:
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    wide = every.groupBy("_g").agg(
        F.first("_n").alias("_n"), *[F.max(F.when(F.col("want") == k, F.col("_low"))).alias(f"_q{k}") for k in range(2 * len(names))])
    out = []
    for i, c in enumerate(names):
        place, low, high = at(probs[c]), F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when(low == high, low).otherwise(between).alias(c))
    return wide.select(*[F.col(f"_g.{k}").alias(k) for k in keys], "_n", *out)
