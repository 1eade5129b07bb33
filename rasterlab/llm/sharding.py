"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first: the matrix is that of a
uniformly random permutation of all rows, so shard sizes are exact and every arrangement is
equally likely. Then each partition permutes locally (it deals its rows to shards in random
order), rows are exchanged, and each shard is permuted again.

Only the matrix is on the driver: input partitions x shards integers, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.llm.common import packed, small_batches
from rasterlab.session import cut_lineage


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric draw for populations of any size.

    Inversion over twelve standard deviations around the mode; probabilities follow from ratios
    of neighbouring terms, so nothing cancels at populations beyond the limits of numpy.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    spread = np.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1)))
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    first, last = max(low, mode - int(12 * spread) - 12), min(high, mode + int(12 * spread) + 12)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each partition for each shard, as a uniform permutation would have them.

    Shard sizes differ by one at most; the first shards hold the rest.
    """
    rng = np.random.default_rng([seed, 1])
    total = sum(counts)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for i, count in enumerate(counts):
        room, need = sum(left), count
        for j in range(shards):
            drawn = hypergeometric(rng, left[j], room - left[j], need) if need else 0
            room, need = room - left[j], need - drawn
            matrix[i, j] = drawn
            left[j] -= drawn
    return matrix


def shuffle_to_shards(
    df: DataFrame, shards: int = 16, seed: int = 0, block_rows: int = 4096, block_bytes: int = 32_000_000
) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    Shard sizes are at most one apart. Rows are told apart by place, not by value: nulls, ties
    and repeated rows are rows like any other, and an empty table gives an empty one. Columns
    called ``shard`` or ``slot`` are replaced.

    The input is written once with each row's partition and place in it, so that these stay what
    they were when they were counted. A shard is dealt to blocks by a random 63-bit key and sorted
    in them; blocks have about ``block_rows`` rows, or fewer so that their strings and binaries
    have about ``block_bytes``. No task holds a whole shard. Block sizes are counted from places
    alone; whole rows are exchanged once.
    """
    spark = df.sparkSession
    small_batches(spark)
    plain = df.drop("shard", "slot")
    sized = [F.coalesce(F.octet_length(plain[f"`{f.name}`"]), F.lit(0)).cast("long") for f in plain.schema.fields
             if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = cut_lineage(plain.select(packed(plain), F.monotonically_increasing_id().alias("_at"), sum(sized, F.lit(0).cast("long")).alias("_size")))
    part = F.shiftright("_at", 33).cast("int")
    found = {r[0]: (r[1], r[2]) for r in fixed.groupBy(part).agg(F.count(F.lit(1)), F.sum("_size")).collect()}
    parts = max(found, default=-1) + 1
    matrix = communication_matrix([found.get(i, (0, 0))[0] for i in range(parts)], shards, seed)
    total, size = int(matrix.sum()), sum(x[1] for x in found.values())
    blocks = max(1, -(-total // (shards * block_rows)), -(-size // (shards * block_bytes)))
    dealt = spark.sparkContext.broadcast(matrix)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, labels, keys = -1, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            at = batch.column("_at").to_numpy()
            shard, key = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(at >> 33).tolist():
                if p != of:
                    rng = np.random.default_rng([seed, 2, p])
                    labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), dealt.value[p]))
                    of, keys = p, rng.integers(0, 2**63 - 1, len(labels))
                mine = at >> 33 == p
                shard[mine], key[mine] = labels[at[mine] & (2**33 - 1)], keys[at[mine] & (2**33 - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard, pa.int32()), pa.array(key, pa.int64())], [*batch.schema.names, "shard", "_key"]
            )

    def placed(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields]).add("shard", T.IntegerType()).add("_key", T.LongType())
        return rows.mapInArrow(permute, schema).withColumn("_block", F.floor(F.col("_key") / F.lit(float(2**63)) * blocks).cast("int"))

    sizes = placed(fixed.select("_at")).groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_block").orderBy("_key", "_at")
    ranked = placed(fixed.select("_row", "_at")).withColumn("_rank", F.row_number().over(inside) - 1)
    out = ranked.join(starts, ["shard", "_block"]).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
    return out.select("_row.*", "shard", "slot")
