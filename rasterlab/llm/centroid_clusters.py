"""Exact k-means on integer vectors by Shallot search.

Every vector keeps its centroid, the second-nearest one, and bounds on both distances, in a table
that each round writes anew. A vector whose bounds decide is not compared; all others start from the
closer of their two centroids and look through its neighbours in order of distance, in a ball that
shrinks with each better find (Borgelt 2020). What the bounds cannot rule out is compared in
integers, so bounds and rounding never reach the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.llm.common import packed
from rasterlab.session import cut_lineage

#: Squared distances of 64 components below this fit a long.
LARGEST = 1 << 27
#: Bounds are floating-point; they decide only with this much to spare.
_SLACK = 1e-9
_STATE = [
    T.StructField("cluster", T.IntegerType()), T.StructField("second", T.IntegerType()), T.StructField("upper", T.DoubleType()),
    T.StructField("lower", T.DoubleType()), T.StructField("distance", T.LongType()),
]


class Centroids:
    """Centres with their mutual distances; neighbours of each in order of distance."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None):
        self.at = centres
        self.apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2).astype(float))
        self.order = np.argsort(self.apart + np.diag(np.full(len(centres), -1.0)), axis=1, kind="stable")
        others = self.apart + np.diag(np.full(len(centres), np.inf))
        self.half_nearest = others.min(axis=1) / 2
        self.moved = np.zeros(len(centres)) if before is None else np.sqrt(((centres - before) ** 2).sum(1).astype(float))
        #: largest way of any centre but the one itself
        top = np.sort(self.moved)[::-1]
        runner = top[1] if len(top) > 1 else 0.0
        self.others_moved = np.where(self.moved == top[0], runner if (self.moved == top[0]).sum() == 1 else top[0], top[0])

    def squared(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x - self.at[c]) ** 2).sum(1)

    def assign(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """New (centroid, second, upper, lower), and how many vectors had to be compared."""
        a, b, upper, lower = a.copy(), b.copy(), upper + self.moved[a], lower - self.others_moved[a]

        def open_(i):
            return i[upper[i] * (1 + _SLACK) + _SLACK >= np.maximum(lower[i], self.half_nearest[a[i]])]

        todo = open_(np.arange(len(x)))
        near = self.squared(x[todo], a[todo])
        upper[todo] = np.sqrt(near.astype(float))
        still = np.isin(todo, open_(todo), assume_unique=True)  # a tight upper bound settles some more
        todo, near = todo[still], near[still]
        if len(todo) and len(self.at) > 1:
            a[todo], b[todo], near, far = self._search(x[todo], a[todo], b[todo], near)
            upper[todo], lower[todo] = np.sqrt(near.astype(float)), np.sqrt(far.astype(float))
        return a, b, upper, lower, len(todo)

    def _search(self, x, a, b, near):
        far = self.squared(x, b)
        swap = (far < near) | ((far == near) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        near, far = np.where(swap, far, near), np.where(swap, near, far)
        start, other, from_start = a.copy(), b.copy(), np.sqrt(near.astype(float))
        live = np.arange(len(x))
        for j in range(1, len(self.at)):
            c = self.order[start[live], j]
            reach = (from_start[live] + np.sqrt(far[live].astype(float))) * (1 + _SLACK) + _SLACK
            inside = self.apart[start[live], c] <= reach
            live, c = live[inside], c[inside]  # neighbours are sorted: who is out stays out
            if not len(live):
                break
            new = c != other[live]
            i, c = live[new], c[new]
            d = self.squared(x[i], c)
            first = (d < near[i]) | ((d == near[i]) & (c < a[i]))
            second = ~first & ((d < far[i]) | ((d == far[i]) & (c < b[i])))
            f, s = i[first], i[second]
            far[f], b[f] = near[f], a[f]
            near[f], a[f] = d[first], c[first]
            far[s], b[s] = d[second], c[second]
        return a, b, near, far


def _assigned(rows: DataFrame, centroids: Centroids, dims: int, last: bool = False) -> DataFrame:
    """Rows with columns ``_row``, ``x`` (little-endian 32-bit integers) and the state of the last round.

    Squared distances are computed for all rows in the last assignment only, else they are 0.
    """
    fields = [f for f in rows.schema.fields if f.name in ("_row", "x")]
    schema = T.StructType([*fields, *_STATE])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            state = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "second", "upper", "lower")]
            a, b, upper, lower, _ = centroids.assign(x, *state)
            near = centroids.squared(x, a) if last else np.zeros(len(x), np.int64)
            new = [pa.array(v, t) for v, t in ((a, pa.int32()), (b, pa.int32()), (upper, pa.float64()), (lower, pa.float64()), (near, pa.int64()))]
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.fieldNames())

    return rows.select(*[f.name for f in fields], "cluster", "second", "upper", "lower").mapInArrow(run, schema)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty clusters stay where they are."""
    k, dims = before.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for pdf in batches:
            if len(pdf):
                c = pdf.cluster.to_numpy()
                np.add.at(sums, c, np.frombuffer(b"".join(pdf.x), "<i4").reshape(-1, dims))
                n += np.bincount(c, minlength=k)
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": n[used], "sums": list(sums[used])})

    part = state.select("cluster", "x").mapInPandas(run, "cluster int, n long, sums array<long>")
    long = part.select("cluster", "n", F.posexplode("sums").alias("d", "v"))
    # k times dims rows
    rows = long.groupBy("cluster", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect()
    after = before.copy()
    for r in rows:
        after[r.cluster, r.d] = int(r.v) // r.n
    return after


def cluster_vectors(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1"
) -> DataFrame:
    """k-means of the vectors with ``dims`` components, none null or non-finite; others are left out.

    A component x counts as the integer floor(scale * x). The ``k`` vectors with the smallest SHA-256
    of ``seed:vec_id`` are the first centroids, numbered in that order; ``rounds`` times all vectors
    go to the nearest centroid (ties: the smaller number) and centroids to the floor of their
    vectors' mean; then vectors are assigned once more. Returns all columns but the vector, with
    ``cluster``, ``distance`` (squared), ``cluster_inertia`` and ``inertia`` (sums over the cluster
    and over all) and ``centroid_sha256`` (of the final centroid's components, comma-joined).

    Ids may repeat; among equal ids the smaller vector comes first. A null id is hashed as no
    digits. With fewer vectors than ``k`` each is a centroid; without any there are no rows. Equal
    vectors share a cluster. A component of more than 2^27 after scaling is an error, as its squared
    distances do not fit a long. Columns named like the added ones are replaced. Only ``k`` rows
    and ``k * dims`` sums reach the driver.
    """
    spark = vectors.sparkSession
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    others = vectors.drop(vector, *added)
    scaled = F.transform(F.col("v"), lambda c: F.floor(F.lit(float(scale)) * c))
    usable = (F.size("v") == dims) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(packed(others), F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    too_large = F.exists("v", lambda c: F.abs(F.lit(float(scale)) * c) > LARGEST)
    error = F.raise_error(F.lit("a component is too large for exact distances"))
    kept = kept.select("_row", "id", F.when(too_large, error).otherwise(scaled).alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        # the columns of a result without rows
        none = kept.limit(0).select(
            "_row.*", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in added[1:4]], F.lit("").alias(added[4])
        )
        return none
    centres = np.array([r.x for r in first], np.int64)
    to_bytes = _as_bytes(kept.select("_row", "x"))
    # before the first round nothing is known of any vector: its bounds decide nothing
    start = [F.lit(0).alias("cluster"), F.lit(min(1, len(centres) - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower")]
    state = to_bytes.select("_row", "x", *start)
    before = None
    for _ in range(rounds):
        state = cut_lineage(_assigned(state, Centroids(centres, before), dims))
        before, centres = centres, _means(state, centres)
    final = cut_lineage(_assigned(state, Centroids(centres, before), dims, last=True).select("_row", "cluster", "distance"))
    sums = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist())], "cluster int, centroid_sha256 string"
    )
    facts = sums.join(F.broadcast(names), "cluster").withColumn("inertia", sums.agg(F.sum("cluster_inertia")).scalar())
    # both have k rows at most
    return final.join(F.broadcast(facts), "cluster").select("_row.*", *added)


def _as_bytes(rows: DataFrame) -> DataFrame:
    """Arrays of integers as little-endian 32-bit bytes."""
    schema = T.StructType([rows.schema["_row"], T.StructField("x", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column("x")
            values = x.flatten().to_numpy().astype("<i4").tobytes()
            width = len(values) // max(len(x), 1)
            cells = pa.array([values[i * width : (i + 1) * width] for i in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), cells], names=["_row", "x"])

    return rows.mapInArrow(run, schema)
