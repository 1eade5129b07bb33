"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.session import cut_lineage


def smallest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by hooking and pointer jumping."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        low = np.minimum(ra, rb)
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        if (parent[a] == parent[b]).all():
            return parent


def _contracted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces the edges of each partition by stars with the same components.

    A partition holds what a shuffle gave it, so memory is bounded as for any sort.
    """

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        ends = pd.concat([pdf[[*keys, c]].set_axis([*keys, "n"], axis=1) for c in ("u", "v")], ignore_index=True)
        # numbering in order of (keys, node) keeps "smallest" meaningful after the numbering
        number = ends.groupby([*keys, "n"], sort=True).ngroup().to_numpy()
        first = np.zeros(number.max() + 1, dtype=np.int64)
        first[number] = np.arange(len(number))
        half = len(pdf)
        root = smallest_roots(len(first), number[:half], number[half:])
        inner = np.flatnonzero(root != np.arange(len(first)))
        out = ends.iloc[first[inner]].rename(columns={"n": "u"}).reset_index(drop=True)
        out["v"] = ends.n.to_numpy()[first[root[inner]]]
        yield out

    return edges.mapInPandas(contract, schema=T.StructType([edges.schema[c] for c in (*keys, "u", "v")]))


def _mark(stars: DataFrame):
    return stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*stars.columns).cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, keys: Sequence[str], src: str, dst: str, few: int = 100_000) -> DataFrame:
    """Smallest node reachable from every non-root node: rows ``(keys, node, root)``.

    Nodes are numbers.  Partitions first contract their own edges; then the large-star and
    small-star steps of Kiveris et al. (2014) alternate: each round reattaches neighbours to
    the smallest one known, with ``min`` aggregates and equi-joins only, never gathering the
    neighbours of a hub, and the loop ends after O(log^2 n) rounds.  Once no more than ``few``
    edges are left, one task contracts them all, which gives the same answer without further
    rounds.  Roots are not listed.
    """
    keys = list(keys)
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    pairs = edges.where(a != b).select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    stars = cut_lineage(_contracted(pairs, keys).distinct())
    before = _mark(stars)
    while before[0]:
        if before[0] <= few:
            stars = cut_lineage(_contracted(stars.coalesce(1), keys))
            break
        both = stars.unionByName(stars.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.join(nearest, [*keys, "u"])
            .where(F.col("v") > F.col("u"))
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, [*keys, "u"])
            .where(F.col("v") != F.col("m"))
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.withColumnRenamed("m", "v"))
        )
        stars = cut_lineage(small.distinct())
        now = _mark(stars)
        if now == before:
            break
        before = now
    return stars.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
