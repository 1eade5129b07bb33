"""Grouped pandas functions for many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def stream_groups(
    df: DataFrame, cols: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType
) -> DataFrame:
    """Like ``groupBy(cols).applyInPandas(fn)`` without a transfer per group.

    Rows are hashed by group and sorted inside the partition, then arrive in large Arrow
    batches; a task holds one batch and the group in progress.
    """
    cols = list(cols)
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            if pdf.empty:
                continue
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for c in cols:
                v = pdf[c].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.append(np.flatnonzero(change), len(pdf))
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                part = pdf.iloc[a:b]
                here = tuple(part[c].iat[0] for c in cols)
                if here != key and held:
                    out.append(fn(held[0] if len(held) == 1 else pd.concat(held)).loc[:, names])
                    held = []
                key = here
                held.append(part)
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield fn(held[0] if len(held) == 1 else pd.concat(held)).loc[:, names]

    return _by_group(df, cols).sortWithinPartitions(*cols).mapInPandas(run, schema=schema)


def _by_group(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Hashed by group into the session's partition count, which AQE leaves as it is: Python
    work is heavy for its bytes, so small partitions should not be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def stream_batches(
    df: DataFrame, cols: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType
) -> DataFrame:
    """Calls ``fn`` with many whole groups at a time, by group and then ``order``: for tiny groups.

    A task holds one batch and the group in progress.
    """
    cols, order = list(cols), list(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            ends = group_ends(pdf, cols)
            # the last group may go on in the next batch
            last = ends[-2] if len(ends) > 1 else 0
            rest = pdf.iloc[last:]
            if last:
                yield fn(pdf.iloc[:last])
        if rest is not None and len(rest):
            yield fn(rest)

    return _by_group(df, cols).sortWithinPartitions(*cols, *order).mapInPandas(run, schema=schema)


def stream_choose(
    df: DataFrame, cols: Sequence[str], items: Sequence[str], choose: Callable[[list[tuple]], Sequence[int]]
) -> DataFrame:
    """Keeps the rows of every group whose positions ``choose`` returns.

    ``choose`` gets a group as a list of ``items`` tuples in order of those columns.  Groups
    may be tiny and many: no data frame is built for one.
    """
    cols, items = list(cols), list(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            ends = group_ends(pdf, cols)
            # the last group may go on in the next batch
            last = ends[-2] if len(ends) > 1 else 0
            rest = pdf.iloc[last:]
            if last:
                yield pdf.iloc[_chosen(pdf.iloc[:last], ends[:-1])]
        if rest is not None and len(rest):
            yield rest.iloc[_chosen(rest, group_ends(rest, cols))]

    def _chosen(pdf: pd.DataFrame, ends: np.ndarray) -> list[int]:
        rows = list(zip(*[pdf[c].tolist() for c in items]))
        keep, start = [], 0
        for end in ends:
            keep.extend(start + i for i in choose(rows[start:end]))
            start = end
        return keep

    ordered = _by_group(df, cols).sortWithinPartitions(*cols, *items)
    return ordered.mapInPandas(run, schema=df.schema)


def group_ends(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Row numbers just past each run of equal keys."""
    change = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for c in cols:
        v = pdf[c].to_numpy()
        change |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change) + 1, len(pdf)).astype(int)
