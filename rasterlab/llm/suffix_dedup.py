"""Removal of byte strings that occur earlier, by prefix doubling over sampled positions.

Positions are named by the bytes that follow them, at growing lengths: first 32 bytes, then the
whole stretch around a position, then each single string of the threshold's length. At each
length, positions whose name is unique leave; those with equal names are sorted by their place.

Only sampled positions are named first. A string of ``length`` bytes is represented by its anchor,
the first of its 32-byte strings with the smallest hash; equal strings have the same anchor at the
same offset, so a string can only be repeated if its anchor's name is. Neighbouring strings share
an anchor, which leaves about one position in 35.

Rounds:

1. Anchors are sorted by name (shards by hash range). A unique name ends its strings. Where all
   bytes of an anchor's strings stand earlier around an equal anchor, all its strings are repeated.
   What remains are first occurrences of a stretch whose anchor occurs around other bytes too.
2. Those alone are compared string by string: by name, in order of place, the first occurrence of
   each string stays and later ones are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import small_batches
from rasterlab.session import cut_lineage

_GRAM = 32
_PIECE = 1_000_000  # windows of a text that are hashed at once
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pair(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Names of pairs: what two neighbouring stretches of ``n`` bytes are called together."""
    h = (a * _M2) ^ (b + np.uint64(n))
    h *= _M1
    h ^= h >> np.uint64(31)
    return h


def _gram_names(b: np.ndarray) -> np.ndarray:
    """Names of all strings of 32 bytes, by doubling from single bytes."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    n = 1
    while n < _GRAM:
        h = _pair(h[:-n], h[n:], n)
        n *= 2
    return h


def _shard(name: np.ndarray, bits: int) -> np.ndarray:
    """Shards of anchor names; these are smallest hashes, so they are hashed anew to spread evenly."""
    with np.errstate(over="ignore"):
        return (_pair(name, name, 3) * _M2 >> np.uint64(64 - bits)).astype(np.int64)


def _first_smallest(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` names, the place of the first smallest one."""
    value, place, n = g, np.arange(len(g), dtype=np.int64), 1

    def merge(step: int) -> None:
        nonlocal value, place
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])

    while 2 * n <= width:
        merge(n)
        n *= 2
    if n < width:
        merge(width - n)
    return place


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes: (place, first string, last string, name, stretch name).

    The stretch of an anchor is the bytes of all its strings. Long texts are taken in pieces; an
    anchor whose strings lie in two pieces counts twice, with different strings.
    """
    whole = np.frombuffer(data, np.uint8)
    strings = len(whole) - length + 1
    parts = []
    for at in range(0, max(strings, 0), _PIECE):
        b = whole[at : at + _PIECE + length - 1]
        with np.errstate(over="ignore"):
            g = _gram_names(b)
            place = _first_smallest(g, length - _GRAM + 1)
            cuts = np.flatnonzero(np.diff(place)) + 1
            first = np.concatenate([[0], cuts])
            last = np.concatenate([cuts - 1, [len(place) - 1]])
            p = place[first]

            def string_name(i: np.ndarray) -> np.ndarray:
                h = g[i]
                for k in range(_GRAM, length - _GRAM, _GRAM):
                    h = _pair(h, g[i + k], k)
                return _pair(h, g[i + length - _GRAM], length)

            stretch = _pair(string_name(first), string_name(last), 7)
            stretch = _pair(stretch, ((last - first) * 4096 + (p - first)).astype(np.uint64), 9)
        parts.append((p + at, first + at, last + at, g[p], stretch))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _places(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
    """Rows (id, bytes) with the block of text each belongs to and its number in the block."""
    block, filled, seq = TaskContext.get().partitionId() << 24, 0, 0
    for batch in batches:
        blocks, seqs = [], []
        for size in pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist():
            if filled and filled + size > block_bytes:
                block, filled, seq = block + 1, 0, 0
            filled += size
            blocks.append(block)
            seqs.append(seq)
            seq += 1
        yield batch, blocks, seqs


def _numbered(block_bytes: int):
    """Adds block and number to rows (id, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blocks, seqs in _places(batches, block_bytes):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(blocks, pa.int64()), pa.array(seqs, pa.int32())], ["doc", "data", "block", "seq"]
            )

    return run


def _ask(length: int, bits: int, block_bytes: int):
    """Rows (block, shard, arrays) of the anchors of each block."""

    def flush(block: int, found: list) -> pa.RecordBatch:
        sizes = [len(f[2]) for f in found]
        docs = np.repeat(np.array([f[0] for f in found], np.int64), sizes)
        seqs = np.repeat(np.array([f[1] for f in found], np.uint32), sizes)
        place = np.concatenate([f[2] for f in found]).astype(np.uint32)
        name = np.concatenate([f[5] for f in found])
        stretch = np.concatenate([f[6] for f in found])
        shard = _shard(name, bits)
        order = np.argsort(shard, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=2**bits))])
        full = [k for k in range(2**bits) if ends[k + 1] > ends[k]]
        part = lambda x: pa.array([x[order[ends[k] : ends[k + 1]]].tobytes() for k in full], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), *map(part, (name, stretch, docs, seqs, place))],
            ["block", "shard", "names", "stretches", "docs", "seqs", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, found = None, []
        for batch, blocks, seqs in _places(batches, block_bytes):
            for doc, data, block, seq in zip(batch.column(0).to_pylist(), batch.column(1), blocks, seqs):
                if block != open_block and found:
                    yield flush(open_block, found)
                    found = []
                open_block = block
                found.append((doc, seq, *anchors(data.as_py(), length)))
        if found:
            yield flush(open_block, found)

    return run


_REPEATED, _OPEN = 1, 2


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, a state of each of its anchors in the shard, in the block's order."""
    names, stretches = (np.concatenate([np.frombuffer(x, np.uint64) for x in pdf[c]]) for c in ("names", "stretches"))
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
    seqs, places = (np.concatenate([np.frombuffer(x, np.uint32) for x in pdf[c]]) for c in ("seqs", "places"))
    sizes = np.array([len(x) // 8 for x in pdf["names"]])
    blocks = np.repeat(pdf["block"].to_numpy(), sizes)
    _, place, count = np.unique(names, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[place] > 1)
    state = np.zeros(len(names), np.uint8)
    if len(twice):
        order = twice[np.lexsort((places[twice], seqs[twice], blocks[twice], docs[twice], stretches[twice], names[twice]))]
        n, s = names[order], stretches[order]
        new_name = np.concatenate([[True], n[1:] != n[:-1]])
        new_stretch = new_name | np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(new_name) - 1
        several = np.bincount(group, new_stretch)[group] > 1
        state[order] = np.where(~new_stretch, _REPEATED, np.where(several, _OPEN, 0))
    ends = np.cumsum(sizes)
    return pd.DataFrame({
        "block": pdf["block"], "shard": pdf["shard"],
        "states": [state[e - k : e].tobytes() for e, k in zip(ends, sizes)],
    })


_ROW = "kind int, block long, seq int, name long, doc long, place long, first long, last long, data binary"


def _decide(length: int, bits: int):
    """Ranges of repeated strings of a block's texts, and the stretches that are still open."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("seq")
        states = {int(s): np.frombuffer(x, np.uint8) for s, x in zip(right["shard"], right["states"])}
        used = dict.fromkeys(states, 0)
        out = []
        block = int(left["block"].iloc[0]) if len(left) else 0
        for doc, data, seq in zip(left["doc"], left["data"], left["seq"]):
            p, first, last, name, _ = anchors(data, length)
            shard = _shard(name, bits)
            state = np.zeros(len(p), np.uint8)
            for k in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == k)
                state[mine] = states[k][used[k] : used[k] + len(mine)]
                used[k] += len(mine)
            known = np.flatnonzero(state == _REPEATED)
            if len(known):
                ranges = np.stack([first[known], last[known]], axis=1).astype(np.int64)
                out.append((0, block, seq, 0, 0, 0, 0, 0, ranges.tobytes()))
            for k in np.flatnonzero(state == _OPEN).tolist():
                a, z = int(first[k]), int(last[k])
                out.append((1, block, seq, int(name[k : k + 1].view(np.int64)[0]), doc, int(p[k]), a, z, data[a : z + length]))
        if any(used[k] != len(x) for k, x in states.items()):
            raise RuntimeError("the input gave other rows when it was read again; pass a table that is written")
        return pd.DataFrame(out, columns=["kind", "block", "seq", "name", "doc", "place", "first", "last", "data"])

    return run


def _compare(length: int):
    """Rows come by anchor name, in order of place: strings met before are repeated.

    Of each string of the current name a 64-bit hash is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, met = None, set()
        for batch in batches:
            out = []
            for own, block, seq, place, first, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    name, met = own, set()
                found = []
                for i in range(first, last + 1):
                    key = hash((place - i, data[i - first : i - first + length]))
                    if key in met:
                        found.append(i)
                    else:
                        met.add(key)
                if found:
                    f = np.array(found, np.int64)
                    out.append((block, seq, np.stack([f, f], axis=1).tobytes()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["block", "seq", "ranges"]
            )

    return run


def _compare_crowded(opened: DataFrame, length: int) -> DataFrame:
    """The same for anchors that very many stretches share: each string is a row, its first place an aggregate."""
    name = lambda i, seed: F.xxhash64(F.lit(seed), F.substring(F.col("data"), (i - F.col("first") + 1).cast("int"), F.lit(length)))
    strings = F.transform(F.sequence("first", "last"), lambda i: F.struct(i.alias("i"), name(i, 1).alias("a"), name(i, 2).alias("b")))
    rows = opened.select("doc", "block", "seq", F.explode(strings).alias("s")).select("s.a", "s.b", F.struct("doc", "block", "seq", "s.i").alias("at"))
    first = rows.groupBy("a", "b").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first, ["a", "b"]).where("at <> first_at")
    found = later.groupBy("at.block", "at.seq").agg(F.collect_list("at.i").alias("places"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [np.repeat(np.array(x, np.int64), 2).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ranges, pa.binary())], ["block", "seq", "ranges"])

    return found.mapInArrow(packed, "block long, seq int, ranges binary")


def _cut(length: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ranges: dict[int, list[bytes]] = {}
        for seq, data in zip(right["seq"], right["ranges"]):
            ranges.setdefault(seq, []).append(data)
        out = []
        for doc, data, seq in zip(left["doc"], left["data"], left["seq"]):
            found = ranges.get(seq)
            if not found:
                out.append((doc, len(data), 0, 0, data))
                continue
            first, last = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2).T
            edge = np.bincount(first, minlength=len(data) + 1) - np.bincount(last + length, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((doc, len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 100, block_bytes: int = 8_000_000, digest: bool = False,
    crowd: int = 50_000,
) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller doc_id, or the same text further to the front. Returns a row for each
    row of ``docs``: doc_id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (the bytes left, as binary, since a cut may fall inside a character), or with
    ``digest`` their ``kept_sha256``.

    Texts are UTF-8 bytes; null is empty; matches never cross texts; occurrences may overlap.
    Strings are judged on the input. Rows that share a doc_id come in the order of reading, rows
    without one come last, also in that order. ``length`` is 64 at least. doc_id must be integer.

    ``docs`` is read three times and must give the same partitions each time, as a table of files
    does; otherwise the task fails rather than mix up answers. A task holds a block of about
    ``block_bytes`` of text (or one longer text), one shard of anchors, or the strings around one
    anchor name; names of more than ``crowd`` open stretches are spread over many tasks instead, a
    row for each string.
    """
    if length < 2 * _GRAM:
        raise ValueError(f"length must be at least {2 * _GRAM}")
    small_batches(docs.sparkSession)
    last_id = F.lit(2**63 - 1)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    schema = "doc long, data binary, block long, seq int"
    # as text, so that pandas leaves ids beside nulls as they are
    named = rows.select(F.col("doc").cast("string").alias("doc"), "data")
    numbered = named.mapInArrow(_numbered(block_bytes), schema.replace("doc long", "doc string"))
    placed = rows.select(F.coalesce("doc", last_id).alias("doc"), "data")
    ordered = placed.mapInArrow(_numbered(block_bytes), schema)
    bits = max(6, int(rows.rdd.getNumPartitions() - 1).bit_length())
    asked = placed.mapInArrow(
        _ask(length, bits, block_bytes), "block long, shard int, names binary, stretches binary, docs binary, seqs binary, places binary"
    )
    states = cut_lineage(asked.groupBy("shard").applyInPandas(_answer, "block long, shard int, states binary"))
    decided = cut_lineage(ordered.groupBy("block").cogroup(states.groupBy("block")).applyInPandas(_decide(length, bits), _ROW))
    opened = decided.where("kind = 1")
    crowded = cut_lineage(opened.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("name"))
    few = opened.join(crowded, "name", "left_anti").repartition("name").sortWithinPartitions("name", "doc", "block", "seq", "place")
    compared = few.select("name", "block", "seq", "place", "first", "last", "data").mapInArrow(
        _compare(length), "block long, seq int, ranges binary"
    )
    repeated = (
        decided.where("kind = 0").select("block", "seq", F.col("data").alias("ranges")).unionByName(compared)
        .unionByName(_compare_crowded(opened.join(crowded, "name", "left_semi"), length))
    )
    out = "doc string, n_bytes long, n_removed long, n_spans long, kept binary"
    cut = _cut(length)
    if digest:
        out = out.replace("kept binary", "kept_sha256 string")
        cut = lambda left, right: _digested(_cut(length)(left, right))
    done = numbered.groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(cut, out)
    return done.withColumn("doc", F.col("doc").cast(docs.schema[doc_id].dataType)).withColumnRenamed("doc", doc_id)


def _digested(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(kept=[hashlib.sha256(x).hexdigest() for x in pdf["kept"]]).rename(columns={"kept": "kept_sha256"})
