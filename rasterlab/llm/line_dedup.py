"""Removal of lines that many documents share, by probing a sharded minimal perfect hash.

Lines are told apart by two 64-bit hashes. The first one picks the shard and the place in the
shard's minimal perfect hash; the second one is the fingerprint stored at that place. Beside the
fingerprints each shard keeps two arrays of the same order: how many documents hold the line and
which of them keeps it. Line texts are never joined or shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import SPACES, let, lowered, packed
from rasterlab.session import cut_lineage

_LEVELS = 24
_ROOM = 2.0


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of ``h`` for each level (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers: a bit array for each level.

    A level holds a set bit where exactly one of the numbers that reached it falls; the others go
    to the next level. The place of a number is the count of set bits before its own. Numbers
    left after the last level are listed in order.
    """

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.before = [np.concatenate([[0], np.cumsum(b)]) for b in bits]
        self.base = np.concatenate([[0], np.cumsum([b.sum() for b in bits])]).astype(np.int64)

    @classmethod
    def build(cls, numbers: np.ndarray) -> PerfectHash:
        bits, left = [], numbers.astype(np.uint64)
        for level in range(_LEVELS):
            if not len(left):
                break
            at = (_mix(left, level) % np.uint64(max(1, int(_ROOM * len(left))))).astype(np.int64)
            once = np.bincount(at, minlength=max(1, int(_ROOM * len(left)))) == 1
            bits.append(once)
            left = left[~once[at]]
        return cls(bits, np.sort(left))

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, 0 to n - 1; for numbers not built in, any place or -1."""
        numbers = numbers.astype(np.uint64)
        out = np.full(len(numbers), -1, dtype=np.int64)
        todo = np.arange(len(numbers))
        for level, bits in enumerate(self.bits):
            at = (_mix(numbers[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.base[level] + self.before[level][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, numbers[todo]), len(self.rest) - 1)
            found = self.rest[at] == numbers[todo]
            out[todo[found]] = self.base[-1] + at[found]
        return out

    def pack(self) -> bytes:
        head = struct.pack("<II", len(self.bits), len(self.rest))
        sizes = struct.pack(f"<{len(self.bits)}Q", *map(len, self.bits))
        return head + sizes + b"".join(np.packbits(b).tobytes() for b in self.bits) + self.rest.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        levels, rest = struct.unpack_from("<II", data)
        sizes = struct.unpack_from(f"<{levels}Q", data, 8)
        at, bits = 8 + 8 * levels, []
        for n in sizes:
            size = -(-n // 8)
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool))
            at += size
        return cls(bits, np.frombuffer(data, np.uint64, rest, at))


def line_key(line: Column) -> Column:
    """A line without outer white space, A-Z lower-cased."""
    return lowered(F.trim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """Hash pairs of the distinct long lines of each row."""
    long = F.filter(F.transform(F.split(text, "\n"), line_key), lambda k: F.length(k) >= min_chars)
    return (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).cast("long").alias("_doc"), F.explode(F.array_distinct(long)).alias("_key"))
        .select("_doc", F.xxhash64("_key").alias("h"), F.xxhash64(F.lit(1), F.col("_key")).alias("f"))
    )


def build_index(shared: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its minimal perfect hash, and the arrays in the order of its places.

    ``shared`` has a row for each line: both hashes, the count of documents, the one that keeps it.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # of lines with the same first hash, one takes the place and the others go to a list
        pdf = pdf.sort_values(["h", "f"])
        first = ~pdf.h.duplicated().to_numpy()
        own, twins = pdf[first], pdf[~first]
        table = PerfectHash.build(own.h.to_numpy())
        arrays = own.iloc[np.argsort(table.places(own.h.to_numpy()))]
        return pd.DataFrame({
            "shard": pdf["shard"].iloc[:1].to_numpy(),
            "mph": [table.pack()],
            "fingerprints": [arrays.f.to_numpy(np.int64).tobytes()],
            "counts": [arrays.n.to_numpy(np.int64).tobytes()],
            "keepers": [arrays.keeper.to_numpy(np.int64).tobytes()],
            "twins": [twins[["h", "f", "n", "keeper"]].to_numpy(np.int64).tobytes()],
        })

    schema = "shard int, mph binary, fingerprints binary, counts binary, keepers binary, twins binary"
    return shared.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, schema)


def _probe(min_docs: int):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard, its arrays before the lines to look up in them."""
        shard = table = None
        for pdf in batches:
            for number, part in pdf.groupby("shard", sort=True):
                head = part[part.mph.notna()]
                if len(head):
                    r, shard = head.iloc[0], number
                    table = PerfectHash.unpack(r.mph)
                    prints, counts, keepers = (np.frombuffer(r[c], np.int64) for c in ("fingerprints", "counts", "keepers"))
                    twins = pd.DataFrame(np.frombuffer(r.twins, np.int64).reshape(-1, 4), columns=["h", "f", "n", "keeper"])
                rows = part[part.mph.isna()]
                if shard != number or not len(rows):
                    continue
                h, f, docs = (rows[c].to_numpy(np.int64) for c in ("h", "f", "_doc"))
                at = table.places(h)
                known = np.flatnonzero(at >= 0)
                known = known[prints[at[known]] == f[known]]
                at = at[known]
                drop = known[(counts[at] >= min_docs) & (keepers[at] != docs[known])]
                yield pd.DataFrame({"_doc": docs[drop], "h": h[drop]})
                if len(twins):
                    other = rows[["_doc", "h", "f"]].merge(twins, on=["h", "f"])
                    yield other.loc[(other.n >= min_docs) & (other["_doc"] != other.keeper), ["_doc", "h"]]

    return probe


def drop_shared_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3,
    lines_per_shard: int = 1_000_000, salts: int = 16,
) -> DataFrame:
    """Drops lines that at least ``min_docs`` documents hold, except in the largest doc_id of them.

    Lines are compared without outer white space and with A-Z lower-cased; only those of at least
    ``min_chars`` code points count. Adds ``kept_text``, ``n_lines`` and ``n_dropped`` to the
    columns of ``docs`` (columns of these names are replaced).

    A null or empty text is one empty line. Every row is a document; rows that share a doc_id each
    count, and all rows of the largest doc_id keep the line. A row without doc_id takes no part: it
    counts for no line and keeps all of its own. doc_id must be an integer column.

    Shards have about ``lines_per_shard`` lines and each is copied to ``salts`` tasks, among which
    the lines to look up are spread by document, so that a line held by a third of all documents
    does not meet in one task.
    """
    rows = docs.drop("kept_text", "n_lines", "n_dropped")
    rows = rows.select(packed(rows), F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    hashed = _lines(rows, "_text", "_id", min_chars)
    counted = hashed.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.max("_doc").alias("keeper"))
    shared = cut_lineage(counted.where(F.col("n") >= min_docs))
    shards = max(16, -(-shared.count() // lines_per_shard))
    arrays = build_index(shared, shards).select(
        "*", F.lit(0).cast("long").alias("_doc"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("f"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    probes = hashed.select(
        F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "_doc", "h", "f",
        F.pmod(F.xxhash64("_doc"), F.lit(salts)).cast("int").alias("_salt"),
    )
    routed = (
        arrays.unionByName(probes, allowMissingColumns=True)
        .repartition("shard", "_salt")
        .sortWithinPartitions("shard", "_salt", F.col("mph").isNull())
    )
    dropped = routed.mapInPandas(_probe(min_docs), "_doc long, h long").groupBy("_doc").agg(F.collect_set("h").alias("_drop"))
    joined = rows.join(dropped, F.col("_id") == F.col("_doc"), "left")
    lines = F.split("_text", "\n")
    kept = F.filter(
        lines, lambda x: let(line_key(x), lambda k: ~((F.length(k) >= min_chars) & F.array_contains(F.col("_drop"), F.xxhash64(k))))
    )
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(kept)
    return joined.select(
        "_row", let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("kept_text"), F.size(k).cast("long").alias("n"))).alias("_kept"),
        F.size(lines).cast("long").alias("n_lines"),
    ).select(
        "_row.*", F.col("_kept.kept_text").alias("kept_text"), "n_lines",
        (F.col("n_lines") - F.col("_kept.n")).alias("n_dropped"),
    )
