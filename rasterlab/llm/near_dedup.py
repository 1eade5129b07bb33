"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A table key is a pair of bands, one from each of two collections: ``bands`` bands in each give
``bands`` squared tables from ``2 * bands * rows`` hash functions, about the square root of what
as many separate tables would need. Documents with equal shingle sets are one from then on. Of
each bucket only what can still join different components is compared.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.functions.graph import connected_components
from rasterlab.llm.common import packed, small_batches
from rasterlab.session import cut_lineage

_BATCH_BYTES = 1_000_000
_CELLS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    A-Z is lower-cased, words lie between ASCII white space. Fewer words than a shingle has are
    one shingle; a text without words has none.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = [w for ws in split for w in ws]
    hashed = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.zeros(0, np.uint64)
    ends = np.cumsum([len(ws) for ws in split])
    joined = np.zeros(len(hashed), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            n = max(0, len(hashed) - k)
            joined[:n] = _mix(joined[:n] * np.uint64(0x9E3779B97F4A7C15) + hashed[k:] + np.uint64(k + 1))
        for end, ws in zip(ends, split):
            first = end - len(ws)
            if len(ws) >= size:
                yield np.unique(joined[first : end - size + 1])
            elif ws:
                short = np.uint64(len(ws))
                for h in hashed[first:end]:
                    short = _mix(np.array([short * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _in_bytes(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about a megabyte of text each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _BATCH_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _histograms(flat: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many hashes of each of ``n`` sets fall into each of ``_CELLS`` cells; counts stop at 255."""
    cell = (_mix(flat) % np.uint64(_CELLS)).astype(np.int64)
    counts = np.bincount(of * _CELLS + cell, minlength=n * _CELLS).reshape(n, _CELLS)
    return np.minimum(counts, 255).astype(np.uint8)


def _signatures(docs: DataFrame, shingle: int, functions: int) -> DataFrame:
    """Rows (doc, n, print, sig, cells): set size, 128-bit hash of the set, minima, histogram."""
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, functions).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, functions).astype(np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _in_bytes(texts):
                sets = list(shingle_sets(texts[a:b], shingle))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes > 0)
                sig = np.zeros((len(sets), functions), "<u4")
                if len(full):
                    flat = np.concatenate(sets)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    with np.errstate(over="ignore"):
                        for j in range(functions):
                            value = ((flat * factors[j] + shifts[j]) >> np.uint64(32)).astype(np.uint32)
                            sig[full, j] = np.minimum.reduceat(value, starts)
                cells = _histograms(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                rows_of = lambda x: pa.array([s.tobytes() for s in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), rows_of(sig), rows_of(cells)],
                    ["doc", "n", "print", "sig", "cells"],
                )

    return docs.mapInArrow(sign, "doc long, n long, print binary, sig binary, cells binary")


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands of both collections, one column for each band."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(sig), 2 * bands), np.uint64)
        for k in range(2 * bands):
            key = np.full(len(sig), k + 1, np.uint64)
            for r in range(rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * rows + r].astype(np.uint64))
            out[:, k] = key
    return out[:, :bands], out[:, bands:]


def _matrix(column, functions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, functions)


def _table_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            one, two = _band_keys(_matrix(batch.column(1).to_pylist(), 2 * bands * rows), bands, rows)
            for i in range(bands):
                with np.errstate(over="ignore"):
                    pair = _mix(one[:, i : i + 1] * np.uint64(3) + two)
                number = np.tile(np.arange(i * bands, (i + 1) * bands, dtype=np.int32), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair.view(np.int64).ravel()), pa.array(number), pa.array(np.repeat(ids, bands))], ["key", "number", "u"]
                )

    return reps.select("u", "sig").mapInArrow(keys, "key long, number int, u long")


def _buckets(keyed: DataFrame) -> DataFrame:
    """Rows (key, number, u, center, size, one, two) of buckets of at least two documents.

    ``center`` is the smallest member; ``one`` and ``two`` are the same for buckets of more than two
    documents with the same members, and null for others.
    """
    bucket = Window.partitionBy("key")
    counted = keyed.withColumns({
        "center": F.min("u").over(bucket), "last": F.max("u").over(bucket), "size": F.count(F.lit(1)).over(bucket),
        "one": F.bit_xor("u").over(bucket), "two": F.bit_xor(F.xxhash64("u")).over(bucket),
    })
    crowd = F.col("size") > 2
    return counted.where("center < last").select(
        "key", "number", "u", "center", "size", F.when(crowd, F.col("one")).alias("one"), F.when(crowd, F.col("two")).alias("two")
    )


def _crowded(buckets: DataFrame) -> DataFrame:
    """Rows (key, number, u) of buckets of more than two; of those with the same members only the one of the first table.

    The first table that a pair shares is among these: a left out bucket has its members in an earlier table.
    """
    crowded = buckets.where("size > 2")
    firsts = crowded.where("u = center").groupBy("center", "size", "one", "two").agg(F.min(F.struct("number", "key")).alias("first"))
    return crowded.join(firsts.select("first.key"), "key").select("key", "number", "u")


def _similar(sig: str, other: str, functions: int) -> Column:
    """Positions at which two signatures agree, for a join's rows."""

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_matrix(a, functions) == _matrix(b, functions)).sum(axis=1))

    return agree(F.col(sig), F.col(other))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (v, u, set) for ``_confirm``."""
    sets = sets.select("doc", "set")
    partners = pairs.join(sets.withColumnRenamed("doc", "u"), "u").select("v", "u", "set")
    return _own(sets.join(pairs.select(F.col("v").alias("doc")).distinct(), "doc")).unionByName(partners)


def _own(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("doc").alias("v"), F.lit(None).cast("long").alias("u"), "set")


def _confirm(both: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have the similarity.

    ``both`` holds (v, u, set of u), and the set of v itself without u. Rows come by v, its set before
    the sets of its partners, so one set is held at a time.
    """
    both = both.repartition("v").sortWithinPartitions("v", F.col("u").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            kept = []
            for v, u, data in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(data, np.uint64)
                if u is None:
                    at, held = v, s
                elif v == at:
                    both_have = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * both_have >= percent * (len(held) + len(s) - both_have):
                        kept.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["u", "v"])

    return both.mapInArrow(check, "u long, v long")


def _open_pairs(
    buckets: DataFrame, roots: DataFrame, sigs: DataFrame, bands: int, band_rows: int, least: int, percent: int, best: bool, block: int,
) -> DataFrame:
    """Pairs of different components that share a bucket and whose signatures agree enough.

    A pair comes from the first table that it shares. Pairs whose sizes or histograms leave no room
    for the similarity are left out: two sets have no more in common than the smaller count of
    each cell. With ``best`` only each document with its most alike partner. A bucket of more than ``block``
    documents is compared block against block, so a task holds two blocks at most.
    """
    rooted = buckets.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("size")).where("a < b")
    placed = (
        rooted.join(mixed.select("key", "size"), "key").join(sigs, "u")
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "number", "u", "root", "n", "sig", "cells")
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    )

    def compare(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """All pairs of whole groups at once: each row with the one after it, then the second one, ..."""
        mine, number, u, root, n = (pdf[c].to_numpy() for c in ("mine", "number", "u", "root", "n"))
        crossed = (pdf.x != pdf.y).to_numpy()
        sig = _matrix(pdf.sig, 2 * bands * band_rows)
        cells = np.frombuffer(b"".join(pdf.cells), np.uint8).reshape(-1, _CELLS)
        full = (cells == 255).any(axis=1)
        found, rows, step = [], np.arange(len(u)), 1
        while True:
            rows = rows[rows + step < len(u)]
            rows = rows[group[rows + step] == group[rows]]
            if not len(rows):
                break
            a = rows[(root[rows] != root[rows + step]) & ~(crossed[rows] & (mine[rows] == mine[rows + step]))]
            a = a[100 * np.minimum(n[a], n[a + step]) >= percent * np.maximum(n[a], n[a + step])]
            b = a + step
            same = sig[a] == sig[b]
            shared = same.reshape(len(a), 2 * bands, band_rows).all(axis=2)
            table = shared[:, :bands].argmax(axis=1) * bands + shared[:, bands:].argmax(axis=1)
            alike = same.sum(axis=1)
            common = np.minimum(cells[a], cells[b]).sum(axis=1, dtype=np.int64)
            room = (100 * common >= percent * (n[a] + n[b] - common)) | full[a] | full[b]
            good = (alike >= least) & (table == number[a]) & room
            a, alike = a[good], alike[good]
            found.append((np.maximum(u[a], u[a + step]), np.minimum(u[a], u[a + step]), alike))
            step += 1
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        out = pd.DataFrame(dict(zip(("u", "v", "alike"), cols))).drop_duplicates(["u", "v"])
        out = pd.concat([out.assign(owner=out.u), out.assign(owner=out.v)]) if best else out.assign(owner=out.u)
        return out.sort_values("alike", kind="stable").drop_duplicates("owner", keep="last") if best else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups of neighbouring rows; the last one of a batch waits for the next batch."""
        held = None
        for pdf in itertools.chain(batches, [None]):
            rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            key, x, y = (rows[c].to_numpy() for c in ("key", "x", "y"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            end = len(rows) if pdf is None else int(np.flatnonzero(new)[-1])
            held = rows.iloc[end:]
            if end:
                yield compare(rows.iloc[:end], np.cumsum(new)[:end])

    found = placed.mapInPandas(run, "u long, v long, alike long, owner long")
    if best:
        top = found.groupBy("owner").agg(F.max_by(F.struct("u", "v"), F.struct("alike", "u", "v")).alias("p"))
        return top.select("p.u", "p.v").distinct()
    return found.select("u", "v").distinct()


def near_duplicate_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80,
    bands: int = 10, rows: int = 2, least_alike: float = 0.5, block: int = 2000,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Two documents are linked if their sets of word shingles have a similarity of at least
    ``percent`` / 100; ``component_id`` is the smallest doc_id that links reach, ``kept`` holds
    where it is the document's own. Documents without words are linked with nothing.

    Candidates share a table key; a pair at the similarity of 0.8 is missed with a probability of
    about 2 * (1 - 0.8 ** rows) ** bands = 7e-5, more alike ones far less often. Of candidates,
    only those are confirmed whose set sizes allow the similarity and which agree on a share
    ``least_alike`` of the hash functions (at 0.8 missed less than once in 100,000), each on its
    full sets, unless both are in one component already.

    Rows that share a doc_id are one document with several texts as to kept: each row gets the
    component of its own text. A row without doc_id takes no part: it is its own group, with a
    null component_id, and kept. doc_id must be an integer column.
    """
    small_batches(docs.sparkSession)
    functions = 2 * bands * rows
    least = round(least_alike * functions)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = cut_lineage(_signatures(docs, shingle, functions))
    known = signed.where("doc is not null and n > 0")
    # equal sets are one; it is named by its hash, as several sets may share a doc_id
    reps = cut_lineage(
        known.groupBy("print").agg(*[F.min(c).alias(c) for c in ("doc", "sig", "cells", "n")]).withColumn("u", F.xxhash64("print"))
    )
    buckets = cut_lineage(_buckets(_table_keys(reps, bands, rows)))
    # most documents share no bucket; the others' signatures are moved several times
    sigs = cut_lineage(reps.join(buckets.select("u").distinct(), "u", "left_semi").select("u", "sig", "cells", "n"))
    # a bucket of two holds one pair, which is its member and its center
    crowded = cut_lineage(_crowded(buckets))
    # first, each document with the most alike of the centers of its buckets
    star = buckets.where("u > center").select("u", F.col("center").alias("v")).distinct()
    mine = sigs.select("u", "sig", "n")
    theirs = sigs.select(F.col("u").alias("v"), F.col("sig").alias("sig_v"), F.col("n").alias("n_v"))
    compared = (
        star.join(mine, "u").join(theirs, "v").where(F.least("n", "n_v") * 100 >= F.greatest("n", "n_v") * percent)
        .withColumn("alike", _similar("sig", "sig_v", functions)).where(F.col("alike") >= least)
    )
    alike = cut_lineage(compared.select("u", "v", "alike"))
    nearest = cut_lineage(alike.groupBy("u").agg(F.max_by("v", F.struct("alike", -F.col("v"))).alias("v")))
    wanted = (
        alike.select("u").unionByName(alike.select(F.col("v").alias("u")))
        .unionByName(crowded.select("u")).distinct()
    )

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _in_bytes(texts):
                found = [s.tobytes() for s in shingle_sets(texts[a:b], shingle)]
                prints = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(found, pa.binary())], ["print", "set"])

    # a few bytes for each candidate: a table whose size is known spares the texts a shuffle while it can be broadcast
    holders = cut_lineage(reps.join(wanted, "u").select(F.col("doc").alias("_doc")).distinct())
    texts = docs.join(holders, F.col("doc") == F.col("_doc")).select("text")
    named = texts.mapInArrow(as_sets, "print binary, set binary").select(F.xxhash64("print").alias("doc"), "set").dropDuplicates(["doc"])
    # where repeats meet, each set learns its center and whether it is one: it need not be moved by name again for that
    centers = nearest.select(F.col("v").alias("doc"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("own")).distinct()
    roles = nearest.select(F.col("u").alias("doc"), "v", F.lit(False).alias("own")).unionByName(centers)
    sets = cut_lineage(named.join(roles.groupBy("doc").agg(F.max("v").alias("v"), F.max("own").alias("own")), "doc", "left"))
    partners = sets.where("v is not null").select("v", F.col("doc").alias("u"), "set")
    links = cut_lineage(_confirm(_own(sets.where("own")).unionByName(partners), percent))
    roots = cut_lineage(connected_components(links, [], "u", "v"))
    for best in (True, False):
        open_pairs = _open_pairs(crowded, roots, sigs, bands, rows, least, percent, best, block)
        if not best:
            other = roots.withColumnsRenamed({"node": "v", "root": "root_v"})
            star_pairs = alike.join(roots.withColumnRenamed("node", "u"), "u", "left").join(other, "v", "left")
            apart = F.coalesce("root", "u") != F.coalesce("root_v", "v")
            ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
            open_pairs = open_pairs.unionByName(star_pairs.where(apart).select(*ends)).distinct()
        more = cut_lineage(_confirm(_with_sets(cut_lineage(open_pairs), sets), percent))
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = cut_lineage(connected_components(links, [], "u", "v"))
    rooted = reps.join(roots.withColumnRenamed("node", "u"), "u", "left").select("print", "doc", F.coalesce("root", "u").alias("node"))
    smallest = rooted.groupBy("node").agg(F.min("doc").alias("root"))
    by_print = rooted.join(smallest, "node").select("print", "root")
    placed = signed.join(by_print, "print", "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc"))
    return placed.select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))


def link_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``; see ``near_duplicate_groups``.

    Rows that share a doc_id get the same values: the largest set size, the smallest component.
    Columns of the added names are replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    groups = near_duplicate_groups(docs, text, doc_id, **options).where(F.col(doc_id).isNotNull())
    each = groups.groupBy(F.col(doc_id).alias("_doc")).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    joined = docs.select(packed(docs), F.col(doc_id).cast("long").alias("_id")).join(each, F.col("_id") == F.col("_doc"), "left")
    return joined.select(
        "_row.*", "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
