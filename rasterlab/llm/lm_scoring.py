"""Word pair language model by deleted interpolation, trained on and applied to all texts.

The probability of a word mixes the maximum-likelihood estimates of the pair, of the single word
and of a uniform distribution. The weights depend on how often the context occurs; they are learned
by expectation-maximisation on held-out counts.

No table of the model is ever held whole. Texts are taken in blocks; a block asks for the counts of
its own distinct words and pairs, 64-bit hashes in order, cut by hash range into shards. A shard
adds up what all blocks report and answers each block with the totals in the order of its question,
so that hashes travel once and totals alone come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import small_batches
from rasterlab.session import cut_lineage

#: Context counts are bucketed by powers of two.
_BUCKETS = 24
#: Estimates are binned by quarters and halves of a power of two for the weights' training.
_PAIR_STEPS, _WORD_STEPS = 4, 2
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814E)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text with its end, and the number of tokens of each text."""
    parts, sizes, waiting, size = [], [], [], 0
    for i, t in enumerate(texts):
        waiting.append((t or "").encode("utf-8", "surrogatepass").lower().split())
        size += len(waiting[-1])
        if size > 200_000 or i + 1 == len(texts):
            flat = [w for ws in waiting for w in ws]
            hashed = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.zeros(0, np.uint64)
            lengths = np.array([len(ws) for ws in waiting])
            out = np.full(len(hashed) + len(waiting), _END, np.uint64)
            ends = np.cumsum(lengths + 1) - 1
            mine = np.ones(len(out), bool)
            mine[ends] = False
            out[mine] = hashed
            parts.append(out)
            sizes.append(lengths + 1)
            waiting, size = [], 0
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(sizes)


def _keys(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Even keys of tokens, odd keys of pairs with the token before, and the texts' first places."""
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = _START
    with np.errstate(over="ignore"):
        pairs = _mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)
    return tokens & ~np.uint64(1), pairs | np.uint64(1), starts


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's part of the sorted keys begins, and the end."""
    tops = (np.arange(1, 2**bits, dtype=np.uint64)) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, tops), [len(keys)]])


def _sum(keys: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(keys.sum(dtype=np.uint64).view(np.int64))


def _ask(block: int, texts: list[str | None], train: bool, bits: int) -> pa.RecordBatch:
    uni, pairs, _ = _keys(*_tokens(texts))
    keys, counts = np.unique(np.concatenate([uni, pairs]), return_counts=True)
    counts = counts.astype("<u4") if train else np.zeros(len(keys), "<u4")
    at = _cuts(keys, bits)
    full = [k for k in range(2**bits) if at[k + 1] > at[k]]
    part = lambda x: pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), part(keys), part(counts)],
        ["block", "shard", "keys", "counts"],
    )


def _in_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each row's block: by input partition, place in it and role (held out, fold or other training)."""
    part = TaskContext.get().partitionId() << 24
    filled, number = [0, 0, 0], [0, 0, 0]
    for batch in batches:
        roles = batch.column(2).to_pylist()
        sizes = [0 if x is None else x for x in batch.column(3).to_pylist()]
        out = np.empty(batch.num_rows, np.int64)
        for i, (role, size) in enumerate(zip(roles, sizes)):
            if filled[role] and filled[role] + size > block_bytes:
                filled[role], number[role] = 0, number[role] + 1
            filled[role] += size
            out[i] = (part + number[role]) * 4 + role
        yield out, batch


def _questions(rows: DataFrame, block_bytes: int, bits: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list]] = {}  # of each role: the open block and its texts
        for blocks, batch in _in_blocks(batches, block_bytes):
            for block, t in zip(blocks.tolist(), batch.column(1).to_pylist()):
                role = block & 3
                if role in held and held[role][0] != block:
                    yield _ask(*held.pop(role), role > 0, bits)
                held.setdefault(role, (block, []))[1].append(t)
        for role, (block, texts) in held.items():
            yield _ask(block, texts, role > 0, bits)

    return rows.mapInArrow(ask, "block long, shard int, keys binary, counts binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one shard, for each block in the order of its keys; block -1 has the shard's own sums."""
    keys = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]).astype(np.float64)
    ends = np.cumsum([len(k) for k in keys])
    names, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, counts, len(names))
    role = np.repeat((pdf["block"].to_numpy() & 3), [len(k) for k in keys])
    fold = np.bincount(place, counts * (role == 1), len(names))
    words = (names & np.uint64(1)) == 0
    out = []
    for block, own, end in zip(pdf["block"], keys, ends):
        mine = place[end - len(own) : end]
        both = (total[mine].astype("<u4").tobytes(), fold[mine].astype("<u4").tobytes() if block & 3 == 1 else b"")
        out.append((block, pdf["shard"].iloc[0], *both, len(own), _sum(own), 0, 0, 0))
    out.append((-1, pdf["shard"].iloc[0], b"", b"", 0, 0, int((total[words] > 0).sum()), int(total[words].sum()), int(fold[words].sum())))
    return pd.DataFrame(out, columns=["block", "shard", "total", "fold", "n", "check", "v", "tokens", "fold_tokens"])


def _looked_up(texts: list[str | None], answers: pd.DataFrame):
    """Token arrays of a block: place of each token's text, totals (and fold counts) of word, context and pair."""
    uni, pairs, starts = _keys(*(found := _tokens(texts)))
    sizes = found[1]
    keys = np.unique(np.concatenate([uni, pairs]))
    answers = answers.sort_values("shard")
    if answers["n"].sum() != len(keys) or _sum(keys) != int(np.sum(answers["check"].to_numpy(np.int64))):
        raise RuntimeError("the input gave other rows when it was read again; pass a table that is written")
    place_word, place_pair = np.searchsorted(keys, uni), np.searchsorted(keys, pairs)
    end = np.searchsorted(keys, _END & ~np.uint64(1))

    def of(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers = np.frombuffer(b"".join(answers[column]), "<u4").astype(np.float64)
        word = numbers[place_word]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[starts] = numbers[end]  # as many texts start as end
        return word, context, numbers[place_pair]

    return np.repeat(np.arange(len(sizes)), sizes), sizes, of


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), _BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=np.asarray(b) > 0)


def expectation_maximisation(cells: pd.DataFrame, uniform: float, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) of each context bucket from held-out cells (bucket, p2, p1, n).

    A bucket without held-out counts takes the weights of the nearest one below it, else above.
    """
    weights = np.full((_BUCKETS, 3), np.nan)
    for bucket, part in cells.groupby("bucket"):
        p = np.stack([part.p2, part.p1, np.full(len(part), uniform)], axis=1)
        n, w = part.n.to_numpy(float), np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (n[:, None] * share).sum(axis=0) / n.sum()
            w = np.maximum(w, 1e-6)
            w /= w.sum()
        weights[int(bucket)] = w
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    for b in range(_BUCKETS):
        if not len(known):
            weights[b] = (0.0 if b == 0 else 0.4, 0.5, 0.1)
        elif np.isnan(weights[b, 0]):
            below = known[known < b]
            weights[b] = weights[below[-1] if len(below) else known[0]]
    return weights / weights.sum(axis=1, keepdims=True)


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 10_000_000) -> DataFrame:
    """Scores every text: rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are words between ASCII white space, A-Z lower-cased, and one end. Rows whose
    crc32(doc_id as text) mod 10 is 0 are held out: they are scored but not learned from; those
    with remainder 1 are learned from, and the weights are trained on their counts against
    estimates without them. ``base_score`` is the smoothed word model, ``score`` the interpolated
    model, both log10 of the whole text's probability.

    A null or empty text is its end alone. Every row counts, so repeated rows are learned from
    again; a null doc_id counts as empty text (held out). Without training tokens the word model
    is uniform over one unseen word. The training cells are bounded by buckets and bins, whatever
    the input; everything else grows with it and stays distributed.

    ``docs`` is read three times and must give the same partitions each time, as a table of files
    does; otherwise the task fails rather than mix up counts. A task holds one block of about
    ``block_bytes`` of text (or one longer text), or one shard of keys.
    """
    small_batches(docs.sparkSession)
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10
    role = F.when(crc == 0, 0).when(crc == 1, 1).otherwise(2).cast("int")
    # ids as text, so that pandas leaves ids beside nulls as they are
    named = F.col(doc_id).cast("string").alias("_id")
    rows = docs.select(named, F.col(text).alias("_text"), role.alias("_role"), F.octet_length(text).alias("_size"))
    bits = max(6, int(rows.rdd.getNumPartitions() - 1).bit_length())
    answer_schema = "block long, shard int, total binary, fold binary, n long, check long, v long, tokens long, fold_tokens long"
    answers = cut_lineage(_questions(rows, block_bytes, bits).groupBy("shard").applyInPandas(_answer, answer_schema))
    sums = answers.where("block = -1").agg(F.sum("v"), F.sum("tokens"), F.sum("fold_tokens")).first()
    v, tokens, fold_tokens = (int(x or 0) for x in sums)
    uniform = 1.0 / (v + 1)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, batch in _in_blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(blocks, pa.int64())], ["_id", "_text", "block"])

    schema = "_id string, _text string, block long"
    placed = rows.mapInArrow(numbered, schema)
    totals = answers.where("block >= 0").drop("v", "tokens", "fold_tokens")
    is_fold = F.col("block").bitwiseAND(3) == 1

    def cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, _, of = _looked_up(left["_text"].tolist(), right)
        (word, context, pair), (f_word, f_context, f_pair) = of("total"), of("fold")
        context = context - f_context
        p2, p1 = _ratio(pair - f_pair, context), _ratio(word - f_word, tokens - fold_tokens)
        code = lambda p, steps: np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * steps), -1).astype(np.int64)
        table = pd.DataFrame({"bucket": _bucket(context), "a": code(p2, _PAIR_STEPS), "b": code(p1, _WORD_STEPS)})
        return table.value_counts().rename("n").reset_index()

    held = placed.where(is_fold).groupBy("block").cogroup(totals.where(is_fold).groupBy("block"))
    found = held.applyInPandas(cells, "bucket long, a long, b long, n long").groupBy("bucket", "a", "b").agg(F.sum("n").alias("n"))
    got = pd.DataFrame([tuple(r) for r in found.collect()], columns=["bucket", "a", "b", "n"])
    for name, code, steps in (("p2", "a", _PAIR_STEPS), ("p1", "b", _WORD_STEPS)):
        got[name] = np.where(got[code] >= 0, 2.0 ** (-got[code].astype(float) / steps), 0.0)
    weights = expectation_maximisation(got, uniform)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of_text, sizes, of = _looked_up(left["_text"].tolist(), right)
        word, context, pair = of("total")
        w = weights[_bucket(context)]
        mixed = w[:, 0] * _ratio(pair, context) + w[:, 1] * _ratio(word, max(tokens, 1)) + w[:, 2] * uniform
        base = np.log10((word + 0.1) / (tokens + 0.1 * (v + 1)))
        add = lambda x: np.bincount(of_text, x, len(sizes))
        return pd.DataFrame({
            "id": left["_id"], "held_out": (left["block"] & 3) == 0, "n_tokens": sizes,
            "n_known": add(word > 0).astype(np.int64), "train_tokens": tokens, "base_score": add(base), "score": add(np.log10(mixed)),
        })

    out = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = placed.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, out)
    return scored.withColumn("id", F.col("id").cast(docs.schema[doc_id].dataType)).withColumnRenamed("id", doc_id)
