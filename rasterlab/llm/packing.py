"""Packing of tokenised examples into sequences under several limits at once.

Each example is cut into pieces that a sequence can hold. Pieces are placed by the dot-product
heuristic of vector bin packing: of the pieces that fit into the open sequence, the next is the
one whose demands (tokens, one segment, loss-bearing tokens) have the largest weighted dot
product with the room left.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import small_batches

#: Chunks of these characters alone are cut into the tokenizer's pre-tokens here; they have no
#: other composed form, and lower-casing maps each character by itself.
_PLAIN = re.compile("[\\x21-\\x7E\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF]+")
#: Pre-tokens of the vocabulary file (fixed by it), for such chunks in lower case.
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\u00DF-\\u00F6\\u00F8-\\u00FF]+|[0-9]|[^a-z0-9\\u00DF-\\u00F6\\u00F8-\\u00FF]+")
#: Texts of such chunks and ASCII white space, and their pre-tokens in lower case.
_PLAIN_TEXT = re.compile("[\\x09-\\x0D\\x20-\\x7E\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF]*")
_PRETOKEN_OF_TEXT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\u00DF-\\u00F6\\u00F8-\\u00FF]+|[0-9]|[^\\x09-\\x0D\\x20a-z0-9\\u00DF-\\u00F6\\u00F8-\\u00FF]+")
#: Bytes that the tables of a worker may take, and what an entry takes beside its own bytes.
_CACHED, _ENTRY = 128_000_000, 120
#: Shorter chunks and pre-tokens are met most often.
_SHORT = 8

_LOADED: dict = {}


class WordTokenizer:
    """A tokenizer that never joins characters across white space, with its results by chunk.

    ``encode`` gives the same ids as the tokenizer itself, as little-endian unsigned 32-bit
    numbers. The two tables only save time; when they are full all but short entries go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        """Empties the tables; a worker that waits for its next task holds the vocabulary alone."""
        self.chunks: dict[bytes, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.size = 0

    def _make_room(self, bytes_: int) -> None:
        if self.size + bytes_ <= _CACHED:
            return
        chunks, pretokens = self.chunks, self.pretokens
        self.forget()
        for mine, old in ((self.chunks, chunks), (self.pretokens, pretokens)):
            for k, v in old.items():
                if len(k) <= _SHORT:
                    mine[k] = v
                    self.size += len(k) + len(v) + _ENTRY
            if 2 * self.size > _CACHED:
                self.forget()

    @staticmethod
    def load(path: str) -> WordTokenizer:
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(path)
        return _LOADED[path]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pretokens(self, new: list[str]) -> None:
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, of = np.array(found.ids, "<u4"), np.array(found.word_ids)
            cuts = np.flatnonzero(np.diff(of)) + 1
            if len(cuts) + 1 == len(part):
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                self.pretokens.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                self.pretokens.update((p, self._ids(p)) for p in part)
            self.size += sum(len(p) + len(self.pretokens[p]) + _ENTRY for p in part)

    def _learn(self, chunks: set[bytes]) -> None:
        self._make_room(sum(map(len, chunks)) * 2 + _ENTRY * len(chunks))
        cut = {}
        for chunk in chunks:
            t = chunk.decode("utf-8", "surrogatepass")
            if _PLAIN.fullmatch(t):
                cut[chunk] = _PRETOKEN.findall(t.lower())
            else:
                self.chunks[chunk] = self._ids(t)
        known = self.pretokens
        self._learn_pretokens(list({p for ps in cut.values() for p in ps if p not in known}))
        known = self.pretokens
        self.chunks.update((c, b"".join([known[p] for p in ps])) for c, ps in cut.items())
        self.size += sum(len(c) + len(self.chunks[c]) + _ENTRY for c in chunks)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; no more than a few megabytes of text are split at once.

        Plain texts are cut into pre-tokens as a whole, others chunk by chunk.
        """
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < 2_000_000:
                t = texts[at] or ""
                plain = _PLAIN_TEXT.fullmatch(t) is not None
                split.append((plain, _PRETOKEN_OF_TEXT.findall(t.lower()) if plain else t.encode("utf-8", "surrogatepass").split()))
                size += len(t) + 1
                at += 1
            needed = {c for plain, parts in split if not plain for c in parts}
            new = needed - self.chunks.keys()
            if new:
                # when the table starts anew, chunks met before are needed again
                held = self.chunks
                self._learn(new)
                if held is not self.chunks:
                    self._learn(needed - self.chunks.keys())
            of_chunks = self.chunks  # stays whole when the tables start anew
            known = self.pretokens
            new = {p for plain, parts in split if plain for p in parts if p not in known}
            if new:
                self._make_room(sum(map(len, new)) * 2 + _ENTRY * len(new))
                if known is not self.pretokens:
                    known = self.pretokens
                    new = {p for plain, parts in split if plain for p in parts if p not in known}
                self._learn_pretokens(list(new))
            of_pieces = self.pretokens
            for plain, parts in split:
                yield b"".join(map((of_pieces if plain else of_chunks).__getitem__, parts))


def cut(tokens: int, prompt: int, limits: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Pieces (start, length, loss-bearing tokens) of an example; the first ``prompt`` tokens bear none."""
    most, _, most_loss = limits
    pieces, start = [], 0
    while start < tokens:
        free = max(0, prompt - start)
        length = min(most, tokens - start, free + most_loss)
        pieces.append((start, length, max(0, length - free)))
        start += length
    return pieces


def place(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Dot-product vector packing: the numbers of the items in each bin.

    ``demands`` has a row for each item and no item exceeds ``limits``. Dimensions weigh as much
    as all items together ask of them. Ties go to the first item.
    """
    sizes = [np.ascontiguousarray(demands[:, d]) for d in range(demands.shape[1])]
    weight = (demands / limits).sum(axis=0) / limits**2
    left = np.arange(len(demands))
    bins = []
    while len(left):
        room, mine = [int(x) for x in limits], []
        alive = np.ones(len(left), dtype=bool)
        while True:
            fits = alive.copy()
            value = np.zeros(len(left))
            for d, size in enumerate(sizes):
                fits &= size <= room[d]
                value += size * (weight[d] * room[d])
            value[~fits] = -1.0
            pick = int(np.argmax(value))
            if not fits[pick]:
                break
            mine.append(int(left[pick]))
            alive[pick] = False
            room = [r - int(size[pick]) for r, size in zip(room, sizes)]
        bins.append(mine)
        left = left[alive]
        sizes = [size[alive] for size in sizes]
    return bins


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", prompt: str | None = None,
    max_tokens: int = 2048, max_segments: int = 64, max_loss: int | None = None, end_id: int = 1, block: int = 2048,
) -> DataFrame:
    """Packs all examples into sequences within three limits: tokens, segments, loss-bearing tokens.

    An example is the ids of its prompt (if a column is named) and of its text, then ``end_id``;
    the prompt's ids bear no loss. Returns a row for each piece: doc_id, ``start`` (ids of its
    example before it), ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``loss_tokens``, ``sequence_id`` and ``offset`` (pieces lie in their sequence without gaps).

    A null or empty text is the end id alone. Rows are packed one by one, so nulls and repeats in
    doc_id change nothing; other columns are not read. An empty table gives no pieces.

    Pieces that fill a sequence become one at once; the rest of about ``block`` examples at a time
    is packed together, in the task that reads them: nothing is shuffled, and memory is bounded by
    the block. The same input partition gives the same sequences again when a task is repeated.
    """
    small_batches(docs.sparkSession)
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    named = [F.col(doc_id), F.col(text).alias("_text"), (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("_prompt")]
    chosen = docs.select(*named)
    key = chosen.schema[0]
    columns = ["start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    full = np.array(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.load(tokenizer)
        try:
            yield from packed(batches, coder)
        finally:  # the worker outlives the task
            coder.forget()

    def packed(batches: Iterator[pa.RecordBatch], coder: WordTokenizer) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId()) << 33
        waiting: list[tuple] = []  # pieces: key, start, length, ids, doc_tokens, loss

        def rows(placed: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*placed))
            arrays = [pa.array(c, k) for c, k in zip(cols, [kind, *kinds])]
            return pa.RecordBatch.from_arrays(arrays, [key.name, *columns])

        def flush() -> list[tuple]:
            nonlocal sequence, waiting
            out = []
            demands = np.array([(p[2], 1, p[5]) for p in waiting], dtype=np.int64).reshape(-1, 3)
            for members in place(demands, full):
                offset = 0
                for k in members:
                    out.append((*waiting[k], sequence, offset))
                    offset += waiting[k][2]
                sequence += 1
            waiting = []
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, texts, prompts = (batch.column(i).to_pylist() for i in range(3))
            done = []
            before = coder.encode(prompts) if prompt else iter([b""] * len(keys))
            for k, head, body in zip(keys, before, coder.encode(texts)):
                ids = head + body + end
                n = len(ids) // 4
                for start, length, loss in cut(n, len(head) // 4, limits):
                    piece = (k, start, length, ids[4 * start : 4 * (start + length)], n, loss)
                    if length == max_tokens:
                        done.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(piece)
                if len(waiting) >= block:
                    done += flush()
                if len(done) >= 5000:
                    yield rows(done, kind)
                    done = []
            if done:
                yield rows(done, kind)
        if waiting:
            yield rows(flush(), kind)

    schema = (
        f"`{key.name}` {key.dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, "
        "loss_tokens long, sequence_id long, offset long"
    )
    return chosen.mapInArrow(run, schema)
