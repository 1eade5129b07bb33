"""Finding and removing passages of test items in training text.

A generalised suffix automaton of the items' words is built once. Documents stream through it: at
each word the automaton knows the longest run of words, ending there, that some item contains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.llm.common import small_batches

#: Words, after lower-casing A-Z: ASCII letters and digits, and everything beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the word numbers of test items.

    A window is ``window`` consecutive words of an item, or a whole item that has fewer. ``items``
    gives for a state the numbers of the items that have the state's window.
    """

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.words.setdefault(w, len(self.words)) for w in item] for item in items]
        for item in coded:
            last = 0
            for w in item:
                last = self._extend(last, w)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.anchor = self._anchors()
        for number, item in enumerate(coded):
            state, matched = 0, 0
            for w in item:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    self.items[self.anchor[state]].add(number)
            if 0 < len(item) < window:
                self.whole[state].append((len(item), number))
        # nearest state on the way to the root, itself included, at which a short item ends
        self.short = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = state if self.whole[state] else self.short[self.link[state]]
        sizes = [len(item) for item in coded if item]
        self.least = min([window, *sizes])
        pairs = np.array([(a, b) for item in coded for a, b in zip(item, item[1:])], dtype=np.int64).reshape(-1, 2)
        self.pairs = np.unique(pairs[:, 0] * (len(self.words) + 1) + pairs[:, 1])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _anchors(self) -> list[int]:
        """For states of at least a window: the state of their last ``window`` words."""
        anchor = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= self.window:
                up = self.link[state]
                anchor[state] = state if self.length[up] < self.window else anchor[up]
        return anchor

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], matched + 1
        return 0, 0

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int], int]:
        """Hit words as a mask (None if there are none), items with windows, longest match.

        Only stretches in which every pair of neighbours occurs in some item can hold a window of
        two words or more, so the automaton runs over these alone; matches of fewer words than
        the shortest window are therefore not measured.
        """
        get = self.words.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        if self.least > 1:
            codes = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * (len(self.words) + 1) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, codes), max(len(self.pairs) - 1, 0))
            known = self.pairs[at] == codes if len(self.pairs) else np.zeros(len(codes), bool)
        else:
            known = ids >= 0
        if not known.any():
            return None, set(), 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        more = 1 if self.least > 1 else 0  # a run of n pairs has n + 1 words
        marks, found, longest = None, set(), 0
        for first, end in zip(edges[::2], edges[1::2] + more):
            if end - first < self.least:
                continue
            state = matched = 0
            for i in range(first, end):
                state, matched = self.step(state, matched, int(ids[i]))
                longest = max(longest, matched)
                width = self.window if matched >= self.window else 0
                if width:
                    found |= self.items[self.anchor[state]]
                s = self.short[state]
                while s:
                    for n, number in self.whole[s]:
                        if n <= matched:
                            found.add(number)
                            width = max(width, n)
                    s = self.short[self.link[s]]
                if width:
                    if marks is None:
                        marks = np.zeros(len(words) + 1, dtype=np.int32)
                    marks[i - width + 1] += 1
                    marks[i + 1] -= 1
        return (np.cumsum(marks[:-1]) > 0 if marks is not None else None), found, longest


def _without(text: str, hit: np.ndarray, least: int) -> str:
    """The text without runs of at least ``least`` hit words and what stands between their words."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    kept, at = [], 0
    for first, end in zip(edges[::2], edges[1::2]):
        if end - first >= least:
            kept.append(raw[at : spans[first][0]])
            at = spans[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, min_span: int = 1, max_coverage: float = 0.5, clean: bool = True, max_chars: int = 100_000_000,
) -> DataFrame:
    """Marks every document word inside any occurrence of a window of a test item.

    Adds ``n_words``, ``n_hit``, ``items`` (ids of items with occurring windows, sorted as
    strings), ``longest_match``, ``over_limit`` (more than ``max_coverage`` of the words hit) and,
    unless ``clean`` is false, ``clean_text`` (without hit runs of at least ``min_span`` words) to
    the columns of ``docs``; columns of these names are replaced. Each row is judged on its own.

    A null or empty text has no words and stays as it is; items without words have no windows;
    windows of items without an id mark words, but no id can be listed. Equal items are all
    listed.

    The automaton is held on the driver and by each task. ``max_chars`` bounds the test items; a
    larger benchmark is refused, not cut: call this once for each block of items then.
    """
    small_batches(docs.sparkSession)
    chosen = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = chosen.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > max_chars:
        raise ValueError(f"test items of {size} characters; the limit of a call is {max_chars}")
    rows = sorted(chosen.collect(), key=lambda r: (r.i or "", r.t or ""))
    automaton = SuffixAutomaton([normal_words(r.t) for r in rows], window)
    shared = docs.sparkSession.sparkContext.broadcast((automaton, [r.i for r in rows]))
    docs = docs.drop("n_words", "n_hit", "items", "longest_match", "over_limit", "clean_text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids = shared.value
        for batch in batches:
            added: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "items", "longest_match", "over_limit")}
            cleaned = []
            for value in batch.column(text):
                t = value.as_py()
                found_words = normal_words(t)
                hit, found, longest = machine.scan(found_words)
                n_hit = 0 if hit is None else int(hit.sum())
                added["n_words"].append(len(found_words))
                added["n_hit"].append(n_hit)
                added["items"].append(sorted({ids[k] for k in found if ids[k] is not None}))
                added["longest_match"].append(longest)
                added["over_limit"].append(n_hit > max_coverage * len(found_words))
                if clean:
                    cleaned.append(t if hit is None else _without(t, hit, min_span))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_())
            arrays = [pa.array(v, k) for v, k in zip(added.values(), kinds)] + [pa.array(cleaned, pa.string())] * clean
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added, *["clean_text"] * clean])

    schema = T.StructType([*docs.schema.fields]).add("n_words", "long").add("n_hit", "long")
    schema = schema.add("items", T.ArrayType(T.StringType())).add("longest_match", "long").add("over_limit", "boolean")
    return docs.mapInArrow(scan, schema.add("clean_text", "string") if clean else schema)
