"""Toxicity by compression: what dictionary of two shortens the windows of a text more?

One zstandard dictionary is trained on ordinary text, another on toxic text. Most of what the
second one holds is ordinary too, so its segments are judged one by one, on windows of documents
that it was not trained on: only those that shorten toxic windows more than ordinary ones stay.
Both dictionaries then share the ordinary content, and the difference of a window's two compressed
lengths is what toxic content alone has saved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import packed, small_batches
from rasterlab.session import cut_lineage

_FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
_LEVEL = 3
_SEGMENT = 16  # bytes of a segment that the trainer picks
_MAGIC, _TABLES = b"\x37\xa4\x30\xec", 256  # a trained dictionary starts with it, and with entropy tables
_REACH = 20  # differences beyond it count as it
_CELLS = 2 * _REACH + 1


def windows(text: str | None, size: int) -> Iterator[bytes]:
    """Neighbouring pieces of at most ``size`` bytes of the lower-cased text, cut before a space where there is one."""
    data, at = (text or "").lower().encode(), 0
    while len(data) - at > size:
        end = data.rfind(b" ", at + 1, at + size)
        end = at + size if end < 0 else end
        yield data[at:end]
        at = end
    yield data[at:]


def compressor(content: bytes, size: int) -> zstandard.ZstdCompressor:
    """For pieces of about ``size`` bytes; without content, one without a dictionary."""
    params = zstandard.ZstdCompressionParameters.from_level(_LEVEL, source_size=size, dict_size=len(content), min_match=3, **_FRAME)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too few samples to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=_SEGMENT, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Two dictionaries, a weight for each difference of lengths, and the calibrated logistic curve."""

    ordinary: bytes
    toxic: bytes
    window: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_CELLS))
    slope: float = 0.0
    offset: float = -np.inf

    def reader(self):
        """A function from a text to the number of its windows at each difference of lengths."""
        plain, toxic = compressor(self.ordinary, self.window), compressor(self.ordinary + self.toxic, self.window)

        def counts(text: str | None) -> np.ndarray:
            saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text, self.window)]
            return np.bincount(np.clip(saved, -_REACH, _REACH) + _REACH, minlength=_CELLS)

        return counts

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.offset):
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -700, 700)))


def _sample(docs: DataFrame, size: int, n: int) -> list[bytes]:
    """The ``n`` windows with the smallest hashes of text and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf.key, pdf.t):
                pieces = [w for w in windows(text, size) if 2 * len(w) > size]
                yield pd.DataFrame({"key": np.int64(key), "place": np.arange(len(pieces), dtype=np.int64), "w": pieces})

    cut = docs.select("key", "t").mapInPandas(run, "key long, place long, w binary")
    return [bytes(r.w) for r in cut.select(F.xxhash64("key", "place").alias("h"), "w").orderBy("h", "w").limit(n).collect()]


def _telling(docs: DataFrame, content: bytes, toxic: list[bytes], ordinary: list[bytes], size: int, least: float) -> bytes:
    """The segments of a dictionary that shorten toxic windows more than ordinary ones, the best last.

    ``least`` is the least difference of the mean gains in standard errors.
    """
    if not toxic or not ordinary or len(content) < _SEGMENT:
        return b""
    spark = docs.sparkSession
    start = _TABLES if content.startswith(_MAGIC) else 0
    pieces = [bytearray(content[i : i + _SEGMENT]) for i in range(start, len(content) - _SEGMENT + 1, _SEGMENT // 2)]
    held = spark.sparkContext.broadcast((toxic, ordinary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bare = compressor(b"", size)
        alone = [np.array([len(bare.compress(w)) for w in part]) for part in held.value]

        def score(piece: bytes, share: int) -> float:
            own = compressor(piece, size)
            parts = [part[: -(-len(part) // share)] for part in held.value]
            gains = [n[: len(part)] - np.array([len(own.compress(w)) for w in part]) for n, part in zip(alone, parts)]
            error = np.sqrt(sum(g.var() / len(g) for g in gains) + 1e-9)
            return (gains[0].mean() - gains[1].mean()) / error

        for pdf in batches:
            # what gains nothing on a quarter of the windows need not be tried on all
            early = [score(bytes(p), 4) for p in pdf.piece]
            yield pdf.assign(score=[score(bytes(p), 1) if s > 0 else s for p, s in zip(pdf.piece, early)])

    tasks = max(1, spark.sparkContext.defaultParallelism * 2)
    judged = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "i int, piece binary").repartition(tasks)
    rows = judged.mapInPandas(run, "i int, piece binary, score double").where(F.col("score") > least).collect()
    return b"".join(bytes(r.piece) for r in sorted(rows, key=lambda r: (r.score, r.i)))


def _curve(evidence: np.ndarray, label: np.ndarray, n: np.ndarray, false_cost: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve; both classes weigh the same, ordinary ones ``false_cost`` times."""
    weight = n * np.where(label == 1, 1 / n[label == 1].sum(), false_cost / n[label == 0].sum())
    centre, scale = np.average(evidence, weights=weight), max(evidence.std(), 1e-9)
    x, w = np.stack([(evidence - centre) / scale, np.ones(len(evidence))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (label - p)) - 1e-6 * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-6 * np.eye(2), gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[0] / scale
    # a text without evidence for toxicity is never called toxic, however short it is
    return slope, min(w[1] - slope * centre, -slope * 0.5)


def train(
    docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, held_out: Column, trained_docs: int, trained_windows: int,
    judged_windows: int, window: int, dictionary: int, false_cost: float,
) -> Model:
    """Fits the model on a bounded sample of labelled documents that are not held out.

    Of each label the ``trained_docs`` documents with the smallest id hashes count. Either half of
    the toxic ones trains a dictionary (``trained_windows`` windows), whose segments are judged on
    ``judged_windows`` windows of each label from the other half; all documents calibrate.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out).groupBy("id").agg(F.max("y").alias("y")).withColumn("key", F.xxhash64(F.col("id").cast("string")))
    chosen = cut_lineage(known.where("y = 1").orderBy("key").limit(trained_docs).unionByName(known.where("y = 0").orderBy("key").limit(trained_docs)))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null")
    # at most 2 * trained_docs rows
    sample = cut_lineage(texts.join(F.broadcast(chosen), "id").select("key", "y", "t"))
    of = lambda y, half: sample.where((F.col("y") == y) & (F.pmod("key", F.lit(2)) == half))
    base = trained(_sample(sample.where("y = 0"), window, trained_windows), dictionary // 4)
    content = b""
    for half in (0, 1):
        judged = [_sample(of(y, 1 - half), 2 * window, judged_windows) for y in (1, 0)]
        content += _telling(docs, trained(_sample(of(1, half), window, trained_windows), dictionary), *judged, 2 * window, 3.0)
    model = Model(base, content, window)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = model.reader()
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "counts": [counts(t) for t in pdf.t]})

    counted = cut_lineage(sample.select("y", "t").mapInPandas(count, "y int, counts array<long>"))
    share = counted.select("y", F.posexplode(F.transform("counts", lambda c: c / F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n))).alias("cell", "v"))
    seen = np.full((2, _CELLS), 0.5)
    for r in share.groupBy("y", "cell").agg(F.sum("v").alias("v")).collect():
        seen[r.y, r.cell] += r.v
    model.weights = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    total = F.aggregate(F.zip_with("counts", weights, lambda c, w: c * w), F.lit(0.0), lambda s, v: s + v)
    # one row for each label and rounded value, no more than documents of the sample
    points = counted.groupBy("y", F.round(total, 2).alias("e")).agg(F.count(F.lit(1)).alias("n")).orderBy("y", "e").collect()
    y, e, n = (np.array([r[k] for r in points], float) for k in range(3))
    if len(set(y)) == 2:
        model.slope, model.offset = _curve(e, y, n, false_cost)
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", held: int = 5, trained_docs: int = 6000,
    trained_windows: int = 30_000, judged_windows: int = 3000, window: int = 64, dictionary: int = 16_384, false_cost: float = 3.0,
) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (score >= 0.5).

    Documents whose crc32(id as text) is divisible by ``held`` are held out, their labels are never
    read. The whole text is cut into windows of ``window`` bytes; each difference between its
    lengths under both dictionaries weighs as the log ratio of its frequencies in toxic and in
    ordinary training documents, and the sum of a document's weights is placed on a logistic curve.
    The curve gives both labels the same weight and an ordinary document called toxic that of
    ``false_cost`` missed ones. Training reads a bounded sample (see ``train``); scoring reads all.

    Null and empty texts are one empty window. Labels other than 0 and 1 and null ids are not
    learned from, an id labelled both ways counts as toxic; a null id is held out. Without
    documents of both labels to learn from, all scores are 0. Rows are scored one by one, so ids
    may repeat. Columns named like the added ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    is_held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % held == 0, F.lit(True))
    model = train(docs, labels, text, doc_id, label, is_held("id"), trained_docs, trained_windows, judged_windows, window, dictionary, false_cost)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = model.reader()
        for texts in parts:
            yield pd.Series(model.probability(np.array([counts(t) @ model.weights for t in texts], float)))

    scored = docs.select(packed(docs), is_held(doc_id).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return scored.select("_row.*", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
