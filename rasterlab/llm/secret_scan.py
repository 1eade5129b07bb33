"""Secrets in text: fixed patterns, and a pair of character Markov models, in DataFrame expressions.

One model is trained on random strings (what the patterns caught), the other on ordinary words and
identifiers. A token is reported if the first explains it better by enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import let, packed
from rasterlab.session import cut_lineage

#: kind, pattern, group whose length counts, least length, what every text with a long match has
#: (fixed values)
PATTERNS = [
    (
        "assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6,
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}",
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
]
KINDS = [*[p[0] for p in PATTERNS], "markov"]
_CODES = 128
_DRAWN = 20.0  # how many transitions the distribution of single characters counts for
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _matches(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches that are long enough.

    The pieces between matches and the matches themselves alternate, so their lengths add up to
    places.
    """
    parts = F.zip_with(
        F.split(text, pattern),
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        ),
        lambda piece, m: F.struct(F.length(piece).alias("before"), F.length(m["m"]).alias("own"), F.length(m["g"]).alias("counts")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(s: Column, p: Column) -> Column:
        at = s["at"] + p["before"]
        end = at + p["own"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        spans = F.when(p["counts"] >= least, F.array_append(s["spans"], span)).otherwise(s["spans"])
        return F.struct(F.coalesce(end, at).alias("at"), spans.alias("spans"))

    return F.aggregate(parts, start, add, lambda s: s["spans"])


def _base_spans(text: Column) -> Column:
    found = []
    for rank, (_, pattern, group, least, needed) in enumerate(PATTERNS):
        some = _matches(text, pattern, group, least, rank)
        found.append(F.when(text.rlike(needed), some).otherwise(F.array().cast(_SPAN)))
    return F.concat(*found)


def _masked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that all other places stay where they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        begin = F.greatest(s["at"], x["start"])
        out = F.concat(s["out"], F.substring(text, s["at"] + 1, begin - s["at"]), F.repeat(F.lit(" "), x["end"] - begin))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(F.sort_array(spans), start, add, rest))


def _transitions(s: Column) -> Column:
    """Codes of neighbouring characters, from the string's start on; other than ASCII is code 127."""
    codes = F.transform(F.split(s, ""), lambda c: F.least(F.ascii(c), F.lit(_CODES - 1)))
    return let(codes, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), c), c, lambda a, b: a * _CODES + F.coalesce(b, F.lit(0))))


def _sum(cells: Column, field: str) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s + x[field])


def train_markov(docs: DataFrame, text: str, doc_id: str, sample_docs: int) -> DataFrame:
    """One row with an array of log ratios of transition probabilities, random over ordinary.

    Labelled samples come from at most ``sample_docs`` documents, those with the smallest id
    hashes: what the patterns catch is random, words and plain numbers outside of it are ordinary.
    """
    # ids may repeat or be null; the hash of the id and of the text decides then
    keyed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(doc_id).cast("string"), F.xxhash64(text)).alias("key"), F.col(text).alias("t"))
    chosen = cut_lineage(keyed.select("key").distinct().orderBy("key").limit(sample_docs))
    # equal ids with equal texts count once, so that no more than sample_docs texts are read
    sample = keyed.join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"]).select("t")
    spans = sample.select("t", _base_spans(F.col("t")).alias("s"))
    caught = spans.select(
        F.lit(1).alias("c"), F.explode(F.transform("s", lambda x: F.substring(F.col("t"), x["start"] + 1, x["end"] - x["start"]))).alias("w")
    ).select("c", F.regexp_extract("w", r"([A-Za-z0-9+/_=-]+)$", 1).alias("w")).where(F.length("w") >= 8)
    plain = F.regexp_replace("t", PATTERNS[0][1], " ")
    ordinary = sample.select(F.lit(0).alias("c"), F.explode(F.regexp_extract_all(plain, F.lit(r"\b([A-Za-z][A-Za-z_-]{3,}|[0-9][0-9/+-]*)\b"), F.lit(1))).alias("w"))
    moves = caught.unionByName(ordinary).select("c", F.explode(_transitions(F.col("w"))).alias("k"))
    counts = moves.groupBy("k").agg(F.sum("c").alias("r"), F.sum(1 - F.col("c")).alias("o"))
    every = docs.sparkSession.range(_CODES * _CODES).join(counts, F.col("id") == F.col("k"), "left")
    whole = every.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in "ro"]).agg(
        F.sort_array(F.collect_list(F.struct("id", "r", "o"))).alias("a")
    )

    places = F.sequence(F.lit(0), F.lit(_CODES - 1))

    def sums(cells: Column) -> Column:
        return F.struct(*[_sum(cells, c).alias(c) for c in "ro"])

    def share(x: Column, n: Column, all_: Column, alone: Column, c: str) -> Column:
        """Probability of a character after another, drawn towards that of the character alone."""
        own = (alone[c] + 0.5) / (all_[c] + 0.5 * _CODES)
        return (x[c] + _DRAWN * own) / (n[c] + _DRAWN)

    column = F.transform(places, lambda j: sums(F.transform(places, lambda i: F.get(F.col("a"), i * _CODES + j))))
    table = whole.select("a", column.alias("alone"), sums(F.col("a")).alias("all_"))

    def row(i: Column) -> Column:
        def of(mine: Column, n: Column) -> Column:
            return F.transform(
                mine,
                lambda x, j: let(F.get(F.col("alone"), j), lambda one: F.log(
                    share(x, n, F.col("all_"), one, "r") / share(x, n, F.col("all_"), one, "o")
                )),
            )

        return let(F.slice(F.col("a"), i * _CODES + 1, _CODES), lambda mine: let(sums(mine), lambda n: of(mine, n)))

    return table.select(F.flatten(F.transform(places, row)).alias("ratios"))


def find_secrets(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = 20_000,
    least_length: int = 10, least_ratio: float = 12.0,
) -> DataFrame:
    """Adds ``spans`` to each document: array of (start, end, kind), by start, then kind.

    Kinds assign, access and hex are fixed patterns. Kind markov are maximal runs of
    ``[A-Za-z0-9+/_=-]`` in what the others leave, ``least_length`` characters or more, whose
    log-likelihood ratio between the models (natural logarithm) is at least ``least_ratio``. Of
    runs so short that not every random string can reach it, the ratio decides, not the length.
    A run beside a span of another kind is judged by what is left of it. Places are code points, the end exclusive. Both models are
    fitted on a bounded sample, see ``train_markov``; every text is searched whole.

    Null and empty texts have no spans. Rows are searched one by one, so ids may repeat or be
    null. A column called ``spans`` is replaced.
    """
    token = "[A-Za-z0-9+/_=-]{%d,}" % least_length
    docs = docs.drop("spans")
    ratios = cut_lineage(train_markov(docs, text, doc_id, sample_docs))
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(packed(docs), value.alias("_text"), _base_spans(value).alias("_base"))
    found = found.select("_row", "_text", "_base", _masked(F.col("_text"), F.col("_base")).alias("_left"), ratios.scalar().alias("_ratios"))

    def score(span: Column) -> Column:
        moves = _transitions(F.substring(F.col("_left"), span["start"] + 1, span["end"] - span["start"]))
        return F.aggregate(moves, F.lit(0.0), lambda s, k: s + F.get(F.col("_ratios"), k))

    left = F.col("_left")
    tokens = F.when(left.rlike(token), _matches(left, token, 0, least_length, len(PATTERNS))).otherwise(F.array().cast(_SPAN))
    apart = F.filter(tokens, lambda t: score(t) >= least_ratio)
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(
        F.sort_array(F.concat("_base", apart)),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["rank"]).alias("kind")),
    )
    return found.select("_row", named.alias("_spans")).select("_row.*", F.col("_spans").alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
