"""Quality rules and a log-likelihood ratio of hashed n-grams, in DataFrame expressions alone.

Two multinomials over hashed words and word pairs are compared: one of trusted documents, one of
the raw corpus. A document's score is the mean log ratio of its n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.llm.common import SPACES, let, packed, words
from rasterlab.session import cut_lineage

SYMBOLS = "#*$%&|<>"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def _bytes_of(text: Column, chars: str) -> Column:
    """How many of some ASCII characters a text has."""
    return sum(
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)
    ).cast("long")


def _duplicate_lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    return let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(windows: Column, width: int) -> Column:
    """Words inside windows whose hash stands at two places or more; ``windows`` is in text order."""
    sorted_pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twin = lambda k, x: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        return F.filter(s, lambda x, k: twin(k - 1, x) | twin(k + 1, x))

    starts = let(sorted_pairs, lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
    gaps = lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return let(starts, lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda n, g: n + g))


def _repeated_words(hashes: Column, width: int) -> Column:
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    counted = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w, width)),
    )
    return F.when(n <= width, F.lit(0).cast("long")).otherwise(counted)


def _parts(hashes: Column, buckets: int) -> tuple[Column, Column]:
    """Buckets of all words, and of all pairs of neighbours (the last word with the text's end)."""
    pairs = F.zip_with(hashes, F.slice(hashes, 2, F.size(hashes)), lambda a, b: F.pmod(F.xxhash64(a, b, F.lit(2)), F.lit(buckets)))
    return F.transform(hashes, lambda a: F.pmod(a, F.lit(buckets))), pairs


def _ngrams(hashes: Column, buckets: int) -> Column:
    return F.concat(*_parts(hashes, buckets))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str, doc_id: str, buckets: int) -> DataFrame:
    """One row with an array of ``buckets`` log ratios, both multinomials with one added to each count.

    ``trusted`` has a column ``_id`` of bounded length. The raw multinomial counts every row.
    """
    grams = (
        docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
        .join(F.broadcast(trusted.select("_id")), F.col("_doc") == F.col("_id"), "left")
        .select(F.col("_id").isNotNull().cast("long").alias("_t"), F.explode(_ngrams_of(F.col("_text"), buckets)).alias("_b"))
        .groupBy("_b")
        .agg(F.sum("_t").alias("_t"), F.count(F.lit(1)).alias("_r"))
    )
    every = docs.sparkSession.range(buckets).join(grams, F.col("id") == F.col("_b"), "left")
    whole = every.select("id", F.coalesce("_t", F.lit(0)).alias("t"), F.coalesce("_r", F.lit(0)).alias("r")).agg(
        F.sort_array(F.collect_list(F.struct("id", "t", "r"))).alias("a"), F.sum("t").alias("t"), F.sum("r").alias("r")
    )
    ratio = lambda x: F.log((x["t"] + 1) / (F.col("t") + buckets)) - F.log((x["r"] + 1) / (F.col("r") + buckets))
    return whole.select(F.transform("a", ratio).alias("ratios"))


def _ngrams_of(text: Column, buckets: int) -> Column:
    return let(_hashes(text), lambda h: _ngrams(h, buckets))


def _mean_ratio(hashes: Column, ratios: Column, buckets: int) -> Column:
    """Words and pairs are summed one after the other, so that no array holds both."""
    total = sum(F.aggregate(part, F.lit(0.0), lambda s, b: s + F.get(ratios, b.cast("int"))) for part in _parts(hashes, buckets))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes)))


def best_cut(scores: DataFrame, lost_trusted: float, slices: int = 256) -> DataFrame:
    """One row with the threshold ``s`` for scores of labelled documents (``s``, ``good`` or not).

    A threshold errs by each good score under it and each bad one that is not. Of those that lose
    at most the share ``lost_trusted`` of the good, it is the one with the fewest errors, of equal
    ones the lowest; without bad scores, the highest. It is null without good scores.

    Distinct scores are counted in slices between sketch quantiles, so no task holds them all.
    """
    counts = cut_lineage(scores.groupBy("s").agg(
        F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")
    ))
    bounds = counts.agg(F.percentile_approx("s", [k / slices for k in range(1, slices)], 10_000).alias("q"))
    placed = counts.withColumn("_q", bounds.scalar()).select(
        "s", "g", "b", F.size(F.filter("_q", lambda q: q <= F.col("s"))).alias("slice")
    )
    totals = placed.groupBy("slice").agg(F.sum("g").alias("_g"), F.sum("b").alias("_b"))
    # at most as many rows as slices
    upto, every = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    starts = totals.select(
        "slice", *[F.coalesce(F.sum(f"_{c}").over(upto), F.lit(0)).alias(f"{c}_start") for c in "gb"],
        *[F.sum(f"_{c}").over(every).alias(f"{c}_all") for c in "gb"],
    )
    inside = Window.partitionBy("slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    under = placed.select("s", "slice", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in "gb"])
    cuts = under.join(starts, "slice").select(
        "s", "g_all", "b_all", *[(F.col(f"{c}_start") + F.col(f"{c}_inside")).alias(f"{c}_under") for c in "gb"]
    )
    errors = F.col("g_under") + F.col("b_all") - F.col("b_under")
    order = F.struct(F.when(F.col("b_all") > 0, errors).otherwise(-F.col("g_under")), F.col("s"))
    allowed = cuts.where((F.col("g_all") > 0) & (F.col("g_under") <= F.floor(F.col("g_all") * F.lit(lost_trusted))))
    return allowed.agg(F.min_by("s", order).alias("s"))


def judge_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", trusted_rows: int = 20_000,
    buckets: int = 65_536, lost_trusted: float = 0.001, width: int = 8,
    min_words: int = 20, max_repeat_percent: int = 30,
) -> DataFrame:
    """Adds rule counts, the verdict of the rules, the score and the final verdict to each document.

    ``labels`` has a row for each labelled document: its id and ``quality``, 1 for trusted ones
    and 0 for bad ones; ids labelled both ways count as bad. Other labels, such as ``toxic``, are
    not looked at: a toxic document of quality 1 is trusted. The trusted multinomial is fitted on
    half of a sample of ``trusted_rows`` trusted documents (those with the smallest id hashes); all
    others are held out. The raw multinomial counts all documents. ``score`` is the mean log ratio
    over a document's words and pairs. The threshold is the one that errs least between the
    held-out and the bad documents which pass the rules, of those that lose at most the share
    ``lost_trusted`` of the former, see ``best_cut``. The same threshold holds for every document,
    and a score equal to it is kept.

    Null and empty texts have no words: zero counts, no score, rules failed, not kept. Rows that
    share a doc_id, or have none, are judged one by one; only the labels are looked up by id.
    Without held-out documents there is no threshold and the rules alone decide. Columns of the
    added names are replaced.

    Each document is scored once: rows, counts and scores are written to the shared folder.
    """
    docs = docs.drop(*ADDED)
    known = labels.where(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        (F.min("quality") == 1).alias("good")
    )
    sample = known.where("good").select("_id").orderBy(F.xxhash64("_id"), "_id").limit(trusted_rows)
    fit = cut_lineage(sample.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)) == 0))
    ratios = cut_lineage(log_ratios(docs, fit, text, doc_id, buckets))
    value = F.col("_text")
    filled = F.coalesce(value, F.lit(""))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    # the table of ratios is one value of the plan: the optimizer puts it where _ratios is used
    scored = cut_lineage(
        docs.select(packed(docs), F.col(text).alias("_text"), ratios.scalar().alias("_ratios"))
        # hashes become a column: eight bytes a word while the rest is worked out, and no words
        .select("_row", "_text", "_ratios", _hashes(value).alias("_h"))
        .select(
            "_row",
            F.size("_h").cast("long").alias("n_words"),
            (F.length(filled).cast("long") - _bytes_of(filled, SPACES)).alias("word_chars"),
            _bytes_of(filled, SYMBOLS).alias("n_symbols"),
            _duplicate_lines(filled).alias("n_dup_lines"),
            _repeated_words(F.col("_h"), width).alias("n_repeat_words"),
            _mean_ratio(F.col("_h"), F.col("_ratios"), buckets).alias("score"),
        )
        .withColumn("base_failed", failed)
    )
    held = known.join(fit, "_id", "left_anti")
    passed = scored.where("not base_failed").select(F.col("_row")[doc_id].alias("_doc"), F.col("score").alias("s"))
    threshold = cut_lineage(best_cut(passed.join(held, F.col("_doc") == F.col("_id")), lost_trusted))
    over = (F.col("score") >= F.col("_cut")) | F.col("_cut").isNull()
    return (
        scored.withColumn("_cut", threshold.scalar())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(over, F.lit(False)))
        .select("_row.*", *ADDED)
    )
