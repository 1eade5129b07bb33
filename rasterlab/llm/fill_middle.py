"""Fill-in-the-middle examples: a text is cut at two places and its parts change order.

One repeated-capture match cuts a whole text into units: the ends of all repetitions give the
number of units and both places, so only three numbers per text come back from Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.llm.common import packed, small_batches

#: A unit: a word with the white space before it, or white space at the end. Possessive, so that a
#: long text leaves nothing to go back to.
UNITS = r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Number of units, and code points before the smaller and the larger cut."""
    units = regex.compile(UNITS)

    def cut(text: str, a: int, b: int) -> tuple[int, int, int]:
        ends = units.fullmatch(text).ends(1)
        low, high = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
        return len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0

    for texts, a, b in parts:
        yield pd.DataFrame([cut(*row) for row in zip(texts, a, b)], columns=["n", "first", "second"], dtype="int64")


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "42", rate: int = 50, spm_rate: int = 80
) -> DataFrame:
    """Adds ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``fim_text`` to each document.

    Four numbers from the SHA-256 of ``seed:doc_id`` decide: two of them cut after so many units,
    the third keeps ``100 - rate`` of 100 texts plain, the fourth writes ``spm_rate`` of 100 others
    suffix first (``spm``: suffix, prefix, middle), the rest as ``psm`` (prefix, suffix, middle).
    ``restored`` gives the exact text back.

    Null texts are empty. Empty texts, and texts that hold one of the three marks, stay plain;
    plain rows have null ``prefix_chars`` and ``middle_chars``. A null id is hashed as no digits.
    Rows are cut one by one: repeated rows with one id get the same cut. Columns named like the
    added ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "fim_text")
    value = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    drawn = docs.select(packed(docs), value.alias("t"), *[_number(digest, k).alias(f"h{k}") for k in range(4)])
    plain = (F.col("t") == "") | F.col("t").rlike(_MARK) | (F.col("h2") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h3") % 100 < spm_rate, "spm").otherwise("psm")
    cut = drawn.select("_row", "t", form.alias("form"), _cuts("t", "h0", "h1").alias("c")).select("_row", "t", "form", "c.*")
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    parts = {
        PREFIX: F.substring("t", F.lit(1), first),
        MIDDLE: F.substring("t", first + 1, second - first),
        SUFFIX: F.substring("t", second + 1, F.length("t")),
    }
    order = {"spm": [SUFFIX, PREFIX, MIDDLE], "psm": [PREFIX, SUFFIX, MIDDLE]}
    out = F.col("t")
    for name, marks in order.items():
        out = F.when(F.col("form") == name, F.concat(*[c for m in marks for c in (F.lit(m), parts[m])])).otherwise(out)
    moved = F.col("form") != "plain"
    return cut.select(
        "_row.*", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"),
        F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), out.alias("fim_text"),
    )


def restored(fim_text: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone.

    Cut texts hold no mark of their own, and no mark can arise where parts and marks meet.
    """
    parts = F.split(fim_text, _MARK, -1)
    in_order = {"spm": (2, 3, 1), "psm": (1, 3, 2)}
    out = fim_text
    for name, places in in_order.items():
        out = F.when(form == name, F.concat(*[F.get(parts, F.lit(k)) for k in places])).otherwise(out)
    return out
