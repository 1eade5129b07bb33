"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it to the shared folder
as Parquet and reads it again for the next one. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlab.llm import decontamination, line_dedup, near_dedup, packing, quality
from rasterlab.llm.common import table
from rasterlab.llm.queries import tokenizer_path
from rasterlab.session import cut_lineage

#: No SQL: quality and packing depend on fitted tables and on a tokenizer.
ORACLE_SQL = None


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the rest as one column, which no helper column of an operator can clash with."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("no_text"), *([F.struct(*rest).alias("of")] if rest else [])).alias("rest"))


def _wide(kept: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of documents again; with another text, ``n_chars`` is counted anew and null stays null."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text)}
    if text != "text":
        new["text"] = F.when(~F.col("rest.no_text"), F.col(text))
        new["n_chars"] = F.length(new["text"]).cast("long")
    return kept.select(*[(new[c] if c in new else F.col("rest.of")[c]).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that neither the rules nor the likelihood ratio reject.

    Null and empty texts have no words and go. Every row is judged by itself: repeated rows stay
    or go together, a null id only has no label, and a score equal to the threshold stays. An
    empty table stays empty. Other columns, whatever their names, come through unchanged.
    """
    judged = quality.judge_quality(_narrow(docs), table(spark, sf_dir, "labels"))
    return _wide(judged.where("kept"), docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of at least three documents but for one; a document left without words goes.

    The largest doc_id keeps a line. Documents that lose nothing stay as they are, null and empty
    texts too. Rows with one id are one document to the count of a line, rows without an id lose
    none. Other columns come through unchanged, but for n_chars.
    """
    kept = line_dedup.drop_shared_lines(_narrow(docs))
    changed = kept.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return _wide(changed, docs.columns, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, similarity 0.8 or more).

    Texts without words, null ones too, are like no other and stay; so do rows without an id. All
    rows with the kept id stay. Other columns come through unchanged.
    """
    return _wide(near_dedup.link_near_duplicates(_narrow(docs), shingle=5).where("kept"), docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of test items; documents that are mostly such passages go.

    Every row is searched by itself; null and empty texts hold no passage and stay. Documents
    without a passage keep their text to the last character. Items without words, or a benchmark
    without items, remove nothing. Other columns come through unchanged, but for n_chars.
    """
    found = decontamination.decontaminate(_narrow(docs), table(spark, sf_dir, "benchmark"))
    return _wide(found.where("not over_limit"), docs.columns, "clean_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, a row for each piece of a document.

    A null or empty text is its end id alone. Every row is packed by itself, repeated ones too; ties
    go to the piece read first. An empty table gives no pieces. Other columns are not read.
    """
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", shared_lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
