"""URL verdicts by host and path rules, and by logistic regression where no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlab.llm.common import let, lowered, packed
from rasterlab.session import cut_lineage

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (verdict and host with path) for this host or a domain above it."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(at + start).alias("rule"))).otherwise(out)
    return out


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of a marked and bounded string."""
    s = F.concat(F.lit(mark + "^"), text, F.lit("$"))

    def of(n: int) -> Column:
        def cut(x: Column) -> Column:
            grams = F.transform(F.sequence(F.lit(2), F.length(x) - n + 1), lambda i: F.concat(F.lit(mark), F.substring(x, i, n)))
            return F.when(F.length(x) > n, grams).otherwise(F.array().cast("array<string>"))

        return let(s, cut)

    return F.concat(*map(of, sizes))


def train(table: DataFrame, features: int, iterations: int, penalty: float):
    """A model from rows (grams, label); None if there are not both labels."""
    both = table.agg(F.min("label"), F.max("label")).first()
    if both[0] is None or both[0] == both[1]:
        return None
    vectors = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True).transform(table)
    fit = LogisticRegression(maxIter=iterations, regParam=penalty, featuresCol="features", labelCol="label")
    return fit.fit(vectors.coalesce(1))


def judge_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", trained_rows: int = 4000, sizes: tuple[int, ...] = (3, 4),
    features: int = 16_384, iterations: int = 30, penalty: float = 0.01, otherwise: str = "allow",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``block_probability`` and ``verdict`` (allow or block).

    Where a rule fits, the longest decides. The rest is judged by logistic regression on hashed
    character n-grams of host and path. It is trained on distinct host and path pairs that a rule
    labels: at most ``trained_rows`` for each verdict, those with the smallest hashes. From a
    probability of one half on, a page is blocked.

    Null urls, and urls without ``://``, have an empty host and path; no rule fits them and the
    model judges them like any other. If the rules label no pages, or all alike, there is no
    model: ``otherwise`` is the verdict and the probability is null. Rows are judged one by one,
    so repeats and null ids change nothing. Columns of the added names are replaced.
    """
    added = ["host", "path", "rule", "block_probability", "verdict"]
    pages = pages.drop(*added)
    placed = pages.select(packed(pages), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = placed.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    known = ruled.where("_rule is not null").select("host", "path", (F.col("_rule.verdict") == "block").cast("double").alias("label")).distinct()
    hashed = known.withColumn("_h", F.xxhash64("host", "path"))
    grams = F.concat(_grams(F.col("host"), "h", sizes), _grams(F.col("path"), "p", sizes))
    sample = None
    for label in (0.0, 1.0):
        part = hashed.where(F.col("label") == label).orderBy("_h", "host", "path").limit(trained_rows)
        sample = part if sample is None else sample.unionByName(part)
    table = cut_lineage(sample.select("_h", "label", grams.alias("grams"))).orderBy("_h", "label")
    model = train(table, features, iterations, penalty)
    if model is None:
        scored = ruled.withColumn("block_probability", F.lit(None).cast("double"))
    else:
        hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
        out = model.transform(hashing.transform(ruled.withColumn("grams", grams)))
        scored = out.withColumn("block_probability", vector_to_array("probability")[1])
    by_model = F.when(F.col("block_probability") >= 0.5, "block").when(F.col("block_probability").isNotNull(), "allow").otherwise(otherwise)
    return scored.select(
        "_row.*", "host", "path", F.col("_rule.rule").alias("rule"), "block_probability",
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"),
    )
