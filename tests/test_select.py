"""Radix selection against the built-in percentile, bit by bit."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlab.functions import select
from rasterlab.functions.joins import attach
from rasterlab.functions.order import levels
from rasterlab.functions.select import ordered_code, quantiles_by_radix

PROBS = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "m": 0.5, "p95": 0.95, "top": 1.0}
EDGE = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), -1.0, 3.0, 0.1, 1e308,
        1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 2.0**1023, np.nextafter(2.0**1023, 0), 8.0, np.nextafter(8, 0)]


def bits(v):
    return None if v is None else struct.pack("<d", v)


def builtin(df, keys, value, weight=None):
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in PROBS.values()]), F.col(weight) if weight else F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("q"))


def same_bits(df, keys, value, weight=None):
    got = {tuple(r[k] for k in keys): [bits(r[c]) for c in PROBS] for r in quantiles_by_radix(df, keys, value, PROBS, weight).collect()}
    want = {tuple(r[k] for k in keys): [bits(x) for x in r.q] for r in builtin(df, keys, value, weight).collect()}
    assert got == want and got


def test_codes_keep_the_order(spark):
    rng = np.random.default_rng(2)
    wild = np.frombuffer(rng.bytes(8 * 3000), "<f8")
    values = [*EDGE, *wild[~np.isnan(wild)].tolist(), *np.exp2(np.arange(-1074, 1024)).tolist(), *(-np.exp2(np.arange(-30, 30) + 0.5)).tolist()]
    out = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ordered_code(F.col("v")).alias("c")).collect()
    for r in out:
        if r.v == r.v:
            assert r.c == (-1 if r.v < 0 else 1) * struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
    assert max(out, key=lambda r: r.c).v != max(out, key=lambda r: r.c).v  # NaN comes last


def test_same_bits_as_the_built_in(spark):
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"k": "hot", "v": rng.lognormal(3, 2, 5000)}), pd.DataFrame({"k": "ties", "v": rng.integers(0, 5, 999) * 1.0}),
             pd.DataFrame({"k": "two", "v": [1.5, 2.25]}), pd.DataFrame({"k": "one", "v": [7.0]}), pd.DataFrame({"k": None, "v": rng.normal(0, 1e-3, 400)}),
             pd.DataFrame({"k": "near", "v": 1 + np.arange(300) * 2.0**-52}), pd.DataFrame({"k": "none", "v": [None, None]})]
    rows = [(r.k, None if r.v != r.v else float(r.v), int(n % 4)) for n, r in enumerate(pd.concat(parts).itertuples())]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    same_bits(df, ["k"], "v")
    same_bits(df.where("w > 0"), ["k"], "v", "w")
    same_bits(df, [], "v")
    edge = spark.createDataFrame([(k, float(v)) for k in range(3) for v in EDGE[k:] if abs(v) < 1e300], "k int, v double")
    same_bits(edge.where("not (v = 0)"), ["k"], "v")


def test_nothing_to_select(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quantiles_by_radix(none, ["k"], "v", PROBS).collect() == []
    assert quantiles_by_radix(none, [], "v", PROBS).collect() == []


def test_an_image_of_four_million_values(spark):
    """More distinct values than a map should hold; codes of one pass share their upper bits."""
    n = 4_000_000
    px = spark.range(n).select(F.lit(0).alias("image_set"), (100 + F.pmod(F.col("id") * 2654435761, F.lit(n)) / n).alias("value"))
    got = quantiles_by_radix(px, ["image_set"], "value", {"m": 0.5, "p5": 0.05}).first()
    want = np.sort(100 + (np.arange(n) * 2654435761 % n) / n)
    assert got["_n"] == n and got.m == np.percentile(want, 50) and got.p5 == pytest.approx(np.percentile(want, 5), rel=1e-15)


def test_levels_go_by_type(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("w", T.IntegerType())])
    df = spark.createDataFrame([(k % 3, k * 7 % 50, float(k * 7 % 50), k % 3) for k in range(200)] + [(9, None, None, 1)], schema)
    for weight in (None, "w"):
        whole, real, plain = [{r.k: r.m for r in levels(df, ["k"], c, {"m": 0.5}, weight, small=s).collect()} for c, s in (("n", None), ("x", False), ("x", True))]
        assert whole == real == plain and 9 not in whole


def test_many_groups_are_joined_plainly(spark, monkeypatch):
    """Wanted ranks of many small groups are not copied to every salt."""
    calls = []
    monkeypatch.setattr(select, "attach", lambda *a: (calls.append(a), attach(*a))[1])
    df = spark.range(12000).select((F.col("id") % 1500).alias("k"), (1 + F.col("id") / F.lit(2.0**30)).alias("v"))
    same_bits(df, ["k"], "v")
    assert not calls
    same_bits(df.where("k < 3"), ["k"], "v")
    assert calls
