import numpy as np
import pandas as pd
import pytest

from rasterlab.functions.order import pick, positions, quantiles
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.lognormal(3, 2, 4000), 2)})
    rest = pd.DataFrame({"k": rng.choice(list("abc"), 300), "v": np.round(rng.normal(0, 5, 300), 1)})
    pdf = pd.concat([hot, rest, pd.DataFrame({"k": ["one"], "v": [7.0]})], ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_match_linear_interpolation(skewed, small):
    pdf, df = skewed
    got = quantiles(df, ["k"], "v", {"q1": 0.25, "p95": 0.95}, small=small).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.loc[k, "_n"] == len(g)
        assert got.loc[k, "q1"] == pytest.approx(np.percentile(g.v, 25))
        assert got.loc[k, "p95"] == pytest.approx(np.percentile(g.v, 95))


@pytest.mark.parametrize("small", [True, False])
def test_positions_are_ranks(skewed, small):
    pdf, df = skewed
    got = positions(df, ["k"], "v", hot_values=16, small=small).toPandas()
    want = pdf.groupby(["k", "v"]).size().rename("w").reset_index().sort_values(["k", "v"])
    want["before"] = want.groupby("k").w.cumsum() - want.w
    want["rank0"] = want.groupby("k").cumcount()
    both = want.merge(got, on=["k", "v"])
    assert len(both) == len(want) == len(got)
    assert (both.w == both._w).all() and (both.before == both._before).all() and (both.rank0 == both._rank0).all()


def test_whole_table_and_picks(skewed):
    pdf, df = skewed
    placed = positions(df, [], "v", hot_values=16, small=False)
    row = pick(placed, [], "v", {"q": F.floor(F.col("_n") * 0.25)}).first()
    assert row["q"] == sorted(pdf.v)[int(len(pdf) * 0.25)]
