import itertools
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from rasterlab.functions import order, special
from rasterlab.operators import stats as st
from rasterlab.operators import summary as s
from rasterlab.plans import analyses


def test_tail_functions():
    assert special.gamma_upper(0.5, 1.920729410347) == pytest.approx(0.05, abs=1e-9)  # chi2, 1 df: 3.8415
    assert special.gamma_upper(1.0, 7.0) == pytest.approx(math.exp(-7))
    assert special.gamma_upper(2.5, 0.3) == pytest.approx(1 - 0.0120047 / 1, abs=2e-2)
    t = 2.2281388519649385  # two-sided 5 % point of t with 10 df
    assert special.beta_inc(5, 0.5, 10 / (10 + t * t)) == pytest.approx(0.05, abs=1e-9)
    assert special.beta_inc(0.5, 0.5, 0.5) == pytest.approx(0.5)


def test_exact_rank_probability():
    for n1, n2 in ((2, 3), (3, 4)):
        values = []
        for pick in itertools.combinations(range(1, n1 + n2 + 1), n1):
            values.append(sum(pick) - n1 * (n1 + 1) / 2)
        for u in set(values):
            extreme = max(u, n1 * n2 - u)
            want = min(1.0, 2 * np.mean([v >= extreme for v in values]))
            assert special.mann_whitney_exact(u, n1, n2) == pytest.approx(want)


def test_mann_whitney_with_ties(spark):
    a, b = [1, 2, 2, 3, 5, 5, 8, 9, 9, 10], [2, 4, 5, 5, 6, 7, 11, 12, 13, 13, 14]
    pdf = pd.DataFrame({"Condition": ["a"] * len(a) + ["b"] * len(b), "v": a + b})
    row = st.mann_whitney(spark.createDataFrame(pdf), ["v"]).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert row.U == pytest.approx(u)
    n1, n2 = len(a), len(b)
    n = n1 + n2
    ties = sum(t**3 - t for t in pd.Series(a + b).value_counts())
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert row.direction == "lower"


def test_joint_density_against_direct_sum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 2, 60)
    y = 0.8 * x + rng.normal(0, 1, 60)
    df = spark.createDataFrame(pd.DataFrame({"Condition": "c", "x": x, "y": y}))
    got = st.kde_2d(df, "x", "y", points=12).toPandas()
    cov = np.cov(x, y) * 60 ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * np.pi * np.sqrt(np.linalg.det(cov)) * 60
    for r in got.itertuples():
        d = np.stack([r.x - x, r.y - y])
        assert r.density == pytest.approx(np.exp(-0.5 * (d * (inv @ d)).sum(0)).sum() / norm)
    assert got.x.min() == pytest.approx(x.min() - 0.1 * np.ptp(x)) and len(got) == 144
    levels = st.contour_levels(spark.createDataFrame(got)).toPandas().set_index("percentile")
    assert levels.loc[55, "level"] == pytest.approx(np.percentile(got.density, 55))


def test_joint_density_of_far_and_equal_rows(spark):
    """Rows of many cells, copies and lone rows far away have the sums of one exponential each."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, 700), rng.normal(50, 0.5, 20), np.full(30, 4.25), [-300.0]])
    y = np.concatenate([0.98 * x[:700] + rng.normal(0, 0.2, 700), rng.normal(-20, 1, 20), np.full(30, 4.0), [2000.0]])
    n, points = len(x), 40
    df = spark.createDataFrame(pd.DataFrame({"Condition": "c", "x": x, "y": y}))
    got = st.kde_2d(df, "x", "y", points=points).toPandas().sort_values(["i", "j"])
    cov = np.cov(x, y) * n ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * np.pi * np.sqrt(np.linalg.det(cov)) * n
    dx, dy = got.x.to_numpy()[:, None] - x, got.y.to_numpy()[:, None] - y
    want = np.exp(-0.5 * (inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy)).sum(axis=1) / norm
    clear = want > 1e-280
    assert len(got) == points ** 2 and np.allclose(got.density[clear], want[clear], rtol=1e-9, atol=0)
    assert (got.density[~clear] < 1e-270).all() and (got.density[want == 0] == 0).all()


def test_joint_density_takes_equal_rows_once(spark, monkeypatch):
    """F12, F13"""
    seen = []
    attach = st.attach
    monkeypatch.setattr(st, "attach", lambda rows, *a, **k: (seen.append(rows.count()), attach(rows, *a, **k))[1])
    df = spark.range(3000).selectExpr("'c' as Condition", "double(id % 20) as x", "double(id % 20 * id % 3) as y")
    got = st.kde_2d(df, "x", "y", points=10).agg({"density": "sum"}).first()[0]
    assert got > 0 and seen == [df.distinct().count()]


def test_flags_need_spread_and_three_rows(spark):
    pdf = pd.DataFrame({"k": ["two"] * 2 + ["flat"] * 5 + ["far"] * 6, "value": [1.0, 900.0] + [4.0] * 5 + [1, 2, 3, 2, 1, 99.0]})
    got = s.mad_outliers(spark.createDataFrame(pdf), ["k"]).where("is_outlier").collect()
    assert [(r.k, r.value) for r in got] == [("far", 99.0)]


def test_single_field_has_no_spread(spark):
    df = spark.createDataFrame(pd.DataFrame({"Condition": "c", "ImageSet": 1, "Area": [5, 6, 9], "A_CTCF": [1.0, 2.0, 4.0]}))
    row = s.hierarchical_summary(s.fov_summary(df)).first()
    assert (row.sd_of_fov_medians, row.cv_percent, row.sem, row.mean_of_fov_medians) == (0.0, 0.0, 0.0, 2.0)


def test_ratio_needs_positive_green(spark):
    df = spark.createDataFrame(pd.DataFrame({"Red_CTCF": [4.0, 4.0], "GFP_CTCF": [2.0, 0.0]}))
    assert [r.ratio for r in s.add_ratio(df).collect()] == [2.0, None]


def test_third_condition_does_not_count(spark):
    rows = [(c, float(v + 10 * k)) for k, c in enumerate("ABC") for v in range(30)]
    df = spark.createDataFrame(rows, "Condition string, v double")
    three = st.mann_whitney(df, ["v"], pair=("A", "C")).collect()[0]
    two = st.mann_whitney(df.where("Condition <> 'B'"), ["v"]).collect()[0]
    assert tuple(three) == tuple(two) and three.U == 50 and three.p_value < 1e-8
    assert st.mann_whitney(df, ["v"]).collect()[0].group_b == "B"


def test_contour_levels_of_many_equal_rows(spark):
    """Levels of a joint density whose rows are copies are those of the direct sums."""
    rng = np.random.default_rng(4)
    x, y = np.repeat(rng.normal(0, 1, 40), 25), np.repeat(rng.normal(5, 3, 40), 25)
    df = spark.createDataFrame(pd.DataFrame({"Condition": "c", "x": x, "y": y}))
    density = st.kde_2d(df, "x", "y", points=15)
    at = density.toPandas()
    inv = np.linalg.inv(np.cov(x, y) * len(x) ** (-1 / 3))
    dx, dy = at.x.to_numpy()[:, None] - x, at.y.to_numpy()[:, None] - y
    want = np.exp(-0.5 * (inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy)).sum(axis=1)
    want *= np.sqrt(np.linalg.det(inv)) / (2 * np.pi * len(x))
    got = st.contour_levels(density).toPandas().set_index("percentile").level
    assert all(got[c] == pytest.approx(np.percentile(want[want > 0], c)) for c in st.CONTOURS)


@pytest.mark.parametrize("small", [True, False])
def test_rank_sums_of_slices(spark, small):
    """Ranks over several slices, with ties, nulls and a group that has no value."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"Condition": rng.choice(["a", "b", "c"], 900, p=[0.6, 0.3, 0.1]), "v": np.round(rng.lognormal(1, 1, 900), 1),
                        "w": rng.integers(0, 4, 900).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("v") < 40, F.col("v")))
    df = df.unionByName(spark.createDataFrame([("d", None, 1.0)], "Condition string, v double, w double"))
    rows = st.rank_sums(df, ["v", "w"], with_medians=True, hot_values=16, small=small).toPandas().set_index(["metric", "Condition"])
    pdf = pd.concat([pdf.assign(v=pdf.v.where(pdf.v < 40)), pd.DataFrame({"Condition": ["d"], "v": [np.nan], "w": [1.0]})])
    for metric in ("v", "w"):
        kept = pdf[pdf[metric].notna()].assign(r=lambda p: p[metric].rank())
        ties = sum(t**3 - t for t in kept[metric].value_counts())
        assert set(rows.loc[metric].index) == set(kept.Condition)
        for name, g in kept.groupby("Condition"):
            got = rows.loc[(metric, name)]
            assert (got.n, got.r, got.total, got.ties, got["median"]) == (len(g), g.r.sum(), len(kept), ties, g[metric].median())


@pytest.mark.parametrize("test", [st.mann_whitney, st.kruskal_wallis])
def test_large_tables_are_ranked_from_counts(spark, tmp_path, monkeypatch, test):
    """The rows are read for the counts alone, not again by every step."""
    monkeypatch.setattr(order, "fits_one_task", lambda *a: False)
    monkeypatch.setattr(st, "fits_one_task", lambda *a: False, raising=False)
    source = str(tmp_path / "rows")
    spark.range(300).selectExpr("concat('c', id % 2) as Condition", "double(id * 7 % 50) as v").write.parquet(source)
    out = test(spark.read.parquet(source), ["v"])
    assert out.count() == 1 and not [f for f in out.inputFiles() if source in f]


def test_ratio_study_runs_what_is_wanted(spark, monkeypatch):
    """Neither test is run for the summary, and of the tests only the one that applies."""
    seen = []
    for name in ("mann_whitney", "kruskal_wallis"):
        real = getattr(st, name)
        monkeypatch.setattr(analyses, name, lambda df, *a, _r=real, _n=name: (seen.append((_n, df.count())), _r(df, *a))[1])
    df = spark.range(90).selectExpr("concat('c', id % 3) as Condition", "double(id + 1) as Red_CTCF", "double(id % 7 + 1) as GFP_CTCF")
    assert analyses.ratio_study(df, parts=["summary"])["summary"].count() == 3 and seen == []
    whole = analyses.ratio_study(df)
    assert set(whole) == set(analyses.RATIO_PARTS) and whole["two_groups"].count() == 0 and whole["all_groups"].count() == 3
    assert [n > 0 for _, n in seen] == [False, True]
