from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from rasterlab.functions.order import quantiles_of_counts
from rasterlab.operators import export as ex
from rasterlab.operators import spatial as sp
from tests.helpers import pixels


def test_mask_pyramid_of_an_image_with_missing_rows(spark):
    """Levels are those of the camera's size."""
    img = np.arange(1, 65).reshape(8, 8)
    whole = ex.mask_pyramid(pixels(spark, img), size=(8, 8)).select("level", "y", "x", "label")
    part = ex.mask_pyramid(pixels(spark, img).where("y < 5"), size=(8, 8)).select("level", "y", "x", "label")
    want = [tuple(r) for r in whole.collect() if (r.label - 1) // 8 < 5]
    assert sorted(map(tuple, part.collect())) == sorted(want)
    assert whole.exceptAll(ex.mask_pyramid(pixels(spark, img)).select("level", "y", "x", "label")).isEmpty()


def test_image_pyramid_of_an_image_with_missing_rows(spark):
    """F5"""
    img = np.arange(64).reshape(8, 8)
    got = ex.image_pyramid(pixels(spark, img, img).where("y < 5"), size=(8, 8)).select("level", "y", "x").collect()
    assert sorted(map(tuple, got)) == sorted({(lv, y >> 3 - lv, x >> 3 - lv) for lv in range(4) for y in range(5) for x in range(8)})


def test_smoothing_with_missing_pixels(spark):
    """What is missing counts as 0 in both passes, also at the edges of the image."""
    rng = np.random.default_rng(3)
    img = rng.integers(1, 1000, (20, 17)).astype(float)
    there = np.ones(img.shape, dtype=bool)
    there[14:, 9:] = there[0, 2] = there[:2, 10:] = False
    there[19, 0] = there[0, 0] = True
    px = pixels(spark, there.astype(int), img).where("label = 1")
    images = px.select("condition", "image_set").distinct().withColumn("sigma", F.lit(1.0))
    w = np.exp(-0.5 * np.arange(-4, 5.0) ** 2)
    w /= w.sum()
    want = np.where(there, img, 0)
    for axis in (0, 1):
        pad = np.pad(want, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.where(there, np.apply_along_axis(lambda line: np.convolve(line, w, mode="valid"), axis, pad), 0)
    got = sp.smoothed(px, images).collect()
    assert len(got) == there.sum() and all(np.isclose(r.value, want[r.y, r.x]) for r in got)


def test_levels_of_counts_keep_the_first_product_exact(spark):
    """F11"""
    rng = np.random.default_rng(5)
    values = {k: np.sort(rng.integers(2000, 5000, int(rng.integers(1, 700)))) for k in range(60)}
    df = spark.createDataFrame([(k, int(v)) for k, vs in values.items() for v in vs], "k int, value long")
    probs = {"lo": 0.0035, "hi": 0.9965, "p": 0.37}
    got = {r.k: r for r in quantiles_of_counts(df, ["k"], "value", probs).collect()}
    for k, vs in values.items():
        for name, q in probs.items():
            at = (len(vs) - 1) * q
            d = at - np.floor(at)
            a, b = float(vs[int(np.floor(at))]), float(vs[int(np.ceil(at))])
            assert got[k][name] == float(Fraction(a) * Fraction(1 - d) + Fraction(b * d))
