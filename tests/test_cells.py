import math
from fractions import Fraction

import numpy as np
import pytest

from rasterlab.operators import background as bg
from rasterlab.operators import cells as c
from rasterlab.operators import morphology as mo
from rasterlab.operators import pixels as p
from rasterlab.operators import spatial as sp
from tests.helpers import blobs, grid, pixels


def test_grid_of_square_cells(spark):
    """512 x 512 counts, 1,000 square cells of side 8, background 150: exact sums."""
    rng = np.random.RandomState(42)
    img = rng.randint(100, 1000, (512, 512))
    mask = np.zeros((512, 512), dtype=int)
    k = 0
    for y in range(0, 505, 16):
        for x in range(0, 505, 16):
            k += 1
            if k <= 1000:
                mask[y:y + 8, x:x + 8] = k
    px = pixels(spark, mask, img)
    level = px.select("condition", "image_set").distinct().selectExpr("*", "150d as background", "0d as bg_std")
    got = c.add_ctcf(c.with_background(c.label_stats(px), level)).toPandas().set_index("label")
    assert len(got) == 1000
    for label in range(1, 1001):
        v = img[mask == label]
        assert got.loc[label, "area"] == v.size
        assert abs(got.loc[label, "int_den"] - v.sum()) < 1e-6
        assert abs(got.loc[label, "ctcf"] - max(0, v.sum() - v.size * 150)) < 1e-6


def test_no_cells(spark):
    px = pixels(spark, np.zeros((5, 6)), np.ones((5, 6), dtype=int))
    stats = c.mask_stats(px).first()
    assert (stats.n_cells, stats.min_area, stats.max_area, stats.mean_area) == (0, 0, 0, 0.0)
    assert c.mask_issues(px).first().issues == ["No cells found in mask"]
    assert sp.nearest_label(px).where("nearest is not null").count() == 0


def test_full_coverage_falls_back(spark):
    img = np.arange(100).reshape(10, 10)
    images, cells = bg.estimate(pixels(spark, np.ones((10, 10)), img), method="voronoi")
    row = images.first()
    assert row.method_used == "voronoi_fallback_p1" and row.low_confidence
    assert row.background == pytest.approx(np.percentile(img, 1))
    assert cells.count() == 1
    # closed-in cells of the older method use the mirrored box mean
    box = np.pad(img, ((25, 24), (25, 24)), mode="symmetric")[4:54, 4:54]
    assert bg.surroundings(pixels(spark, np.ones((10, 10)), img)).first().background == pytest.approx(box.mean())


def test_few_background_pixels(spark):
    mask = np.ones((8, 8), dtype=int)
    mask[:5] = 0
    img = np.arange(64).reshape(8, 8)
    row = bg.polynomial_surface(pixels(spark, mask, img)).first()
    assert row.background == np.median(img[mask == 0]) and row.bg_std == 0
    assert bg.coverage(pixels(spark, mask, img)).first().bg_cv == 999.0


def test_uniform_images(spark):
    for level, want in ((0, 0.0), (7, 0.5)):
        out = p.normalise(pixels(spark, np.zeros((3, 3)), np.full((3, 3), level)))
        assert {r.norm for r in out.collect()} == {want}


def test_polynomial_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    mask = blobs(rng)
    img = rng.integers(50, 300, mask.shape)
    h, w = mask.shape
    yy, xx = np.indices(mask.shape)
    terms = [(yy / (h - 1)) ** q * (xx / (w - 1)) ** r for q in range(4) for r in range(4 - q)]
    a = np.stack([t[mask == 0] for t in terms], axis=1)
    k = np.linalg.lstsq(a, img[mask == 0], rcond=None)[0]
    surface = sum(q * t for q, t in zip(k, terms))
    got = bg.polynomial_surface(pixels(spark, mask, img)).toPandas().set_index("label")
    for label in np.unique(mask[mask > 0]):
        assert got.loc[label, "background"] == pytest.approx(np.median(surface[mask == label]), abs=1e-6)
    assert got.bg_std.iloc[0] == pytest.approx(np.std((img - surface)[mask == 0]))


@pytest.mark.parametrize("radius,tile", [(3, 512), (6, 16)])
def test_opening_against_brute_force(spark, radius, tile):
    rng = np.random.default_rng(radius)
    img = rng.integers(0, 1000, (30, 37)).astype(float)
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
            if dy * dy + dx * dx <= radius * radius]

    def extreme(a, pick, fill):
        pad = np.pad(a, radius, constant_values=fill)
        return pick([pad[radius + dy:radius + dy + 30, radius + dx:radius + dx + 37] for dy, dx in disk], axis=0)

    want = extreme(extreme(img, np.min, np.inf), np.max, -np.inf)
    out = sp.opened_surface(pixels(spark, np.zeros(img.shape), img), radius=radius, tile=tile)
    assert np.array_equal(grid(out, "surface"), want)
    assert (grid(out, "surface") <= img).all()


def test_median_filter_against_brute_force(spark):
    rng = np.random.default_rng(5)
    img = rng.integers(0, 255, (21, 26))
    pad = np.pad(img, ((5, 4), (5, 4)), mode="symmetric")
    want = np.array([[np.sort(pad[y:y + 10, x:x + 10].ravel())[50] for x in range(26)] for y in range(21)])
    out = sp.median_filtered_background(pixels(spark, np.zeros(img.shape), img), size=10, tile=8)
    assert np.array_equal(grid(out, "surface"), want)


def test_nearest_label_against_brute_force(spark):
    rng = np.random.default_rng(9)
    mask = blobs(rng, (50, 35), n=5, r=3)
    ys, xs = np.nonzero(mask)
    out = sp.nearest_label(pixels(spark, mask)).toPandas()
    for r in out.sample(300, random_state=0).itertuples():
        d2 = (ys - r.y) ** 2 + (xs - r.x) ** 2
        assert r.d2 == d2.min()
        assert r.nearest == mask[ys, xs][d2 == d2.min()].min()


def test_solidity_against_brute_force(spark):
    mask = blobs(np.random.default_rng(11), n=12)
    mask[30, 2:9] = 40
    mask[25:31, 2] = 40
    got = mo.solidity(pixels(spark, mask)).toPandas().set_index("label")
    for label in np.unique(mask[mask > 0]):
        y, x = np.nonzero(mask == label)
        corners = {(a + da, b + db) for a, b in zip(y, x) for da, db in ((-.5, 0), (.5, 0), (0, -.5), (0, .5))}
        inside = 0
        pts = np.array(sorted(corners))
        for cy in range(y.min(), y.max() + 1):
            for cx in range(x.min(), x.max() + 1):
                # inside a convex hull: no direction has all points strictly on one side
                ang = np.sort(np.arctan2(pts[:, 0] - cy, pts[:, 1] - cx))
                gap = np.diff(np.append(ang, ang[0] + 2 * np.pi)).max()
                inside += gap <= np.pi + 1e-9
        assert got.loc[label, "solidity"] == pytest.approx(len(y) / inside), label


def test_one_pixel_wide_cell(spark):
    mask = np.zeros((6, 9), dtype=int)
    mask[2, 1:8] = 1
    row = mo.morphology(pixels(spark, mask)).first()
    assert row.aspect_ratio == 999.0 and row.eccentricity == 1.0 and not row.is_border


def test_smoothing_across_tiles(spark):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 100, (20, 530)).astype(float)
    px = pixels(spark, np.zeros(img.shape), img)
    sig = px.select("condition", "image_set").distinct().selectExpr("*", "1.5d as sigma")
    r = 6
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / 1.5) ** 2)
    w /= w.sum()
    want = img
    for axis in (0, 1):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (r, r)
        ext = np.pad(want, pads, mode="symmetric")
        want = sum(w[i] * np.take(ext, range(i, i + want.shape[axis]), axis=axis) for i in range(2 * r + 1))
    assert np.allclose(grid(sp.smoothed(px, sig), "value"), want)


def test_hulls_of_many_cells_at_once(spark):
    """Cells of all heights in one call, some with missing rows, as each alone against the corners' hull."""
    rng = np.random.default_rng(21)
    cells = []
    for height in (1, 2, 3, 9, 40):
        y = np.sort(rng.choice(height + 4, size=height, replace=False)) + 7
        left = rng.integers(0, 30, height)
        cells.append((y, left, left + rng.integers(0, 30, height)))
    number = np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells])
    got = mo._hull_pixels(number, *(np.concatenate([c[i] for c in cells]) for i in range(3)))
    for (y, left, right), pixels_inside in zip(cells, got):
        pts = [p for a, lo, hi in zip(2 * y, 2 * left, 2 * right)
               for p in ((a, lo - 1), (a, hi + 1), (a - 1, lo), (a + 1, lo), (a - 1, hi), (a + 1, hi))]
        inside = 0
        for row in range(2 * y.min(), 2 * y.max() + 1, 2):
            # the widest reach of any two points around the row
            ends = [Fraction(x0) if y0 == y1 else x0 + Fraction((x1 - x0) * (row - y0), y1 - y0)
                    for y0, x0 in pts if y0 <= row for y1, x1 in pts if y1 >= row and (y1 > y0 or (y0, x0) == (y1, x1))]
            inside += max(0, math.floor(max(ends) / 2) - math.ceil(min(ends) / 2) + 1)
        assert pixels_inside == inside


def test_distances_are_found_once(spark):
    """The distance limit, the cells and the whole image read written distances."""
    rng = np.random.default_rng(4)
    mask = blobs(rng, (30, 30), n=4, r=3)
    out = bg.voronoi(pixels(spark, mask, rng.integers(0, 50, mask.shape)))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().sparkPlan().toString()
