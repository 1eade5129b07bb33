"""Contours in walking order."""

import numpy as np
import pytest
from tests.helpers import blobs, flood, pixels

from rasterlab.operators import export as ex


def rings(spark, mask):
    px = pixels(spark, mask).select("condition", "image_set", "y", "x", "label")
    out = {}
    for r in ex.contour_rings(px).collect():
        out.setdefault((r.label, r.ring), {})[r.position] = (r.cy, r.cx)
    points = sorted((r.label, r.cy, r.cx) for r in ex.contour_vertices(px).collect())
    assert sorted((k[0], *p) for k, v in out.items() for p in v.values()) == points
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def gaps(line):
    return np.abs(np.diff(line, axis=0)).max(axis=1).max(initial=0)


def enclosed(line):
    y, x = line.T
    return 0.5 * (np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def test_rings_of_cells_with_holes(spark):
    mask = np.zeros((30, 34), dtype=int)
    mask[2:12, 3:15] = 4
    mask[4:9, 5:12] = 0
    mask[6, 7] = 4  # an island in the hole
    mask[14, 3] = mask[15, 4] = 6  # joined at a corner only
    mask[20:24, 20:22] = 9
    mask[20:24, 22:25] = 8  # touching cells
    got = rings(spark, mask)
    assert {k: len([r for q, r in got if q == k]) for k in (4, 6, 9, 8)} == {4: 3, 6: 2, 9: 1, 8: 1}
    for line in got.values():
        assert gaps(np.vstack([line, line[:1]])) <= 1
    # the outer contour is the longest; holes run the other way round
    assert len(got[4, 0]) == 2 * (10 + 12) and enclosed(got[4, 0]) > 0 > enclosed(got[4, 1]) and len(got[4, 2]) == 4
    assert (got[9, 0][0] == (19.5, 20)).all()


def test_contours_are_open_at_the_edge(spark):
    mask = np.zeros((12, 12), dtype=int)
    mask[0:4, 3:7] = 1
    mask[5:, 5] = 2
    got = rings(spark, mask)
    assert set(got) == {(1, 0), (2, 0)} and all(gaps(x) <= 1 for x in got.values())
    assert {got[1, 0][0][0], got[1, 0][-1][0]} == {0.0} and len(got[1, 0]) == 4 + 4 + 4


@pytest.mark.parametrize("seed", [1, 2])
def test_any_mask_across_tiles(spark, seed, monkeypatch):
    monkeypatch.setattr(ex, "tiles", lambda px, keys, halo=0: tiles(px, keys, halo, 16))
    from rasterlab.operators.tiling import tiles

    rng = np.random.default_rng(seed)
    mask = blobs(rng, (40, 44), n=12, r=7)
    mask[rng.random(mask.shape) < 0.1] = 0
    inner = mask.copy()
    inner[[0, -1]] = 0
    inner[:, [0, -1]] = 0
    got = rings(spark, inner)
    assert all(gaps(np.vstack([x, x[:1]])) <= 1 for x in got.values())
    for k in np.unique(inner[inner > 0]):
        solid = len(np.unique(flood(inner == k))) - 1
        holes = len(np.unique(flood(np.pad(inner != k, 1, constant_values=True), diagonal=True))) - 2
        mine = [got[q] for q in got if q[0] == k]
        assert sum(enclosed(x) > 0 for x in mine) == solid and sum(enclosed(x) < 0 for x in mine) == holes
        assert [len(got[k, r]) for r in range(len(mine))] == sorted(map(len, mine), reverse=True)
    rings(spark, mask)
