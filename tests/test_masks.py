import numpy as np
import pandas as pd
import pytest

from rasterlab.operators import masks as m
from rasterlab.operators.components import components
from tests.helpers import blobs, flood, grid, pixels

KEYS = ("condition", "image_set")


def relabel(a):
    out = np.zeros_like(a)
    for i, k in enumerate(np.unique(a[a > 0]), 1):
        out[a == k] = i
    return out


@pytest.mark.parametrize("tile,diagonal", [(512, False), (8, False), (8, True), (5, True)])
def test_components_against_search(spark, tile, diagonal):
    mask = np.random.default_rng(tile).random((37, 41)) < 0.55
    px = pixels(spark, mask.astype(int))
    got = grid(components(px.where("label = 1"), KEYS, diagonal=diagonal, tile=tile), "component")
    want = flood(mask, diagonal)
    full = np.zeros(mask.shape, dtype=np.int64)
    full[: got.shape[0], : got.shape[1]] = got
    for k in range(1, want.max() + 1):
        y, x = np.nonzero(want == k)
        first = min(zip(y, x))
        assert (full[y, x] == first[0] * 2**31 + first[1]).all()


def test_snake_over_many_tiles(spark):
    mask = np.zeros((33, 33), dtype=int)
    mask[::2] = 1
    mask[1::4, -1] = 1
    mask[3::4, 0] = 1
    out = components(pixels(spark, mask).where("label = 1"), KEYS, tile=4)
    assert out.select("component").distinct().count() == 1


@pytest.mark.parametrize("steps", [1, 3])
def test_dilation_in_label_order(spark, steps):
    mask = blobs(np.random.default_rng(steps), n=14, r=3)
    want = mask.copy()
    for k in np.unique(mask[mask > 0]):
        cell = mask == k
        for _ in range(steps):
            pad = np.pad(cell, 1)
            grown = pad[1:-1, 1:-1] | pad[:-2, 1:-1] | pad[2:, 1:-1] | pad[1:-1, :-2] | pad[1:-1, 2:]
            want[grown & (want == 0)] = k
            cell = want == k
    assert np.array_equal(grid(m.dilate(pixels(spark, mask), iterations=steps)), want)


def in_order(mask, steps, only=None):
    """Cells grown one after the other."""
    want = mask.copy()
    for k in np.unique(mask[mask > 0]) if only is None else only:
        cell = mask == k
        for _ in range(steps):
            pad = np.pad(cell, 1)
            grown = pad[:-2, 1:-1] | pad[2:, 1:-1] | pad[1:-1, :-2] | pad[1:-1, 2:]
            cell = grown & (want == 0)
            want[cell] = k
    return want


@pytest.mark.parametrize("case", ["crowded", "chain", "spiral"])
def test_dilation_across_tiles(spark, case):
    """Confluent cells, a chain of labels that each take the way of the next, and one long way round."""
    rng = np.random.default_rng(5)
    mask = np.zeros((50, 60), dtype=int)
    if case == "crowded":
        at = rng.permutation(50 * 60)[:500]
        mask.ravel()[at] = rng.permutation(500) + 1
        steps = 4
    elif case == "chain":
        mask[1, 2::3] = np.arange(1, 21)  # one row; rows above and below are closed but for gaps
        mask[0], mask[2] = 99, 98
        steps = 2
    else:
        mask[::2] = 50
        mask[0::4, -1] = mask[2::4, 0] = 0
        mask[1, 0] = 3
        steps = 150
    got = grid(m.dilate(pixels(spark, mask), iterations=steps, tile=16))
    assert np.array_equal(got, in_order(mask, steps))


def test_dilation_of_some_cells_in_steps(spark):
    mask = blobs(np.random.default_rng(8), n=9)
    ids = spark.createDataFrame(pd.DataFrame({"condition": "c", "image_set": [0, 0], "label": [5, 2]}))
    got = grid(m.dilate(pixels(spark, mask), iterations=3, only=ids, tile=16))
    assert np.array_equal(got, in_order(mask, 3, only=[2, 5]))


def test_subset_edits_leave_other_cells(spark):
    mask = blobs(np.random.default_rng(8), n=6)
    ids = spark.createDataFrame(pd.DataFrame({"condition": "c", "image_set": [0], "label": [2]}))
    grown = grid(m.dilate(pixels(spark, mask), only=ids))
    assert set(np.unique(grown[grown != mask])) <= {2}
    shrunk = grid(m.erode(pixels(spark, mask), only=ids))
    assert set(np.unique(mask[shrunk != mask])) <= {2}


@pytest.mark.parametrize("limit", [None, 3])
def test_fill_holes(spark, limit):
    mask = np.zeros((14, 16), dtype=int)
    mask[0:8, 0:8] = 3
    mask[2:6, 2:6] = 0
    mask[3:5, 3:5] = 1  # a smaller label inside: overwritten
    mask[9:14, 9:14] = 5
    mask[11, 11] = 0
    mask[9, 2:5] = mask[11, 2:5] = 7  # open ring
    want = mask.copy()
    for k in np.unique(mask[mask > 0]):
        cell = mask == k
        outside = flood(np.pad(~cell, 1, constant_values=True))
        filled = ~(outside == outside[0, 0])[1:-1, 1:-1]
        if limit is not None and (filled & ~cell).sum() > limit:
            continue
        want[filled] = k
    assert np.array_equal(grid(m.fill_holes(pixels(spark, mask), max_hole_size=limit)), want)


def test_clean_small_objects_counts_touching_cells_together(spark):
    mask = np.zeros((20, 20), dtype=int)
    mask[0:5, 0:6] = 4
    mask[0:5, 6:11] = 9  # touches: 55 pixels together
    mask[10:14, 10:14] = 2  # 16 pixels alone
    want = mask.copy()
    want[want == 2] = 0
    assert np.array_equal(grid(m.clean_small_objects(pixels(spark, mask))), relabel(want))


def test_region_growing(spark):
    rng = np.random.default_rng(4)
    img = rng.integers(50, 150, (24, 26))
    mask = np.zeros(img.shape, dtype=int)
    mask[5:9, 5:9] = 3
    seeds = [(1, 12, 12), (2, 6, 6), (3, 20, 3)]
    want = mask.copy()
    for _, y, x in seeds:
        if want[y, x]:
            continue
        region = flood(np.abs(img - img[y, x]) <= 0.3 * img[y, x])
        fill = (region == region[y, x]) & (want == 0)
        want[fill] = want.max() + 1
    sd = spark.createDataFrame(pd.DataFrame(seeds, columns=["seq", "y", "x"])).selectExpr(
        "'c' as condition", "0L as image_set", "seq", "cast(y as int) as y", "cast(x as int) as x")
    assert np.array_equal(grid(m.grow_from_seeds(pixels(spark, mask, img), sd)), want)


def test_split_keeps_one_test_pair(spark):
    log = spark.createDataFrame(pd.DataFrame({"condition": "c", "image_set": range(3), "seq": range(3), "action": "upsert"}))
    out = m.train_test_split(m.training_manifest(log)).toPandas()
    assert len(out) == 3 and out.is_test.sum() == 1


def test_seeds_across_tiles(spark):
    """Regions that wind through many tiles and meet; the smallest seq writes, numbers follow the writers."""
    rng = np.random.default_rng(21)
    img = np.full((40, 50), 100)
    img[rng.random(img.shape) < 0.35] = 500
    img[::8, :-1] = 500
    img[4::8, 1:] = 500
    mask = np.zeros(img.shape, dtype=int)
    mask[10:14, 10:14] = 4
    free = np.argwhere(mask == 0)
    seeds = [(7 + 3 * k, *map(int, free[i])) for k, i in enumerate(rng.permutation(len(free))[:25])]
    want, top = mask.copy(), 4
    for _, y, x in sorted(seeds):
        parts = flood(np.abs(img - img[y, x]) <= img[y, x] * 0.3)
        mine = (parts == parts[y, x]) & (mask == 0) & (want == 0)
        if mine.any():
            top += 1
            want[mine] = top
    sd = spark.createDataFrame([("c", 0, *s) for s in seeds], "condition string, image_set long, seq long, y int, x int")
    assert np.array_equal(grid(m.grow_from_seeds(pixels(spark, mask, img), sd, tile=16)), want)
    assert np.array_equal(grid(m.grow_from_seeds(pixels(spark, mask, img), sd.limit(0), tile=16)), mask)
