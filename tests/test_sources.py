import io

import numpy as np
import pandas as pd
import pytest

from rasterlab.operators import filenames as fn
from rasterlab.operators import export as ex
from rasterlab.sources import codecs, files, images
from tests.helpers import pixels


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(dtype, compress):
    img = (np.arange(3 * 7 * 5).reshape(3, 7, 5) * 2).astype(dtype)
    back = codecs.read_tiff(codecs.write_tiff(img, compress))
    assert back.dtype == img.dtype and np.array_equal(back, img)


def test_plane_rules():
    assert codecs.single_plane(np.zeros((3, 9, 8))).shape == (9, 8)
    assert codecs.single_plane(np.arange(9 * 8 * 2).reshape(9, 8, 2))[0, 1] == 2
    assert codecs.single_plane(np.arange(7 * 9 * 8).reshape(7, 9, 8))[0, 0] == 3 * 72
    assert codecs.channel_planes(np.zeros((9, 8, 3))).shape == (3, 9, 8)
    assert codecs.mask_plane(np.zeros((2, 9, 8))).shape == (9, 8)


def test_scan_folder(spark, tmp_path):
    for name in ("ctl/a_w1.tif", "ctl/a_w2.TIFF", "ctl/.hidden.tif", ".cache/b_w1.tif", "drug/c_w1.tif", "drug/notes.txt"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(codecs.write_tiff(np.full((4, 3), 7, dtype="uint16")))
    got = {(r.condition, r.name) for r in files.scan_experiment(spark, str(tmp_path)).collect()}
    assert got == {("ctl", "a_w1.tif"), ("ctl", "a_w2.TIFF"), ("drug", "c_w1.tif")}
    (tmp_path / "drug" / "bad.tif").write_bytes(b"nonsense")
    content = images.read_files(spark, str(tmp_path / "drug"), "*.tif")
    assert images.decode_images(content, on_error="skip").count() == 12
    assert [r.path.rsplit("/", 1)[1] for r in images.unreadable(content).collect()] == ["bad.tif"]
    for decode in (images.decode_images, images.decode_channels, images.decode_masks):
        with pytest.raises(Exception, match="cannot decode"):
            decode(content).count()


def test_files_that_decode_but_do_not_fit(spark):
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((2, 2, 2, 2, 2)))
    df = spark.createDataFrame([("odd.npy", bytearray(buffer.getvalue()))], "path string, content binary")
    for kind, decode in (("image", images.decode_images), ("channels", images.decode_channels), ("mask", images.decode_masks)):
        assert decode(df, on_error="skip").count() == 0 and images.unreadable(df, kind).count() == 1
        with pytest.raises(Exception, match="cannot decode"):
            decode(df).count()


def test_tiled_files_round_trip(spark):
    img = np.arange(30 * 41).reshape(30, 41)
    coded = images.encode_tiles(pixels(spark, np.zeros(img.shape), img), tile=16)
    assert coded.count() == 6
    back = images.place_tiles(images.decode_images(coded), tile=16).toPandas()
    assert len(back) == img.size and (back.value == img[back.y, back.x]).all()


def with_gaps(spark, shape=(40, 37)):
    """An image that ends within a row of blocks, with a hole and a narrow strip."""
    img = np.arange(shape[0] * shape[1]).reshape(shape)
    px = pixels(spark, img % 7, img, other=2 * img)
    return px.where("not (y >= 24 and x >= 20) and not (y between 3 and 6 and x between 2 and 9) and not (y = 30 and x = 3)")


def test_channel_files_make_up_no_pixels(spark):
    """A tile with missing pixels becomes full rectangles (F8)."""
    px = with_gaps(spark)
    back = images.place_tiles(images.decode_channels(images.encode_tiles(px, channels=["value", "other"], tile=16)), tile=16)
    got = sorted(map(tuple, back.select("condition", "image_set", "channel", "y", "x", "value").collect()))
    want = [(r.condition, r.image_set, k, r.y, r.x, float(v)) for r in px.collect() for k, v in enumerate((r.value, r.other))]
    assert got == sorted(want)


@pytest.mark.parametrize("extension", ["npy", "npz", "tif"])
def test_mask_files_make_up_no_pixels(spark, extension):
    """F9"""
    px = with_gaps(spark)
    back = images.place_tiles(images.decode_masks(images.encode_tiles(px, value="label", extension=extension, tile=16)), tile=16)
    columns = ["condition", "image_set", "y", "x", "label"]
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, px.select(*columns).collect()))


def test_single_and_unparsed_files(spark):
    df = spark.createDataFrame(pd.DataFrame({"condition": ["one", "flat", "flat"], "name": ["x.tif", "p.tif", "q.tif"]}))
    grouped = fn.dominant_group(fn.tokenise(df))
    sets = fn.build_image_sets(grouped, fn.channel_position(fn.score_positions(fn.position_tokens(grouped))))
    got = {r.condition: r for r in fn.completeness(df, sets).collect()}
    assert (got["one"].n_image_sets, got["one"].confidence, got["one"].n_orphans) == (1, 1.0, 0)
    assert (got["flat"].n_image_sets, got["flat"].confidence, got["flat"].n_orphans) == (2, 0.0, 2)


def test_duplicate_suffix_keeps_last(spark):
    names = ["s_c0.tif", "s_C0_old.tif", "t_C1.png", "u_C0.jpg"]
    df = spark.createDataFrame(pd.DataFrame({"condition": "x", "name": names}))
    got = {(r.base, r.suffix): r.name for r in fn.group_by_suffix(df, ["C0", "C1"]).collect()}
    assert got == {("s", "C0"): "s_c0.tif", ("t", "C1"): "t_C1.png"}


def test_inference_in_tiles_matches_whole(spark):
    from tests.helpers import blobs, flood, grid

    mask = blobs(np.random.default_rng(3), (60, 70), n=20, r=3) > 0
    px = pixels(spark, mask.astype(int)).selectExpr("condition", "image_set", "y", "x", "array(cast(label as double)) as channels")

    def model(image, params):
        return flood(image[0] > 0.5)

    whole = grid(ex.segment(px, model))
    tiled = grid(ex.segment(px, model, tile=32, halo=16))
    want = flood(mask)
    assert whole.max() == tiled.max() == want.max()
    pairs = {(a, b) for a, b in zip(tiled[mask], want[mask])}
    assert len(pairs) == want.max() and not tiled[~mask].any()


def test_stitched_tiles_label_like_the_whole_image(spark):
    """Objects that cross many tiles, touch at tile corners, or wind in and out of a tile."""
    from pyspark.sql import functions as F
    from tests.helpers import grid

    from rasterlab.plans.queries_export import bright_regions

    rng = np.random.default_rng(12)
    img = (rng.random((70, 90)) < 0.62).astype(float)
    img[3, :] = 1.0
    img[::6, 5:80] = 1.0
    img[40:60, 20] = 1.0
    px = pixels(spark, np.zeros(img.shape), img).select("condition", "image_set", "y", "x", F.array("value").alias("channels"), F.lit(0.5).alias("threshold"))
    whole = grid(ex.segment(px, bright_regions, params=["threshold"]))
    assert whole.max() > 20
    for tile, halo in ((32, 1), (16, 3)):
        assert np.array_equal(grid(ex.segment(px, bright_regions, params=["threshold"], tile=tile, halo=halo)), whole)
    none = px.withColumn("threshold", F.lit(2.0))
    assert grid(ex.segment(none, bright_regions, params=["threshold"], tile=32, halo=1)).max() == 0
