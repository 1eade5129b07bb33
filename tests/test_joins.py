import re
import sys

import pytest
from pyspark.sql import functions as F

from rasterlab.functions.joins import attach, attach_labels
from rasterlab.operators.masks import dilate
from rasterlab.plans import catalog


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def joins_of(df):
    """The key lists of the sort-merge joins of a plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"SortMergeJoin\(?.*?\[([^\]]*)\]", plan)]


@pytest.mark.parametrize("name", ["x5_normalise", "x7_auto_contrast", "l7_saturated"])
def test_image_joins_are_salted(spark, sf_dir, no_broadcast, name):
    keys = joins_of(catalog.QUERIES[name](spark, sf_dir))
    assert any("_salt" in k for k in keys)


@pytest.mark.parametrize("name", ["q9_apply_qc", "m1_remove_cells"])
def test_label_joins_spread_background(spark, sf_dir, no_broadcast, name):
    keys = joins_of(catalog.QUERIES[name](spark, sf_dir))
    assert any("_own" in k for k in keys)


IMAGE_KEYS = {"condition", "image_set", "marker", "path", "frame"}
PIXEL_QUERIES = [
    "b3_annular_ring", "b5_voronoi", "b8_plane_fit", "b10_dispatch_auto", "b14_corner_background", "b1_real_values", "m5_grow_from_seed",
    "m6_clean_small_objects", "m8_dilate_more", "m9_merge_union", "m11_smooth_boundaries", "g7_segmentation_input", "l7_saturated", "x5_normalise",
    "x9_rgb_composite",
]


def bare_joins(df):
    """Sort-merge joins of a plan on image keys alone with pixels (y, x) on a side."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan()]
    names = lambda seq: {seq.apply(i).name() for i in range(seq.size())}
    while todo:
        node = todo.pop()
        inner = node.children()
        todo += [inner.apply(i) for i in range(inner.size())]
        if node.nodeName() == "SortMergeJoin":
            keys = {re.sub(r"#\d+L?", "", k.strip()) for k in node.leftKeys().mkString(",").split(",")}
            sides = [names(side.output()) for side in (node.left(), node.right())]
            if keys <= IMAGE_KEYS and any({"y", "x"} <= s for s in sides):
                found.append(sorted(keys))
    return found


@pytest.mark.parametrize("name", PIXEL_QUERIES)
def test_no_join_of_pixels_on_image_keys_alone(spark, sf_dir, no_broadcast, monkeypatch, name):
    """Also in the tables that a query writes on its way."""
    seen = []
    for module in [m for k, m in sys.modules.items() if k.startswith("rasterlab.") and hasattr(m, "cut_lineage")]:
        cut = module.cut_lineage

        def record(df, cut=cut):
            seen.extend(bare_joins(df))
            return cut(df)

        monkeypatch.setattr(module, "cut_lineage", record)
    assert bare_joins(catalog.QUERIES[name](spark, sf_dir)) + seen == []


def test_bare_joins_are_seen(spark, no_broadcast):
    px = spark.createDataFrame([("c", 0, y, x) for y in range(3) for x in range(3)], "condition string, image_set int, y int, x int")
    images = px.groupBy("condition", "image_set").agg(F.max("x").alias("w"))
    assert bare_joins(px.join(images, ["condition", "image_set"])) == [["condition", "image_set"]]
    assert bare_joins(attach(px, images, ["condition", "image_set"])) == []


def test_densities_spread_conditions(spark, sf_dir, no_broadcast):
    assert any("_salt" in k for k in joins_of(catalog.QUERIES["t6_kde_2d"](spark, sf_dir)))


def test_attach_like_a_join(spark, no_broadcast):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit(None).cast("int").alias("n"))
    values = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, v long")
    for how in ("inner", "left"):
        want = rows.join(values, "k", how)
        got = attach(rows, values, "k", how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_attach_labels_leaves_background(spark, no_broadcast):
    px = spark.createDataFrame([("c", y, x, (y * 3 + x) % 4) for y in range(9) for x in range(9)], "condition string, y int, x int, label int")
    values = spark.createDataFrame([("c", 1, "one"), ("c", 0, "none")], "condition string, label int, v string")
    got = attach_labels(px, values, ["condition"]).collect()
    assert len(got) == 81 and all(r.v == ("one" if r.label == 1 else None) for r in got)


def test_attach_counts_its_copies(spark):
    """A table below the broadcast limit is above it 64 times over, and must not pass through the driver."""
    values = spark.range(100_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    plan = attach(spark.range(10_000_000).select("id", (F.col("id") % 7).alias("k")), values, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["g1_contour_rings", "g6_segment_tiles", "m6_clean_small_objects"])
def test_small_groups_are_not_copied(spark, sf_dir, no_broadcast, monkeypatch, name):
    """Values of points, objects and rings are as many as pixels: joined once each, not 64 times."""
    seen = []
    for module in [m for k, m in sys.modules.items() if k.startswith("rasterlab.") and hasattr(m, "cut_lineage")]:
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: (seen.extend(joins_of(df)), cut(df))[1])
    seen += joins_of(catalog.QUERIES[name](spark, sf_dir))
    assert [k for k in seen if "_salt" in k and any(c in k for c in ("node", "_code", "component", "_ring"))] == []


def test_pixels_are_not_broadcast(spark):
    """A written table of pixels is small in its file and large in memory."""
    px = spark.range(400).selectExpr(
        "'c' as condition", "0L as image_set", "cast(id div 20 as int) as y", "cast(id % 20 as int) as x", "cast(id = 210 as int) as label")
    got = dilate(px, iterations=3)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.where("label = 1").count() == 25
