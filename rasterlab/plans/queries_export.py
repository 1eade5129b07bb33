"""File round trips, sinks, contours, pyramids, inference and whole analyses."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from rasterlab.functions.graph import smallest_roots
from rasterlab.operators import export as ex
from rasterlab.operators import pixels as p
from rasterlab.operators import spatial as sp
from rasterlab.operators import summary as s
from rasterlab.operators import tables as t
from rasterlab.operators import tracking as tr
from rasterlab.plans import analyses, views
from rasterlab.plans.queries_cells import MSTATS
from rasterlab.plans.queries_shape import MOM
from rasterlab.plans.queries_stats import KRUSKAL_P, LONG
from rasterlab.plans.queries_summary import IQR3, LIMITS
from rasterlab.plans.queries_tracking import MOVIE, movie
from rasterlab.plans.registry import query, rounded
from rasterlab.session import shared_folder
from rasterlab.sources import images as im
from rasterlab.sources import sinks

PLACE = ("condition", "image_set", "y", "x")


def scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/out-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- decoding

@query("s4_decode_images", "raster", "SELECT condition, image_set, y, x, value::DOUBLE AS value, 'uint16' AS dtype FROM raster")
def s4_decode_images(spark, sf_dir):
    files = im.encode_tiles(views.raster(spark, sf_dir), extension="tif")
    return im.place_tiles(im.decode_images(files)).select(*PLACE, "value", "dtype")


@query("s5_decode_channels", "mosaic", """
SELECT condition, image_set, CAST(0 AS INT) AS channel, y, x, value::DOUBLE AS value FROM mosaic
UNION ALL SELECT condition, image_set, 1, y, x, (2000 - value)::DOUBLE FROM mosaic""")
def s5_decode_channels(spark, sf_dir):
    px = views.mosaic(spark, sf_dir).withColumn("other", 2000 - F.col("value"))
    files = im.encode_tiles(px, extension="tif", channels=["value", "other"])
    return im.place_tiles(im.decode_channels(files)).select("condition", "image_set", "channel", "y", "x", "value")


@query("s6_decode_masks", "mosaic", "SELECT condition, image_set, y, x, label FROM mosaic")
def s6_decode_masks(spark, sf_dir):
    px = views.mosaic(spark, sf_dir)
    parts = [im.encode_tiles(px.where(F.col("image_set") % 3 == i), value="label", extension=e)
             for i, e in enumerate(("npy", "npz", "tif"))]
    files = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return im.place_tiles(im.decode_masks(files)).select(*PLACE, "label")


# ---------------------------------------------------------------- sinks

@query("s8_save_masks", "mosaic", "SELECT condition, image_set, y, x, label, 'uint16' AS dtype FROM mosaic")
def s8_save_masks(spark, sf_dir):
    path = scratch(spark)
    sinks.save_masks(views.mosaic(spark, sf_dir), path)
    return sinks.load_masks(spark, path).select(*PLACE, "label", "dtype")


@query("s9_save_results", "cells", 'SELECT Condition AS "Condition", ImageSet AS "ImageSet", CellID AS "CellID", Area AS "Area", A_CTCF AS "A_CTCF", B_CTCF AS "B_CTCF" FROM cells')
def s9_save_results(spark, sf_dir):
    path = scratch(spark)
    sinks.save_results(views.cells(spark, sf_dir), path)
    return sinks.load_results(spark, path)


@query("s10_export_csv", "cells", f"""{LIMITS}
SELECT Condition AS "Condition", CellID AS "CellID", round(A_CTCF, 2) AS "A_CTCF" FROM flagged WHERE NOT (is_outlier_area OR "is_outlier_A" OR "is_outlier_B")""")
def s10_export_csv(spark, sf_dir):
    path = scratch(spark)
    sinks.export_csv(s.flag_outliers(views.cells(spark, sf_dir)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("Condition", F.col("CellID").cast("bigint").alias("CellID"), F.round(F.col("A_CTCF").cast("double"), 2).alias("A_CTCF"))


@query("s11_export_by_segmentation", "cells", """
SELECT CASE WHEN CellID % 3 = 0 THEN 'nuclear' ELSE 'cellular' END AS "SegmentationType", count(*) AS n, CAST(sum(CellID) AS BIGINT) AS ids FROM cells GROUP BY ALL""")
def s11_export_by_segmentation(spark, sf_dir):
    path = scratch(spark)
    sinks.export_by_segmentation(views.cells(spark, sf_dir).withColumn(
        "SegmentationType", F.when(F.col("CellID") % 3 == 0, "nuclear").otherwise("cellular")), path)
    return spark.read.option("header", True).csv(path).groupBy("SegmentationType").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("CellID").cast("bigint")).alias("ids"))


@query("s12_export_tracks", "tracks", """
SELECT condition, track_id, frame, label FROM tracks""")
def s12_export_tracks(spark, sf_dir):
    path = scratch(spark)
    sinks.export_tracks(views.tracks(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path).select(
        "condition", *[F.col(c).cast(k).alias(c) for c, k in (("track_id", "bigint"), ("frame", "int"), ("label", "bigint"))])


@query("s12_export_lineage", "tracks", """
SELECT DISTINCT condition, track_id AS "DaughterID", parent_id AS "ParentID" FROM tracks WHERE parent_id IS NOT NULL""")
def s12_export_lineage(spark, sf_dir):
    path = scratch(spark)
    sinks.export_lineage(views.tracks(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path).select(
        "condition", F.col("DaughterID").cast("bigint").alias("DaughterID"), F.col("ParentID").cast("bigint").alias("ParentID"))


@query("s13_roi_metadata", "mosaic", """
SELECT condition, image_set, label AS "CellID", 'Cell_' || lpad(label::VARCHAR, 3, '0') AS "ROI_Name", count(*) AS "Area",
       printf('%.2f', round(avg(y), 2)) AS "Centroid_Y", printf('%.2f', round(avg(x), 2)) AS "Centroid_X" FROM mosaic WHERE label > 0 GROUP BY ALL""")
def s13_roi_metadata(spark, sf_dir):
    return ex.roi_metadata(views.mosaic(spark, sf_dir))


# ---------------------------------------------------------------- contours and pyramids

@query("g1_contour_vertices", "mosaic", """
SELECT m.condition, m.image_set, m.label, m.y + dy / 2.0::DOUBLE AS cy, m.x + dx / 2.0::DOUBLE AS cx
FROM mosaic m, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
JOIN mosaic s ON s.image_set = m.image_set AND s.y = m.y + dy AND s.x = m.x + dx WHERE m.label > 0 AND s.label <> m.label""")
def g1_contour_vertices(spark, sf_dir):
    return ex.contour_vertices(views.mosaic(spark, sf_dir))


_SIDE = "SELECT condition, image_set, label, (y::BIGINT * 2147483648 + x) * 4 + {k} AS node, y + {dy} AS cy, x + {dx} AS cx, CASE WHEN {on} IS NULL THEN NULL WHEN {on} <> label THEN (y::BIGINT * 2147483648 + x) * 4 + {turn} WHEN {over} <> label THEN ((y::BIGINT + {oy}) * 2147483648 + x + {ox}) * 4 + {k} ELSE ((y::BIGINT + {ay}) * 2147483648 + x + {ax}) * 4 + {back} END AS next FROM nb2 WHERE label > 0 AND {out} <> label"
_SIDES = " UNION ALL ".join(_SIDE.format(**dict(zip("k dy dx out on over turn oy ox ay ax back".split(), v))) for v in [
    (0, "-0.5::DOUBLE", "0.0::DOUBLE", "n", "e", "ne", 1, 0, 1, -1, 1, 3), (1, "0.0::DOUBLE", "0.5::DOUBLE", "e", "s", "se", 2, 1, 0, 1, 1, 0),
    (2, "0.5::DOUBLE", "0.0::DOUBLE", "s", "w", "sw", 3, 0, -1, 1, -1, 1), (3, "0.0::DOUBLE", "-0.5::DOUBLE", "w", "n", "nw", 0, -1, 0, -1, -1, 2)])


@query("g1_contour_rings", "mosaic", f"""
 nb AS (SELECT condition, image_set, y, x, label, lag(label) OVER r AS w, lead(label) OVER r AS e, lag(label) OVER c AS n, lead(label) OVER c AS s FROM mosaic
        WINDOW r AS (PARTITION BY image_set, y ORDER BY x), c AS (PARTITION BY image_set, x ORDER BY y)),
 nb2 AS (SELECT *, lag(n) OVER r AS nw, lead(n) OVER r AS ne, lag(s) OVER r AS sw, lead(s) OVER r AS se FROM nb WINDOW r AS (PARTITION BY image_set, y ORDER BY x)),
 v AS MATERIALIZED ({_SIDES}),
 walk(image_set, label, head, node, pos, next) AS (
   SELECT image_set, label, node, node, 0::BIGINT, next FROM v
   UNION ALL SELECT w.image_set, w.label, w.head, v.node, w.pos + 1, v.next FROM walk w JOIN v ON v.image_set = w.image_set AND v.node = w.next AND v.node <> w.head),
 way AS (SELECT image_set, label, head, count(*) AS n, min(node) AS low, bool_or(next IS NOT DISTINCT FROM head) AS closed FROM walk GROUP BY ALL),
 heads AS (SELECT *, row_number() OVER (PARTITION BY image_set, label ORDER BY n DESC, low) - 1 AS ring FROM way ANTI JOIN (SELECT image_set, next AS head FROM v) b
           ON NOT way.closed AND b.image_set = way.image_set AND b.head = way.head WHERE NOT closed OR head = low)
SELECT v.condition, v.image_set, v.label, CAST(ring AS INT) AS ring, pos AS position, cy, cx
FROM heads h JOIN walk w USING (image_set, label, head) JOIN v ON v.image_set = w.image_set AND v.node = w.node""")
def g1_contour_rings(spark, sf_dir):
    return ex.contour_rings(views.mosaic(spark, sf_dir))


@query("g1_contour_summary", "mosaic", """
 v AS (SELECT m.condition, m.image_set, m.label AS "CellID", count(*) AS n_vertices FROM mosaic m, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
       JOIN mosaic s ON s.image_set = m.image_set AND s.y = m.y + dy AND s.x = m.x + dx WHERE m.label > 0 AND s.label <> m.label GROUP BY ALL),
 a AS (SELECT condition, image_set, label AS "CellID", count(*) AS "Area" FROM mosaic WHERE label > 0 GROUP BY ALL)
SELECT condition, image_set, "CellID", "Area", coalesce(n_vertices, 0) AS n_vertices FROM a LEFT JOIN v USING (condition, image_set, "CellID")""")
def g1_contour_summary(spark, sf_dir):
    return ex.contour_summary(views.mosaic(spark, sf_dir)).select("condition", "image_set", "CellID", "Area", "n_vertices")


@query("g4_mask_pyramid", "mosaic", """
 lv AS (SELECT unnest(range(0, 8)) AS level), sz AS (SELECT level, CAST(greatest(1, 80 // (2 ** (7 - level))::INT) AS INT) AS n FROM lv),
 tg AS (SELECT level, n, unnest(range(0, n)) AS i FROM sz), sr AS (SELECT level, i, ((2*i + 1) * 80) // (2*n) AS src FROM tg)
SELECT m.condition, m.image_set, CAST(a.level AS INT) AS level, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, label, CAST(a.i // 256 AS INT) AS tile_y, CAST(b.i // 256 AS INT) AS tile_x
FROM mosaic m JOIN sr a ON a.src = m.y JOIN sr b ON b.src = m.x AND b.level = a.level""")
def g4_mask_pyramid(spark, sf_dir):
    return ex.mask_pyramid(views.mosaic(spark, sf_dir), size=views.MOSAIC_SIZE).select(*PLACE, "level", "label", "tile_y", "tile_x")


@query("g5_image_pyramid", "mosaic", """
 q AS (SELECT condition, image_set, quantile_cont(value::DOUBLE, 0.01) AS lo, quantile_cont(value::DOUBLE, 0.99) AS hi FROM mosaic GROUP BY ALL),
 n AS (SELECT m.condition, m.image_set, y, x, least(greatest((value - lo) / (hi - lo), 0), 1) AS norm FROM mosaic m JOIN q USING (condition, image_set)),
 lv AS (SELECT unnest(range(0, 8)) AS level), sz AS (SELECT level, (2 ** (7 - level))::INT AS sc, CAST(greatest(80 // (2 ** (7 - level))::INT - 1, 0) AS INT) AS top FROM lv)
SELECT condition, image_set, CAST(level AS INT) AS level, CAST(least(y // sc, top) AS INT) AS y, CAST(least(x // sc, top) AS INT) AS x,
       CAST(floor(round(avg(norm) * 255, 6)) AS INT) AS gray, CAST(0 AS INT) AS tile_y, CAST(0 AS INT) AS tile_x
FROM n, sz GROUP BY condition, image_set, level, least(y // sc, top), least(x // sc, top)""")
def g5_image_pyramid(spark, sf_dir):
    return ex.image_pyramid(views.mosaic(spark, sf_dir), size=views.MOSAIC_SIZE)


# ---------------------------------------------------------------- segmentation

def bright_regions(image: np.ndarray, params) -> np.ndarray:
    """A stand-in model: connected regions of the first channel above a threshold."""
    on = image[0] > params["threshold"]
    grid = np.where(on, np.arange(on.size).reshape(on.shape), -1)
    pairs = [(grid[:, :-1], grid[:, 1:]), (grid[:-1], grid[1:])]
    a = np.concatenate([q.ravel() for q, _ in pairs])
    b = np.concatenate([q.ravel() for _, q in pairs])
    both = (a >= 0) & (b >= 0)
    root = smallest_roots(on.size, a[both], b[both]).reshape(on.shape)
    found = np.unique(root[on])
    return np.where(on, np.searchsorted(found, root) + 1, 0)


def channel_files(spark, sf_dir):
    """The two-marker mosaic as channel files: suffixes c0 and C1."""
    return views.markers(spark, sf_dir).select(
        "condition", "image_set", F.when(F.col("marker") == "A", "c0").otherwise("C1").alias("suffix"), "y", "x", "value"
    ).withColumn("path", F.concat_ws("_", "condition", "image_set", "suffix"))


def wanted_channels(px):
    return px.select("condition", "image_set").distinct().select(
        "condition", "image_set", F.posexplode(F.array(F.lit("C1"), F.lit("C0"), F.lit("x9"))).alias("pos", "suffix"))


@query("g7_segmentation_input", "mosaic", """
 q AS (SELECT condition, image_set, quantile_cont(value::DOUBLE, 0.01) AS lo, quantile_cont(value::DOUBLE, 0.99) AS hi FROM mosaic GROUP BY ALL)
SELECT m.condition, m.image_set, y, x, round(least(greatest(1 - (value - lo) / (hi - lo), 0), 1), 6) AS first, CAST(1 AS INT) AS n_channels
FROM mosaic m JOIN q USING (condition, image_set)""")
def g7_segmentation_input(spark, sf_dir):
    """C1 matches exactly; upper-case C0 finds no file, as only the wanted spelling or its cases are tried."""
    px = channel_files(spark, sf_dir)
    files = px.select("condition", "image_set", "suffix", "path").distinct()
    out = ex.segmentation_input(px, files, wanted_channels(px).where("suffix <> 'C0'"))
    return out.select(*PLACE, F.round(F.col("channels")[0], 6).alias("first"), F.size("channels").alias("n_channels"))


# the model: connected pixels of the first channel above the condition's threshold, numbered row by row
SEGMENTED = """
 v AS (SELECT condition, image_set, y, x, value FROM markers WHERE marker = 'B' AND image_set % 4 <> 3),
 q AS (SELECT condition, image_set, quantile_cont(value::DOUBLE, 0.01) AS lo, quantile_cont(value::DOUBLE, 0.99) AS hi FROM v GROUP BY ALL),
 lit AS (SELECT v.condition, v.image_set, y, x, y::BIGINT * 2147483648 + x AS code FROM v JOIN q USING (condition, image_set)
         LEFT JOIN region ON v.condition = 'c' || CAST(r_regionkey AS VARCHAR)
         WHERE least(greatest((value - lo) / (hi - lo), 0), 1) > coalesce(0.6::DOUBLE + r_regionkey / 20.0::DOUBLE, 0.75::DOUBLE)),
 reach(condition, image_set, start, y, x) AS (
   SELECT condition, image_set, code, y, x FROM lit
   UNION
   SELECT r.condition, r.image_set, r.start, n.y, n.x FROM reach r CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)
     JOIN lit n ON n.condition = r.condition AND n.image_set = r.image_set AND n.y = r.y + o.dy AND n.x = r.x + o.dx),
 part AS (SELECT condition, image_set, y, x, min(start) AS first FROM reach GROUP BY ALL),
 num AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY condition, image_set ORDER BY first) AS INT) AS label FROM part)
SELECT condition, image_set, v.y, v.x, coalesce(label, 0) AS label FROM v LEFT JOIN num USING (condition, image_set, y, x)"""


@query("g6_segment_images", "mosaic markers", SEGMENTED)
def g6_segment_images(spark, sf_dir):
    from rasterlab.sources.files import pending

    px = channel_files(spark, sf_dir)
    files = px.select("condition", "image_set", "suffix", "path").distinct()
    done = px.where("image_set % 4 = 3").select("condition", "image_set").distinct()
    todo = pending(px.select("condition", "image_set").distinct(), done)
    regions = views.table(spark, sf_dir, "region").selectExpr(
        "concat('c', cast(r_regionkey as string)) as condition", "0.6d + r_regionkey / 20d as threshold")
    settings = t.with_overrides(todo, regions, {"threshold": 0.75, "sigma": 1.0})
    inputs = ex.segmentation_input(px, files, wanted_channels(px)).join(settings, ["condition", "image_set"])
    return ex.segment(inputs, bright_regions, params=["threshold"])


@query("g6_segment_tiles", "mosaic markers", SEGMENTED)
def g6_segment_tiles(spark, sf_dir):
    """The same labels from overlapping tiles, stitched."""
    px = channel_files(spark, sf_dir)
    files = px.select("condition", "image_set", "suffix", "path").distinct()
    regions = views.table(spark, sf_dir, "region").selectExpr(
        "concat('c', cast(r_regionkey as string)) as condition", "0.6d + r_regionkey / 20d as threshold")
    todo = px.where("image_set % 4 <> 3").select("condition", "image_set").distinct()
    settings = t.with_overrides(todo, regions, {"threshold": 0.75})
    inputs = ex.segmentation_input(px, files, wanted_channels(px)).join(settings, ["condition", "image_set"])
    return ex.segment(inputs, bright_regions, params=["threshold"], tile=32, halo=4)


# ---------------------------------------------------------------- analyses

Z1 = f"""{MOM},
 m2 AS (SELECT m.condition, m.image_set, marker, y, x, nuclear_label, value, CASE WHEN is_border OR area > 12 THEN 0 ELSE m.label END AS label
        FROM markers m LEFT JOIN mom ON mom.image_set = m.image_set AND mom.label = m.label),
 {MSTATS.strip().replace("FROM markers", "FROM m2")},
 bg AS (SELECT condition, image_set, marker, median(value::DOUBLE) FILTER (label = 0) AS background, stddev_pop(value) FILTER (label = 0) AS bg_std, 0.99::DOUBLE * max(value) AS top
        FROM m2 GROUP BY ALL),
 c AS (SELECT st.*, background, bg_std, max >= top AS sat, greatest(0, int_den - area*background - CASE WHEN marker = 'A' THEN nuclear_sum ELSE 0 END) AS ctcf
       FROM stats st JOIN bg USING (condition, image_set, marker)),
 cut AS (SELECT condition, image_set, marker, quantile_cont(mean, 0.05) AS p5, count(*) AS n FROM c GROUP BY ALL),
 d AS (SELECT c.*, n > 10 AND mean < p5 AS dim FROM c JOIN cut USING (condition, image_set, marker)),
 w AS (SELECT condition AS "Condition", image_set AS "ImageSet", label::BIGINT AS "CellID", max(area) AS "Area",
        max(ctcf) FILTER (marker = 'A') AS a, max(ctcf) FILTER (marker = 'B') AS b, max(mean) FILTER (marker = 'B') AS bm, max(background) FILTER (marker = 'A') AS ab,
        max(sqrt(area*std*std + CAST(area AS DOUBLE)*area*bg_std*bg_std)) FILTER (marker = 'A') AS sg, bool_or(sat) FILTER (marker = 'A') AS is_saturated, bool_or(dim) FILTER (marker = 'A') AS is_dim
       FROM d GROUP BY condition, image_set, label),
 md AS (SELECT "Condition", median("Area") AS am, median(a) AS xm, median(b) AS bm0, count(*) AS n FROM w GROUP BY ALL),
 mm AS (SELECT "Condition", any_value(am) AS am, any_value(xm) AS xm, any_value(bm0) AS bm0, any_value(n) AS n, median(abs("Area" - am)) AS ad, median(abs(a - xm)) AS xd, median(abs(b - bm0)) AS bd
        FROM w JOIN md USING ("Condition") GROUP BY "Condition")
SELECT "Condition", "ImageSet", "CellID", "Area", round(a, 6) AS "A_CTCF", round(b, 6) AS "B_CTCF", round(bm, 6) AS "B_MeanIntensity", round(ab, 6) AS "A_Background",
       round(sg, 6) AS "A_CTCF_sigma", is_saturated, is_dim, 'global_roi' AS background_method,
       coalesce(n >= 3 AND ad >= 1e-12 AND abs(0.6745::DOUBLE * ("Area" - am) / ad) > 3.5, false) AS is_outlier_area,
       coalesce(n >= 3 AND xd >= 1e-12 AND abs(0.6745::DOUBLE * (a - xm) / xd) > 3.5, false) AS "is_outlier_A",
       coalesce(n >= 3 AND bd >= 1e-12 AND abs(0.6745::DOUBLE * (b - bm0) / bd) > 3.5, false) AS "is_outlier_B"
FROM w JOIN mm USING ("Condition")"""


@query("z1_full_quantification", "mosaic markers", Z1)
def z1_full_quantification(spark, sf_dir):
    out = analyses.quantify(views.markers(spark, sf_dir), ["A", "B"], thresholds={"max_area": 12},
                            background="global_roi", nuclear_markers=["A"])
    return rounded(out.select(
        "Condition", "ImageSet", "CellID", "Area", "A_CTCF", "B_CTCF", "B_MeanIntensity", "A_Background", "A_CTCF_sigma",
        "is_saturated", "is_dim", "background_method", "is_outlier_area", "is_outlier_A", "is_outlier_B"))


# calibration frames of the mosaic's own shape; corrected pixels are real numbers
CALIBRATED = """
 frames AS (SELECT y, x, (value % 64)::DOUBLE AS d, (1000 + value % 200)::DOUBLE AS f FROM mosaic WHERE image_set < 3),
 masters AS (SELECT y, x, median(d) AS dark, median(f) AS f FROM frames GROUP BY ALL),
 cm AS (SELECT m.* EXCLUDE (value), greatest((value - dark) / greatest(f / (SELECT median(f) FROM masters), 0.01::DOUBLE), 0) AS value FROM markers m JOIN masters USING (y, x)),
"""


def calibrated(spark, sf_dir):
    from rasterlab.operators.pixels import master_dark, master_flat

    frames = views.mosaic(spark, sf_dir).where("image_set < 3")
    dark = master_dark(frames.selectExpr("image_set AS frame_no", "y", "x", "value % 64 AS value"))
    flat = master_flat(frames.selectExpr("image_set AS frame_no", "y", "x", "1000 + value % 200 AS value"))
    return dark, flat


@query("z1_calibrated", "mosaic markers", CALIBRATED + Z1.replace("FROM markers m ", "FROM cm m "))
def z1_calibrated(spark, sf_dir):
    dark, flat = calibrated(spark, sf_dir)
    out = analyses.quantify(views.markers(spark, sf_dir), ["A", "B"], thresholds={"max_area": 12}, dark=dark, flat=flat,
                            background="global_roi", nuclear_markers=["A"])
    return rounded(out.select(
        "Condition", "ImageSet", "CellID", "Area", "A_CTCF", "B_CTCF", "B_MeanIntensity", "A_Background", "A_CTCF_sigma",
        "is_saturated", "is_dim", "background_method", "is_outlier_area", "is_outlier_A", "is_outlier_B"))


@query("z1_auto_background")
def z1_auto_background(spark, sf_dir):
    return rounded(analyses.quantify(views.markers(spark, sf_dir), ["A", "B"], pixel_size_um=0.5))


@query("z2_qc_report", "cells", """
 fov AS (SELECT Condition, ImageSet, count(*) AS n_cells, median(A_CTCF) AS m, median(B_CTCF) AS b FROM cells GROUP BY ALL)
SELECT Condition AS "Condition", 'A' AS "Marker", CAST(sum(n_cells) AS BIGINT) AS "N_cells", count(*) AS "N_FOVs", round(avg(m), 2) AS mean_of_fov_medians FROM fov GROUP BY Condition
UNION ALL SELECT Condition, 'B', CAST(sum(n_cells) AS BIGINT), count(*), round(avg(b), 2) FROM fov GROUP BY Condition""")
def z2_qc_report(spark, sf_dir):
    _, summary = analyses.qc_report(views.cells(spark, sf_dir))
    return summary.select("Condition", "Marker", "N_cells", "N_FOVs", "mean_of_fov_medians")


@query("z3_batch_summary", "mosaic markers", """
 bg AS (SELECT condition, image_set, marker, median(value::DOUBLE) FILTER (label = 0) AS b FROM markers GROUP BY ALL),
 st AS (SELECT condition, image_set, marker, label, count(*) AS area, sum(value)::DOUBLE AS d FROM markers WHERE label > 0 GROUP BY ALL),
 c AS (SELECT condition, image_set, label, marker, area, greatest(0, d - area * b) AS ctcf FROM st JOIN bg USING (condition, image_set, marker))
SELECT condition AS "Condition", count(*) FILTER (marker = 'A') AS "N_Cells", round(avg(area) FILTER (marker = 'A'), 6) AS "Mean_Area", round(stddev_samp(area) FILTER (marker = 'A'), 6) AS "Std_Area",
       round(avg(ctcf) FILTER (marker = 'A'), 6) AS "A_Mean_CTCF", round(stddev_samp(ctcf) FILTER (marker = 'A'), 6) AS "A_Std_CTCF", round(median(ctcf) FILTER (marker = 'A'), 6) AS "A_Median_CTCF",
       round(avg(ctcf) FILTER (marker = 'B'), 6) AS "B_Mean_CTCF", round(stddev_samp(ctcf) FILTER (marker = 'B'), 6) AS "B_Std_CTCF", round(median(ctcf) FILTER (marker = 'B'), 6) AS "B_Median_CTCF"
FROM c GROUP BY condition""")
def z3_batch_summary(spark, sf_dir):
    return rounded(s.condition_summary(analyses.batch_analysis(views.markers(spark, sf_dir), ["A", "B"]), batch=True))


@query("z4_timelapse_ctcf", "raster", f"""{MOVIE},
 r AS (SELECT condition, label, dense_rank() OVER (PARTITION BY condition ORDER BY min(frame), label) - 1 AS track_id FROM det GROUP BY condition, label),
 bg AS (SELECT condition, frame, median(value::DOUBLE) FILTER (label = 0) AS background FROM movie GROUP BY ALL),
 st AS (SELECT condition, frame, label, count(*) AS area, sum(value)::DOUBLE AS int_den FROM movie WHERE label > 0 GROUP BY ALL)
SELECT condition, frame, track_id, label, area, round(greatest(0, int_den - area * background), 6) AS ctcf, track_id AS root_id, CAST(0 AS INT) AS generation, false AS is_division
FROM st JOIN r USING (condition, label) JOIN bg USING (condition, frame)""")
def z4_timelapse_ctcf(spark, sf_dir):
    _, ctcf = analyses.timelapse(movie(spark, sf_dir).withColumn("marker", F.lit("A")), radius=5)
    return rounded(ctcf.select("condition", "frame", "track_id", "label", "area", "ctcf", "root_id", "generation", "is_division"))


@query("z4_timelapse_dynamics", "raster", f"""{MOVIE}
SELECT condition, frame, count(*) AS n_cells, round(avg(mean_intensity), 6) AS mean_intensity FROM det GROUP BY ALL""")
def z4_timelapse_dynamics(spark, sf_dir):
    tracks, _ = analyses.timelapse(movie(spark, sf_dir).withColumn("marker", F.lit("A")), radius=5)
    return rounded(tr.cells_per_frame(tracks).join(tr.intensity_by_frame(tracks), ["condition", "frame"]))


@query("z5_ratio_study", "ratio", f"""{IQR3}
SELECT Condition AS "Condition", count(*) AS "N_cells", round(avg(Red_CTCF), 6) AS "Red_mean", round(median(Red_CTCF), 6) AS "Red_median",
       round(avg(GFP_CTCF), 6) AS "Green_mean", round(median(GFP_CTCF), 6) AS "Green_median", round(avg(ratio), 6) AS "Ratio_mean",
       round(median(ratio), 6) AS "Ratio_median", round(stddev_samp(ratio), 6) AS "Ratio_std" FROM f3 GROUP BY Condition""")
def z5_ratio_study(spark, sf_dir):
    return rounded(analyses.ratio_study(views.ratio(spark, sf_dir), parts=["summary"])["summary"])


@query("z5_ratio_tests", "ratio", f"""{IQR3}, {LONG.replace("FROM clean", "FROM f3")}
{KRUSKAL_P}""")
def z5_ratio_tests(spark, sf_dir):
    return rounded(analyses.ratio_study(views.ratio(spark, sf_dir), parts=["all_groups"])["all_groups"])


@query("z7_both_segmentations", "mosaic markers", """
 x AS (SELECT 'cellular' AS seg, condition, image_set, marker, label, value FROM markers UNION ALL SELECT 'nuclear', condition, image_set, marker, nuclear_label, value FROM markers),
 bg AS (SELECT seg, condition, image_set, marker, median(value::DOUBLE) FILTER (label = 0) AS b FROM x GROUP BY ALL),
 st AS (SELECT seg, condition, image_set, marker, label, count(*) AS area, sum(value)::DOUBLE AS d FROM x WHERE label > 0 GROUP BY ALL),
 c AS (SELECT *, greatest(0, d - area * b) AS ctcf FROM st JOIN bg USING (seg, condition, image_set, marker))
SELECT seg AS "SegmentationType", condition AS "Condition", image_set AS "ImageSet", label AS "CellID", max(area) AS "Area",
       round(max(ctcf) FILTER (marker = 'A'), 6) AS "A_CTCF", round(max(ctcf) FILTER (marker = 'B'), 6) AS "B_CTCF" FROM c GROUP BY ALL""")
def z7_both_segmentations(spark, sf_dir):
    out = analyses.both_segmentations(views.markers(spark, sf_dir), ["A", "B"])
    return rounded(out.select("SegmentationType", "Condition", "ImageSet", "CellID", "Area", "A_CTCF", "B_CTCF"))
