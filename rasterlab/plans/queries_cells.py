"""Per-cell measurement on the raster and two-marker mosaic views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import background as bg
from rasterlab.operators import cells as c
from rasterlab.operators import summary as s
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded
from rasterlab.schema import IMAGE

MK = (*IMAGE, "marker")

STATS = """
 stats AS (SELECT condition, image_set, label, count(*) AS area, CAST(sum(value) AS DOUBLE) AS int_den,
                  avg(value) AS mean, stddev_pop(value) AS std,
                  CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max
           FROM raster WHERE label <> 0 GROUP BY ALL)"""
BG = """
 bg AS (SELECT condition, image_set, coalesce(median(CAST(value AS DOUBLE)) FILTER (label = 0), 0) AS background,
               coalesce(stddev_pop(value) FILTER (label = 0), 0) AS bg_std
        FROM raster GROUP BY ALL)"""
MSTATS = """
 stats AS (SELECT condition, image_set, marker, label, count(*) AS area, CAST(sum(value) AS DOUBLE) AS int_den,
                  avg(value) AS mean, stddev_pop(value) AS std,
                  CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max,
                  CAST(sum(CASE WHEN nuclear_label > 0 THEN value ELSE 0 END) AS DOUBLE) AS nuclear_sum
           FROM markers WHERE label <> 0 GROUP BY ALL)"""
MBG = """
 bg AS (SELECT condition, image_set, marker,
               coalesce(median(CAST(value AS DOUBLE)) FILTER (label = 0), 0) AS background,
               coalesce(stddev_pop(value) FILTER (label = 0), 0) AS bg_std
        FROM markers GROUP BY ALL)"""
MCTCF = f"""{MSTATS}, {MBG},
 ctcf AS (SELECT *, ctcf / area AS mcf,
                 CASE WHEN bg_std > 0 THEN sqrt(area*std*std + CAST(area AS DOUBLE)*area*bg_std*bg_std) END AS ctcf_sigma
          FROM (SELECT stats.*, background, bg_std, greatest(0, int_den - area*background) AS ctcf
                FROM stats JOIN bg USING (condition, image_set, marker)))"""


def raster_ctcf(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    return c.add_ctcf(c.with_background(c.label_stats(px), bg.global_background(px)))


def marker_ctcf(spark, sf_dir, nuclear=()):
    px = views.markers(spark, sf_dir)
    cells = c.with_background(c.label_stats(px, MK, nuclear=bool(nuclear)), bg.global_background(px, MK), MK)
    return c.add_ctcf_sigma(c.add_ctcf(cells, nuclear))


@query("a0_condition_ctcf_summary", "raster", f"""{STATS}, {BG},
 ctcf AS (SELECT condition, image_set, label, area, greatest(0, int_den - area*background) AS M_CTCF
          FROM stats JOIN bg USING (condition, image_set)),
 fov AS (SELECT condition, image_set, count(*) AS n, median(M_CTCF) AS m FROM ctcf GROUP BY ALL)
SELECT condition AS "Condition", 'M' AS "Marker", CAST(sum(n) AS BIGINT) AS "N_cells", count(*) AS "N_FOVs",
       round(avg(m), 6) AS mean_of_fov_medians, round(coalesce(stddev_samp(m), 0), 6) AS sd_of_fov_medians,
       round(CASE WHEN avg(m) > 0 THEN coalesce(stddev_samp(m), 0) / avg(m) * 100 ELSE 0 END, 6) AS cv_percent,
       round(coalesce(stddev_samp(m), 0) / sqrt(count(*)), 6) AS sem
FROM fov GROUP BY condition""")
def a0_condition_ctcf_summary(spark, sf_dir):
    wide = raster_ctcf(spark, sf_dir).select(
        F.col("condition").alias("Condition"), F.col("image_set").alias("ImageSet"),
        F.col("area").alias("Area"), F.col("ctcf").alias("M_CTCF"),
    )
    return rounded(s.hierarchical_summary(s.fov_summary(wide)))


@query("l1_label_stats", "raster", f"""{STATS}
SELECT condition, image_set, label, area, int_den, round(mean, 6) AS mean, round(std, 6) AS std, min, max FROM stats""")
def l1_label_stats(spark, sf_dir):
    return rounded(c.label_stats(views.raster(spark, sf_dir)))


@query("l2_ctcf_global", "raster", f"""{STATS}, {BG}
SELECT condition, image_set, label, area, background, round(greatest(0, int_den - area*background), 6) AS ctcf
FROM stats JOIN bg USING (condition, image_set)""")
def l2_ctcf_global(spark, sf_dir):
    return rounded(raster_ctcf(spark, sf_dir).select("condition", "image_set", "label", "area", "background", "ctcf"))


@query("l3_ctcf_per_cell_background", "raster", f"""{STATS},
 local AS (SELECT condition, image_set, (y//10)*5 + x//10 + 1 AS label, median(CAST(value AS DOUBLE)) AS background
           FROM raster WHERE label = 0 GROUP BY ALL)
SELECT condition, image_set, label, area, background, round(greatest(0, int_den - area*background), 6) AS ctcf
FROM stats JOIN local USING (condition, image_set, label)""")
def l3_ctcf_per_cell_background(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    own_square = F.expr("cast((y div 10)*5 + x div 10 + 1 as int)")
    local = px.where("label = 0").groupBy("condition", "image_set", own_square.alias("label")).agg(
        F.median(F.col("value").cast("double")).alias("background")
    )
    cells = c.add_ctcf(c.with_cell_background(c.label_stats(px), local))
    return rounded(cells.select("condition", "image_set", "label", "area", "background", "ctcf"))


@query("l4_nuclear_correction", "mosaic markers", f"""{MSTATS}, {MBG}
SELECT condition, image_set, marker, label, nuclear_sum,
       round(greatest(0, int_den - area*background - CASE WHEN marker = 'A' THEN nuclear_sum ELSE 0 END), 6) AS ctcf
FROM stats JOIN bg USING (condition, image_set, marker)""")
def l4_nuclear_correction(spark, sf_dir):
    return rounded(marker_ctcf(spark, sf_dir, ["A"]).select(*MK, "label", "nuclear_sum", "ctcf"))


@query("l5_mean_corrected_fluorescence", "raster", f"""{STATS}, {BG}
SELECT condition, image_set, label, round(greatest(0, int_den - area*background) / area, 6) AS mcf
FROM stats JOIN bg USING (condition, image_set)""")
def l5_mean_corrected_fluorescence(spark, sf_dir):
    return rounded(raster_ctcf(spark, sf_dir).select("condition", "image_set", "label", "mcf"))


@query("l6_ctcf_sigma", "raster", f"""{STATS}, {BG}
SELECT condition, image_set, label,
       round(CASE WHEN bg_std > 0 THEN sqrt(area*std*std + CAST(area AS DOUBLE)*area*bg_std*bg_std) END, 6) AS ctcf_sigma
FROM stats JOIN bg USING (condition, image_set)""")
def l6_ctcf_sigma(spark, sf_dir):
    return rounded(c.add_ctcf_sigma(raster_ctcf(spark, sf_dir)).select("condition", "image_set", "label", "ctcf_sigma"))


@query("l7_saturated", "raster", f"""{STATS},
 lim AS (SELECT condition, image_set, 0.99::DOUBLE * max(value) AS top FROM raster GROUP BY ALL)
SELECT condition, image_set, label, max >= top AS by_image_max, max >= 65535.0::DOUBLE*0.99::DOUBLE AS by_uint16,
       max >= 3900 AS by_threshold
FROM stats JOIN lim USING (condition, image_set)""")
def l7_saturated(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    out = c.label_stats(px)
    for name, how in (("by_image_max", {"dtype": "float32"}), ("by_uint16", {"dtype": "uint16"}),
                      ("by_threshold", {"threshold": 3900})):
        out = c.flag_saturated(out, c.saturation_limits(px, **how)).withColumnRenamed("is_saturated", name)
    return out.select("condition", "image_set", "label", "by_image_max", "by_uint16", "by_threshold")


@query("l8_dim", "raster", f"""{STATS},
 cut AS (SELECT condition, image_set, quantile_cont(mean, 0.05) AS p5, count(*) AS n FROM stats GROUP BY ALL)
SELECT condition, image_set, label, n > 10 AND mean < p5 AS is_dim FROM stats JOIN cut USING (condition, image_set)""")
def l8_dim(spark, sf_dir):
    return c.flag_dim(c.label_stats(views.raster(spark, sf_dir))).select("condition", "image_set", "label", "is_dim")


@query("l9_multi_marker", "mosaic markers", f"""{MCTCF}
SELECT condition, image_set, marker, label, area, int_den, round(mean, 6) AS mean, round(std, 6) AS std, min, max,
       background, round(ctcf, 6) AS ctcf, round(mcf, 6) AS mcf, round(ctcf_sigma, 6) AS ctcf_sigma FROM ctcf""")
def l9_multi_marker(spark, sf_dir):
    return rounded(marker_ctcf(spark, sf_dir).select(
        *MK, "label", "area", "int_den", "mean", "std", "min", "max", "background", "ctcf", "mcf", "ctcf_sigma"))


@query("l10_wide_results", "mosaic markers", f"""{MCTCF},
 shape AS (SELECT condition, image_set, label, avg(y) AS y_centroid, avg(x) AS x_centroid
           FROM mosaic WHERE label % 3 <> 0 GROUP BY ALL),
 wide AS (SELECT condition AS "Condition", 'cellular' AS "SegmentationType", image_set AS "ImageSet", label AS "CellID",
        max(area) AS "Area",
        round(max(ctcf) FILTER (marker='A'), 6) AS "A_CTCF", round(max(int_den) FILTER (marker='A'), 6) AS "A_IntegratedDensity",
        round(max(mean) FILTER (marker='A'), 6) AS "A_MeanIntensity", round(max(background) FILTER (marker='A'), 6) AS "A_Background",
        round(max(ctcf) FILTER (marker='B'), 6) AS "B_CTCF", round(max(int_den) FILTER (marker='B'), 6) AS "B_IntegratedDensity",
        round(max(mean) FILTER (marker='B'), 6) AS "B_MeanIntensity", round(max(background) FILTER (marker='B'), 6) AS "B_Background",
        round(max(area) * 0.25, 6)::DOUBLE AS area_um2
   FROM ctcf GROUP BY condition, image_set, label)
SELECT wide.*, round(coalesce(x_centroid, 0), 6) AS x_centroid, round(coalesce(y_centroid, 0), 6) AS y_centroid
FROM wide LEFT JOIN shape ON shape.condition = wide."Condition" AND image_set = "ImageSet" AND label = "CellID" """)
def l10_wide_results(spark, sf_dir):
    shape = views.mosaic(spark, sf_dir).where("label % 3 <> 0").groupBy("condition", "image_set", "label").agg(
        F.avg("y").alias("y_centroid"), F.avg("x").alias("x_centroid"))
    return rounded(c.wide_results(marker_ctcf(spark, sf_dir), ["A", "B"], morphology=shape, pixel_size_um=0.5))


@query("l11_mask_stats", "mosaic", """
 a AS (SELECT condition, image_set, label, count(*) AS n FROM mosaic WHERE label <> 0 GROUP BY ALL),
 i AS (SELECT DISTINCT condition, image_set FROM mosaic)
SELECT condition, image_set, count(n) AS n_cells, coalesce(min(n), 0) AS min_area, coalesce(max(n), 0) AS max_area,
       round(coalesce(avg(n), 0), 6) AS mean_area
FROM i LEFT JOIN a USING (condition, image_set) GROUP BY ALL""")
def l11_mask_stats(spark, sf_dir):
    return rounded(c.mask_stats(views.mosaic(spark, sf_dir)))


@query("l12_mask_validation", "raster", """
 a AS (SELECT condition, image_set, label, count(*) AS n FROM raster WHERE label <> 0 AND label % 5 <> 3 GROUP BY ALL),
 f AS (SELECT condition, image_set, count(*) AS n_cells, min(n) AS min_area, max(n) AS max_area, avg(n) AS mean_area,
              count(*) FILTER (n < 50) AS small, max(label) AS top FROM a GROUP BY ALL)
SELECT condition, image_set, n_cells, min_area, max_area, round(mean_area, 6) AS mean_area,
       concat_ws('; ', CASE WHEN small > 0 THEN small || ' cells with area < 50 pixels (possible noise)' END,
                 CASE WHEN top > n_cells THEN 'Gap in label numbering: ' || n_cells || ' cells but max label is ' || top END
       ) AS issues, small = 0 AND top <= n_cells AS is_valid
FROM f""")
def l12_mask_validation(spark, sf_dir):
    px = views.raster(spark, sf_dir).withColumn("label", F.when(F.col("label") % 5 == 3, 0).otherwise(F.col("label")))
    return rounded(c.mask_issues(px).withColumn("issues", F.array_join("issues", "; ")))


@query("l13_missing_marker_zeros", "mosaic markers", f"""{MCTCF},
 cells AS (SELECT DISTINCT condition, image_set, label, area FROM ctcf),
 grid AS (SELECT * FROM cells, (VALUES ('A'), ('C')) m(marker))
SELECT condition, image_set, label, area, marker, round(coalesce(ctcf, 0), 6) AS ctcf, coalesce(int_den, 0) AS int_den,
       round(coalesce(mean, 0), 6) AS mean, coalesce(background, 0) AS background
FROM grid LEFT JOIN (SELECT * EXCLUDE area FROM ctcf) USING (condition, image_set, label, marker)""")
def l13_missing_marker_zeros(spark, sf_dir):
    return rounded(c.fill_missing_markers(marker_ctcf(spark, sf_dir), ["A", "C"]))


@query("l14_legacy_ctcf", "raster", f"""{STATS},
 bg AS (SELECT condition, image_set, quantile_cont(CAST(value AS DOUBLE), 0.05) FILTER (label = 0) AS background
        FROM raster GROUP BY ALL)
SELECT condition, image_set, label, area, int_den, round(mean, 6) AS mean, round(background, 6) AS background,
       round(greatest(0, int_den - area*background), 6) AS ctcf
FROM stats JOIN bg USING (condition, image_set)""")
def l14_legacy_ctcf(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    return rounded(c.legacy_ctcf(px, bg.legacy_background(px, method="percentile5")))


@query("l15_background_above_cells", "mosaic", """
 f AS (SELECT condition, image_set, median(CAST(value AS DOUBLE)) FILTER (label > 0) AS cell_median,
              quantile_cont(CAST(value AS DOUBLE), 0.5) FILTER (label = 0) AS background FROM mosaic GROUP BY ALL)
SELECT *, background > cell_median AS above_cells FROM f""")
def l15_background_above_cells(spark, sf_dir):
    px = views.mosaic(spark, sf_dir)
    return c.background_above_cells(px, bg.global_background(px))
