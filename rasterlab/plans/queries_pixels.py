"""Calibration, normalisation, colour and outline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import background as bg
from rasterlab.operators import cells as c
from rasterlab.operators import pixels as p
from rasterlab.operators import spatial as sp
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded

DARK = """
 dark AS (SELECT y, x, median(CAST(value AS DOUBLE)) AS dark FROM calibration_frames WHERE kind = 'dark' GROUP BY ALL)"""
FLAT = """
 fmed AS (SELECT y, x, median(CAST(value AS DOUBLE)) AS v FROM calibration_frames WHERE kind = 'flat' GROUP BY ALL),
 flat AS (SELECT y, x, greatest(v / (SELECT median(v) FROM fmed), 0.01::DOUBLE) AS flat FROM fmed)"""
CONTRAST = """
 q AS (SELECT condition, image_set, quantile_cont(value::DOUBLE, 0.0035) AS lo, quantile_cont(value::DOUBLE, 0.9965) AS hi FROM {src} GROUP BY ALL),
 gray AS (SELECT s.*, CAST(floor(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) AS INT) AS gray
          FROM {src} s JOIN q USING (condition, image_set))"""
HEX = "CAST(CAST(CAST(gray / 255.0::DOUBLE AS FLOAT)::DOUBLE * {v} AS FLOAT) - 0 AS DOUBLE)"


def frames(spark, sf_dir, kind):
    return views.calibration_frames(spark, sf_dir).where(F.col("kind") == kind).drop("kind")


@query("x1_master_dark", "raster calibration_frames", f"{DARK} SELECT y, x, dark FROM dark")
def x1_master_dark(spark, sf_dir):
    return p.master_dark(frames(spark, sf_dir, "dark"))


@query("x2_master_flat", "raster calibration_frames", f"{FLAT} SELECT y, x, round(flat, 6) AS flat FROM flat")
def x2_master_flat(spark, sf_dir):
    return rounded(p.master_flat(frames(spark, sf_dir, "flat")))


@query("x3_calibration_check", "raster mosaic calibration_frames", f"""{DARK}, {FLAT},
 skew AS (SELECT y, x, CASE WHEN x < 20 THEN flat * 0.3 ELSE flat END AS flat FROM flat),
 s AS (SELECT (SELECT '(' || max(y)+1 || ', ' || max(x)+1 || ')' FROM dark) AS cs,
              (SELECT '(' || max(y)+1 || ', ' || max(x)+1 || ')' FROM mosaic) AS ms,
              (SELECT median(flat) FROM skew) AS m, (SELECT avg(CASE WHEN flat < 0.5 THEN 1.0 ELSE 0 END) FROM skew) AS low)
SELECT concat_ws('; ', CASE WHEN cs <> ms THEN 'dark shape ' || cs || ' does not match image ' || ms END,
                 CASE WHEN cs <> ms THEN 'flat shape ' || cs || ' does not match image ' || ms END,
                 CASE WHEN abs(m - 1) > 0.05 THEN 'flat median ' || printf('%.3f', m) || ' is not 1' END,
                 CASE WHEN low > 0.1 THEN printf('%.1f', low * 100) || '% of flat pixels are below 0.5' END) AS issues FROM s""")
def x3_calibration_check(spark, sf_dir):
    flat = p.master_flat(frames(spark, sf_dir, "flat")).withColumn(
        "flat", F.when(F.col("x") < 20, F.col("flat") * 0.3).otherwise(F.col("flat")))
    out = p.calibration_issues(views.mosaic(spark, sf_dir), p.master_dark(frames(spark, sf_dir, "dark")), flat)
    return out.select(F.array_join("issues", "; ").alias("issues"))


@query("x4_correct_image", "raster calibration_frames", f"""{DARK}, {FLAT}
SELECT condition, image_set, y, x, label, round(greatest((value - dark) / flat, 0), 6) AS value
FROM raster JOIN dark USING (y, x) JOIN flat USING (y, x)""")
def x4_correct_image(spark, sf_dir):
    return rounded(p.correct(views.raster(spark, sf_dir), p.master_dark(frames(spark, sf_dir, "dark")),
                             p.master_flat(frames(spark, sf_dir, "flat"))))


NORM = """
 v AS (SELECT condition, image_set, y, x, CASE WHEN image_set % 4 = 1 THEN 7 WHEN image_set % 4 = 3 THEN 0 ELSE value END AS value FROM raster),
 q AS (SELECT condition, image_set, quantile_cont(value::DOUBLE, 0.01) AS lo, quantile_cont(value::DOUBLE, 0.99) AS hi,
              min(value) AS mn, max(value) AS mx FROM v GROUP BY ALL)"""


def flat_variants(spark, sf_dir):
    """The raster with every fourth image uniformly 7 and another fourth uniformly 0."""
    return views.raster(spark, sf_dir).drop("label").withColumn("value", F.expr(
        "case when image_set % 4 = 1 then 7 when image_set % 4 = 3 then 0 else value end"))


@query("x5_normalise", "raster", f"""{NORM}
SELECT condition, image_set, y, x, value::BIGINT AS value, round(CASE WHEN mn = mx THEN CASE WHEN value = 0 THEN 0 ELSE 0.5::DOUBLE END
       ELSE least(greatest((value - lo) / (hi - lo), 0), 1) END, 6) AS norm FROM v JOIN q USING (condition, image_set)""")
def x5_normalise(spark, sf_dir):
    return rounded(p.normalise(flat_variants(spark, sf_dir)))


@query("x6_normalise_legacy", "raster", f"""{NORM}
SELECT condition, image_set, y, x, value::BIGINT AS value, round(CASE WHEN mn = mx THEN 0::DOUBLE
       ELSE least(greatest((value - lo) / (hi - lo), 0), 1) END, 6) AS norm FROM v JOIN q USING (condition, image_set)""")
def x6_normalise_legacy(spark, sf_dir):
    return rounded(p.normalise(flat_variants(spark, sf_dir), legacy=True))


@query("x7_auto_contrast", "raster", CONTRAST.format(src="raster") + """
SELECT condition, image_set, y, x, gray FROM gray""")
def x7_auto_contrast(spark, sf_dir):
    return p.auto_contrast(views.raster(spark, sf_dir)).select("condition", "image_set", "y", "x", "gray")


@query("x8_false_colour", "raster", CONTRAST.format(src="raster") + """
SELECT condition, image_set, y, x, gray,
       CAST(trunc(CAST(CAST(CAST(gray / 255.0::DOUBLE AS FLOAT) AS DOUBLE) * 255 AS FLOAT)) AS INT) AS r,
       CAST(trunc(CAST(CAST(CAST(gray / 255.0::DOUBLE AS FLOAT) AS DOUBLE) * 102 AS FLOAT)) AS INT) AS g,
       CAST(trunc(CAST(CAST(CAST(gray / 255.0::DOUBLE AS FLOAT) AS DOUBLE) * 0 AS FLOAT)) AS INT) AS b FROM gray""")
def x8_false_colour(spark, sf_dir):
    px = p.auto_contrast(views.raster(spark, sf_dir)).withColumn("colour", F.lit("#FF6600"))
    return p.false_colour(px).select("condition", "image_set", "y", "x", "gray", "r", "g", "b")


@query("x9_rgb_composite", "mosaic markers", """
 q AS (SELECT condition, image_set, marker, quantile_cont(value::DOUBLE, 0.01) AS lo, quantile_cont(value::DOUBLE, 0.99) AS hi FROM markers GROUP BY ALL),
 n AS (SELECT m.condition, m.image_set, y, x, m.marker, least(greatest((value - lo) / (hi - lo), 0), 1) AS norm
       FROM markers m JOIN q USING (condition, image_set, marker)),
 w AS (SELECT condition, image_set, y, x, sum(CASE WHEN marker = 'B' THEN norm ELSE 0 END) AS g2,
              sum(CASE WHEN marker = 'A' THEN norm ELSE 0 END) AS a FROM n GROUP BY ALL)
SELECT condition, image_set, y, x, CAST(0 AS INT) AS r, CAST(floor(least(round(a + g2, 9), 1) * 255) AS INT) AS g,
       CAST(floor(least(round(a, 9), 1) * 255) AS INT) AS b FROM w""")
def x9_rgb_composite(spark, sf_dir):
    return p.composite(views.markers(spark, sf_dir), ["A", "B"])


@query("x10_subtract_background", "raster", """
 bg AS (SELECT condition, image_set, median(value::DOUBLE) FILTER (label = 0) AS background FROM raster GROUP BY ALL)
SELECT condition, image_set, y, x, greatest(value - background, 0) AS clipped, value - background AS signed
FROM raster JOIN bg USING (condition, image_set)""")
def x10_subtract_background(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    level = bg.global_background(px).drop("bg_std")
    both = px.join(level, ["condition", "image_set"]).withColumn("raw", F.col("value"))
    clipped = bg.subtract(both).withColumnRenamed("value", "clipped").withColumnRenamed("raw", "value")
    return bg.subtract(clipped, clip=False).select(
        "condition", "image_set", "y", "x", "clipped", F.col("value").alias("signed"))


@query("x11_id_map", "mosaic", """
 m AS (SELECT condition, image_set, y, x, label * 331 AS label FROM mosaic)
SELECT condition, image_set, y, x, (label % 65536) // 256 AS r, label % 256 AS g, CAST(0 AS INT) AS b, label % 65536 AS back FROM m""")
def x11_id_map(spark, sf_dir):
    px = views.mosaic(spark, sf_dir).withColumn("label", F.col("label") * 331)
    return p.label_from_id_map(p.id_map(px)).select(
        "condition", "image_set", "y", "x", "r", "g", "b", F.col("label").alias("back"))


@query("x12_label_colours", "mosaic", """
SELECT DISTINCT label, CAST((label::BIGINT*67+13) % 256 AS INT) AS r, CAST((label::BIGINT*137+43) % 256 AS INT) AS g,
       CAST((label::BIGINT*209+97) % 256 AS INT) AS b FROM mosaic WHERE label > 0""")
def x12_label_colours(spark, sf_dir):
    return p.label_colours(views.mosaic(spark, sf_dir).where("label > 0").select("label").distinct())


OUTLINE = """
 o AS (SELECT condition, image_set, y, x, label, label > 0 AND (
          coalesce(lag(label) OVER r, 0) <> label OR coalesce(lead(label) OVER r, 0) <> label OR
          coalesce(lag(label) OVER c, 0) <> label OR coalesce(lead(label) OVER c, 0) <> label) AS is_outline
       FROM mosaic WINDOW r AS (PARTITION BY condition, image_set, y ORDER BY x), c AS (PARTITION BY condition, image_set, x ORDER BY y))"""


@query("x13_outline", "mosaic", f"{OUTLINE} SELECT condition, image_set, y, x, is_outline FROM o")
def x13_outline(spark, sf_dir):
    return sp.outline(views.mosaic(spark, sf_dir)).select("condition", "image_set", "y", "x", "is_outline")


@query("x14_outline_thick", "mosaic", f"""{OUTLINE},
 s AS (SELECT condition, image_set, y + dy AS y, x + dx AS x FROM o,
       (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) d(dy,dx) WHERE is_outline GROUP BY ALL)
SELECT m.condition, m.image_set, m.y, m.x, s.y IS NOT NULL AS is_outline
FROM mosaic m LEFT JOIN s ON m.condition = s.condition AND m.image_set = s.image_set AND m.y = s.y AND m.x = s.x""")
def x14_outline_thick(spark, sf_dir):
    return sp.outline(views.mosaic(spark, sf_dir), thick=True).select("condition", "image_set", "y", "x", "is_outline")


@query("x15_overlay", "mosaic", """
 e AS (SELECT condition, image_set, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM mosaic GROUP BY ALL),
 g AS (SELECT m.*, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS grey FROM mosaic m JOIN e USING (condition, image_set)),
 b AS (SELECT *, CASE WHEN label > 0 THEN ((label::BIGINT*67+13) % 256) / 255.0::DOUBLE * 0.5::DOUBLE + grey * 0.5::DOUBLE ELSE grey END AS r0,
              CASE WHEN label > 0 THEN ((label::BIGINT*137+43) % 256) / 255.0::DOUBLE * 0.5::DOUBLE + grey * 0.5::DOUBLE ELSE grey END AS g0,
              CASE WHEN label > 0 THEN ((label::BIGINT*209+97) % 256) / 255.0::DOUBLE * 0.5::DOUBLE + grey * 0.5::DOUBLE ELSE grey END AS b0 FROM g)
SELECT condition, image_set, y, x, CAST(floor(round(r0, 9) * 255) AS INT) AS r, CAST(floor(round(g0, 9) * 255) AS INT) AS g,
       CAST(floor(round(b0, 9) * 255) AS INT) AS b FROM b""")
def x15_overlay(spark, sf_dir):
    return p.overlay(views.mosaic(spark, sf_dir)).select("condition", "image_set", "y", "x", "r", "g", "b")


@query("x16_gaussian_smooth", "mosaic", """
 k AS (SELECT d, exp(-0.5::DOUBLE * d * d) / sum(exp(-0.5::DOUBLE * d * d)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS d)),
 m AS (SELECT condition, image_set, y, x, value::DOUBLE AS v, max(y) OVER (PARTITION BY image_set) + 1 AS h,
              max(x) OVER (PARTITION BY image_set) + 1 AS wd FROM mosaic),
 a AS (SELECT t.condition, t.image_set, t.y, t.x, t.wd, sum(s.v * k.w) AS v FROM m t, k, m s
       WHERE s.image_set = t.image_set AND s.x = t.x
         AND s.y = CASE WHEN t.y + d < 0 THEN -(t.y + d) - 1 WHEN t.y + d >= t.h THEN 2*t.h - 1 - (t.y + d) ELSE t.y + d END
       GROUP BY ALL)
SELECT t.condition, t.image_set, t.y, t.x, round(sum(s.v * k.w), 6) AS value FROM a t, k, a s
WHERE s.image_set = t.image_set AND s.y = t.y
  AND s.x = CASE WHEN t.x + d < 0 THEN -(t.x + d) - 1 WHEN t.x + d >= t.wd THEN 2*t.wd - 1 - (t.x + d) ELSE t.x + d END
GROUP BY ALL""")
def x16_gaussian_smooth(spark, sf_dir):
    px = views.mosaic(spark, sf_dir)
    sigmas = px.select("condition", "image_set").distinct().withColumn("sigma", F.lit(1.0))
    return rounded(sp.smoothed(px, sigmas).select("condition", "image_set", "y", "x", "value"))


@query("x17_channel_sum", "mosaic markers", """
 t AS (SELECT condition, image_set, y, x, sum(CASE WHEN marker = 'B' THEN 3 * value ELSE value END)::BIGINT AS value FROM markers GROUP BY ALL),
""" + CONTRAST.format(src="t").strip() + " SELECT condition, image_set, y, x, value, gray FROM gray")
def x17_channel_sum(spark, sf_dir):
    px = views.markers(spark, sf_dir).withColumn(
        "value", F.when(F.col("marker") == "B", 3 * F.col("value")).otherwise(F.col("value")))
    return p.channel_sum(px)


@query("a19_value_map", "mosaic", """
 cv AS (SELECT condition, image_set, label, avg(value) AS value FROM mosaic WHERE label > 0 AND label % 7 <> 0 GROUP BY ALL),
 r AS (SELECT condition, image_set, min(value) AS lo, max(value) AS hi FROM cv GROUP BY ALL)
SELECT m.condition, m.image_set, y, x, m.label, round(cv.value, 6) AS cell_value, round((cv.value - lo) / (hi - lo), 6) AS norm
FROM mosaic m JOIN cv USING (condition, image_set, label) JOIN r USING (condition, image_set)""")
def a19_value_map(spark, sf_dir):
    px = views.mosaic(spark, sf_dir)
    means = c.label_stats(px).where("label % 7 <> 0").select("condition", "image_set", "label", F.col("mean").alias("value"))
    return rounded(p.value_map(px, means))


@query("s16_image_metadata", "raster", """
SELECT condition, image_set, max(x) + 1 AS width, max(y) + 1 AS height,
       CASE WHEN max(value) <= 255 THEN 'uint8' WHEN max(value) <= 65535 THEN 'uint16' ELSE 'int32' END AS dtype
FROM raster GROUP BY ALL""")
def s16_image_metadata(spark, sf_dir):
    from rasterlab.sources.images import image_metadata

    return image_metadata(views.raster(spark, sf_dir))
