"""Image-wide background estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.functions.order import levels
from rasterlab.operators import background as bg
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded

BGV = "CAST(value AS DOUBLE)"
MODE = """
 span AS (SELECT condition, image_set, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi, stddev_pop(value) AS bg_std
          FROM raster WHERE label = 0 GROUP BY ALL),
 bins AS (SELECT condition, image_set, lo, hi, bg_std, least(floor((value - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS c
          FROM raster JOIN span USING (condition, image_set) WHERE label = 0 GROUP BY ALL),
 peak AS (SELECT *, row_number() OVER (PARTITION BY condition, image_set ORDER BY c DESC, bin) AS rn FROM bins)"""


@query("b1_global_roi", "raster", f"""
SELECT condition, image_set, round(median({BGV}) FILTER (label = 0), 6) AS median_bg,
       round(avg({BGV}) FILTER (label = 0), 6) AS mean_bg,
       round(quantile_cont({BGV}, 0.05) FILTER (label = 0), 6) AS p5_bg,
       round(stddev_pop({BGV}) FILTER (label = 0), 6) AS bg_std
FROM raster GROUP BY ALL""")
def b1_global_roi(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    out = bg.global_background(px).withColumnRenamed("background", "median_bg")
    for stat, name in (("mean", "mean_bg"), ("percentile5", "p5_bg")):
        one = bg.global_background(px, statistic=stat).drop("bg_std").withColumnRenamed("background", name)
        out = out.join(one, ["condition", "image_set"])
    return rounded(out)


REAL = "value / (1 + sqrt(y + 1) / 7) + x / 3.0::DOUBLE"


@query("b1_real_values", "raster", f"""
 v AS (SELECT condition, image_set, {REAL} AS v FROM raster WHERE label = 0)
SELECT condition, image_set, round(quantile_cont(v, 0.05), 6) AS p5_bg, round(median(v), 6) AS median_bg, round(quantile_cont(v, 0.95), 6) AS p95_bg FROM v GROUP BY ALL""")
def b1_real_values(spark, sf_dir):
    """Uneven light makes every pixel a value of its own; always by radix selection."""
    px = views.raster(spark, sf_dir).withColumn("value", F.expr(REAL.replace("3.0::DOUBLE", "3.0d")))
    found = levels(px.where("label = 0"), ["condition", "image_set"], "value", {"p5_bg": 0.05, "median_bg": 0.5, "p95_bg": 0.95}, small=False)
    return rounded(found)


@query("b2_global_mode", "raster", f"""{MODE}
SELECT condition, image_set, round(lo + (bin + 0.5) * (hi - lo) / 256, 6) AS background, round(bg_std, 6) AS bg_std
FROM peak WHERE rn = 1""")
def b2_global_mode(spark, sf_dir):
    return rounded(bg.global_background(views.raster(spark, sf_dir), statistic="mode"))


@query("b11_legacy_estimate", "raster", f"""
 crowded AS (SELECT condition, image_set, y, x, CASE WHEN image_set % 2 = 1 AND label = 0 AND (y > 0 OR x > 2) THEN 99 ELSE label END AS label, value
             FROM raster)
SELECT condition, image_set,
       round(CASE WHEN count(*) FILTER (label = 0) < 0.01 * count(*) THEN quantile_cont({BGV}, 0.05)
                  ELSE median({BGV}) FILTER (label = 0) END, 6) AS median_bg,
       round(CASE WHEN count(*) FILTER (label = 0) < 0.01 * count(*) THEN quantile_cont({BGV}, 0.05)
                  ELSE avg({BGV}) FILTER (label = 0) END, 6) AS mean_bg
FROM crowded GROUP BY ALL""")
def b11_legacy_estimate(spark, sf_dir):
    px = views.raster(spark, sf_dir).withColumn("label", F.expr(
        "case when image_set % 2 = 1 and label = 0 and (y > 0 or x > 2) then 99 else label end"))
    one = bg.legacy_background(px).withColumnRenamed("background", "median_bg")
    two = bg.legacy_background(px, method="mean").withColumnRenamed("background", "mean_bg")
    return rounded(one.join(two, ["condition", "image_set"]))


@query("b14_corner_background", "mosaic", f"""
 d AS (SELECT condition, image_set, max(y) + 1 AS h, max(x) + 1 AS w FROM mosaic GROUP BY ALL),
 p AS (SELECT m.*, h, w, CAST(floor(h*0.1) AS INT) AS ch, CAST(floor(w*0.1) AS INT) AS cw
       FROM mosaic m JOIN d USING (condition, image_set)),
 four AS (SELECT condition, image_set, value FROM p WHERE y < ch AND x < cw
          UNION ALL SELECT condition, image_set, value FROM p WHERE y < ch AND x >= w - cw
          UNION ALL SELECT condition, image_set, value FROM p WHERE y >= h - ch AND x < cw
          UNION ALL SELECT condition, image_set, value FROM p WHERE y >= h - ch AND x >= w - cw)
SELECT condition, image_set, round(median({BGV}), 6) AS background FROM four GROUP BY ALL""")
def b14_corner_background(spark, sf_dir):
    return rounded(bg.corner_background(views.mosaic(spark, sf_dir)))


@query("b15_legacy_auto", "raster", """
 f AS (SELECT condition, image_set, count(*) FILTER (label = 0) < 0.05 * count(*) AS scarce,
              stddev_pop(value) FILTER (label = 0) / (avg(value) FILTER (label = 0) + 1e-8) AS cv
       FROM (SELECT condition, image_set, label, value + 4000 * (image_set % 3) AS value FROM raster) GROUP BY ALL)
SELECT condition, image_set,
       CASE WHEN scarce THEN 'percentile5' WHEN cv < 0.3 THEN 'median' ELSE 'percentile5' END AS method,
       CASE WHEN scarce THEN 'Limited background area (<5%), using 5th percentile'
            WHEN cv < 0.1 THEN 'Uniform background (CV < 0.1), using median'
            WHEN cv < 0.3 THEN 'Moderately uniform background, using median'
            ELSE 'Variable background (CV=' || printf('%.2f', cv) || '), using 5th percentile' END AS reason
FROM f""")
def b15_legacy_auto(spark, sf_dir):
    px = views.raster(spark, sf_dir).withColumn("value", F.expr("value + 4000 * (image_set % 3)"))
    return bg.legacy_auto(px)


@query("b9_auto_method", "raster", """
 v AS (SELECT condition, image_set, CASE WHEN image_set % 4 = 3 AND x % 10 <> 9 THEN 99 ELSE label END AS label,
              value + 4000 * (image_set % 3) AS value FROM raster),
 f AS (SELECT condition, image_set, avg(CASE WHEN label <> 0 THEN 1.0 ELSE 0 END) AS coverage,
              count(*) FILTER (label = 0) AS bg_pixels,
              CASE WHEN count(*) FILTER (label = 0) < 100 OR avg(value) FILTER (label = 0) < 1e-8 THEN 999
                   ELSE stddev_pop(value) FILTER (label = 0) / avg(value) FILTER (label = 0) END AS bg_cv
       FROM v GROUP BY ALL)
SELECT condition, image_set, round(coverage, 6) AS coverage, bg_pixels, round(bg_cv, 6) AS bg_cv,
       CASE WHEN coverage > 0.8 THEN 'masked_annular_ring' WHEN bg_cv > 0.3 THEN 'polynomial_surface' ELSE 'voronoi' END AS method,
       CASE WHEN coverage > 0.8 THEN 'High cell coverage (' || printf('%.0f', coverage*100) || '%); using masked annular ring to sample intercellular gaps'
            WHEN bg_cv > 0.3 THEN 'High background non-uniformity (CV=' || printf('%.2f', bg_cv) || '); using polynomial surface fit'
            WHEN bg_cv > 0.15 THEN 'Moderate background non-uniformity (CV=' || printf('%.2f', bg_cv) || '); using Voronoi-partitioned local background'
            ELSE 'Uniform background (CV=' || printf('%.2f', bg_cv) || '); using Voronoi-partitioned local background' END AS reason
FROM f""")
def b9_auto_method(spark, sf_dir):
    px = views.raster(spark, sf_dir).withColumns({
        "label": F.expr("case when image_set % 4 = 3 and x % 10 <> 9 then 99 else label end"),
        "value": F.expr("value + 4000 * (image_set % 3)"),
    })
    return rounded(bg.choose_method(px))


RING = """
 d1 AS (SELECT *, max(label) OVER (PARTITION BY condition, image_set, y ORDER BY x RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS o1,
               max(label) OVER (PARTITION BY condition, image_set, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS i1 FROM {src}),
 d2 AS (SELECT *, max(o1) OVER (PARTITION BY condition, image_set, x ORDER BY y RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS o2,
               max(i1) OVER (PARTITION BY condition, image_set, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS i2 FROM d1),
 ring AS (SELECT condition, image_set, o2 AS label, median(value::DOUBLE) AS r FROM d2 WHERE label = 0 AND o2 > 0 AND i2 = 0 GROUP BY ALL),
 whole AS (SELECT condition, image_set, median(value::DOUBLE) AS m, stddev_pop(value) AS bg_std FROM {src} WHERE label = 0 GROUP BY ALL),
 cells AS (SELECT DISTINCT condition, image_set, label::BIGINT AS label FROM {src} WHERE label > 0),
 res AS (SELECT condition, image_set, label, coalesce(r, m) AS background, bg_std
         FROM cells LEFT JOIN ring USING (condition, image_set, label) JOIN whole USING (condition, image_set))"""
VORONOI = """
 near AS (SELECT b.condition, b.image_set, b.y, b.x, b.value,
                 min((b.y-c.y)*(b.y-c.y) + (b.x-c.x)*(b.x-c.x)) AS d2,
                 arg_min(c.label, ((b.y-c.y)*(b.y-c.y) + (b.x-c.x)*(b.x-c.x))::BIGINT * 100000 + c.label)::BIGINT AS nearest
          FROM {src} b JOIN {src} c ON b.condition = c.condition AND b.image_set = c.image_set
          WHERE b.label = 0 AND c.label > 0 GROUP BY ALL),
 lim AS (SELECT condition, image_set, CASE WHEN count(*) FILTER (d2 >= 100) >= 100 THEN 100 WHEN count(*) FILTER (d2 >= 25) >= 100 THEN 25
                WHEN count(*) FILTER (d2 >= 9) >= 100 THEN 9 WHEN count(*) FILTER (d2 >= 1) >= 100 THEN 1 ELSE 0 END AS lim FROM near GROUP BY ALL),
 use AS (SELECT near.* FROM near JOIN lim USING (condition, image_set) WHERE d2 >= lim),
 loc AS (SELECT condition, image_set, nearest AS label, median(value::DOUBLE) AS m FROM use GROUP BY ALL),
 whole AS (SELECT condition, image_set, median(value::DOUBLE) AS w, stddev_pop(value) AS s FROM use GROUP BY ALL),
 cells AS (SELECT DISTINCT condition, image_set, label::BIGINT AS label FROM {src} WHERE label > 0),
 res AS (SELECT condition, image_set, label, coalesce(m, w, 0) AS background, coalesce(s, 0) AS bg_std
         FROM cells LEFT JOIN loc USING (condition, image_set, label) LEFT JOIN whole USING (condition, image_set))"""
OPENED = """
 off AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy*dy + dx*dx <= 9),
 pos AS (SELECT image_set, y, x FROM raster),
 ero AS (SELECT image_set, y, x, min(v)::DOUBLE AS v FROM (SELECT image_set, y + dy AS y, x + dx AS x, value AS v FROM raster, off)
         JOIN pos USING (image_set, y, x) GROUP BY ALL),
 opn AS (SELECT image_set, y, x, max(v) AS v FROM (SELECT image_set, y + dy AS y, x + dx AS x, v FROM ero, off)
         JOIN pos USING (image_set, y, x) GROUP BY ALL),
 j AS (SELECT r.condition, r.image_set, r.label::BIGINT AS label, v FROM raster r JOIN opn USING (image_set, y, x)),
 sd AS (SELECT condition, image_set, stddev_pop(v) AS bg_std FROM j WHERE label = 0 GROUP BY ALL),
 res AS (SELECT condition, image_set, label, median(v) AS background, any_value(bg_std) AS bg_std
         FROM j JOIN sd USING (condition, image_set) WHERE label > 0 GROUP BY ALL)"""
OUT = "SELECT condition, image_set, label, round(background, 6) AS background, round(bg_std, 6) AS bg_std FROM res"


@query("b3_annular_ring", "raster", RING.format(src="raster") + OUT)
def b3_annular_ring(spark, sf_dir):
    return rounded(bg.annular_ring(views.raster(spark, sf_dir)))


@query("b4_masked_annular_ring", "mosaic", RING.format(src="mosaic") + OUT)
def b4_masked_annular_ring(spark, sf_dir):
    images, cells = bg.estimate(views.mosaic(spark, sf_dir), method="masked_annular_ring")
    return rounded(cells)


@query("b5_voronoi", "raster", VORONOI.format(src="raster") + OUT)
def b5_voronoi(spark, sf_dir):
    return rounded(bg.voronoi(views.raster(spark, sf_dir)))


@query("b6_rolling_ball", "raster", OPENED + OUT)
def b6_rolling_ball(spark, sf_dir):
    return rounded(bg.rolling_ball(views.raster(spark, sf_dir), radius=3))


@query("b6_rolling_ball_r50")
def b6_rolling_ball_r50(spark, sf_dir):
    return rounded(bg.rolling_ball(views.raster(spark, sf_dir)))


@query("b7_white_tophat", "raster", OPENED + OUT)
def b7_white_tophat(spark, sf_dir):
    images, cells = bg.estimate(views.raster(spark, sf_dir), method="white_tophat", ball_radius=3)
    return rounded(cells)


@query("b8_plane_fit", "raster", """
 p AS (SELECT condition, image_set, label, value::DOUBLE AS z, x::DOUBLE / 49 AS u,
              y::DOUBLE / greatest(max(y) OVER (PARTITION BY image_set), 1) AS v FROM raster),
 s AS (SELECT condition, image_set, count(*)::DOUBLE AS n, sum(u) AS su, sum(v) AS sv, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv,
              sum(z) AS sz, sum(u*z) AS suz, sum(v*z) AS svz FROM p WHERE label = 0 GROUP BY ALL),
 c AS (SELECT condition, image_set, suu - su*su/n AS cuu, svv - sv*sv/n AS cvv, suv - su*sv/n AS cuv, suz - su*sz/n AS cuz, svz - sv*sz/n AS cvz,
              su/n AS mu, sv/n AS mv, sz/n AS mz FROM s),
 k AS (SELECT *, (cuz*cvv - cvz*cuv) / (cuu*cvv - cuv*cuv) AS bu, (cvz*cuu - cuz*cuv) / (cuu*cvv - cuv*cuv) AS bv FROM c),
 f AS (SELECT p.condition, p.image_set, label, z, mz + bu*(u - mu) + bv*(v - mv) AS fit FROM p JOIN k USING (condition, image_set)),
 sd AS (SELECT condition, image_set, stddev_pop(z - fit) AS bg_std FROM f WHERE label = 0 GROUP BY ALL),
 res AS (SELECT condition, image_set, label::BIGINT AS label, median(fit) AS background, any_value(bg_std) AS bg_std
         FROM f JOIN sd USING (condition, image_set) WHERE label > 0 GROUP BY ALL)
""" + OUT)
def b8_plane_fit(spark, sf_dir):
    return rounded(bg.polynomial_surface(views.raster(spark, sf_dir), order=1))


@query("b8_polynomial_surface")
def b8_polynomial_surface(spark, sf_dir):
    return rounded(bg.polynomial_surface(views.raster(spark, sf_dir)))


CROWDED = """
 crowded AS (SELECT condition, image_set, y, x, CASE WHEN image_set % 5 = 1 AND label = 0 AND x > 0 THEN 7 ELSE label END AS label, value FROM mosaic)"""


def crowded(spark, sf_dir):
    return views.mosaic(spark, sf_dir).drop("nuclear_label").withColumn("label", F.expr(
        "case when image_set % 5 = 1 and label = 0 and x > 0 then 7 else label end"))


@query("b10_dispatch_auto", "mosaic", f"""{CROWDED},
 f AS (SELECT condition, image_set, avg(CASE WHEN label <> 0 THEN 1.0 ELSE 0 END) AS cov, count(*) FILTER (label = 0) AS nb,
              count(DISTINCT label) FILTER (label > 0) AS nc, quantile_cont(value::DOUBLE, 0.01) AS p1,
              stddev_pop(value) FILTER (label = 0) AS sd, avg(value) FILTER (label = 0) AS mean FROM crowded GROUP BY ALL),
 scarce AS (SELECT * FROM f WHERE cov > 0.95 AND nb < 50 * greatest(nc, 1)),
 plenty AS (SELECT c.* FROM crowded c ANTI JOIN scarce USING (condition, image_set)),
{VORONOI.format(src="plenty").strip()}
SELECT condition, image_set, round(median(background), 6) AS background, round(any_value(bg_std), 6) AS bg_std, 'voronoi' AS method_used,
       false AS low_confidence FROM res GROUP BY ALL
UNION ALL
SELECT condition, image_set, round(p1, 6), round(sd, 6), 'masked_annular_ring_fallback_p1', true FROM scarce""")
def b10_dispatch_auto(spark, sf_dir):
    images, cells = bg.estimate(crowded(spark, sf_dir))
    return rounded(images.drop("method_reason"))


@query("b10_dispatch_global", "mosaic", f"""{CROWDED},
 f AS (SELECT condition, image_set, avg(CASE WHEN label <> 0 THEN 1.0 ELSE 0 END) AS cov, count(*) FILTER (label = 0) AS nb,
              count(DISTINCT label) FILTER (label > 0) AS nc, quantile_cont(value::DOUBLE, 0.01) AS p1,
              stddev_pop(value) FILTER (label = 0) AS sd, median(value::DOUBLE) FILTER (label = 0) AS med FROM crowded GROUP BY ALL)
SELECT condition, image_set, round(CASE WHEN cov > 0.95 AND nb < 50 * nc THEN p1 ELSE med END, 6) AS background, round(sd, 6) AS bg_std,
       CASE WHEN cov > 0.95 AND nb < 50 * nc THEN 'global_roi_fallback_p1' ELSE 'global_roi' END AS method_used,
       CASE WHEN cov > 0.95 AND nb < 50 * nc THEN ' | WARNING: <5% background area — using 1st percentile as approximation. Provide a negative control for accuracy.'
            ELSE 'Global ROI (median)' END AS method_reason, cov > 0.95 AND nb < 50 * nc AS low_confidence
FROM f""")
def b10_dispatch_global(spark, sf_dir):
    images, cells = bg.estimate(crowded(spark, sf_dir), method="global_roi")
    return rounded(images)


@query("b12_median_filter", "raster", """
 dims AS (SELECT image_set, max(y) + 1 AS h, max(x) + 1 AS w FROM raster GROUP BY ALL),
 o AS (SELECT unnest(range(-25, 25)) AS o),
 ys AS (SELECT image_set, y, CASE WHEN y + o < 0 THEN -1 - y - o WHEN y + o >= h THEN 2 * h - 1 - y - o ELSE y + o END AS my
        FROM (SELECT image_set, h, unnest(range(h)) AS y FROM dims), o),
 xs AS (SELECT image_set, x, CASE WHEN x + o < 0 THEN -1 - x - o WHEN x + o >= w THEN 2 * w - 1 - x - o ELSE x + o END AS mx
        FROM (SELECT image_set, w, unnest(range(w)) AS x FROM dims), o),
 s AS (SELECT b.condition, b.image_set, b.y, b.x, list_sort(list(v.value))[1251] AS surface
       FROM raster b JOIN ys ON ys.image_set = b.image_set AND ys.y = b.y JOIN xs ON xs.image_set = b.image_set AND xs.x = b.x
       JOIN raster v ON v.image_set = b.image_set AND v.y = ys.my AND v.x = xs.mx WHERE b.label = 0 GROUP BY ALL)
SELECT condition, image_set, median(surface::DOUBLE) AS background FROM s GROUP BY ALL""")
def b12_median_filter(spark, sf_dir):
    return bg.median_filter_background(views.raster(spark, sf_dir))


@query("b13_surroundings", "mosaic", """
 near AS (SELECT DISTINCT c.condition, c.image_set, c.label, b.y, b.x, b.value
          FROM (SELECT * FROM mosaic WHERE label > 0) c
          JOIN mosaic b ON b.condition = c.condition AND b.image_set = c.image_set AND b.label = 0
               AND b.y BETWEEN c.y - 5 AND c.y + 5 AND b.x BETWEEN c.x - 5 AND c.x + 5
          WHERE abs(b.y - c.y) + abs(b.x - c.x) <= 5)
SELECT condition, image_set, label::BIGINT AS label, round(median(value::DOUBLE), 6) AS background FROM near GROUP BY ALL""")
def b13_surroundings(spark, sf_dir):
    return rounded(bg.surroundings(views.mosaic(spark, sf_dir)))


@query("b16_region_map", "raster", """
 cv AS (SELECT condition, image_set, label, avg(value) AS v FROM raster WHERE label > 0 AND label % 6 <> 0 GROUP BY ALL),
 r AS (SELECT condition, image_set, min(v) AS lo, max(v) AS hi FROM cv GROUP BY ALL),
 near AS (SELECT b.condition, b.image_set, b.y, b.x,
                 arg_min(c.label, ((b.y-c.y)*(b.y-c.y) + (b.x-c.x)*(b.x-c.x))::BIGINT * 100000 + c.label) AS nearest
          FROM raster b JOIN raster c ON b.condition = c.condition AND b.image_set = c.image_set
          WHERE b.label = 0 AND c.label > 0 GROUP BY ALL)
SELECT near.condition, near.image_set, y, x, nearest::BIGINT AS nearest, round(coalesce(v, 0), 6) AS value,
       round((coalesce(v, 0) - lo) / (hi - lo), 6) AS norm
FROM near LEFT JOIN cv ON cv.condition = near.condition AND cv.image_set = near.image_set AND cv.label = nearest
JOIN r ON r.condition = near.condition AND r.image_set = near.image_set""")
def b16_region_map(spark, sf_dir):
    px = views.raster(spark, sf_dir)
    means = px.where("label > 0 and label % 6 <> 0").groupBy("condition", "image_set", "label").agg(F.avg("value").alias("value"))
    return rounded(bg.region_map(px, means))


@query("j4_nearest_cell", "raster", """
SELECT b.condition, b.image_set, b.y, b.x, min((b.y-c.y)*(b.y-c.y) + (b.x-c.x)*(b.x-c.x))::BIGINT AS d2,
       arg_min(c.label, ((b.y-c.y)*(b.y-c.y) + (b.x-c.x)*(b.x-c.x))::BIGINT * 100000 + c.label)::BIGINT AS nearest
FROM raster b JOIN raster c ON b.condition = c.condition AND b.image_set = c.image_set
WHERE b.label = 0 AND c.label > 0 GROUP BY ALL""")
def j4_nearest_cell(spark, sf_dir):
    from rasterlab.operators.spatial import nearest_label

    return nearest_label(views.raster(spark, sf_dir)).where("label = 0").select(
        "condition", "image_set", "y", "x", "d2", "nearest")
