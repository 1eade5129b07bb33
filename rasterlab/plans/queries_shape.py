"""Cell shape and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import morphology as mo
from rasterlab.operators import qc
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded

MOM = """
 mom AS (SELECT condition, image_set, label, count(*) AS area, avg(y) AS y_centroid, avg(x) AS x_centroid,
                var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b,
                min(y) = 0 OR min(x) = 0 OR max(y) = 79 OR max(x) = 79 AS is_border
         FROM mosaic WHERE label > 0 GROUP BY ALL),
 lam AS (SELECT *, (a+c)/2 + sqrt((a-c)*(a-c)/4 + b*b) AS l1, (a+c)/2 - sqrt((a-c)*(a-c)/4 + b*b) AS l2 FROM mom),
 shape AS (SELECT *, CASE WHEN l1 > 0 THEN sqrt(1 - l2/l1) ELSE 0 END AS eccentricity,
                  CASE WHEN l2 > 1e-12 THEN sqrt(l1)/sqrt(l2) ELSE 999 END AS aspect_ratio FROM lam)"""
GATED = f"""{MOM},
 g AS (SELECT *, is_border AS rb, area < 10 AS rs, area > 11 AS rl, eccentricity > 0.85 AS re, aspect_ratio > 2.4 AS ra FROM shape)"""


def gated(spark, sf_dir):
    morph = mo.moments(views.mosaic(spark, sf_dir)).withColumns({
        "is_border": F.expr("y_min = 0 or x_min = 0 or y_max = 79 or x_max = 79"),
        "solidity": F.lit(1.0), "circularity": F.lit(1.0),
    })
    return qc.gates(morph, {"min_area": 10, "max_area": 11, "max_eccentricity": 0.85, "max_aspect_ratio": 2.4})


@query("q1_area_centroid", "mosaic", f"""{MOM}
SELECT condition, image_set, label, area, round(y_centroid, 6) AS y_centroid, round(x_centroid, 6) AS x_centroid FROM mom""")
def q1_area_centroid(spark, sf_dir):
    return rounded(mo.moments(views.mosaic(spark, sf_dir)).select(
        "condition", "image_set", "label", "area", "y_centroid", "x_centroid"))


@query("q2_eccentricity", "mosaic", f"""{MOM}
SELECT condition, image_set, label, round(eccentricity, 6) AS eccentricity, round(aspect_ratio, 6) AS aspect_ratio FROM shape""")
def q2_eccentricity(spark, sf_dir):
    return rounded(mo.moments(views.mosaic(spark, sf_dir)).select(
        "condition", "image_set", "label", "eccentricity", "aspect_ratio"))


@query("q3_perimeter", "mosaic", """
 e AS (SELECT t.image_set, t.y, t.x, t.label, count(s.label) FILTER (s.label = t.label) < 4 AS edge
       FROM (SELECT * FROM mosaic WHERE label > 0) t, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
       LEFT JOIN mosaic s ON s.image_set = t.image_set AND s.y = t.y + dy AND s.x = t.x + dx GROUP BY ALL),
 b AS (SELECT * FROM e WHERE edge),
 k AS (SELECT t.image_set, t.y, t.x, t.label, 1 + sum(CASE WHEN s.label = t.label THEN w ELSE 0 END) AS code
       FROM b t, (VALUES (0,1,2),(0,-1,2),(1,0,2),(-1,0,2),(1,1,10),(1,-1,10),(-1,1,10),(-1,-1,10)) d(dy,dx,w)
       LEFT JOIN b s ON s.image_set = t.image_set AND s.y = t.y + dy AND s.x = t.x + dx GROUP BY ALL),
 p AS (SELECT image_set, label, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1 WHEN code IN (21,33) THEN sqrt(2)
              WHEN code IN (13,23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM k GROUP BY ALL),
 a AS (SELECT condition, image_set, label, count(*) AS area FROM mosaic WHERE label > 0 GROUP BY ALL)
SELECT condition, image_set, label, round(perimeter, 6) AS perimeter,
       round(CASE WHEN perimeter > 0 THEN least(4*pi()*area/(perimeter*perimeter), 1) ELSE 0 END, 6) AS circularity
FROM a JOIN p USING (image_set, label)""")
def q3_perimeter(spark, sf_dir):
    return rounded(mo.morphology(views.mosaic(spark, sf_dir)).select(
        "condition", "image_set", "label", "perimeter", "circularity"))


# corners half a pixel around the row ends; a hull edge has every corner on its left, a hull pixel every edge
HULL = """
 r AS (SELECT image_set, label, y, min(x) AS lo, max(x) AS hi FROM raster WHERE label > 0 GROUP BY ALL),
 pt AS (SELECT DISTINCT image_set, label, unnest([2*y, 2*y, 2*y-1, 2*y+1, 2*y-1, 2*y+1]) AS py, unnest([2*lo-1, 2*hi+1, 2*lo, 2*lo, 2*hi, 2*hi]) AS px FROM r),
 edge AS (SELECT a.image_set, a.label, a.py AS ay, a.px AS ax, b.py AS zy, b.px AS zx
          FROM pt a JOIN pt b ON b.image_set = a.image_set AND b.label = a.label AND (b.py <> a.py OR b.px <> a.px)
          JOIN pt c ON c.image_set = a.image_set AND c.label = a.label
          GROUP BY ALL HAVING min((b.py - a.py) * (c.px - a.px) - (b.px - a.px) * (c.py - a.py)) >= 0),
 box AS (SELECT image_set, label, min(y) AS y0, max(y) AS y1, min(lo) AS x0, max(hi) AS x1 FROM r GROUP BY ALL),
 spot AS (SELECT image_set, label, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM box)),
 hull AS (SELECT s.image_set, s.label, s.y, s.x FROM spot s JOIN edge e USING (image_set, label)
          GROUP BY ALL HAVING min((zy - ay) * (2 * s.x - ax) - (zx - ax) * (2 * s.y - ay)) >= 0),
 n AS (SELECT image_set, label, count(*) AS h FROM hull GROUP BY ALL)
SELECT condition, image_set, label, round(count(*) / any_value(h)::DOUBLE, 6) AS solidity FROM raster JOIN n USING (image_set, label) GROUP BY ALL"""


@query("q4_solidity", "raster", HULL)
def q4_solidity(spark, sf_dir):
    return rounded(mo.solidity(views.raster(spark, sf_dir)))


@query("q5_border_cells", "mosaic", f"{MOM} SELECT condition, image_set, label, is_border FROM mom")
def q5_border_cells(spark, sf_dir):
    return mo.morphology(views.mosaic(spark, sf_dir)).select("condition", "image_set", "label", "is_border")


@query("q5_border_of_pieces", "mosaic", """
 m AS (SELECT condition, image_set, y, x, label % 40 + CASE WHEN label > 0 THEN 1 ELSE 0 END AS label FROM mosaic WHERE label > 0),
 pieces AS (SELECT condition, image_set, label % 40 + 1 AS label, label AS piece, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
            FROM mosaic WHERE label > 0 GROUP BY ALL)
SELECT condition, image_set, label, bool_and(y0 = 0 OR x0 = 0 OR y1 = 79 OR x1 = 79) AS is_border FROM pieces GROUP BY ALL""")
def q5_border_of_pieces(spark, sf_dir):
    px = views.mosaic(spark, sf_dir).withColumn(
        "label", F.when(F.col("label") > 0, F.col("label") % 40 + 1).otherwise(0))
    return mo.border_of_pieces(px)


@query("q6_qc_gates", "mosaic", f"""{GATED}
SELECT condition, image_set, label, rb AS rejects_border, rs AS rejects_area_small, rl AS rejects_area_large,
       re AS rejects_eccentricity, ra AS rejects_aspect_ratio, rb OR rs OR rl OR re OR ra AS rejected FROM g""")
def q6_qc_gates(spark, sf_dir):
    return gated(spark, sf_dir).select(
        "condition", "image_set", "label", "rejects_border", "rejects_area_small", "rejects_area_large",
        "rejects_eccentricity", "rejects_aspect_ratio", "rejected")


COUNTS = """count(*) FILTER (rb) AS border, count(*) FILTER (rs) AS area_small, count(*) FILTER (rl) AS area_large,
       CAST(0 AS BIGINT) AS solidity, count(*) FILTER (re) AS eccentricity, CAST(0 AS BIGINT) AS circularity,
       count(*) FILTER (ra) AS aspect_ratio, count(*) FILTER (rb OR rs OR rl OR re OR ra) AS total_rejected,
       count(*) FILTER (NOT (rb OR rs OR rl OR re OR ra)) AS total_kept"""


@query("q7_rejection_counts", "mosaic", f"{GATED} SELECT condition, image_set, {COUNTS} FROM g GROUP BY condition, image_set")
def q7_rejection_counts(spark, sf_dir):
    return qc.rejection_counts(gated(spark, sf_dir))


@query("q8_qc_totals", "mosaic", f"{GATED} SELECT condition, image_set, {COUNTS} FROM g GROUP BY ROLLUP (condition, image_set)")
def q8_qc_totals(spark, sf_dir):
    return qc.qc_totals(gated(spark, sf_dir))


@query("q9_apply_qc", "mosaic", f"""{GATED}
SELECT m.condition, m.image_set, y, x, CASE WHEN rb OR rs OR rl OR re OR ra THEN 0 ELSE m.label END AS label
FROM mosaic m LEFT JOIN g ON m.image_set = g.image_set AND m.label = g.label""")
def q9_apply_qc(spark, sf_dir):
    return qc.apply_gates(views.mosaic(spark, sf_dir), gated(spark, sf_dir)).select("condition", "image_set", "y", "x", "label")


@query("q10_area_fences", "raster", """
 a AS (SELECT condition, image_set, label, count(*) AS area FROM raster WHERE label > 0 GROUP BY ALL),
 q AS (SELECT condition, image_set, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.75) AS q3 FROM a GROUP BY ALL)
SELECT condition, image_set, round(greatest(q1 - 1.5*(q3-q1), 1), 6)::DOUBLE AS min_area, round(q3 + 1.5*(q3-q1), 6)::DOUBLE AS max_area FROM q""")
def q10_area_fences(spark, sf_dir):
    return rounded(qc.area_fences(mo.moments(views.raster(spark, sf_dir))))
