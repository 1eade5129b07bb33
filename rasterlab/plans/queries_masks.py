"""Mask edits on the mosaic view, with requests derived from other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import cells as c
from rasterlab.operators import masks as m
from rasterlab.operators.components import components
from rasterlab.plans import views
from rasterlab.plans.queries_tables import POINTS, points
from rasterlab.plans.registry import query, rounded

KEYS = ("condition", "image_set")
PLACE = ("condition", "image_set", "y", "x", "label")


def mosaic(spark, sf_dir):
    return views.mosaic(spark, sf_dir).drop("nuclear_label")


EDITS = """
 ed AS (SELECT DISTINCT 'c' || CAST((user_id % 5) % 2 AS VARCHAR) AS condition, user_id % 5 AS image_set, CAST(event_id * 7 % 3000 AS INT) AS label
        FROM events)"""


def edits(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(
        "concat('c', cast((user_id % 5) % 2 as string)) as condition", "user_id % 5 as image_set",
        "cast(event_id * 7 % 3000 as int) as label")


@query("m1_remove_cells", "mosaic", f"""{EDITS}
SELECT m.condition, m.image_set, y, x, CASE WHEN ed.label IS NOT NULL THEN 0 ELSE m.label END AS label
FROM mosaic m LEFT JOIN ed ON ed.condition = m.condition AND ed.image_set = m.image_set AND ed.label = m.label AND m.label > 0""")
def m1_remove_cells(spark, sf_dir):
    return m.remove_cells(mosaic(spark, sf_dir), edits(spark, sf_dir)).select(*PLACE)


@query("m2_remove_at_position", "mosaic", f"""{POINTS},
 hit AS (SELECT DISTINCT condition, image_set, label FROM pts JOIN mosaic USING (condition, image_set, y, x) WHERE label > 0)
SELECT m.condition, m.image_set, y, x, CASE WHEN hit.label IS NOT NULL THEN 0 ELSE m.label END AS label
FROM mosaic m LEFT JOIN hit USING (condition, image_set, label)""")
def m2_remove_at_position(spark, sf_dir):
    return m.remove_cells_at(mosaic(spark, sf_dir), points(spark, sf_dir)).select(*PLACE)


@query("m3_merge_cells", "mosaic", """
SELECT condition, image_set, y, x, CASE WHEN label > 0 AND label % 10 = 3 AND image_set > 0 THEN label - 1
       WHEN label > 0 AND label % 10 = 4 AND image_set > 0 THEN label - 2 ELSE label END AS label FROM mosaic""")
def m3_merge_cells(spark, sf_dir):
    px = mosaic(spark, sf_dir)
    first = px.where("label % 10 = 2").select(*KEYS, "label").distinct()
    reqs = first.select(*KEYS, F.expr(
        "case when image_set = 0 then array(label) else array(label + 2, label, label + 1) end").alias("labels"))
    return m.merge_cells(px, reqs).select(*PLACE)


POLY = """
 im AS (SELECT DISTINCT condition, image_set FROM mosaic),
 pl AS (SELECT condition, image_set, s.seq, s.ow, s.y0 + CAST(image_set % 7 AS INT) AS y0, s.x0 AS x0, s.h, s.w FROM im,
        (VALUES (1, false, 5, 6, 12, 20), (2, true, 30, 10, 9, 33), (3, false, 34, 20, 15, 25)) s(seq, ow, y0, x0, h, w)),
 e AS (SELECT pl.*, v.* FROM pl, LATERAL (VALUES (y0, x0, y0, x0 + w), (y0, x0 + w, y0 + h, x0 + w // 2), (y0 + h, x0 + w // 2, y0, x0)) v(ay, ax, ey, ex)),
 px AS (SELECT m.condition, m.image_set, m.y, m.x, e.seq, e.ow,
        bool_or((ex-ax)*(m.y-ay) - (ey-ay)*(m.x-ax) = 0 AND m.y BETWEEN least(ay,ey) AND greatest(ay,ey) AND m.x BETWEEN least(ax,ex) AND greatest(ax,ex)) AS edge,
        sum(CASE WHEN (ay > m.y) <> (ey > m.y) AND m.x < (ex-ax)*(m.y-ay)::DOUBLE/(ey-ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM mosaic m JOIN e USING (condition, image_set) GROUP BY ALL),
 top AS (SELECT condition, image_set, max(label) AS top FROM mosaic GROUP BY ALL),
 w AS (SELECT px.condition, px.image_set, y, x, max(top + seq) FILTER (ow) AS over_, min(top + seq) FILTER (NOT ow) AS first_
       FROM px JOIN top USING (condition, image_set) WHERE edge OR inside GROUP BY ALL)"""


@query("m4_add_polygons", "mosaic", f"""{POLY}
SELECT m.condition, m.image_set, m.y, m.x, CAST(coalesce(over_, CASE WHEN label = 0 THEN coalesce(first_, 0) END, label) AS INT) AS label
FROM mosaic m LEFT JOIN w USING (condition, image_set, y, x)""")
def m4_add_polygons(spark, sf_dir):
    px = mosaic(spark, sf_dir)
    polygons = px.select(*KEYS).distinct().selectExpr(*KEYS, """explode(array(
        named_struct('seq', 1, 'o', false, 'y0', 5, 'x0', 6, 'h', 12, 'w', 20),
        named_struct('seq', 2, 'o', true, 'y0', 30, 'x0', 10, 'h', 9, 'w', 33),
        named_struct('seq', 3, 'o', false, 'y0', 34, 'x0', 20, 'h', 15, 'w', 25))) as s""").selectExpr(
        *KEYS, "s.seq as seq", "s.o as overwrite", "s.y0 + cast(image_set % 7 as int) as y0", "s.x0 as x0", "s.h as h", "s.w as w"
    ).selectExpr(*KEYS, "seq", "overwrite", """array(named_struct('y', y0, 'x', x0), named_struct('y', y0, 'x', x0 + w),
        named_struct('y', y0 + h, 'x', x0 + w div 2)) as vertices""").withColumn(
        "vertices", F.expr("transform(vertices, v -> named_struct('y', cast(v.y as bigint), 'x', cast(v.x as bigint)))"))
    return m.add_cells(px, polygons).select(*PLACE)


GROWN = f"""{POINTS},
 mz AS MATERIALIZED (SELECT image_set, y, x, value FROM mosaic),
 last_ AS (SELECT image_set, y, max(event_id) AS seq, arg_max(x, (event_id, x)) AS x FROM pts GROUP BY ALL),
 seeds AS MATERIALIZED (SELECT image_set, seq, y, x, value AS v0 FROM last_ JOIN mosaic USING (image_set, y, x) WHERE label = 0),
 reg(image_set, seq, y, x) AS (
   SELECT image_set, seq, y, x FROM seeds
   UNION
   SELECT m.image_set, r.seq, m.y, m.x
   FROM (SELECT image_set, seq, y + unnest([0, 0, 1, -1]) AS y, x + unnest([1, -1, 0, 0]) AS x FROM reg) r
     JOIN mz m ON m.image_set = r.image_set AND m.y = r.y AND m.x = r.x
     JOIN seeds s ON s.image_set = r.image_set AND s.seq = r.seq AND abs(m.value - s.v0) <= s.v0 * 0.3::DOUBLE),
 got AS (SELECT image_set, y, x, min(seq) AS seq FROM reg JOIN mosaic USING (image_set, y, x) WHERE label = 0 GROUP BY ALL),
 num AS (SELECT image_set, seq, top + row_number() OVER (PARTITION BY image_set ORDER BY seq) AS new
         FROM (SELECT DISTINCT image_set, seq FROM got) JOIN (SELECT image_set, max(label) AS top FROM mosaic GROUP BY ALL) USING (image_set))
SELECT condition, image_set, y, x, CAST(coalesce(new, label) AS INT) AS label FROM mosaic LEFT JOIN got USING (image_set, y, x) LEFT JOIN num USING (image_set, seq)"""


@query("m5_grow_from_seed", "mosaic", GROWN)
def m5_grow_from_seed(spark, sf_dir):
    # the last click on each row of pixels
    last = points(spark, sf_dir).groupBy("condition", "image_set", "y").agg(F.max(F.struct("event_id", "x")).alias("p"))
    seeds = last.select("condition", "image_set", "y", "p.x", F.col("p.event_id").alias("seq"))
    return m.grow_from_seeds(mosaic(spark, sf_dir), seeds).select(*PLACE)


PARTS = """
 pix AS (SELECT image_set, y, x, y::BIGINT * 2147483648 + x AS code FROM mosaic WHERE label > 0),
 cell AS (SELECT image_set, label, min(y::BIGINT * 2147483648 + x) AS code FROM mosaic WHERE label > 0 GROUP BY ALL),
 touch AS (SELECT DISTINCT a.image_set, a.label AS p, b.label AS q FROM mosaic a JOIN mosaic b ON a.image_set = b.image_set
           AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)) WHERE a.label > 0 AND b.label > 0 AND a.label <> b.label),
 both_ AS (SELECT image_set, p, q FROM touch UNION SELECT image_set, q, p FROM touch),
 w AS (SELECT image_set, label AS start, label AS label FROM cell),
 r1 AS (SELECT * FROM w UNION SELECT w.image_set, w.start, both_.q FROM w JOIN both_ ON both_.image_set = w.image_set AND both_.p = w.label),
 r2 AS (SELECT * FROM r1 UNION SELECT a.image_set, a.start, b.label FROM r1 a JOIN r1 b ON a.image_set = b.image_set AND a.label = b.start),
 r3 AS (SELECT * FROM r2 UNION SELECT a.image_set, a.start, b.label FROM r2 a JOIN r2 b ON a.image_set = b.image_set AND a.label = b.start),
 r4 AS (SELECT * FROM r3 UNION SELECT a.image_set, a.start, b.label FROM r3 a JOIN r3 b ON a.image_set = b.image_set AND a.label = b.start),
 r5 AS (SELECT * FROM r4 UNION SELECT a.image_set, a.start, b.label FROM r4 a JOIN r4 b ON a.image_set = b.image_set AND a.label = b.start),
 root AS (SELECT r5.image_set, r5.start AS label, min(cell.code) AS component FROM r5 JOIN cell ON cell.image_set = r5.image_set AND cell.label = r5.label GROUP BY ALL)"""


@query("m6_clean_small_objects", "mosaic", f"""{PARTS},
 big AS (SELECT image_set, component FROM mosaic JOIN root USING (image_set, label) GROUP BY ALL HAVING count(*) >= 20),
 kept AS (SELECT image_set, label, dense_rank() OVER (PARTITION BY image_set ORDER BY label) AS new
          FROM (SELECT DISTINCT image_set, label FROM root JOIN big USING (image_set, component)))
SELECT condition, image_set, y, x, coalesce(CAST(new AS INT), 0) AS label FROM mosaic LEFT JOIN kept USING (image_set, label)""")
def m6_clean_small_objects(spark, sf_dir):
    return m.clean_small_objects(mosaic(spark, sf_dir), min_size=20).select(*PLACE)


@query("m7_fill_holes", "raster", """
SELECT condition, image_set, y, x, label FROM raster""")
def m7_fill_holes(spark, sf_dir):
    holed = views.raster(spark, sf_dir).withColumn("label", F.expr(
        "case when y % 10 = 4 and x % 10 = 4 then 0 else label end"))
    return m.fill_holes(holed).select(*PLACE)


NEXT = """
 n AS (SELECT m.condition, m.image_set, m.y, m.x, m.label, min(s.label) FILTER (s.label > 0) AS near
       FROM mosaic m, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
       LEFT JOIN mosaic s ON s.image_set = m.image_set AND s.y = m.y + dy AND s.x = m.x + dx GROUP BY ALL)"""


@query("m8_dilate_once", "mosaic", f"""{NEXT}
SELECT condition, image_set, y, x, CASE WHEN label = 0 THEN coalesce(near, 0) ELSE label END AS label FROM n""")
def m8_dilate_once(spark, sf_dir):
    return m.dilate(mosaic(spark, sf_dir)).select(*PLACE)


# owner * 4 + steps, recomputed everywhere from the neighbours until it stays (40 sweeps are plenty)
SWEEPS = """
 s(sweep, image_set, y, x, label, v) AS (
   SELECT 0, image_set, y, x, label, CASE WHEN label > 0 THEN label * 4 ELSE 1000000000 END FROM mosaic
   UNION ALL
   SELECT sweep + 1, image_set, y, x, label,
          CASE WHEN label > 0 THEN v ELSE least(coalesce(lag(p) OVER r, 1000000000), coalesce(lead(p) OVER r, 1000000000), coalesce(lag(p) OVER c, 1000000000), coalesce(lead(p) OVER c, 1000000000)) END
   FROM (SELECT *, CASE WHEN v < 1000000000 AND v % 4 < 3 THEN v + 1 ELSE 1000000000 END AS p FROM s) WHERE sweep < 40
   WINDOW r AS (PARTITION BY image_set, y ORDER BY x), c AS (PARTITION BY image_set, x ORDER BY y))"""


@query("m8_dilate_more", "mosaic", f"""{SWEEPS}
SELECT m.condition, image_set, y, x, CAST(CASE WHEN v < 1000000000 THEN v // 4 ELSE 0 END AS INT) AS label FROM s JOIN mosaic m USING (image_set, y, x) WHERE sweep = 40""")
def m8_dilate_more(spark, sf_dir):
    return m.dilate(mosaic(spark, sf_dir), iterations=3).select(*PLACE)


SECOND = """
 a AS (SELECT condition, image_set, y, x, label FROM mosaic),
 b AS (SELECT condition, image_set, y, x, CASE WHEN y >= 40 AND y % 10 > 4 AND value > 900 THEN 1 + y // 10 ELSE 0 END AS label FROM mosaic),
 t AS (SELECT condition, image_set, max(label) AS top FROM a GROUP BY ALL)"""


def second_mask(spark, sf_dir):
    return mosaic(spark, sf_dir).withColumn("label", F.expr(
        "case when y >= 40 and y % 10 > 4 and value > 900 then cast(1 + y div 10 as int) else 0 end"))


def _merged(expr: str) -> str:
    return f"""{SECOND},
 g AS (SELECT a.condition, a.image_set, a.y, a.x, {expr} AS label FROM a JOIN b USING (condition, image_set, y, x) JOIN t USING (condition, image_set)),
 r AS (SELECT condition, image_set, label, CAST(dense_rank() OVER (PARTITION BY condition, image_set ORDER BY label) AS INT) AS n
       FROM (SELECT DISTINCT condition, image_set, label FROM g WHERE label > 0))
SELECT g.condition, g.image_set, y, x, coalesce(n, 0) AS label FROM g LEFT JOIN r USING (condition, image_set, label)"""


@query("m9_merge_union", "mosaic", _merged("CASE WHEN a.label > 0 THEN a.label WHEN b.label > 0 THEN b.label + top ELSE 0 END"))
def m9_merge_union(spark, sf_dir):
    return m.merge_masks(mosaic(spark, sf_dir), second_mask(spark, sf_dir)).select(*PLACE)


@query("m9_merge_intersection", "mosaic", _merged("CASE WHEN a.label > 0 AND b.label > 0 THEN a.label ELSE 0 END"))
def m9_merge_intersection(spark, sf_dir):
    return m.merge_masks(mosaic(spark, sf_dir), second_mask(spark, sf_dir), mode="intersection").select(*PLACE)


@query("m10_erode", "mosaic", """
 big AS (SELECT condition, image_set, y, x, CAST(y // 20 * 4 + x // 20 + 1 AS INT) * CASE WHEN label % 3 = 1 AND y % 2 = 0 THEN 0 ELSE 1 END AS label FROM mosaic),
 e1 AS (SELECT t.condition, t.image_set, t.y, t.x, CASE WHEN bool_and(s.label IS NULL OR s.label = t.label) THEN t.label ELSE 0 END AS label
        FROM big t, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
        LEFT JOIN big s ON s.image_set = t.image_set AND s.y = t.y + dy AND s.x = t.x + dx GROUP BY t.condition, t.image_set, t.y, t.x, t.label)
SELECT t.condition, t.image_set, t.y, t.x, CASE WHEN bool_and(s.label IS NULL OR s.label = t.label) THEN t.label ELSE 0 END AS label
FROM e1 t, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
LEFT JOIN e1 s ON s.image_set = t.image_set AND s.y = t.y + dy AND s.x = t.x + dx GROUP BY t.condition, t.image_set, t.y, t.x, t.label""")
def m10_erode(spark, sf_dir):
    big = mosaic(spark, sf_dir).withColumn("label", F.expr(
        "cast(y div 20 * 4 + x div 20 + 1 as int) * case when label % 3 = 1 and y % 2 = 0 then 0 else 1 end"))
    return m.erode(big, iterations=2).select(*PLACE)


CROSS = "(VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)"


@query("m11_smooth_boundaries", "mosaic", f"""
 s0 AS (SELECT condition, image_set, label, y, x FROM mosaic WHERE label > 0),
 s1 AS (SELECT DISTINCT condition, image_set, label, y + dy AS y, x + dx AS x FROM s0, {CROSS} WHERE y + dy BETWEEN 0 AND 79 AND x + dx BETWEEN 0 AND 79),
 s2 AS (SELECT condition, image_set, label, y + dy AS y, x + dx AS x FROM s1, {CROSS} GROUP BY ALL HAVING count(*) = 5),
 s3 AS (SELECT condition, image_set, label, y + dy AS y, x + dx AS x FROM s2, {CROSS} GROUP BY ALL HAVING count(*) = 5),
 s4 AS (SELECT DISTINCT condition, image_set, label, y + dy AS y, x + dx AS x FROM s3, {CROSS} WHERE y + dy BETWEEN 0 AND 79 AND x + dx BETWEEN 0 AND 79),
 t AS (SELECT condition, image_set, y, x, max(label) AS top FROM s4 GROUP BY ALL)
SELECT m.condition, m.image_set, m.y, m.x, coalesce(top, 0) AS label FROM mosaic m LEFT JOIN t USING (condition, image_set, y, x)""")
def m11_smooth_boundaries(spark, sf_dir):
    return m.smooth_boundaries(mosaic(spark, sf_dir)).select(*PLACE)


@query("m13_connected_components", "mosaic", f"""{PARTS}
SELECT condition, image_set, y, x, component FROM mosaic JOIN root USING (image_set, label)""")
def m13_connected_components(spark, sf_dir):
    px = mosaic(spark, sf_dir).where("label > 0")
    return components(px.select(*KEYS, "y", "x"), KEYS)


@query("m13_components_across_tiles", "mosaic", f"""{PARTS}
SELECT condition, image_set, y, x, component FROM mosaic JOIN root USING (image_set, label)""")
def m13_components_across_tiles(spark, sf_dir):
    """The same components with 16-pixel tiles, so that most of them cross a seam."""
    px = mosaic(spark, sf_dir).where("label > 0")
    return components(px.select(*KEYS, "y", "x"), KEYS, tile=16)


@query("m14_edit_summary", "mosaic", f"""{EDITS},
 aft AS (SELECT m.condition, m.image_set, y, x, m.label AS a, CASE WHEN ed.label IS NOT NULL THEN 0 ELSE m.label END AS b
         FROM mosaic m LEFT JOIN ed ON ed.condition = m.condition AND ed.image_set = m.image_set AND ed.label = m.label AND m.label > 0)
SELECT condition, image_set, count(DISTINCT a) FILTER (a > 0) AS original_cells, count(DISTINCT b) FILTER (b > 0) AS edited_cells,
       CAST(0 AS BIGINT) AS cells_added, count(DISTINCT a) FILTER (a > 0) - count(DISTINCT b) FILTER (b > 0) AS cells_removed,
       count(*) FILTER (a <> b) AS pixels_changed, round(100.0::DOUBLE * count(*) FILTER (a <> b) / count(*), 6) AS percent_changed
FROM aft GROUP BY ALL""")
def m14_edit_summary(spark, sf_dir):
    px = mosaic(spark, sf_dir)
    return rounded(m.edit_summary(px, m.remove_cells(px, edits(spark, sf_dir))))


@query("m15_edit_log", "edit_log", """
 o AS (SELECT *, row_number() OVER (PARTITION BY image_set ORDER BY ts, seq) AS a, row_number() OVER (PARTITION BY image_set ORDER BY ts DESC, seq DESC) AS z FROM edit_log)
SELECT image_set, max(seq) FILTER (a = 1) AS original_seq, max(operation) FILTER (z = 1) AS last_operation, least(count(*), 20) AS undo_depth
FROM o GROUP BY image_set""")
def m15_edit_log(spark, sf_dir):
    return m.edit_log_status(views.edit_log(spark, sf_dir))


@query("m16_training_manifest", "", """
 l AS (SELECT event_type AS condition, user_id AS image_set, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'upsert' END AS action FROM events)
SELECT condition, image_set, seq, action FROM l QUALIFY row_number() OVER (PARTITION BY condition, image_set ORDER BY seq DESC) = 1 AND action <> 'remove'""")
def m16_training_manifest(spark, sf_dir):
    return m.training_manifest(_pair_log(spark, sf_dir))


def _pair_log(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(
        "event_type as condition", "user_id as image_set", "event_id as seq",
        "case when event_id % 4 = 0 then 'remove' else 'upsert' end as action")


@query("m16_train_test_split", "", """
 l AS (SELECT event_type AS condition, user_id AS image_set, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'upsert' END AS action FROM events),
 man AS (SELECT condition, image_set, seq, action FROM l QUALIFY row_number() OVER (PARTITION BY condition, image_set ORDER BY seq DESC) = 1 AND action <> 'remove'),
 h AS (SELECT *, CAST('0x' || substr(md5(condition || '|' || image_set || '|42'), 1, 15) AS BIGINT) AS h FROM man)
SELECT condition, image_set, seq, action, row_number() OVER (ORDER BY h) <= greatest(1, count(*) OVER () // 5) AS is_test FROM h""")
def m16_train_test_split(spark, sf_dir):
    return m.train_test_split(m.training_manifest(_pair_log(spark, sf_dir)))


@query("l12_fragmented_cells")
def l12_fragmented_cells(spark, sf_dir):
    px = mosaic(spark, sf_dir)
    out = c.mask_issues(px, components=m.eroded_component_counts(px))
    return rounded(out.withColumn("issues", F.array_join("issues", "; ")))
