"""Projections, filters, joins, paging and set operations on result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import qc
from rasterlab.operators import summary as s
from rasterlab.operators import tables as t
from rasterlab.plans import views
from rasterlab.plans.analyses import RATIO_KEYWORDS
from rasterlab.plans.queries_shape import GATED, gated
from rasterlab.plans.queries_summary import LIMITS
from rasterlab.plans.registry import query, rounded


def flagged_cells(spark, sf_dir):
    return s.flag_outliers(views.cells(spark, sf_dir)).withColumns({
        "is_saturated": F.col("CellID") % 11 == 0, "is_dim": F.col("CellID") % 13 == 0})


@query("p1_chart_projection", "cells", f"""{LIMITS}
SELECT Condition AS "Condition", ImageSet AS "ImageSet", CellID AS "CellID", Area AS "Area", A_CTCF AS "A_CTCF", B_CTCF AS "B_CTCF",
       is_outlier_area, "is_outlier_A", "is_outlier_B", CellID % 11 = 0 AS is_saturated, CellID % 13 = 0 AS is_dim FROM flagged""")
def p1_chart_projection(spark, sf_dir):
    return t.chart_projection(flagged_cells(spark, sf_dir).withColumn("A_MCF", F.col("A_CTCF") / F.col("Area")))


@query("p2_filter_results", "cells", """
SELECT Condition AS "Condition", ImageSet AS "ImageSet", CellID AS "CellID", Area AS "Area", A_CTCF AS "A_CTCF"
FROM cells WHERE Condition IN ('F', 'O') AND Area >= 200""")
def p2_filter_results(spark, sf_dir):
    return t.filter_results(views.cells(spark, sf_dir), ["F", "O"], 200, "A_")


@query("p3_drop_outliers", "cells", f"""{LIMITS}
SELECT Condition AS "Condition", CellID AS "CellID" FROM flagged WHERE NOT (is_outlier_area OR "is_outlier_A" OR "is_outlier_B")""")
def p3_drop_outliers(spark, sf_dir):
    return t.drop_outliers(s.flag_outliers(views.cells(spark, sf_dir))).select("Condition", "CellID")


@query("p4_any_flag", "cells", f"""{LIMITS}
SELECT CellID AS "CellID", is_outlier_area OR "is_outlier_A" OR "is_outlier_B" OR CellID % 11 = 0 OR CellID % 13 = 0 AS flagged FROM flagged""")
def p4_any_flag(spark, sf_dir):
    return t.flagged(flagged_cells(spark, sf_dir)).select("CellID", "flagged")


@query("p5_cell_records", "cells", """
SELECT CellID::VARCHAR AS cell_id, Area::DOUBLE AS area, CASE WHEN CellID % 5 = 0 THEN NULL ELSE round(A_CTCF, 2) END AS a_ctcf
FROM cells WHERE Condition = 'F' AND ImageSet = 7""")
def p5_cell_records(spark, sf_dir):
    cells = views.cells(spark, sf_dir).withColumn(
        "A_CTCF", F.when(F.col("CellID") % 5 == 0, float("nan")).otherwise(F.col("A_CTCF")))
    rec = t.cell_records(cells, "F", 7)
    return rec.select(
        "cell_id", F.get_json_object("record", "$.Area").cast("double").alias("area"),
        F.round(F.get_json_object("record", "$.A_CTCF").cast("double"), 2).alias("a_ctcf"))


POINTS = """
 pts AS (SELECT event_id, 'c' || CAST((user_id % 5) % 2 AS VARCHAR) AS condition, user_id % 5 AS image_set,
                CAST((event_id * 7) % 97 AS INT) AS y, CAST((event_id * 13) % 89 AS INT) AS x FROM events)"""


def points(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('c', cast((user_id % 5) % 2 as string)) as condition", "user_id % 5 as image_set",
        "cast((event_id * 7) % 97 as int) as y", "cast((event_id * 13) % 89 as int) as x")


@query("p6_label_at", "mosaic", f"""{POINTS}
SELECT event_id, coalesce(label, 0) AS label FROM pts LEFT JOIN mosaic USING (condition, image_set, y, x)""")
def p6_label_at(spark, sf_dir):
    return t.labels_at(views.mosaic(spark, sf_dir), points(spark, sf_dir)).select("event_id", "label")


@query("p7_marker_list", "mosaic markers", "SELECT DISTINCT marker FROM markers")
def p7_marker_list(spark, sf_dir):
    return t.distinct_markers(views.markers(spark, sf_dir))


@query("p8_detect_columns", "", """
 cols AS (SELECT p_partkey AS pos, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_Red_CTCF' WHEN p_partkey % 3 = 1 THEN '_gfp_ctcf' ELSE '_Size' END AS name FROM part),
 kw AS (SELECT * FROM (VALUES ('condition',0,'condition'),('condition',1,'treatment'),('condition',2,'group'),('condition',3,'sample'),
   ('red',0,'mrfp_ctcf'),('red',1,'rfp_ctcf'),('red',2,'red_ctcf'),('red',3,'jc1_red_ctcf'),('red',4,'jc-1_red_ctcf'),('red',5,'aggregate_ctcf'),
   ('green',0,'gfp_ctcf'),('green',1,'green_ctcf'),('green',2,'jc1_green_ctcf'),('green',3,'jc-1_green_ctcf'),('green',4,'monomer_ctcf'),
   ('area',0,'area'),('area',1,'cell_area'),('area',2,'size')) k(role, kp, word)),
 h AS (SELECT role, kp, pos, name FROM cols, kw WHERE contains(lower(name), word) AND (role NOT IN ('red', 'green') OR contains(lower(name), 'ctcf')))
SELECT role, arg_min(name, kp * 1000000 + pos) AS name FROM h GROUP BY role""")
def p8_detect_columns(spark, sf_dir):
    cols = views.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as pos",
        """concat(replace(p_name, ' ', '_'), case when p_partkey % 3 = 0 then '_Red_CTCF'
                  when p_partkey % 3 = 1 then '_gfp_ctcf' else '_Size' end) as name""")
    return t.detect_columns(cols, RATIO_KEYWORDS, only_ctcf=("red", "green"))


@query("p9_min_area", "cells", 'SELECT CellID AS "CellID", Area AS "Area" FROM cells WHERE Area >= 50')
def p9_min_area(spark, sf_dir):
    return t.filter_results(views.cells(spark, sf_dir), min_area=50).select("CellID", "Area")


@query("p10_positive_finite", "cells", 'SELECT CellID AS "CellID", B_CTCF AS "B_CTCF" FROM cells WHERE B_CTCF > 0 AND A_CTCF > 0')
def p10_positive_finite(spark, sf_dir):
    return t.finite_positive(views.cells(spark, sf_dir), ["A_CTCF", "B_CTCF"]).select("CellID", "B_CTCF")


@query("w2_page", "cells", """
 r AS (SELECT *, row_number() OVER (ORDER BY CellID) - 1 AS row_no FROM cells)
SELECT CellID AS "CellID", Condition AS "Condition", Area AS "Area", row_no FROM r WHERE row_no >= 300 AND row_no < 600""")
def w2_page(spark, sf_dir):
    return t.page(views.cells(spark, sf_dir), "CellID", 1, 300).select("CellID", "Condition", "Area", "row_no")


@query("w2_page_counts", "cells", "SELECT count(*) AS total_rows, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS total_pages FROM cells")
def w2_page_counts(spark, sf_dir):
    return t.page_counts(views.cells(spark, sf_dir))


@query("w3_relabel_sequential", "mosaic", """
 r AS (SELECT image_set, label, CAST(dense_rank() OVER (PARTITION BY image_set ORDER BY label) AS INT) AS n
       FROM (SELECT DISTINCT image_set, label * 5 AS label FROM mosaic WHERE label > 0))
SELECT condition, image_set, y, x, coalesce(n, 0) AS label
FROM mosaic m LEFT JOIN r USING (image_set) WHERE r.label = m.label * 5
UNION ALL SELECT condition, image_set, y, x, 0 FROM mosaic WHERE label = 0""")
def w3_relabel_sequential(spark, sf_dir):
    px = views.mosaic(spark, sf_dir).withColumn("label", F.col("label") * 5)
    return t.relabel_sequential(px).select("condition", "image_set", "y", "x", "label")


@query("w5_latest_per_key", "edit_log", """
SELECT image_set, max(seq) AS seq, arg_max(operation, seq) AS operation FROM edit_log GROUP BY image_set""")
def w5_latest_per_key(spark, sf_dir):
    return t.latest(views.edit_log(spark, sf_dir).drop("ts"), ["image_set"], ["seq"])


@query("w6_recent_edits", "edit_log", """
SELECT image_set, seq, operation FROM edit_log QUALIFY row_number() OVER (PARTITION BY image_set ORDER BY seq DESC) <= 20""")
def w6_recent_edits(spark, sf_dir):
    return t.most_recent(views.edit_log(spark, sf_dir).drop("ts"), ["image_set"], "seq")


@query("w7_natural_order", "", """
SELECT DISTINCT p_brand AS suffix, CASE WHEN regexp_matches(p_brand, '[0-9]') THEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) ELSE 999 END AS natural_key FROM part
UNION SELECT DISTINCT p_type, CASE WHEN regexp_matches(p_type, '[0-9]') THEN CAST(regexp_extract(p_type, '([0-9]+)', 1) AS INT) ELSE 999 END FROM part""")
def w7_natural_order(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("suffix")).union(part.select("p_type")).distinct()
    return t.natural_order(names, "suffix")


@query("u1_union_results", "cells", """
SELECT Condition AS "Condition", CellID AS "CellID", A_CTCF AS "A_CTCF", NULL::DOUBLE AS "B_CTCF" FROM cells WHERE ImageSet < 20
UNION ALL SELECT Condition, CellID, NULL, B_CTCF FROM cells WHERE ImageSet >= 20""")
def u1_union_results(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    return t.union_results(cells.where("ImageSet < 20").select("Condition", "CellID", "A_CTCF"),
                           cells.where("ImageSet >= 20").select("Condition", "CellID", "B_CTCF"))


@query("j2_results_with_shape", "mosaic", """
 r AS (SELECT condition, image_set, label, sum(value)::DOUBLE AS int_den FROM mosaic WHERE label > 0 GROUP BY ALL),
 m AS (SELECT condition, image_set, label, avg(y) AS y_centroid FROM mosaic WHERE label > 0 AND label % 2 = 0 GROUP BY ALL)
SELECT r.condition, r.image_set, r.label, int_den, round(coalesce(y_centroid, 0), 6) AS y_centroid
FROM r LEFT JOIN m USING (condition, image_set, label)""")
def j2_results_with_shape(spark, sf_dir):
    from rasterlab.operators import cells as c
    from rasterlab.operators import morphology as mo

    px = views.mosaic(spark, sf_dir)
    shape = mo.moments(px.where("label % 2 = 0")).select("condition", "image_set", "label", "y_centroid")
    out = c.label_stats(px).join(shape, ["condition", "image_set", "label"], "left").fillna(0.0, ["y_centroid"])
    return rounded(out.select("condition", "image_set", "label", "int_den", "y_centroid"))


@query("j3_kept_cells", "mosaic", f"""{GATED}
SELECT m.condition, m.image_set, m.label, count(*) AS area FROM mosaic m
JOIN g ON g.image_set = m.image_set AND g.label = m.label AND NOT (rb OR rs OR rl OR re OR ra) GROUP BY ALL""")
def j3_kept_cells(spark, sf_dir):
    from rasterlab.operators import cells as c

    kept = qc.kept_cells(c.label_stats(views.mosaic(spark, sf_dir)), gated(spark, sf_dir))
    return kept.select("condition", "image_set", "label", "area")


@query("j1_calibrated_signal", "raster calibration_frames", """
 dark AS (SELECT y, x, median(CAST(value AS DOUBLE)) AS dark FROM calibration_frames WHERE kind = 'dark' GROUP BY ALL)
SELECT condition, image_set, label, sum(greatest(value - dark, 0))::DOUBLE AS signal
FROM raster JOIN dark USING (y, x) WHERE label > 0 GROUP BY ALL""")
def j1_calibrated_signal(spark, sf_dir):
    from rasterlab.operators import pixels as p

    frames = views.calibration_frames(spark, sf_dir).where("kind = 'dark'").drop("kind")
    px = p.correct(views.raster(spark, sf_dir).where("label > 0"), p.master_dark(frames))
    return px.groupBy("condition", "image_set", "label").agg(F.sum("value").alias("signal"))


@query("j7_parameter_override", "raster", """
 i AS (SELECT DISTINCT condition, image_set FROM raster),
 o AS (SELECT 'c' || CAST(r_regionkey AS VARCHAR) AS condition, CASE WHEN r_regionkey % 2 = 0 THEN 20.0::DOUBLE + r_regionkey END AS diameter,
              CAST(10 + r_regionkey AS INT) AS min_size FROM region)
SELECT condition, image_set, coalesce(diameter, 30) AS diameter, coalesce(min_size, 15) AS min_size, 0.4::DOUBLE AS flow_threshold
FROM i LEFT JOIN o USING (condition)""")
def j7_parameter_override(spark, sf_dir):
    images = views.raster(spark, sf_dir).select("condition", "image_set").distinct()
    overrides = views.table(spark, sf_dir, "region").selectExpr(
        "concat('c', cast(r_regionkey as string)) as condition",
        "case when r_regionkey % 2 = 0 then 20d + r_regionkey end as diameter", "cast(10 + r_regionkey as int) as min_size")
    return t.with_overrides(images, overrides, {"diameter": 30.0, "min_size": 15, "flow_threshold": 0.4})


NAMED = """
 f AS (SELECT l_returnflag AS condition, l_suppkey % 50 AS image_set, CASE l_linenumber % 4 WHEN 0 THEN 'c0' WHEN 1 THEN 'C0' WHEN 2 THEN 'c1' ELSE 'W2' END AS suffix,
              min(l_partkey)::VARCHAR AS path FROM lineitem GROUP BY ALL)"""


@query("j8_suffix_match", "", f"""{NAMED},
 w AS (SELECT DISTINCT condition, image_set, s.suffix FROM f, (VALUES ('c0'), ('C1'), ('w2'), ('x9')) s(suffix)),
 h AS (SELECT w.*, path, CASE WHEN f.suffix = w.suffix THEN 0 WHEN f.suffix = upper(w.suffix) THEN 1 WHEN f.suffix = lower(w.suffix) THEN 2 END AS k
       FROM w JOIN f ON f.condition = w.condition AND f.image_set = w.image_set AND lower(f.suffix) = lower(w.suffix))
SELECT condition, image_set, suffix, arg_min(path, k) AS path FROM h WHERE k IS NOT NULL GROUP BY ALL""")
def j8_suffix_match(spark, sf_dir):
    files = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as condition", "l_suppkey % 50 as image_set",
        "case l_linenumber % 4 when 0 then 'c0' when 1 then 'C0' when 2 then 'c1' else 'W2' end as suffix", "l_partkey",
    ).groupBy("condition", "image_set", "suffix").agg(F.min("l_partkey").cast("string").alias("path"))
    wanted = files.select("condition", "image_set").distinct().withColumn(
        "suffix", F.explode(F.array(*[F.lit(x) for x in ("c0", "C1", "w2", "x9")])))
    return t.match_suffix(wanted, files)


@query("j9_zip_lists", "", """
 b AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS a, list(n_nationkey ORDER BY n_nationkey) FILTER (n_nationkey < 18) AS k FROM nation GROUP BY ALL)
SELECT n_regionkey, unnest(a[1:len(k)]) AS name, unnest(k[1:len(a)]) AS suffix FROM b""")
def j9_zip_lists(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation")
    lists = nation.groupBy("n_regionkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("name"),
        F.array_sort(F.collect_list(F.when(F.col("n_nationkey") < 18, F.col("n_nationkey")))).alias("suffix"))
    return t.zip_lists(lists, "name", "suffix")
