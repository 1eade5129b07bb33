"""Outlier flags, roll-ups and distributions over the cell and ratio views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import summary as s
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded

LIMITS = """
 med AS (SELECT Condition, median(Area) AS am, median(A_CTCF) AS xm, median(B_CTCF) AS bm, count(*) AS n FROM cells GROUP BY ALL),
 mad AS (SELECT c.Condition, any_value(n) AS n, any_value(am) AS am, any_value(xm) AS xm, any_value(bm) AS bm,
                median(abs(Area - am)) AS ad, median(abs(A_CTCF - xm)) AS xd, median(abs(B_CTCF - bm)) AS bd
         FROM cells c JOIN med USING (Condition) GROUP BY c.Condition),
 flagged AS (SELECT c.*,
        coalesce(n >= 3 AND ad >= 1e-12 AND abs(0.6745::DOUBLE * (Area - am) / ad) > 3.5, false) AS is_outlier_area,
        coalesce(n >= 3 AND xd >= 1e-12 AND abs(0.6745::DOUBLE * (A_CTCF - xm) / xd) > 3.5, false) AS "is_outlier_A",
        coalesce(n >= 3 AND bd >= 1e-12 AND abs(0.6745::DOUBLE * (B_CTCF - bm) / bd) > 3.5, false) AS "is_outlier_B"
        FROM cells c JOIN mad USING (Condition))"""
FOV = """
 fov AS (SELECT Condition, ImageSet, count(*) AS n_cells, median(Area) AS median_area,
                median(A_CTCF) AS am, avg(A_CTCF) AS aa, median(B_CTCF) AS bm, avg(B_CTCF) AS ba
         FROM cells GROUP BY ALL)"""
CLEAN = """
 clean AS (SELECT *, Red_CTCF / GFP_CTCF AS ratio FROM ratio WHERE Area >= 50 AND Red_CTCF > 0 AND GFP_CTCF > 0)"""


@query("a1_mad_outliers", "cells", """
 m AS (SELECT Condition, median(A_CTCF) AS med, count(*) AS n FROM cells GROUP BY ALL),
 d AS (SELECT Condition, CellID, A_CTCF, abs(A_CTCF - med) AS dev, n FROM cells JOIN m USING (Condition)),
 mad AS (SELECT Condition, median(dev) AS mad FROM d GROUP BY ALL)
SELECT Condition AS "Condition", CellID AS "CellID",
       n >= 3 AND mad >= 1e-12 AND 0.6745::DOUBLE * dev / mad > 1.5 AS is_outlier
FROM d JOIN mad USING (Condition)""")
def a1_mad_outliers(spark, sf_dir):
    out = s.mad_outliers(views.cells(spark, sf_dir), ["Condition"], "A_CTCF", threshold=1.5)
    return out.select("Condition", "CellID", "is_outlier")


@query("a2_outlier_flags", "cells", f"""{LIMITS}
SELECT Condition AS "Condition", CellID AS "CellID", is_outlier_area, "is_outlier_A", "is_outlier_B" FROM flagged""")
def a2_outlier_flags(spark, sf_dir):
    return s.flag_outliers(views.cells(spark, sf_dir)).select(
        "Condition", "CellID", "is_outlier_area", "is_outlier_A", "is_outlier_B")


@query("a3_flag_totals", "cells", f"""{LIMITS}
SELECT count(*) AS total_cells, count(DISTINCT Condition) AS conditions,
       count(*) FILTER (is_outlier_area OR "is_outlier_A" OR "is_outlier_B") AS outliers_flagged FROM flagged""")
def a3_flag_totals(spark, sf_dir):
    return s.flag_totals(s.flag_outliers(views.cells(spark, sf_dir)))


@query("a4_fov_summary", "cells", f"""{FOV}
SELECT Condition AS "Condition", ImageSet AS "ImageSet", n_cells, median_area, round(am, 6) AS "A_median_CTCF",
       round(aa, 6) AS "A_mean_CTCF", round(bm, 6) AS "B_median_CTCF", round(ba, 6) AS "B_mean_CTCF" FROM fov""")
def a4_fov_summary(spark, sf_dir):
    return rounded(s.fov_summary(views.cells(spark, sf_dir)))


HIER = """
SELECT Condition AS "Condition", 'A' AS "Marker", CAST(sum(n_cells) AS BIGINT) AS "N_cells", count(*) AS "N_FOVs",
       round(avg(am), 6) AS mean_of_fov_medians, round(coalesce(stddev_samp(am), 0), 6) AS sd_of_fov_medians,
       round(CASE WHEN avg(am) > 0 THEN coalesce(stddev_samp(am), 0)/avg(am)*100 ELSE 0 END, 6) AS cv_percent,
       round(coalesce(stddev_samp(am), 0)/sqrt(count(*)), 6) AS sem FROM fov GROUP BY Condition
UNION ALL
SELECT Condition, 'B', CAST(sum(n_cells) AS BIGINT), count(*), round(avg(bm), 6), round(coalesce(stddev_samp(bm), 0), 6),
       round(CASE WHEN avg(bm) > 0 THEN coalesce(stddev_samp(bm), 0)/avg(bm)*100 ELSE 0 END, 6),
       round(coalesce(stddev_samp(bm), 0)/sqrt(count(*)), 6) FROM fov GROUP BY Condition"""


@query("a5_hierarchical_summary", "cells", f"{FOV}, res AS ({HIER}) SELECT * FROM res")
def a5_hierarchical_summary(spark, sf_dir):
    return rounded(s.hierarchical_summary(s.fov_summary(views.cells(spark, sf_dir))))


@query("a6_condition_summary", "cells", """
SELECT Condition AS "Condition", count(*) AS n_cells, round(avg(Area), 6) AS mean_area,
       round(avg(A_CTCF), 6) AS "A_mean", round(stddev_samp(A_CTCF), 6) AS "A_std", round(median(A_CTCF), 6) AS "A_median",
       round(avg(B_CTCF), 6) AS "B_mean", round(stddev_samp(B_CTCF), 6) AS "B_std", round(median(B_CTCF), 6) AS "B_median"
FROM cells GROUP BY Condition""")
def a6_condition_summary(spark, sf_dir):
    return rounded(s.condition_summary(views.cells(spark, sf_dir)))


@query("a7_batch_summary", "cells", """
SELECT Condition AS "Condition", count(*) AS "N_Cells", round(avg(Area), 6) AS "Mean_Area", round(stddev_samp(Area), 6) AS "Std_Area",
       round(avg(A_CTCF), 6) AS "A_Mean_CTCF", round(stddev_samp(A_CTCF), 6) AS "A_Std_CTCF", round(median(A_CTCF), 6) AS "A_Median_CTCF",
       round(avg(B_CTCF), 6) AS "B_Mean_CTCF", round(stddev_samp(B_CTCF), 6) AS "B_Std_CTCF", round(median(B_CTCF), 6) AS "B_Median_CTCF"
FROM cells GROUP BY Condition""")
def a7_batch_summary(spark, sf_dir):
    return rounded(s.condition_summary(views.cells(spark, sf_dir), batch=True))


@query("a8_counters", "cells", """
SELECT count(*) AS total_cells, count(DISTINCT Condition) AS n_conditions, count(DISTINCT ImageSet) AS n_image_sets FROM cells""")
def a8_counters(spark, sf_dir):
    return s.counters(views.cells(spark, sf_dir))


IQR3 = f"""{CLEAN},
 q1 AS (SELECT quantile_cont(Red_CTCF, .25) AS a, quantile_cont(Red_CTCF, .75) AS b FROM clean),
 f1 AS (SELECT clean.* FROM clean, q1 WHERE Red_CTCF BETWEEN a - 1.5*(b-a) AND b + 1.5*(b-a)),
 q2 AS (SELECT quantile_cont(GFP_CTCF, .25) AS a, quantile_cont(GFP_CTCF, .75) AS b FROM f1),
 f2 AS (SELECT f1.* FROM f1, q2 WHERE GFP_CTCF BETWEEN a - 1.5*(b-a) AND b + 1.5*(b-a)),
 q3 AS (SELECT quantile_cont(ratio, .25) AS a, quantile_cont(ratio, .75) AS b FROM f2),
 f3 AS (SELECT f2.* FROM f2, q3 WHERE ratio BETWEEN a - 1.5*(b-a) AND b + 1.5*(b-a))"""


@query("a9_iqr_removal", "ratio", f"""{IQR3}
SELECT Condition AS "Condition", count(*) AS n, round(min(ratio), 6) AS lo, round(max(ratio), 6) AS hi,
       round(sum(Red_CTCF), 2) AS red_sum FROM f3 GROUP BY Condition""")
def a9_iqr_removal(spark, sf_dir):
    kept = s.remove_iqr_outliers(s.clean_ratio(views.ratio(spark, sf_dir)), ["Red_CTCF", "GFP_CTCF", "ratio"])
    out = kept.groupBy("Condition").agg(
        F.count(F.lit(1)).alias("n"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"),
        F.round(F.sum("Red_CTCF"), 2).alias("red_sum"))
    return rounded(out)


@query("a10_chart_iqr_filter", "cells", """
 r AS (SELECT Condition, A_CTCF AS v, row_number() OVER (PARTITION BY Condition ORDER BY A_CTCF) AS rn,
              count(*) OVER (PARTITION BY Condition) AS n FROM cells),
 q AS (SELECT Condition, max(n) AS n, max(v) FILTER (rn = floor(n*0.25) + 1) AS q1, max(v) FILTER (rn = floor(n*0.75) + 1) AS q3
       FROM r GROUP BY Condition)
SELECT c.Condition AS "Condition", CellID AS "CellID", A_CTCF AS "A_CTCF"
FROM cells c JOIN q USING (Condition) WHERE n < 4 OR A_CTCF BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)""")
def a10_chart_iqr_filter(spark, sf_dir):
    return s.chart_iqr_filter(views.cells(spark, sf_dir), "A_CTCF").select("Condition", "CellID", "A_CTCF")


@query("a11_ratio", "ratio", """
SELECT Condition AS "Condition", count(*) AS n, count(r) AS n_ratio, round(sum(r), 4) AS ratio_sum
FROM (SELECT *, CASE WHEN GFP_CTCF > 0 THEN Red_CTCF / GFP_CTCF END AS r FROM ratio) GROUP BY Condition""")
def a11_ratio(spark, sf_dir):
    return s.add_ratio(views.ratio(spark, sf_dir)).groupBy("Condition").agg(
        F.count(F.lit(1)).alias("n"), F.count("ratio").alias("n_ratio"), F.round(F.sum("ratio"), 4).alias("ratio_sum"))


@query("a12_ratio_summary", "ratio", f"""{CLEAN}
SELECT Condition AS "Condition", count(*) AS "N_cells", round(avg(Red_CTCF), 6) AS "Red_mean", round(median(Red_CTCF), 6) AS "Red_median",
       round(avg(GFP_CTCF), 6) AS "Green_mean", round(median(GFP_CTCF), 6) AS "Green_median", round(avg(ratio), 6) AS "Ratio_mean",
       round(median(ratio), 6) AS "Ratio_median", round(stddev_samp(ratio), 6) AS "Ratio_std" FROM clean GROUP BY Condition""")
def a12_ratio_summary(spark, sf_dir):
    return rounded(s.ratio_summary(s.clean_ratio(views.ratio(spark, sf_dir))))


@query("a13_condition_means", "ratio", f"""{CLEAN}
SELECT Condition AS "Condition", round(avg(Red_CTCF), 6) AS "Red_CTCF", round(avg(GFP_CTCF), 6) AS "GFP_CTCF",
       round(avg(ratio), 6) AS ratio FROM clean GROUP BY Condition""")
def a13_condition_means(spark, sf_dir):
    clean = s.clean_ratio(views.ratio(spark, sf_dir))
    return rounded(clean.groupBy("Condition").agg(*[F.avg(c).alias(c) for c in ("Red_CTCF", "GFP_CTCF", "ratio")]))


@query("a14_value_counts", "ratio", """
SELECT Condition AS "Condition", count(*) AS n FROM ratio GROUP BY Condition""")
def a14_value_counts(spark, sf_dir):
    return views.ratio(spark, sf_dir).groupBy("Condition").agg(F.count(F.lit(1)).alias("n"))


@query("a15_log_transform", "cells", """
SELECT CellID AS "CellID", round(log10(greatest(0, B_CTCF) + 1), 6) AS "B_CTCF" FROM cells WHERE B_CTCF > 0""")
def a15_log_transform(spark, sf_dir):
    return rounded(s.log_transform(views.cells(spark, sf_dir), ["B_CTCF"]).select("CellID", "B_CTCF"))


@query("a16_box_plot", "cells", """
 q AS (SELECT Condition, quantile_cont(A_CTCF, .25) AS q1, median(A_CTCF) AS median, quantile_cont(A_CTCF, .75) AS q3
       FROM cells GROUP BY ALL)
SELECT c.Condition AS "Condition", round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       round(min(A_CTCF) FILTER (A_CTCF >= q1 - 1.5*(q3-q1)), 6) AS lower_whisker,
       round(max(A_CTCF) FILTER (A_CTCF <= q3 + 1.5*(q3-q1)), 6) AS upper_whisker,
       round(avg(A_CTCF), 6) AS mean, count(*) AS n
FROM cells c JOIN q USING (Condition) GROUP BY c.Condition""")
def a16_box_plot(spark, sf_dir):
    return rounded(s.box_plot(views.cells(spark, sf_dir), "A_CTCF"))


@query("a17_histogram", "cells", """
 r AS (SELECT Condition, min(Area)::DOUBLE AS lo, max(Area)::DOUBLE AS hi, count(*) AS n FROM cells GROUP BY ALL)
SELECT c.Condition AS "Condition", CAST(least(floor((Area - lo) / (hi - lo) * 50), 49) AS INT) AS bin,
       round(any_value(lo) + least(floor((Area - lo) / (hi - lo) * 50), 49) * any_value((hi - lo) / 50), 6) AS bin_start,
       count(*) AS count, round(count(*) / any_value(n * (hi - lo) / 50), 6) AS density
FROM cells c JOIN r USING (Condition)
GROUP BY c.Condition, least(floor((Area - lo) / (hi - lo) * 50), 49)""")
def a17_histogram(spark, sf_dir):
    return rounded(s.histogram(views.cells(spark, sf_dir), "Area", ["Condition"]))


@query("a18_value_range", "cells", """
SELECT ImageSet AS "ImageSet", min(A_CTCF) AS vmin, CASE WHEN min(A_CTCF) = max(A_CTCF) THEN max(A_CTCF) + 1 ELSE max(A_CTCF) END AS vmax
FROM cells GROUP BY ImageSet""")
def a18_value_range(spark, sf_dir):
    return s.value_range(views.cells(spark, sf_dir), "A_CTCF", ["ImageSet"])


@query("a20_correlation_matrix", "cells", """
 c AS (SELECT ImageSet::DOUBLE AS i, Area::DOUBLE AS a, A_CTCF AS x, B_CTCF AS b FROM cells)
SELECT * FROM (
 SELECT 'ImageSet' AS row, 'ImageSet' AS col, round(corr(i, i), 6) AS r FROM c UNION ALL SELECT 'ImageSet', 'Area', round(corr(i, a), 6) FROM c
 UNION ALL SELECT 'ImageSet', 'A_CTCF', round(corr(i, x), 6) FROM c UNION ALL SELECT 'ImageSet', 'B_CTCF', round(corr(i, b), 6) FROM c
 UNION ALL SELECT 'Area', 'ImageSet', round(corr(i, a), 6) FROM c UNION ALL SELECT 'Area', 'Area', round(corr(a, a), 6) FROM c
 UNION ALL SELECT 'Area', 'A_CTCF', round(corr(a, x), 6) FROM c UNION ALL SELECT 'Area', 'B_CTCF', round(corr(a, b), 6) FROM c
 UNION ALL SELECT 'A_CTCF', 'ImageSet', round(corr(i, x), 6) FROM c UNION ALL SELECT 'A_CTCF', 'Area', round(corr(a, x), 6) FROM c
 UNION ALL SELECT 'A_CTCF', 'A_CTCF', round(corr(x, x), 6) FROM c UNION ALL SELECT 'A_CTCF', 'B_CTCF', round(corr(x, b), 6) FROM c
 UNION ALL SELECT 'B_CTCF', 'ImageSet', round(corr(i, b), 6) FROM c UNION ALL SELECT 'B_CTCF', 'Area', round(corr(a, b), 6) FROM c
 UNION ALL SELECT 'B_CTCF', 'A_CTCF', round(corr(x, b), 6) FROM c UNION ALL SELECT 'B_CTCF', 'B_CTCF', round(corr(b, b), 6) FROM c)""")
def a20_correlation_matrix(spark, sf_dir):
    return rounded(s.correlation_matrix(views.cells(spark, sf_dir)))
