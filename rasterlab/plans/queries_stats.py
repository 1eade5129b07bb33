"""Rank tests, correlation and density queries on the ratio views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import stats as st
from rasterlab.operators import summary as s
from rasterlab.plans import views
from rasterlab.plans.queries_summary import CLEAN
from rasterlab.plans.registry import query, rounded

METRICS = ["Red_CTCF", "GFP_CTCF", "ratio"]
LONG = """
 long AS (SELECT "Condition", 'Red_CTCF' AS metric, Red_CTCF AS v FROM clean UNION ALL SELECT "Condition", 'GFP_CTCF', GFP_CTCF FROM clean
          UNION ALL SELECT "Condition", 'ratio', ratio FROM clean),
 ranked AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS r,
                   count(*) OVER (PARTITION BY metric, v) AS t FROM long),
 tie AS (SELECT metric, count(*)::DOUBLE AS n, sum(t::DOUBLE*t - 1) AS ties FROM ranked GROUP BY ALL),
 grp AS (SELECT metric, "Condition" AS c, count(*) AS n, sum(r) AS r, median(v) AS med FROM ranked GROUP BY ALL)"""
CLEAN2 = CLEAN.replace("FROM ratio", "FROM ratio2").replace(" ratio WHERE", " ratio2 WHERE")

CLEAN_AR = CLEAN.replace("WHERE Area", "WHERE Condition IN ('A', 'R') AND Area")
PAIR = """
 a AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY metric ORDER BY c) = 1),
 b AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY metric ORDER BY c DESC) = 1)
SELECT metric, a.c AS group_a, b.c AS group_b, a.n AS n_a, b.n AS n_b, a.r - a.n * (a.n + 1) / 2 AS "U",
       CASE WHEN a.med > b.med THEN 'higher' ELSE 'lower' END AS direction
FROM a JOIN b USING (metric)"""
KRUSKAL_RAW = """
SELECT metric, ((12 / (any_value(tie.n) * (any_value(tie.n) + 1)) * sum(grp.r * grp.r / grp.n) - 3 * (any_value(tie.n) + 1))
       / (1 - any_value(ties) / (any_value(tie.n)*any_value(tie.n)*any_value(tie.n) - any_value(tie.n)))) AS "H",
       count(*) - 1 AS df, any_value(tie.n)::BIGINT AS n
FROM grp JOIN tie USING (metric) GROUP BY metric"""
KRUSKAL = f"""SELECT * REPLACE (round("H", 6) AS "H") FROM ({KRUSKAL_RAW})"""
# the chi-square tail of three conditions
KRUSKAL_P = f"""SELECT * REPLACE (round("H", 6) AS "H"), round(exp(-"H" / 2), 6) AS p_value FROM ({KRUSKAL_RAW})"""


@query("t1_mann_whitney_u", "ratio2", f"""{CLEAN2}, {LONG}, {PAIR}""")
def t1_mann_whitney_u(spark, sf_dir):
    return st.mann_whitney(s.clean_ratio(views.ratio2(spark, sf_dir)), METRICS).drop("p_value", "stars")


@query("t1_mann_whitney_pair", "ratio", f"""{CLEAN_AR}, {LONG}, {PAIR}""")
def t1_mann_whitney_pair(spark, sf_dir):
    """Two of three conditions: the third one must not count."""
    return st.mann_whitney(s.clean_ratio(views.ratio(spark, sf_dir)), METRICS, pair=("A", "R")).drop("p_value", "stars")


@query("t1_mann_whitney_p")
def t1_mann_whitney_p(spark, sf_dir):
    return rounded(st.mann_whitney(s.clean_ratio(views.ratio2(spark, sf_dir)), METRICS))


@query("t2_kruskal_wallis_h", "ratio", f"""{CLEAN}, {LONG}
{KRUSKAL}""")
def t2_kruskal_wallis_h(spark, sf_dir):
    return rounded(st.kruskal_wallis(s.clean_ratio(views.ratio(spark, sf_dir)), METRICS).drop("p_value"))


@query("t2_kruskal_wallis_p", "ratio", f"""{CLEAN}, {LONG}
{KRUSKAL_P}""")
def t2_kruskal_wallis_p(spark, sf_dir):
    return rounded(st.kruskal_wallis(s.clean_ratio(views.ratio(spark, sf_dir)), METRICS))


@query("t3_pearson_r", "ratio", f"""{CLEAN}
SELECT 'linear' AS scale, round(corr(Red_CTCF, GFP_CTCF), 6) AS r, count(*) AS n,
       CASE WHEN corr(Red_CTCF, GFP_CTCF) > 0.7 THEN 'strong positive' WHEN corr(Red_CTCF, GFP_CTCF) < -0.3 THEN 'negative' ELSE 'weak' END AS reading FROM clean
UNION ALL
SELECT 'log10', round(corr(log10(Red_CTCF), log10(GFP_CTCF)), 6), count(*),
       CASE WHEN corr(log10(Red_CTCF), log10(GFP_CTCF)) > 0.7 THEN 'strong positive' WHEN corr(log10(Red_CTCF), log10(GFP_CTCF)) < -0.3 THEN 'negative' ELSE 'weak' END FROM clean""")
def t3_pearson_r(spark, sf_dir):
    clean = s.clean_ratio(views.ratio(spark, sf_dir))
    both = [st.pearson(clean, "Red_CTCF", "GFP_CTCF", log10=lg).withColumn("scale", F.lit("log10" if lg else "linear"))
            for lg in (False, True)]
    return rounded(both[0].unionByName(both[1]).drop("p_value"))


@query("t3_pearson_p")
def t3_pearson_p(spark, sf_dir):
    return rounded(st.pearson(s.clean_ratio(views.ratio(spark, sf_dir)), "Red_CTCF", "GFP_CTCF"))


KDE = """
 grid AS (SELECT c AS "Condition", n, h, i, x0 + i * step AS x FROM sh, (SELECT unnest(range(200)) AS i)),
 vals AS (SELECT Condition AS c, A_CTCF AS v, count(*) AS k FROM cells GROUP BY ALL)
SELECT "Condition", CAST(i AS INT) AS i, round(x, 4) AS x, round(sum(k * exp(-0.5::DOUBLE * ((x - v) / h) * ((x - v) / h))) / any_value(n * h * sqrt(2 * pi())), 12) AS density
FROM grid JOIN vals ON "Condition" = c GROUP BY "Condition", i, x"""


@query("t4_kde_silverman", "cells", """
 r AS (SELECT Condition AS c, A_CTCF AS v, row_number() OVER (PARTITION BY Condition ORDER BY A_CTCF) AS rn, count(*) OVER (PARTITION BY Condition) AS n FROM cells),
 q AS (SELECT c, max(n) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, max(v) FILTER (rn = floor(n*0.75) + 1) - max(v) FILTER (rn = floor(n*0.25) + 1) AS iqr FROM r GROUP BY c),
 b AS (SELECT *, 1.06::DOUBLE * least(sd, CASE WHEN iqr <> 0 THEN iqr ELSE sd END / 1.34::DOUBLE) * pow(n, -0.2::DOUBLE) AS h FROM q),
 sh AS (SELECT c, n, h, lo - 3*h AS x0, (hi - lo + 6*h) / 199 AS step FROM b),
""" + KDE.strip())
def t4_kde_silverman(spark, sf_dir):
    out = st.kde_silverman(views.cells(spark, sf_dir), "A_CTCF")
    return out.select("Condition", "i", F.round("x", 4).alias("x"), F.round("density", 12).alias("density"))


@query("t5_kde_scott", "cells", """
 b AS (SELECT Condition AS c, count(*) AS n, min(A_CTCF) AS lo, max(A_CTCF) AS hi, stddev_samp(A_CTCF) * pow(count(*), -0.2::DOUBLE) AS h FROM cells GROUP BY ALL),
 sh AS (SELECT c, n, h, lo AS x0, (hi - lo) / 199 AS step FROM b),
""" + KDE.strip())
def t5_kde_scott(spark, sf_dir):
    out = st.kde_scott(views.cells(spark, sf_dir), "A_CTCF")
    return out.select("Condition", "i", F.round("x", 4).alias("x"), F.round("density", 12).alias("density"))


@query("t6_kde_2d")
def t6_kde_2d(spark, sf_dir):
    return st.kde_2d(s.clean_ratio(views.ratio(spark, sf_dir)), "Red_CTCF", "GFP_CTCF")


@query("t6_contour_levels")
def t6_contour_levels(spark, sf_dir):
    return st.contour_levels(st.kde_2d(s.clean_ratio(views.ratio(spark, sf_dir)), "Red_CTCF", "GFP_CTCF"))
