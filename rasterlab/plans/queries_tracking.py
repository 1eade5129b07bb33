"""Time-lapse queries on the detection and track views, and on the raster read as a movie."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlab.operators import pixels as p
from rasterlab.operators import tracking as tr
from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded

RADIUS = 5.0
MOVIE = """
 movie AS (SELECT 'm' || CAST(image_set % 2 AS VARCHAR) AS condition, CAST(image_set AS INT) AS frame, y, x, label, value FROM raster),
 det AS (SELECT condition, frame, label, avg(y) AS cy, avg(x) AS cx, count(*) AS area, avg(value) AS mean_intensity FROM movie WHERE label > 0 GROUP BY ALL)"""
LIN = """
 nodes AS (SELECT DISTINCT condition, track_id, parent_id FROM tracks),
 up(condition, track_id, anc, gen) AS (
   SELECT condition, track_id, track_id, 0 FROM nodes
   UNION ALL SELECT up.condition, up.track_id, n.parent_id, gen + 1 FROM up JOIN nodes n ON n.condition = up.condition AND n.track_id = up.anc WHERE n.parent_id IS NOT NULL),
 lin AS (SELECT condition, track_id, arg_max(anc, gen) AS root_id, max(gen) AS generation FROM up GROUP BY ALL),
 fl AS (SELECT t.*, root_id, generation, parent_id IS NOT NULL AND frame = min(frame) OVER (PARTITION BY t.condition, t.track_id) AS is_division
        FROM tracks t JOIN lin USING (condition, track_id))"""


def movie(spark, sf_dir):
    return views.raster(spark, sf_dir).selectExpr(
        "concat('m', cast(image_set % 2 as string)) as condition", "cast(image_set as int) as frame", "y", "x", "label", "value")


@query("k1_detections", "raster", f"""{MOVIE}
SELECT condition, frame, label, round(cy, 6) AS cy, round(cx, 6) AS cx, area, round(mean_intensity, 6) AS mean_intensity FROM det""")
def k1_detections(spark, sf_dir):
    return rounded(tr.detections(movie(spark, sf_dir)))


@query("j5_candidate_links", "detections", """
 fr AS (SELECT condition, frame, lag(frame) OVER (PARTITION BY condition ORDER BY frame) AS prev_frame FROM (SELECT DISTINCT condition, frame FROM detections))
SELECT a.condition, a.frame, fr.prev_frame, a.label, b.label AS prev_label, round(sqrt((a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx)), 6) AS distance
FROM detections a JOIN fr ON fr.condition = a.condition AND fr.frame = a.frame JOIN detections b ON b.condition = a.condition AND b.frame = fr.prev_frame
WHERE sqrt((a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx)) < 5""")
def j5_candidate_links(spark, sf_dir):
    return rounded(tr.candidate_links(views.detections(spark, sf_dir), RADIUS))


# every choice of links of a connected group of cells, cell by cell; the most links win, then the least distance
BEST_LINKS = """
 fr AS (SELECT condition, frame, lag(frame) OVER (PARTITION BY condition ORDER BY frame) AS prev_frame FROM (SELECT DISTINCT condition, frame FROM detections)),
 cand AS (SELECT a.condition, a.frame, fr.prev_frame, a.label, b.label AS prev_label, sqrt((a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx)) AS distance
   FROM detections a JOIN fr ON fr.condition = a.condition AND fr.frame = a.frame JOIN detections b ON b.condition = a.condition AND b.frame = fr.prev_frame
   WHERE sqrt((a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx)) < 5),
 rival AS (SELECT DISTINCT a.condition, a.frame, a.label AS p, b.label AS q FROM cand a JOIN cand b USING (condition, frame, prev_label)),
 reach(condition, frame, p, q) AS (SELECT * FROM rival
   UNION SELECT r.condition, r.frame, r.p, s.q FROM reach r JOIN rival s ON s.condition = r.condition AND s.frame = r.frame AND s.p = r.q),
 grp AS (SELECT condition, frame, p AS label, min(q) AS root FROM reach GROUP BY ALL),
 ord AS (SELECT *, row_number() OVER (PARTITION BY condition, frame, root ORDER BY label) AS k, count(*) OVER (PARTITION BY condition, frame, root) AS n FROM grp),
 opt AS (SELECT condition, frame, label, prev_label, distance FROM cand UNION ALL SELECT condition, frame, label, NULL, 1e6 FROM grp),
 st(condition, frame, root, k, links, cost) AS (
   SELECT DISTINCT condition, frame, root, 0::BIGINT, []::BIGINT[], 0::DOUBLE FROM ord
   UNION ALL
   SELECT s.condition, s.frame, s.root, o.k, list_append(s.links, coalesce(c.prev_label, -1)), s.cost + c.distance
   FROM st s JOIN ord o ON o.condition = s.condition AND o.frame = s.frame AND o.root = s.root AND o.k = s.k + 1
     JOIN opt c ON c.condition = o.condition AND c.frame = o.frame AND c.label = o.label
   WHERE c.prev_label IS NULL OR NOT list_contains(s.links, c.prev_label)),
 best AS (SELECT st.condition, st.frame, st.root, arg_min(links, cost) AS links FROM st
   JOIN (SELECT DISTINCT condition, frame, root, n FROM ord) e ON e.condition = st.condition AND e.frame = st.frame AND e.root = st.root AND st.k = e.n GROUP BY ALL),
 won AS (SELECT condition, frame, root, unnest(links) AS prev_label, unnest(range(1, len(links) + 1)) AS k FROM best),
 links AS (SELECT c.condition, c.frame, c.label, c.prev_frame, c.prev_label, round(c.distance, 6) AS distance
   FROM won JOIN ord USING (condition, frame, root, k)
   JOIN cand c ON c.condition = won.condition AND c.frame = won.frame AND c.label = ord.label AND c.prev_label = won.prev_label)"""


@query("k2_optimal_links", "detections", f"{BEST_LINKS} SELECT * FROM links")
def k2_optimal_links(spark, sf_dir):
    return rounded(tr.assign_links(tr.candidate_links(views.detections(spark, sf_dir), RADIUS)))


@query("k3_track_ids", "detections", f"""{BEST_LINKS},
 chain(condition, frame, label, f0, l0) AS (
   SELECT condition, frame, label, frame, label FROM detections d ANTI JOIN links USING (condition, frame, label)
   UNION ALL SELECT l.condition, l.frame, l.label, c.f0, c.l0 FROM chain c JOIN links l ON l.condition = c.condition AND l.prev_frame = c.frame AND l.prev_label = c.label)
SELECT condition, frame, label, dense_rank() OVER (PARTITION BY condition ORDER BY f0, l0) - 1 AS track_id FROM chain""")
def k3_track_ids(spark, sf_dir):
    return tr.track(views.detections(spark, sf_dir), RADIUS).select("condition", "frame", "label", "track_id")


@query("k3_movie_tracks", "raster", f"""{MOVIE},
 r AS (SELECT condition, label, dense_rank() OVER (PARTITION BY condition ORDER BY min(frame), label) - 1 AS track_id FROM det GROUP BY condition, label)
SELECT det.condition, det.frame, det.label, track_id FROM det JOIN r USING (condition, label)""")
def k3_movie_tracks(spark, sf_dir):
    return tr.track(tr.detections(movie(spark, sf_dir)), RADIUS).select("condition", "frame", "label", "track_id")


@query("w1_sorted_tracks", "tracks", "SELECT condition, track_id, frame, label FROM tracks ORDER BY condition, track_id, frame")
def w1_sorted_tracks(spark, sf_dir):
    return views.tracks(spark, sf_dir).select("condition", "track_id", "frame", "label").orderBy("condition", "track_id", "frame")


@query("w4_heatmap_rows", "tracks", """
SELECT condition, track_id, round(avg(mean_intensity), 6) AS mean_intensity FROM tracks GROUP BY ALL""")
def w4_heatmap_rows(spark, sf_dir):
    return rounded(tr.heatmap_rows(views.tracks(spark, sf_dir)))


@query("k4_lineage", "tracks", LIN.replace(" nodes AS", " nodes AS", 1) + """
SELECT condition, frame, track_id, parent_id, root_id, generation, is_division FROM fl""")
def k4_lineage(spark, sf_dir):
    return tr.with_lineage(views.tracks(spark, sf_dir)).select(
        "condition", "frame", "track_id", "parent_id", "root_id", "generation", "is_division")


@query("k5_lineage_nodes", "tracks", """
 nodes AS (SELECT DISTINCT condition, track_id, parent_id FROM tracks),
 ch AS (SELECT condition, parent_id AS track_id, string_agg(track_id, ',' ORDER BY track_id) AS children, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL)
SELECT condition, track_id, nodes.parent_id, coalesce(children, '') AS children, coalesce(n, 0) > 1 AS is_division FROM nodes LEFT JOIN ch USING (condition, track_id)""")
def k5_lineage_nodes(spark, sf_dir):
    return tr.lineage_nodes(views.tracks(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


@query("k6_track_paths", "tracks", """
SELECT condition, track_id, count(*) AS n_points, string_agg(frame || ':' || round(cy)::BIGINT || ':' || round(cx)::BIGINT, ' ' ORDER BY frame) AS path FROM tracks GROUP BY ALL""")
def k6_track_paths(spark, sf_dir):
    text = F.transform("path", lambda q: F.concat_ws(
        ":", q["frame"], F.round(q["cy"]).cast("bigint"), F.round(q["cx"]).cast("bigint")))
    return tr.track_paths(views.tracks(spark, sf_dir)).select(
        "condition", "track_id", F.size("path").cast("bigint").alias("n_points"), F.array_join(text, " ").alias("path"))


@query("k7_track_ctcf", "raster", f"""{MOVIE},
 bg AS (SELECT condition, frame, median(value::DOUBLE) FILTER (label = 0) AS background FROM movie GROUP BY ALL),
 st AS (SELECT condition, frame, label, count(*) AS area, sum(value)::DOUBLE AS int_den, avg(value) AS mean FROM movie WHERE label > 0 GROUP BY ALL),
 tk AS (SELECT condition, frame, CASE WHEN label % 5 = 2 THEN label + 1000 ELSE label END AS label, label::BIGINT AS track_id, CAST(trunc(cy) AS INT) AS y, CAST(trunc(cx) AS INT) AS x FROM det),
 fd AS (SELECT tk.condition, tk.frame, tk.track_id, coalesce(o.label, m.label) AS label
        FROM tk LEFT JOIN st o ON o.condition = tk.condition AND o.frame = tk.frame AND o.label = tk.label
        LEFT JOIN movie m ON m.condition = tk.condition AND m.frame = tk.frame AND m.y = tk.y AND m.x = tk.x)
SELECT condition, frame, track_id, label, 'A' AS marker, area, int_den, round(mean, 6) AS mean, background,
       round(greatest(0, int_den - area * background), 6) AS ctcf
FROM fd JOIN st USING (condition, frame, label) JOIN bg USING (condition, frame)""")
def k7_track_ctcf(spark, sf_dir):
    px = movie(spark, sf_dir).withColumn("marker", F.lit("A"))
    tracks = tr.detections(movie(spark, sf_dir)).withColumn("track_id", F.col("label").cast("bigint")).withColumn(
        "label", F.when(F.col("label") % 5 == 2, F.col("label") + 1000).otherwise(F.col("label")))
    return rounded(tr.track_ctcf(tracks, px).select(
        "condition", "frame", "track_id", "label", "marker", "area", "int_den", "mean", "background", "ctcf"))


@query("j6_fallback_lookup", "raster", f"""{MOVIE},
 tk AS (SELECT condition, frame, CASE WHEN label % 4 = 1 THEN label + 1000 ELSE label END AS label, label AS track_id, CAST(trunc(cy) AS INT) AS y, CAST(trunc(cx) AS INT) AS x FROM det)
SELECT tk.condition, tk.frame, track_id, CASE WHEN tk.label > 1000 THEN m.label ELSE tk.label END AS label
FROM tk JOIN movie m ON m.condition = tk.condition AND m.frame = tk.frame AND m.y = tk.y AND m.x = tk.x""")
def j6_fallback_lookup(spark, sf_dir):
    px = movie(spark, sf_dir).withColumn("marker", F.lit("A"))
    tracks = tr.detections(movie(spark, sf_dir)).withColumn("track_id", F.col("label")).withColumn(
        "label", F.when(F.col("label") % 4 == 1, F.col("label") + 1000).otherwise(F.col("label")))
    return tr.track_ctcf(tracks, px).select("condition", "frame", "track_id", "label")


@query("k8_cells_per_frame", "tracks", "SELECT condition, frame, count(DISTINCT track_id) AS n_cells FROM tracks GROUP BY ALL")
def k8_cells_per_frame(spark, sf_dir):
    return tr.cells_per_frame(views.tracks(spark, sf_dir))


@query("k9_divisions_per_frame", "tracks", LIN + "SELECT condition, frame, count(*) AS n_divisions FROM fl WHERE is_division GROUP BY ALL")
def k9_divisions_per_frame(spark, sf_dir):
    return tr.divisions(tr.with_lineage(views.tracks(spark, sf_dir)))


@query("k9_divisions_per_condition", "tracks", LIN + "SELECT condition, count(*) AS n_divisions FROM fl WHERE is_division GROUP BY ALL")
def k9_divisions_per_condition(spark, sf_dir):
    return tr.divisions(tr.with_lineage(views.tracks(spark, sf_dir)), ["condition"])


@query("k10_intensity_by_frame", "tracks", "SELECT condition, frame, round(avg(mean_intensity), 6) AS mean_intensity FROM tracks GROUP BY ALL")
def k10_intensity_by_frame(spark, sf_dir):
    return rounded(tr.intensity_by_frame(views.tracks(spark, sf_dir)))


@query("k11_peak_intensity", "tracks", "SELECT condition, track_id, max(mean_intensity) AS peak_intensity FROM tracks GROUP BY ALL")
def k11_peak_intensity(spark, sf_dir):
    return tr.peak_intensity(views.tracks(spark, sf_dir))


@query("k12_intensity_matrix", "tracks", "SELECT condition, track_id, " + ", ".join(
    f"round(avg(mean_intensity) FILTER (frame = {f}), 6) AS f{f}" for f in range(30)) + " FROM tracks GROUP BY ALL")
def k12_intensity_matrix(spark, sf_dir):
    tracks = views.tracks(spark, sf_dir)
    last = tracks.agg(F.max("frame")).first()[0]
    return rounded(tr.intensity_matrix(tracks, range((last if last is not None else -1) + 1)))


@query("k12_intensity_long", "tracks", "SELECT condition, track_id, frame, round(avg(mean_intensity), 6) AS mean_intensity FROM tracks GROUP BY ALL")
def k12_intensity_long(spark, sf_dir):
    return rounded(tr.intensity_long(views.tracks(spark, sf_dir)))


@query("k13_run_summary", "tracks", """
SELECT condition, count(DISTINCT frame) AS n_frames, count(DISTINCT track_id) AS n_tracks,
       count(DISTINCT track_id) FILTER (parent_id IS NOT NULL) AS n_divisions FROM tracks GROUP BY ALL""")
def k13_run_summary(spark, sf_dir):
    return tr.run_summary(views.tracks(spark, sf_dir))


@query("k14_traces", "tracks", LIN + "SELECT condition, track_id, frame, mean_intensity, is_division FROM fl")
def k14_traces(spark, sf_dir):
    return tr.traces(tr.with_lineage(views.tracks(spark, sf_dir)))


@query("k15_track_colours", "tracks", """
SELECT DISTINCT track_id, CAST((track_id*67+13) % 256 AS INT) AS r, CAST((track_id*137+43) % 256 AS INT) AS g, CAST((track_id*209+97) % 256 AS INT) AS b FROM tracks""")
def k15_track_colours(spark, sf_dir):
    return p.label_colours(views.tracks(spark, sf_dir).select("track_id").distinct(), "track_id")


@query("u3_track_listing", "tracks", """
SELECT condition, count(DISTINCT track_id) AS n_tracks, string_agg(DISTINCT frame, ',' ORDER BY frame) AS frames FROM tracks GROUP BY condition""")
def u3_track_listing(spark, sf_dir):
    return tr.frame_listing(views.tracks(spark, sf_dir)).withColumn("frames", F.array_join("frames", ","))
