"""Linking detections through time, lineage and per-track measurements.

Frame-to-frame linking is independent between frame pairs, so it is one equi-join on grid
buckets, a component split, and a small assignment problem per component.  Identities then
spread along the links by connected components, in O(log^2) rounds rather than frame by frame.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlab.functions.graph import connected_components
from rasterlab.functions.grouped import stream_choose
from rasterlab.functions.order import positions
from rasterlab.operators.background import legacy_background
from rasterlab.operators.cells import add_ctcf, label_stats
from rasterlab.operators.tables import labels_at
from rasterlab.session import cut_lineage

FRAME = ("condition", "frame")
UNLINKED_COST = 1e6  # fixed value: cost of leaving a cell without a predecessor


def detections(px: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Label, centroid, area and mean intensity of every cell in every frame."""
    return px.where("label > 0").groupBy(*keys, "label").agg(
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("area"),
        F.avg(F.col("value").cast("double")).alias("mean_intensity"))


def previous_frames(det: DataFrame) -> DataFrame:
    """Each frame with detections and the last one before it that has any (empty frames are bridged)."""
    frames = det.select("condition", "frame").distinct()
    return frames.withColumn("prev_frame", F.lag("frame").over(Window.partitionBy("condition").orderBy("frame")))


def candidate_links(det: DataFrame, radius: float) -> DataFrame:
    """Pairs of detections in consecutive frames closer than ``radius``.

    Detections meet through grid buckets of the radius: each looks into the 3 x 3 buckets
    around it, which is complete because no closer pair can lie further apart.
    """
    gy, gx = F.floor(F.col("cy") / radius), F.floor(F.col("cx") / radius)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    now = (
        det.join(previous_frames(det).where("prev_frame is not null"), ["condition", "frame"])
        .select("condition", "frame", "prev_frame", "label", "cy", "cx", gy.alias("_gy"), gx.alias("_gx"),
                F.explode(steps).alias("_s"))
        .withColumns({"_gy": F.col("_gy") + F.col("_s.a"), "_gx": F.col("_gx") + F.col("_s.b")}).drop("_s")
    )
    before = det.select(
        "condition", F.col("frame").alias("prev_frame"), F.col("label").alias("prev_label"),
        F.col("cy").alias("_py"), F.col("cx").alias("_px"), gy.alias("_gy"), gx.alias("_gx"))
    dy, dx = F.col("cy") - F.col("_py"), F.col("cx") - F.col("_px")
    return (
        now.join(before, ["condition", "prev_frame", "_gy", "_gx"])
        .withColumn("distance", F.sqrt(dy * dy + dx * dx))
        .where(F.col("distance") < radius)
        .select("condition", "frame", "prev_frame", "label", "prev_label", "distance")
    )


def cheapest_links(pairs: Sequence[tuple]) -> list[tuple]:
    """Optimal assignment of one component: the chosen (row, column) of ``pairs`` (row, column, cost).

    Every row may also stay unlinked at :data:`UNLINKED_COST`.  Rows enter one at a time along a
    shortest augmenting path over the listed pairs only, so memory follows their number.
    """
    options: dict = {}
    for r, c, d in pairs:
        options.setdefault(r, [(("unlinked", r), UNLINKED_COST)]).append((("column", c), d))
    row_price = dict.fromkeys(options, 0.0)
    col_price: dict = {}
    row_of: dict = {}
    col_of: dict = {}
    for start in options:
        reach, came_from, settled, heap = {}, {}, {}, []
        row, so_far = start, 0.0
        while True:
            for c, d in options[row]:
                if c not in settled:
                    total = so_far + d - row_price[row] - col_price.get(c, 0.0)
                    if total < reach.get(c, float("inf")):
                        reach[c], came_from[c] = total, row
                        heapq.heappush(heap, (total, len(reach), c))
            so_far, _, c = heapq.heappop(heap)
            while c in settled or so_far > reach[c]:
                so_far, _, c = heapq.heappop(heap)
            if c not in row_of:
                break
            settled[c] = so_far
            row = row_of[c]
        for col, at in settled.items():
            row_price[row_of[col]] += so_far - at
            col_price[col] = col_price.get(col, 0.0) - (so_far - at)
        row_price[start] += so_far
        while True:  # hand the columns back along the path
            row = came_from[c]
            row_of[c] = row
            c, col_of[row] = col_of.get(row), c
            if row == start:
                break
    return [(r, c[1]) for r, c in col_of.items() if c[0] == "column"]


def assign_links(candidates: DataFrame) -> DataFrame:
    """One-to-one links with the most pairs, then the least total distance, per pair of frames.

    Pairs without a rival are taken as they are.  The rest split into connected components of
    the candidate graph, which are independent problems: detections further apart than the
    radius never compete.
    """
    keys = ["condition", "frame"]
    by_cell = candidates.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_d1"))
    by_prev = candidates.groupBy(*keys, "prev_label").agg(F.count(F.lit(1)).alias("_d2"))
    rated = candidates.join(by_cell, [*keys, "label"]).join(by_prev, [*keys, "prev_label"])
    lone = (F.col("_d1") == 1) & (F.col("_d2") == 1)
    out = ["condition", "frame", "label", "prev_frame", "prev_label", "distance"]
    alone = rated.where(lone).select(*out)
    rivals = rated.where(~lone)

    # cells take the even numbers, previous cells the odd ones
    cell, previous = 2 * F.col("label"), 2 * F.col("prev_label") + 1
    graph = connected_components(
        rivals.select(*keys, cell.alias("src"), previous.alias("dst")), keys, "src", "dst")
    roots = graph.select(*keys, F.col("node").alias("_node"), "root")
    grouped = rivals.withColumn("_node", cell).join(roots, [*keys, "_node"], "left").withColumn(
        "_root", F.coalesce("root", "_node")).drop("root", "_node", "_d1", "_d2")

    def solve(pairs: list[tuple]) -> list[int]:
        at = {(cell, previous): i for i, (cell, previous, _) in enumerate(pairs)}
        return sorted(at[link] for link in cheapest_links(pairs))

    linked = stream_choose(grouped, [*keys, "_root"], ["label", "prev_label", "distance"], solve)
    return alone.unionByName(linked.select(*out))


def track_ids(det: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``track_id``: linked detections share the id of their first one.

    Ids count from 0 per condition in order of the first detection's (frame, label).
    """
    # (frame, label) as one number; what does not fit is refused, as it would meet another one
    def node(frame: str, label: str):
        fits = F.col(frame).between(0, 2**23 - 1) & F.col(label).between(0, 2**40 - 1)
        code = F.shiftleft(F.col(frame).cast("bigint"), 40) + F.col(label)
        return F.when(fits | F.col(frame).isNull() | F.col(label).isNull(), code).otherwise(
            F.raise_error(F.format_string("frame %d, label %d: frames must be below 2^23, labels below 2^40", frame, label)))

    roots = connected_components(
        links.select("condition", node("frame", "label").alias("src"), node("prev_frame", "prev_label").alias("dst")),
        ["condition"], "src", "dst")
    placed = det.withColumn("_node", node("frame", "label")).join(
        roots.withColumnRenamed("node", "_node"), ["condition", "_node"], "left"
    ).withColumn("_root", F.coalesce("root", "_node")).drop("root", "_node")
    order = positions(placed, ["condition"], "_root").select("condition", "_root", F.col("_rank0").alias("track_id"))
    return placed.join(order, ["condition", "_root"]).drop("_root")


def track(det: DataFrame, radius: float = 50) -> DataFrame:
    """Tracks of a detection table: adds ``track_id``, and no parents (this linker sees no divisions)."""
    links = cut_lineage(assign_links(candidate_links(det, radius)))
    return track_ids(det, links).withColumn("parent_id", F.lit(None).cast("bigint"))


def lineage(tracks: DataFrame) -> DataFrame:
    """Per track: parent, root ancestor and generation (number of ancestors), by pointer doubling.

    Tracks that are their own ancestors have no root: they are named in a ValueError.
    """
    nodes = tracks.select("condition", "track_id", "parent_id").distinct()
    now = cut_lineage(nodes.select(
        "condition", "track_id", "parent_id", F.coalesce("parent_id", "track_id").alias("root_id"),
        F.col("parent_id").isNotNull().cast("int").alias("generation")))
    for _ in range(now.count().bit_length() + 1):
        far = now.select("condition", F.col("track_id").alias("root_id"), F.col("root_id").alias("_r"),
                         F.col("generation").alias("_g"))
        nxt = cut_lineage(now.join(far, ["condition", "root_id"], "left").select(
            "condition", "track_id", "parent_id", F.coalesce("_r", "root_id").alias("root_id"),
            (F.col("generation") + F.coalesce("_g", F.lit(0))).alias("generation")))
        moved = now.select("condition", "track_id", F.col("root_id").alias("_was")).join(
            nxt, ["condition", "track_id"]).where("_was <> root_id")
        now = nxt
        if moved.isEmpty():
            break
    # a root with a parent among the tracks lies on a cycle
    parents = nodes.where("parent_id is not null").select("condition", F.col("track_id").alias("root_id")).distinct()
    cyclic = now.join(parents, ["condition", "root_id"], "left_semi").select("condition", "track_id").orderBy("condition", "track_id")
    found = cyclic.limit(5).collect()
    if found:
        raise ValueError(f"tracks that are their own ancestors: {[tuple(r) for r in found]}")
    return now


def with_lineage(tracks: DataFrame) -> DataFrame:
    """Adds ``root_id``, ``generation`` and ``is_division`` (first frame of a daughter)."""
    first = tracks.groupBy("condition", "track_id").agg(F.min("frame").alias("_first"))
    return (
        tracks.join(lineage(tracks).drop("parent_id"), ["condition", "track_id"]).join(first, ["condition", "track_id"])
        .withColumn("is_division", F.col("parent_id").isNotNull() & (F.col("frame") == F.col("_first"))).drop("_first")
    )


def lineage_nodes(tracks: DataFrame) -> DataFrame:
    """Per track: parent, sorted children, and whether it divides (more than one child)."""
    nodes = tracks.select("condition", "track_id", "parent_id").distinct()
    children = nodes.where("parent_id is not null").groupBy("condition", F.col("parent_id").alias("track_id")).agg(
        F.array_sort(F.collect_list(F.col("track_id"))).alias("children"))
    return nodes.join(children, ["condition", "track_id"], "left").select(
        "condition", "track_id", "parent_id", F.coalesce("children", F.array().cast("array<bigint>")).alias("children")
    ).withColumn("is_division", F.size("children") > 1)


def track_paths(tracks: DataFrame) -> DataFrame:
    """Ordered (frame, cy, cx) positions of every track."""
    return tracks.groupBy("condition", "track_id").agg(
        F.array_sort(F.collect_list(F.struct("frame", "cy", "cx"))).alias("path"))


def track_ctcf(tracks: DataFrame, px: DataFrame, method: str = "median") -> DataFrame:
    """CTCF per track, frame and marker, with the older background estimate of each frame.

    A track row finds its cell by label, else by the label under its centroid.
    """
    frame_keys = ["condition", "frame", "marker"]
    measured = label_stats(px, frame_keys).join(legacy_background(px, frame_keys, method), frame_keys)
    measured = add_ctcf(measured).select(*frame_keys, "label", "area", "int_den", "mean", "background", "ctcf")
    one_marker = px.where("label > 0").select("condition", "frame", "label").distinct().withColumn("_own", F.lit(True))
    by_label = tracks.drop("area", "mean_intensity").join(one_marker, ["condition", "frame", "label"], "left")
    # truncation toward zero, as array indices are taken
    spots = by_label.where("_own is null").select(
        "condition", "frame", "track_id", F.col("cy").cast("int").alias("y"), F.col("cx").cast("int").alias("x"))
    mask = px.select("condition", "frame", "y", "x", "label").distinct()
    under = labels_at(mask, spots, FRAME).select(
        "condition", "frame", "track_id", F.col("label").alias("_under"))
    found = by_label.join(under, ["condition", "frame", "track_id"], "left").withColumn(
        "label", F.when(F.col("_own"), F.col("label")).otherwise(F.col("_under"))).where("label > 0").drop("_own", "_under")
    return found.join(measured, ["condition", "frame", "label"])


def cells_per_frame(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("condition", "frame").agg(F.countDistinct("track_id").alias("n_cells"))


def divisions(flagged: DataFrame, by: Sequence[str] = ("condition", "frame")) -> DataFrame:
    """Division events per frame (or per condition) of tracks with ``is_division``."""
    return flagged.where("is_division").groupBy(*by).agg(F.count(F.lit(1)).alias("n_divisions"))


def intensity_by_frame(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("condition", "frame").agg(F.avg("mean_intensity").alias("mean_intensity"))


def peak_intensity(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("condition", "track_id").agg(F.max("mean_intensity").alias("peak_intensity"))


def intensity_matrix(tracks: DataFrame, frames: Sequence[int]) -> DataFrame:
    """Track x frame matrix of mean intensity, one column per listed frame."""
    aggs = [F.avg(F.when(F.col("frame") == f, F.col("mean_intensity"))).alias(f"f{f}") for f in frames]
    return tracks.groupBy("condition", "track_id").agg(*aggs)


def intensity_long(tracks: DataFrame) -> DataFrame:
    """The same in long form: a row for each track and frame."""
    return tracks.groupBy("condition", "track_id", "frame").agg(F.avg("mean_intensity").alias("mean_intensity"))


def heatmap_rows(tracks: DataFrame) -> DataFrame:
    """Tracks from brightest to dimmest; a range-partitioned sort."""
    return tracks.groupBy("condition", "track_id").agg(
        F.avg("mean_intensity").alias("mean_intensity")).orderBy(F.desc("mean_intensity"), "condition", "track_id")


def run_summary(tracks: DataFrame) -> DataFrame:
    """Frames, tracks and divisions per condition."""
    daughters = F.countDistinct(F.when(F.col("parent_id").isNotNull(), F.col("track_id")))
    return tracks.groupBy("condition").agg(
        F.countDistinct("frame").alias("n_frames"), F.countDistinct("track_id").alias("n_tracks"),
        daughters.alias("n_divisions"))


def traces(flagged: DataFrame) -> DataFrame:
    """Intensity traces ordered by track and frame, with division markers."""
    return flagged.select("condition", "track_id", "frame", "mean_intensity", "is_division").orderBy(
        "condition", "track_id", "frame")


def frame_listing(tracks: DataFrame) -> DataFrame:
    """Distinct tracks and the sorted frame list per condition."""
    return tracks.groupBy("condition").agg(
        F.countDistinct("track_id").alias("n_tracks"), F.array_sort(F.collect_set("frame")).alias("frames"))
