import itertools

import numpy as np
import pandas as pd
import pytest

from rasterlab.functions.graph import connected_components
from rasterlab.operators import tracking as tr


def frame_table(spark, rows):
    pdf = pd.DataFrame(rows, columns=["condition", "frame", "label", "cy", "cx"])
    return spark.createDataFrame(pdf.assign(area=1, mean_intensity=1.0))


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, k = rng.integers(2, 6), rng.integers(2, 6)
    a, b = rng.random((n, 2)) * 6, rng.random((k, 2)) * 6
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    pairs = [(i, j, cost[i, j]) for i in range(n) for j in range(k) if cost[i, j] < 3]
    got = tr.cheapest_links(pairs)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    total = sum(cost[i, j] for i, j in got)
    best = (0, 0.0)
    options = [[None] + [j for j in range(k) if cost[i, j] < 3] for i in range(n)]
    for choice in itertools.product(*options):
        used = [j for j in choice if j is not None]
        if len(set(used)) == len(used):
            best = max(best, (len(used), -sum(cost[i, j] for i, j in enumerate(choice) if j is not None)))
    assert len(got) == best[0] and total == pytest.approx(-best[1])


def test_tracks_bridge_empty_frames_and_end_in_others(spark):
    det = frame_table(spark, [
        ("a", 0, 1, 0.0, 0.0), ("a", 0, 2, 50.0, 50.0),
        # frame 1 is empty
        ("a", 2, 1, 1.0, 0.0),
        ("a", 3, 1, 50.0, 50.0), ("a", 3, 2, 2.0, 0.0),
    ])
    got = {(r.frame, r.label): r.track_id for r in tr.track(det, 5.0).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (2, 1): 0, (3, 2): 0, (3, 1): 2}


def test_links_are_one_to_one_and_within_reach(spark):
    rng = np.random.default_rng(1)
    rows = [("a", f, i, *rng.random(2) * 40) for f in range(4) for i in range(60)]
    links = tr.assign_links(tr.candidate_links(frame_table(spark, rows), 5.0)).toPandas()
    assert (links.distance < 5).all()
    assert not links.duplicated(["frame", "label"]).any() and not links.duplicated(["frame", "prev_label"]).any()
    pos = {(f, i): np.array([y, x]) for _, f, i, y, x in rows}
    for f in range(1, 4):
        pairs = [(i, j, float(np.linalg.norm(pos[f, i] - pos[f - 1, j]))) for i in range(60) for j in range(60)]
        whole = tr.cheapest_links([p for p in pairs if p[2] < 5])
        mine = links[links.frame == f]
        assert len(whole) == len(mine)
        assert sum(np.linalg.norm(pos[f, i] - pos[f - 1, j]) for i, j in whole) == pytest.approx(mine.distance.sum())


def test_components_of_hub_and_path(spark):
    edges = [(1, 0, i) for i in range(1, 200)] + [(2, i, i + 1) for i in range(100)] + [(3, 5, 9), (3, 9, 7)]
    df = spark.createDataFrame(edges, ["k", "a", "b"]).repartition(7)
    for few in (0, 100_000):
        got = {(r.k, r.node): r.root for r in connected_components(df, ["k"], "a", "b", few=few).collect()}
        assert got == {**{(1, i): 0 for i in range(1, 200)}, **{(2, i): 0 for i in range(1, 101)}, (3, 9): 5, (3, 7): 5}


@pytest.mark.parametrize("cycle", [[(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 2)]])
def test_cyclic_parents_are_named(spark, cycle):
    rows = [("c", t, p) for t, p in cycle] + [("c", 9, None), ("c", 10, 9)]
    df = spark.createDataFrame(rows, "condition string, track_id long, parent_id long")
    with pytest.raises(ValueError, match="own ancestors"):
        tr.lineage(df)


def test_long_chain_of_parents(spark):
    rows = [("c", t, t - 1 if t else None) for t in range(40)]
    df = spark.createDataFrame(rows, "condition string, track_id long, parent_id long")
    assert {(r.track_id, r.root_id, r.generation) for r in tr.lineage(df).collect()} == {(t, 0, t) for t in range(40)}


def test_labels_too_large_for_track_ids_are_refused(spark):
    det = frame_table(spark, [("c", 0, 1, 0.0, 0.0), ("c", 1, 2**41, 0.0, 0.0)])
    links = spark.createDataFrame([], "condition string, frame long, label long, prev_frame long, prev_label long")
    with pytest.raises(Exception, match="below 2\\^40"):
        tr.track_ids(det, links).collect()
