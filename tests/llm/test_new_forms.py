"""Fill-in-the-middle, toxicity and clustering: odd rows, exact round trips, held-out accuracy."""

import random

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.test_edges import FIELDS, TEXTS, table

from rasterlab.llm import centroid_clusters, fill_middle, toxicity

rng = random.Random(11)


@pytest.fixture(scope="module")
def odd(spark):
    more = [(None, "a b c"), (1, TEXTS[0][1]), (1, TEXTS[0][1]), (20, "x <S> y"), (21, "<"), (22, " lead and trail \n"), (23, "a<P"), (24, "S>b <"), (25, "\x1c \x85 é z")]
    more += [(100 + k, "".join(rng.choices(" \n\t<PSM>ab é", k=rng.randint(1, 40)))) for k in range(200)]
    return [*TEXTS, *more]


def test_middle_of_odd_texts(spark, odd):
    out = fill_middle.fill_in_middle(table(spark, odd))
    back = fill_middle.restored(out["fim_text"], out["form"]).alias("back")
    rows = out.select("*", back).collect()
    assert set(FIELDS.names) - {"n"} <= set(out.columns) and len(rows) == len(odd)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[1] is None)
    for r, (i, t) in zip(sorted(rows, key=lambda r: key((r.doc_id, r.text))), sorted(odd, key=key)):
        assert (r.doc_id, r.text) == (i, t) and r.back == (t or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == brute.fill_in_middle(i, t)
    assert fill_middle.fill_in_middle(table(spark, [])).collect() == []


def test_one_match_of_a_very_long_text(spark):
    long = "word  \n" * 400_000
    rows = fill_middle.fill_in_middle(spark.createDataFrame([(k, long) for k in range(3)], "doc_id long, text string")).collect()
    assert [(r.n, r.fim_text) for r in sorted(rows)] == [(brute.fill_in_middle(k, long)[0], brute.fill_in_middle(k, long)[4]) for k in range(3)]


def prose(n):
    return " ".join("".join(rng.choices(["ba", "no", "ri", "tu", "ke", "sol"], k=rng.randint(1, 4))) for _ in range(n))


def test_toxicity_on_held_out_documents(spark):
    bad = ["wretch", "vermin", "cretin"]
    texts, labels = [], []
    for k in range(600):
        words = prose(rng.randint(80, 160)).split()
        for _ in range(6 if k % 4 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    texts += [(1000, None), (1001, ""), (None, "vermin cretin wretch " * 20), (1002, "cretin " * 30_000)]
    docs = spark.createDataFrame([(*x, "own") for x in texts], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, marks).collect()
    assert len(rows) == len(texts)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    caught = np.mean([r.predicted for r in held if r.doc_id % 4 == 0])
    false = np.mean([r.predicted for r in held if r.doc_id % 4])
    assert caught >= 0.9 and false <= 0.05, (caught, false)
    by = {r.doc_id: r for r in rows}
    assert by[1000].predicted == by[1001].predicted == 0 and by[1000].score == by[1001].score
    assert by[None].held_out and by[None].predicted == 1 and by[1002].predicted == 1


def test_toxicity_without_labels(spark, odd):
    docs = table(spark, odd)
    for marks in ([], [(1, 1)], [(1, 0), (2, 0)]):
        rows = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
        assert len(rows) == len(odd) and all(r.score == 0 and r.predicted == 0 for r in rows)
    few = toxicity.score_toxicity(docs, spark.createDataFrame([(1, 1), (2, 0), (7, 0), (11, 1)], "doc_id long, toxic int"))
    assert few.count() == len(odd) and set(FIELDS.names) - {"score"} <= set(few.columns)
    assert toxicity.score_toxicity(table(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "own", "own") for i, v in rows], "vec_id long, embedding array<float>, cluster string, _row string")


def test_clusters_with_ties_and_odd_rows(spark):
    good = [(k, [float(x) for x in np.random.default_rng(k % 90).integers(-3, 4, 64) / 64]) for k in range(300)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [1.0] * 63 + [float("-inf")])]
    out = centroid_clusters.cluster_vectors(vectors(spark, good + bad))
    got = {r.vec_id: (r["cluster"], r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()}
    assert got == brute.clusters(good) and {"_row", "vec_id"} <= set(out.columns)


def test_few_vectors(spark):
    two = [(4, [0.5] * 64), (9, [-0.25] * 64)]
    got = {r.vec_id: (r["cluster"], r.distance) for r in centroid_clusters.cluster_vectors(vectors(spark, two * 3)).collect()}
    assert {d for _, d in got.values()} == {0}
    one = centroid_clusters.cluster_vectors(vectors(spark, [(4, [0.5] * 64), (None, [0.5] * 64)])).collect()
    assert {r.vec_id for r in one} == {4, None} and {(r["cluster"], r.distance) for r in one} == {(0, 0)}
    for none in ([], [(1, None)]):
        empty = centroid_clusters.cluster_vectors(vectors(spark, none))
        assert empty.collect() == [] and empty.columns[-5:] == ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        centroid_clusters.cluster_vectors(vectors(spark, [(4, [3e38] * 64)])).collect()


def test_bounds_spare_comparisons():
    """The search gives what comparing everything gives, and later rounds compare fewer vectors."""
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(c, 6, (400, 8)) for c in g.uniform(-300, 300, (12, 8))]).round().astype(np.int64)
    at, before = x[g.permutation(len(x))[:12]], None
    a, b = np.zeros(len(x), int), np.ones(len(x), int)
    upper, lower, compared = np.full(len(x), np.inf), np.full(len(x), -np.inf), []
    for _ in range(6):
        a, b, upper, lower, n = centroid_clusters.Centroids(at, before).assign(x, a, b, upper, lower)
        compared.append(n)
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (a == d.argmin(1)).all()
        assert (upper * (1 + 1e-9) + 1e-9 >= np.sqrt(d.min(1))).all()
        assert (lower * (1 - 1e-9) - 1e-9 <= np.sqrt(np.where(np.arange(12) == a[:, None], 10**12, d).min(1))).all()
        before, at = at, np.array([x[a == c].sum(0) // max((a == c).sum(), 1) if (a == c).any() else at[c] for c in range(12)])
    assert compared[0] >= len(x) - 12 and compared[-1] < len(x) / 2


def test_names_of_candidates_are_written(spark, monkeypatch):
    """The texts are joined with a table of known size, so that they need no shuffle while it is small."""
    from rasterlab.llm import near_dedup

    seen, cut = [], near_dedup.cut_lineage
    monkeypatch.setattr(near_dedup, "cut_lineage", lambda df: (seen.append(df.columns), cut(df))[1])
    docs = spark.createDataFrame([(0, "one two three four five six"), (1, "one two three four five six"), (2, "other words")], "doc_id long, text string")
    rows = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_groups(docs, shingle=2).collect()}
    assert rows == {0: 0, 1: 0, 2: 2} and ["_doc"] in seen


def test_equal_buckets_are_compared_once(spark):
    """Buckets of the same members in several tables: the first table's stays, so the first table of each pair does."""
    from rasterlab.llm import near_dedup

    members = {(10, 5): (1, 2, 3), (11, 2): (1, 2, 3), (12, 9): (1, 2, 3), (13, 0): (1, 2, 4), (14, 3): (1, 2), (15, 7): (1, 2, 3, 4), (16, 8): (9,)}
    keyed = spark.createDataFrame([(k, n, u) for (k, n), us in members.items() for u in us], "key long, number int, u long")
    buckets = near_dedup._buckets(keyed)
    assert {r.key for r in buckets.collect()} == {10, 11, 12, 13, 14, 15}
    kept = {}
    for r in near_dedup._crowded(buckets).collect():
        kept.setdefault((r.key, r.number), set()).add(r.u)
    assert kept == {k: set(members[k]) for k in ((11, 2), (13, 0), (15, 7))}


def test_sets_know_their_center_and_signatures_share_a_bucket(spark, monkeypatch):
    """Full sets are moved by name once, and only signatures of documents that share a bucket are moved on."""
    from rasterlab.llm import near_dedup

    seen, cut = {}, near_dedup.cut_lineage
    monkeypatch.setattr(near_dedup, "cut_lineage", lambda df: seen.setdefault(tuple(df.columns), cut(df)))
    words = prose(60).split()
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), prose(60), " ".join(words)]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicate_groups(docs, shingle=2).collect()) == [(0, 0), (1, 0), (1, 0), (2, 2), (3, 0)]
    assert seen["u", "sig", "cells", "n"].count() == 2
    sets = seen["doc", "set", "v", "own"].collect()
    (center,) = [r.doc for r in sets if r.own]
    assert len(sets) == 2 and [r.v for r in sets if r.doc != center] == [center]
