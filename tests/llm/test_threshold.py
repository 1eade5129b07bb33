"""The threshold of op4 is placed by both labels."""

import itertools
import random

import pytest

from rasterlab.llm import quality

WORDS = ["".join(w) for w in itertools.product("bdf", "aeiou")]


def text(rng, n, junk):
    """``n`` words, some of them junk."""
    drawn = [rng.choice(["&&&", "%%%", "###"]) for _ in range(junk)] + [rng.choice(WORDS) for _ in range(n - junk)]
    rng.shuffle(drawn)
    return " ".join(drawn)


def brute_cut(good, bad, lost):
    cuts = [c for c in sorted({*good, *bad}) if sum(g < c for g in good) <= int(lost * len(good))]
    return min(cuts, key=lambda c: (sum(g < c for g in good) + sum(b >= c for b in bad), c)) if good else None


@pytest.mark.parametrize("lost", [0.0, 0.02, 0.3])
def test_best_cut(spark, lost):
    rng = random.Random(3)
    good, bad = [round(rng.gauss(1, 1), 2) for _ in range(300)], [round(rng.gauss(-1, 1), 2) for _ in range(100)]
    df = spark.createDataFrame([(g, True) for g in good] + [(b, False) for b in bad], "s double, good boolean")
    assert quality.best_cut(df, lost, slices=7).first().s == brute_cut(good, bad, lost)
    only_good = quality.best_cut(df.where("good"), lost, slices=7).first().s
    assert only_good == max(c for c in good if sum(g < c for g in good) <= int(lost * len(good)))
    assert quality.best_cut(df.where("not good"), lost).first().s is None


def test_junk_goes_and_trusted_documents_stay(spark):
    rng = random.Random(5)
    rows = [(k, text(rng, 400, 0), 1) for k in range(200)] + [(200 + k, text(rng, 400, 4), 0) for k in range(60)]
    rows += [(300 + k, text(rng, 400, 0), None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r for r in quality.judge_quality(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()}
    assert not any(r.base_failed for r in got.values())
    kept = lambda q: [got[i].kept for i, _, x in rows if x == q]
    assert sum(kept(0)) <= 3 and sum(kept(1)) >= 198


def test_all_labelled_rows_outside_the_sample_count(spark):
    """Trusted documents of another kind that no small sample has; toxic ones are trusted."""
    rng = random.Random(7)
    rows = [(k, text(rng, 400, 0), 1, 0) for k in range(300)] + [(300 + k, text(rng, 400, 3), 1, 1) for k in range(30)]
    rows += [(400 + k, text(rng, 400, 80), 0, 0) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = df.select("doc_id", "quality", "toxic")
    got = {r.doc_id: r.kept for r in quality.judge_quality(df.select("doc_id", "text"), labels, trusted_rows=6).collect()}
    assert all(got[i] == (q == 1) for i, _, q, _ in rows)
