"""Event-time windows of a stream against the same function on a table."""

import datetime as dt
import random

import pytest

from rasterlab.streaming.windows import follow_activity, late_rows, windowed_activity

SCHEMA = "at timestamp, kind string, who long, v double"
COLUMNS = {"ts": "at", "condition": "kind", "track_id": "who", "value": "v"}
START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(
        [(r.window_start, r.window_end, r.condition or "", r.n_cells, r.n_events, None if r.mean_intensity is None else round(r.mean_intensity, 9)) for r in df.collect()],
        key=str)


def events(n, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = START + dt.timedelta(minutes=k * 3, seconds=rng.randrange(60))
        kind = rng.choice(["a", "a", "b", None])
        out.append((at, kind, rng.choice([None, *range(6)]), rng.choice([None, rng.random() * 100])))
    return out


def batches(found, spread, size, seed=4):
    """Out of order by at most ``spread`` rows, in files of ``size`` rows."""
    rng = random.Random(seed)
    order = sorted(range(len(found)), key=lambda k: k + rng.random() * spread)
    mixed = [found[k] for k in order]
    return [mixed[k : k + size] for k in range(0, len(mixed), size)]


def arrive(spark, folder, parts, first=0):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{first + k:03d}")


def follow(spark, tmp_path, **how):
    q = follow_activity(spark, f"{tmp_path}/in/*", SCHEMA, COLUMNS, f"{tmp_path}/out", f"{tmp_path}/mark", files_per_batch=1, **how)
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def as_table(spark, found, **how):
    return rows(windowed_activity(spark.createDataFrame(found, SCHEMA).selectExpr(*[f"{c} AS {n}" for n, c in COLUMNS.items()]), **how))


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_out_of_order_batches_give_the_rows_of_the_table(spark, tmp_path, slide):
    found = events(240)
    end = [(START + dt.timedelta(days=9), "end", 1, 1.0)]  # closes all windows before it
    parts = batches(found, spread=15, size=60)
    arrive(spark, f"{tmp_path}/in", [*parts[:3]])
    first = follow(spark, tmp_path, size="1 hour", slide=slide, late="2 hours")
    part = rows(spark.read.parquet(f"{tmp_path}/out"))
    # the second run goes on with the state of the first
    arrive(spark, f"{tmp_path}/in", [*parts[3:], end], first=3)
    second = follow(spark, tmp_path, size="1 hour", slide=slide, late="2 hours")
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    want = as_table(spark, found, size="1 hour", slide=slide)
    assert got == want and set(part) < set(got)
    assert late_rows(first) == late_rows(second) == 0


def test_late_rows_are_counted(spark, tmp_path):
    found = events(100)
    far = [(START + dt.timedelta(hours=50), "far", 1, 1.0)]
    late = [(START + dt.timedelta(minutes=5), "a", 77, 5.0), (START + dt.timedelta(minutes=70), "b", 78, 5.0)]
    end = [(START + dt.timedelta(days=9), "end", 1, 1.0)]
    arrive(spark, f"{tmp_path}/in", [found, far, late, end])
    q = follow(spark, tmp_path, size="1 hour", late="10 minutes")
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == as_table(spark, [*found, *far], size="1 hour")
    assert late_rows(q) == 2


def test_rows_without_a_time(spark):
    found = [(None, "a", 1, 1.0), (START, None, None, None), (START, None, 3, 4.0)]
    assert as_table(spark, found, size="1 hour") == [(START, START + dt.timedelta(hours=1), "", 1, 2, 4.0)]
    assert as_table(spark, [], size="1 hour") == []
    with pytest.raises(ValueError):
        windowed_activity(spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "value AS track_id", "value", "'c' AS condition"), "1 hour")
