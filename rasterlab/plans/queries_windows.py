"""Cells and intensity per event-time window of the events table."""

from __future__ import annotations

from rasterlab.plans import views
from rasterlab.plans.registry import query, rounded
from rasterlab.streaming.windows import windowed_activity

#: What of an event is its condition, its track and its intensity.
EVENT = {"ts": "ts", "condition": "event_type", "track_id": "user_id", "value": "value"}
_FIGURES = "count(DISTINCT user_id) AS n_cells, count(*) AS n_events, round(round(sum(value), 9) / count(value), 6) AS mean_intensity"


def events(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(*[f"{c} AS {name}" for name, c in EVENT.items()])


@query("k8_k10_windows", "", f"""
SELECT time_bucket(INTERVAL 6 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS window_start, window_start + INTERVAL 6 HOURS AS window_end, event_type AS condition, {_FIGURES}
FROM events GROUP BY ALL""")
def k8_k10_windows(spark, sf_dir):
    return rounded(windowed_activity(events(spark, sf_dir), "6 hours"))


@query("k8_k10_sliding_windows", "", f"""
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type AS condition, {_FIGURES}
FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - unnest(range(4)) * INTERVAL 6 HOURS AS window_start FROM events)
GROUP BY ALL""")
def k8_k10_sliding_windows(spark, sf_dir):
    return rounded(windowed_activity(events(spark, sf_dir), "1 day", "6 hours"))
