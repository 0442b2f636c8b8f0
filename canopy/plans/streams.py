"""Queries that also run on streams."""

from __future__ import annotations

from canopy.catalog import query
from canopy.plans.bindings import table
from canopy.streaming.watch import windowed_counts


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"))
