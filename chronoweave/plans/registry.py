"""All registered queries and their SQL."""

from __future__ import annotations

from chronoweave.plans import array_queries, metric_queries, recording_queries, report_queries, series_queries, stream_queries, tracking_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (series_queries, recording_queries, metric_queries, array_queries, tracking_queries, report_queries, stream_queries):
    QUERIES.update(module.QUERIES)
    # The SQL side rounds like functions.columns.rounded: halves go up whatever the summation order.
    ORACLES.update({name: sql.replace(", 6)", " + 2.7e-10, 6)") for name, sql in module.ORACLES.items()})
