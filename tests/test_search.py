"""Totals of a period are whole: every group comes out, however many there are."""

from __future__ import annotations

import datetime as dt

from gleanwright.operators import search


def test_bulk_totals_of_every_group(spark):
    data = [(f"q{n}", n, n + 1, 2.0, "2024-05-01") for n in range(1500)] + [("q7", 1, 4, 7.0, "2024-05-02"), ("q7", 1, 4, 7.0, "2025-01-01")]
    rows = spark.createDataFrame(data, "query string, clicks long, impressions long, position double, day string").selectExpr("* except(day)", "to_date(day) AS day")
    columns = {n: n for n in ("clicks", "impressions", "position", "day")}
    got = search.bulk_totals(spark, rows, ["query"], columns, dt.date(2024, 1, 1), dt.date(2024, 12, 31), offset=0).collect()
    assert len(got) == 1500
    assert sum(r.impressions for r in got) == sum(range(1, 1501)) + 4
    assert [r.impressions for r in got] == sorted((r.impressions for r in got), reverse=True)
    held = {r["query"]: r for r in got}["q7"]
    assert (held.clicks, held.impressions, held.average_position) == (8, 12, (2.0 * 8 + 7.0 * 4) / 12)
