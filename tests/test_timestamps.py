from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanwright.operators import timestamps as t

UTC = dt.timezone.utc


def micros(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


FEEDS = [("b", "Europe/Berlin", "DMY"), ("n", "America/New_York", "MDY"), ("u", None, "DMY")]
CASES = [
    ("2024-05-01T10:00:00Z", None, micros(2024, 5, 1, 10)), ("2024-05-01T10:00:00+02:00", "n", micros(2024, 5, 1, 8)), ("2024-05-01 10:00:00 +0545", None, micros(2024, 5, 1, 4, 15)),
    ("2024-05-01T10:00", "b", micros(2024, 5, 1, 8)), ("  2024-05-01 10:00:00 ", "n", micros(2024, 5, 1, 14)), ("2024-05-01", None, micros(2024, 5, 1)), ("1714557600", None, 1714557600000000),
    ("1714557600.25", None, 1714557600250000), ("1714557600123", None, 1714557600123000), ("1714557600123456", None, 1714557600123456), ("/Date(1714557600123+0200)/", None, 1714557600123000),
    ("20240501T100000Z", None, micros(2024, 5, 1, 10)), ("Wed, 01 May 2024 10:00:00 GMT", None, micros(2024, 5, 1, 10)), ("Wed, 01 May 2024 10:00:00 -0400", None, micros(2024, 5, 1, 14)),
    ("1 May 2024, 10:00", "b", micros(2024, 5, 1, 8)), ("May 1, 2024 12:05 am", "b", micros(2024, 4, 30, 22, 5)), ("03/04/2024 10:00", "b", micros(2024, 4, 3, 8)), ("03/04/2024 10:00 PM", "n", micros(2024, 3, 5, 3)),
    ("01.05.2024 10:00", "n", micros(2024, 5, 1, 14)), ("2024/05/01 10:00:00 UTC+02:00", None, micros(2024, 5, 1, 8)), ("2024-05-01 10:00:00 CEST", None, micros(2024, 5, 1, 8)),
    ("2024-05-01T10:00:00.123456789+00:00", None, micros(2024, 5, 1, 10) + 123456), ("2024-10-27 02:30:00", "b", micros(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "b", None), ("2024-02-30", None, None), ("2024-05-01 24:00:00", "b", None), ("2024-05-01 10:61:00", "b", None), ("24:61", "b", None), ("2024-", "b", None), ("", "b", None), (None, "b", None),
    ("1969-12-31T23:59:59Z", None, None), ("/Date(-62135596800000)/", None, None), ("2024-05-01T10:00", None, None), ("2024-05-01T10:00", "missing", None), ("03/04/2024 10:00", None, None), ("yesterday", "b", None),
    ("13/25/2024 10:00", "b", None), ("2024-05-01 13:00 PM", "b", None), ("171455760", None, None), ("2024-05-01 10:00:00 XYZ", "b", None), ("x" * 50000, "b", None),
]


@pytest.fixture(scope="module")
def told(spark):
    feeds = spark.createDataFrame(FEEDS, "feed string, tz string, date_order string")
    data = [(str(k), w, f, dt.datetime(2026, 1, 1)) for k, (w, f, _) in enumerate(CASES)]
    frame = spark.createDataFrame(data, "id string, written string, feed string, captured_at timestamp")
    return {r.id: r.utc_micros for r in t.normalised(frame, feeds).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(told, k):
    assert told.get(str(k)) == CASES[k][2], CASES[k]


def test_missing_zone_is_found_by_alignment(spark):
    feeds = spark.createDataFrame([("a", "Europe/Berlin", "DMY"), ("c", "Asia/Tokyo", "DMY"), ("x", None, "DMY")], "feed string, tz string, date_order string")
    start = dt.datetime(2024, 1, 1)
    data = []
    for k in range(60):  # local Tokyo clock, captured minutes after
        local = start + dt.timedelta(hours=37 * k)
        data.append((str(k), local.strftime("%Y-%m-%d %H:%M:%S"), "x", local - dt.timedelta(hours=9) + dt.timedelta(minutes=3 + k % 7)))
    frame = spark.createDataFrame(data, "id string, written string, feed string, captured_at timestamp")
    found = {r.feed: r.zone for r in t.chosen_zones(t.parsed_rows(frame, feeds), t.candidate_zones(feeds)).collect()}
    assert found == {"a": "Europe/Berlin", "c": "Asia/Tokyo", "x": "Asia/Tokyo"}
    assert t.normalised(frame, feeds).count() == 60


def test_empty_and_repeated(spark, rows):
    feeds = spark.createDataFrame(FEEDS, "feed string, tz string, date_order string")
    schema = "id string, written string, feed string, captured_at timestamp"
    assert rows(t.normalised(spark.createDataFrame([], schema), feeds)) == []
    data = [("a", "1714557600", "b", None), ("a", "2024-05-01T10:00:00Z", None, None), ("a", None, "b", None)]
    assert rows(t.normalised(spark.createDataFrame(data, schema), feeds)) == [("a", 1714557600000000)]
    clash = spark.createDataFrame([("a", "1714557600", "b", None, 1, "x")], schema + ", parsed int, zone string")
    assert rows(t.normalised(clash, feeds).select(F.col("utc_micros"))) == [(1714557600000000,)]


def test_zones_told_from_the_rows_alone(spark):
    """The estimate, blind to the declared zones, finds every one of them."""
    import os

    from gleanwright.plans import core
    from gleanwright.session import table

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        return
    declared = {r.feed: r.tz for r in table(spark, folder, "feeds").collect()}
    assert {r.feed: r.zone for r in core.p4_zones(spark, folder).collect()} == declared
