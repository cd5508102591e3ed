from __future__ import annotations

import datetime as dt
import random

from gleanwright.operators.intervals import covered_periods

D = dt.date


def brute(intervals):
    days, out = {}, []
    for key, a, b in intervals:
        if key is not None and a and b and a <= b:
            days.setdefault(key, set()).update(range(a.toordinal(), b.toordinal() + 1))
    for key, covered in days.items():
        order = sorted(covered)
        start = order[0]
        for x, y in zip(order, [*order[1:], None]):
            if y != x + 1:
                out.append((key, "period", D.fromordinal(start), D.fromordinal(x)))
                if y:
                    out.append((key, "gap", D.fromordinal(x + 1), D.fromordinal(y - 1)))
                    start = y
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "k bigint, s date, e date")


def test_random_intervals_match_days(spark, rows):
    rng = random.Random(3)
    data = []
    for _ in range(400):
        a = D(2023, 1, 1) + dt.timedelta(rng.randrange(400))
        data.append((rng.randrange(6), a, a + dt.timedelta(rng.randrange(-2, 9))))
    assert rows(covered_periods(frame(spark, data), "k", "s", "e")) == brute(data)


def test_nested_touching_repeated_and_unusable_rows(spark, rows):
    data = [(1, D(2024, 1, 1), D(2024, 1, 10)), (1, D(2024, 1, 3), D(2024, 1, 4)), (1, D(2024, 1, 11), D(2024, 1, 12)), (1, D(2024, 1, 1), D(2024, 1, 10)),
            (1, D(2024, 2, 1), D(2024, 2, 1)), (1, None, D(2024, 3, 1)), (1, D(2024, 3, 2), D(2024, 3, 1)), (None, D(2024, 1, 1), D(2024, 1, 2)), (2, D(2024, 1, 1), None)]
    assert rows(covered_periods(frame(spark, data), "k", "s", "e")) == [
        (1, "gap", D(2024, 1, 13), D(2024, 1, 31)), (1, "period", D(2024, 1, 1), D(2024, 1, 12)), (1, "period", D(2024, 2, 1), D(2024, 2, 1))]


def test_empty_and_clashing_columns(spark, rows):
    assert rows(covered_periods(frame(spark, []), "k", "s", "e")) == []
    clash = spark.createDataFrame([(7, D(2024, 1, 1), D(2024, 1, 2), 5, "x")], "key bigint, day date, hi date, delta int, active string")
    assert rows(covered_periods(clash, "key", "day", "hi")) == [(7, "period", D(2024, 1, 1), D(2024, 1, 2))]
