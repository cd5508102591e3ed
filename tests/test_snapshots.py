from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gleanwright.operators import snapshots
from gleanwright.operators.snapshots import Bitmap, snapshot_changes

SCHEMA = "s bigint, o date, d timestamp, item string, v bigint"


def changes(spark, data, rows, **options):
    df = spark.createDataFrame(data, SCHEMA)
    found = snapshot_changes(df, ["s"], "o", "d", "item", {"v": F.max("v")}, **options)
    return rows(found.select("s", F.col("observed_on").cast("string"), "item", "change_kind"))


def brute(data):
    last, snaps, out = {}, defaultdict(dict), []
    for s, o, d, _, _ in data:
        last[s, o] = max(last.get((s, o), d), d)
    for s, o, d, item, v in data:
        if d == last[s, o]:
            snap = snaps[s].setdefault(o, {})
            if item is not None:
                snap[item] = max((x for x in (snap.get(item), v) if x is not None), default=None)
    for s, by in snaps.items():
        dates = sorted(by)
        for a, b in zip(dates, dates[1:]):
            for item in by[a].keys() | by[b].keys():
                kind = "added" if item not in by[a] else "removed" if item not in by[b] else "changed" if by[a][item] != by[b][item] else None
                if kind:
                    out.append((s, str(b), item, kind))
    return sorted(out, key=repr)


def test_bitmaps_sparse_and_dense():
    rng = np.random.default_rng(1)
    for size in (0, 10, 5000, 60000, 150000):
        a, b = (np.unique(rng.integers(0, 200000, size)) for _ in range(2))
        x, y = Bitmap(a), Bitmap(b)
        assert set(x.and_not(y)) == set(a) - set(b) and set(x.both(y)) == set(a) & set(b)


def test_random_snapshots_in_many_blocks(spark, rows):
    rng = random.Random(5)
    data = []
    for s in range(4):
        for o in sorted(rng.sample(range(40), 8)):
            for copy in range(rng.choice((1, 1, 2))):
                day = dt.date(2024, 1, 1) + dt.timedelta(o)
                for item in rng.sample(range(60), rng.randrange(0, 40)):
                    data.append((s, day, dt.datetime(2024, 3, 1 + copy), f"k{item}", rng.choice((None, 1, 2))))
                data.append((s, day, dt.datetime(2024, 3, 1 + copy), None, 9))
    assert changes(spark, data, rows) == brute(data)
    assert changes(spark, data, rows, block_rows=7) == brute(data)


def test_first_snapshot_null_values_and_repeats(spark, rows):
    a, b, t = dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.datetime(2024, 2, 1)
    data = [(1, a, t, "x", None), (1, a, t, "x", None), (1, a, t, "y", 1), (1, b, t, "x", 0), (1, b, t, "y", 1), (2, a, t, "z", 1), (None, a, t, "q", 1), (3, None, t, "q", 1)]
    assert changes(spark, data, rows) == [(1, "2024-01-08", "x", "changed")]
    assert changes(spark, [], rows) == []


def test_extra_columns_with_clashing_names(spark, rows):
    t = dt.datetime(2024, 2, 1)
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), t, "x", 1, 5, "q"), (1, dt.date(2024, 1, 2), t, "y", 1, 6, "r")], SCHEMA + ", block int, n string")
    found = snapshot_changes(df, ["s"], "o", "d", "item", {"v": F.max("v")})
    assert rows(found.select("item", "change_kind")) == [("x", "removed"), ("y", "added")]


def test_one_delivery_at_a_time_gives_the_same_changes(spark, rows):
    rng, t = random.Random(11), dt.datetime(2024, 3, 1)
    data = [(s, dt.date(2024, 1, 1 + 3 * o + s), t, f"k{item}", rng.choice((None, 1, 2))) for s in range(3) for o in range(5) for item in rng.sample(range(40), rng.randrange(1, 30))]
    frame = spark.createDataFrame(data, SCHEMA)
    state, found, numbers = None, [], {}
    for o in range(5):
        # The third stream misses a delivery, which is then none of its snapshots.
        late = frame.where(F.expr(f"o = date_add(date'2024-01-01', int(3 * {o} + s)) AND NOT (s = 2 AND {o} = 2)")).select("s", F.col("o").alias("observed_on"), "item", "v")
        state = snapshots.new_state(late, ["s"], ["v"]) if state is None else state
        out = snapshots.next_snapshot(state, late, ["s"], ["v"], 3).checkpoint()
        found += rows(out.where("change_kind IS NOT NULL").select("s", F.col("observed_on").cast("string"), "item", "change_kind"))
        state = out.drop("observed_on", "change_kind")
        for r in state.collect():
            assert numbers.setdefault((r.s, r.item), r.ordinal) == r.ordinal  # a key keeps its ordinal
    assert sorted(found, key=repr) == brute([x for x in data if not (x[0] == 2 and x[1] == dt.date(2024, 1, 9))])
    assert state.select("s", "item").distinct().count() == state.count() == len(numbers)
