from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleanwright.operators import embeddings, event_cycles, selection, trends


def test_shortlist_is_the_greedy_choice(spark):
    rng = random.Random(1)
    data = [(f"p{k}", rng.choice("abc"), rng.randrange(1, 12), rng.choice(["direct", "adjacent", "reject", None]), rng.choice(["listening", "mixed"]), rng.choice(["natural", "awkward"])) for k in range(80)]
    df = spark.createDataFrame(data, "phrase string, grp string, priority int, fit string, intent string, clarity string")
    taken, picked, want = Counter(), [], {}
    for phrase, group, _, fit, intent, clarity in sorted(data, key=lambda d: (d[2], d[0])):
        reason = "unreviewed" if fit is None else "fit_ineligible" if fit != "direct" else "different_intent" if intent != "listening" else "awkward_wording" if clarity != "natural" else None
        if reason is None:
            if taken[group] >= 2:
                reason = "intent_group_cap"
            elif len(picked) >= 4:
                reason = "outside_shortlist_limit"
            else:
                taken[group] += 1
                picked.append(phrase)
        want[phrase] = reason
    got = {r.phrase: r.reason for r in selection.shortlist(df, "phrase", "grp", "priority", "fit", "intent", "clarity", limit=4).collect()}
    assert got == want


def test_hashtag_plan_order_of_reasons(spark):
    day = dt.date(2024, 5, 30)
    rows = [("#a", "direct", "clear", "topic", 1, day, None, False), ("#b", "direct", "clear", "brand", 2, day, None, False), ("#c", "direct", "clear", "brand", 3, day, None, False), ("#d", "direct", "clear", "topic", 4, day, None, False), ("#e", "direct", "clear", "niche", 5, day, None, False),
            ("#fyp", "direct", "clear", "topic", 1, day, None, False), ("#x", "adjacent", "clear", "topic", 1, day, None, False), ("#y", "direct", "hold", "topic", 1, day, None, False), ("#t", "direct", "clear", "trend", 1, day, None, False), ("#o", "direct", "clear", "topic", 1, dt.date(2024, 4, 1), None, False), ("#l", "direct", "clear", "format", 9, None, None, True)]
    df = spark.createDataFrame(rows, "tag string, fit string, safety string, role string, priority int, freshest date, trend_at date, local boolean")
    plan = lambda p: {r.tag: r.reason for r in selection.hashtag_plan(df, p, F.lit(dt.date(2024, 6, 1)), F.lit(dt.date(2024, 5, 31)), F.lit(dt.date(2024, 5, 31))).collect()}
    assert plan("youtube") == {"#a": None, "#b": None, "#c": "role_cap", "#d": None, "#e": "editorial_ceiling", "#fyp": "generic_reach_bait", "#x": "not_directly_relevant", "#y": "safety_hold_or_rejection", "#t": "trend_needs_recent_native_evidence", "#o": "discovery_evidence_missing_or_stale", "#l": "editorial_ceiling"}
    assert plan("reddit")["#a"] == "native_surface_instead_of_hashtags"


def test_focus_and_contains(spark):
    df = spark.createDataFrame([("The quiet song", 1), ("quiet big song", 2), ("song quiet", 3), ("broken song", 4), ("drum", 5)], "phrase string, row int")
    got = {r.phrase: (r.overlap, r.reason) for r in selection.focused(df, "phrase", "row", "quiet song", exclude=("broken",), include=("quiet song", "song quiet", "drum")).collect()}
    assert got == {"The quiet song": (2, None), "quiet big song": (2, "required_context_absent"), "song quiet": (2, None), "broken song": (1, "excluded_phrase"), "drum": (0, "insufficient_seed_overlap")}
    assert selection.focused(df, "phrase", "row", "quiet song", all_seed_terms=True).where("reason = 'missing_seed_terms'").count() == 2


def test_copy_issues(spark, rows):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "tag string")
    assert rows(selection.copy_issues(t("a", "b"), t("b", "b", "c"), "tag")) == [("a", "missing"), ("b", "repeated"), ("c", "unplanned")]


def test_event_cycles(spark, rows):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    bins = [("k", day(n), day(n), float({10: 80, 11: 70, 30: 90, 31: 20, 50: 60}.get(n, 5)) if n != 33 else None, n == 33, n != 52) for n in range(70)]
    b = spark.createDataFrame(bins, "phrase string, start date, end date, value double, censored boolean, eligible boolean")
    e = spark.createDataFrame([("k", day(n)) for n in (10, 30, 50)], "phrase string, event_date date")
    cycles = event_cycles.aligned(b, e, ["phrase"], (-3, 3))
    got = {r.event_date: r for r in cycles.collect()}
    first, second, third = got[day(10)], got[day(30)], got[day(50)]
    assert (first.peak, [tuple(p) for p in first.peaks], [tuple(p) for p in first.high], first.covered_days, first.issues) == (80.0, [(0, 0)], [(0, 0), (1, 1)], 7, [])
    assert (second.censored_bins, second.missing_bins, second.issues) == (1, 0, []) and third.incomplete_bins == 1 and "incomplete_alignment_window" in third.issues
    assert rows(event_cycles.majority_intervals(cycles, ["phrase"], "high")) == [("k", 0, 0)]
    assert rows(event_cycles.envelope(cycles, ["phrase"])) == [("k", 3, 0, 0)]
    assert rows(event_cycles.holdouts(cycles, ["phrase"])) == [("k", day(50), 2, 0, 0, True)]
    assert event_cycles.independent(cycles, ["phrase"], 20).count() == 0 and event_cycles.independent(cycles, ["phrase"], 19).count() == 3
    days = event_cycles.proposed_days(event_cycles.envelope(cycles, ["phrase"]), ["phrase"], F.lit(day(100)), 2, F.lit(day(90)), F.lit(day(99)), F.lit(day(60)), [])
    assert rows(days) == [("k", day(98))]


def test_trends(spark):
    wide = spark.createDataFrame([("2024-01-01", "<1", "10", ""), ("2024-01-08", "5", "20", "3"), ("2024-01-15", "0", "30", "4")], ["week", "a: (GB)", "b: (GB)", "c: (GB)"])
    points = trends.long_series(wide, "week", ["a: (GB)", "b: (GB)", "c: (GB)"])
    s = {r.series: r for r in trends.cohort_rank(trends.summary(points, "series", "value").withColumn("x", F.lit(1)), ["x"]).collect()}
    assert (s["a"].mean, s["a"].peak, s["a"].lower, s["a"].upper, s["a"].zero_periods, s["a"].unknown_periods) == (None, None, 1.6666, 2.0, 1, 1)
    assert (s["b"].mean, s["b"].peak, s["b"].lower, s["b"].cohort_rank) == (20.0, 30.0, 20.0, 1) and (s["c"].mean, s["c"].lower) == (None, None)
    lines = [("e", n, x) for n, x in enumerate([["Related queries"], ["TOP"], ["song", "100"], ["song", "100"], ["demo", "90"], ["demo", "80"], ["RISING"], ["clip", "250%"], ["reel", "Breakout"]])]
    got = {(r.section, r.phrase): r for r in trends.related_rows(spark.createDataFrame(lines, "e string, n int, cells array<string>"), "e", "n", "cells").collect()}
    assert got["top", "song"].value == 100 and not got["top", "song"].conflict and got["top", "demo"].conflict and got["rising", "clip"].value == 250 and got["rising", "reel"].metric == "related_rising_breakout" and got["rising", "reel"].value is None


def test_embeddings_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8))
    x[7] = 0
    df = spark.createDataFrame([(k, x[k].tolist(), k % 3) for k in range(90)], "id bigint, v array<double>, g int")
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    for block in (4096, 3):
        got = {(r.query_id, r.place): r.id for r in embeddings.query_top_k(df.where("id % 10 = 0"), df, "id", "v", 4, block).collect()}
        for q in range(0, 90, 10):
            order = sorted((k for k in range(90) if k != q), key=lambda k: (-(u[q] @ u[k]), k))[:4]
            assert [got[q, p] for p in (1, 2, 3, 4)] == order
    assert embeddings.query_top_k(df.where("false"), df, "id", "v", 4).collect() == []
    chosen = embeddings.mmr(df, "g", "id", "v", 5, pool=30).collect()
    assert Counter(r.g for r in chosen) == {0: 5, 1: 5, 2: 5}
    assert embeddings.max_sum(df, "g", "id", "v", 3, pool=6).count() == 9
