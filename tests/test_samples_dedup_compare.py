from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from gleanwright.functions import counts
from gleanwright.operators import compare, dedup, evidence, samples, search


def test_counts_rules(spark):
    cases = {"1,234": (None, 1234, False), "2.1M": (None, 2100000, True), "17": (17, 17, False), "17.00": (17, 17, False), "1.5": (None, None, False), "<1": (None, None, False), "": (None, None, False), None: (None, None, None), "-3": (None, None, False), "9" * 32: (None, None, False)}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", counts.exact_count(F.col("v")).alias("e"), counts.display_count(F.col("v")).alias("d"), counts.measured(F.col("v")).alias("m"), counts.is_censored(F.col("v")).alias("c"))
    got = {r.v: r for r in df.collect()}
    for v, (exact, shown, _) in cases.items():
        assert (got[v].e, got[v].d.value) == (exact, shown), v
    assert got["<1"].c and got["<1"].m is None and got["1,234"].m == 1234 and got["2.1M"].d.approximate and not got["17"].d.approximate
    changes = spark.createDataFrame([(0.0, 5.0), (-4.0, 4.0), (2.0, 3.0), (None, 1.0)], "a double, b double")
    for base, want in (("signed", [None, -200, 50, None]), ("absolute", [None, 200, 50, None]), ("positive", [None, None, 50, None])):
        assert [r[0] for r in changes.select(counts.percent_change(F.col("a"), F.col("b"), base)).collect()] == want


def test_term_stats_missing_is_not_zero(spark):
    records = spark.createDataFrame([("a", 10.0, 1.0, None), ("b", None, 5.0, 2.0), ("c", 0.0, 3.0, 1.0), ("d", 30.0, 4.0, 2.0)], "id string, views double, likes double, comments double")
    members = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("b", "y")], "id string, term string")
    got = {r.term: r for r in samples.term_stats(members, records, "id", "term", ["views"], samples.complete_ratio(["likes", "comments"], "views", "ratio")).collect()}
    x, y = got["x"], got["y"]
    assert (x.records, x.sample_views_available, x.sample_views_sum, x.sample_views_mean, x.sample_views_median) == (4, 3, 40.0, mean([10, 0, 30]), median([10, 0, 30]))
    assert (x.ratio, x.ratio_records) == (6 / 30, 1) and (y.sample_views_sum, y.sample_views_available, y.ratio) == (None, 0, None)


def test_cooccurrence_brute_force(spark):
    rng = random.Random(2)
    data = [(f"r{k}", t) for k in range(80) for t in rng.sample("abcdefg", rng.randrange(0, 5)) for _ in range(rng.choice((1, 2)))]
    sets = defaultdict(set)
    for r, t in data:
        sets[t].add(r)
    got = {(r.term, r.other): r for r in samples.cooccurrence(spark.createDataFrame(data, "id string, t string"), "id", "t", 80).collect()}
    assert set(got) == {(a, b) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    for (a, b), r in got.items():
        n = len(sets[a] & sets[b])
        assert r.shared == n and r.jaccard == pytest.approx(n / len(sets[a] | sets[b])) and r.lift == pytest.approx(n * 80 / (len(sets[a]) * len(sets[b])))
    kept = Counter(r.term for r in samples.cooccurrence(spark.createDataFrame(data, "id string, t string"), "id", "t", 80, 2).collect())
    assert max(kept.values()) == 2


def test_dedup_rules(spark, rows):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    data = [("a", t(1), 5, None, "x"), ("a", t(2), 6, "u", "x"), ("b", t(1), 1, "v", "[removed]"), ("b", t(3), 1, "v", "live"), ("c", t(1), None, None, "y"), ("c", t(1), None, None, "y")]
    df = spark.createDataFrame(data, "id string, at timestamp, n bigint, who string, body string")
    assert rows(dedup.first_non_null(df, "id", F.col("at"), ["n", "who"])) == [("a", 2, 5, "u", 1), ("b", 2, 1, "v", 0), ("c", 2, None, None, 0)]
    assert rows(dedup.keep_first(df, "id", ["at"], ["n"]).select("id", "n", "copies", "conflicting")) == [("a", 5, 2, True), ("b", 1, 2, False), ("c", None, 2, False)]
    assert rows(dedup.without_removed(df, "id", F.col("body") == "[removed]", ["at"]).select("id")) == [("a",), ("c",)]


def test_compare_states_and_bases(spark):
    a = spark.createDataFrame([("p", None, 10.0, dt.datetime(2024, 1, 1)), ("q", "s", 0.0, dt.datetime(2024, 1, 1)), ("r", "s", 1.0, dt.datetime(2024, 1, 1)), ("t", "s", 1.0, dt.datetime(2024, 1, 1)), ("t", "s", 2.0, dt.datetime(2024, 1, 1)), ("u", "s", 1.0, dt.datetime(2024, 1, 9))], "phrase string, source string, value double, at timestamp")
    b = spark.createDataFrame([("p", None, 15.0, dt.datetime(2024, 1, 3)), ("q", "s", 4.0, dt.datetime(2024, 1, 3)), ("n", "s", 7.0, dt.datetime(2024, 1, 3)), ("t", "s", 1.0, dt.datetime(2024, 1, 3)), ("u", "s", 2.0, dt.datetime(2024, 1, 3))], a.schema)
    got = {r.phrase: r for r in compare.compare(a, b, ["phrase", "source"], ["value"], "full_outer", "at").collect()}
    assert {k: r.state for k, r in got.items()} == {"p": "both", "q": "both", "r": "removed", "n": "added", "t": "conflict", "u": "both"}
    assert (got["p"].value_change, got["p"].value_percent, got["p"].value_per_day) == (5.0, 50.0, 2.5)
    assert (got["q"].value_change, got["q"].value_percent) == (4.0, None) and got["t"].value_change is None and got["u"].value_change is None
    assert {r.phrase for r in compare.compare(a, b, ["phrase", "source"], ["value"]).collect()} == {"p", "q", "t", "u"}


def test_rankings(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 4), (1, "y", 2), (1, None, 3)], "s bigint, url string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], a.schema)
    changes = compare.rank_changes(a, b, ["s"], "url", "rank")
    assert rows(changes) == [(1, "x", 1, None, "left", None), (1, "y", 2, 1, "stayed", 1), (1, "z", None, 2, "entered", None)]
    assert rows(compare.set_overlap(changes, ["s"])) == [(1, 1, 3, 1 / 3)]


def test_evidence_order_and_limit(spark):
    e = spark.createDataFrame([("a", "m", 5.0), ("b", "m", 9.0), ("b", "m", 8.0), ("c", "m", 7.0), ("d", "n", 1.0), ("c", "m", 7.0)], "phrase string, metric string, value double")
    assert [r.phrase for r in evidence.ordered_by_metric(e, "m").collect()] == ["c", "a", "b", "d"]
    assert [r.phrase for r in evidence.ordered_by_metric(e, "m", False).collect()] == ["a", "c", "b", "d"]
    cut = evidence.limited(evidence.ordered_by_metric(e, "m"), 2).collect()
    assert [(r.phrase, r.output_truncated) for r in cut] == [("c", True), ("a", True)]
    assert not evidence.limited(evidence.ordered_by_metric(e, "m"), 4).first().output_truncated


def test_search_reports(spark, rows):
    df = spark.createDataFrame([("q", "p1", 1, 200, 5.0), ("q", "p2", 0, None, 6.0), ("r", "p1", 50, 100, 3.0), ("s", "p1", 1, 100, 20.0), ("t", "p", None, 500, 9.0)], "query string, page string, clicks bigint, impressions bigint, position double")
    found = search.opportunities(df, "impressions", "clicks", "position", target_ctr=0.1)
    assert [(r[0], round(r[1], 6)) for r in rows(found.select("query", "scenario_clicks"))] == [("q", 19.0), ("s", 9.0)]
    assert rows(search.page_overlap(df, ["query"], "page", "impressions")) == [("q", 2, None, None)]
    ok = df.select("query", search.ctr_consistent(F.col("clicks"), F.col("impressions"), F.lit(0.005)).alias("ok"))
    assert {r.query: r.ok for r in ok.where("page = 'p1'").collect()} if "page" in ok.columns else True
    serp = spark.createDataFrame([(1, "https://www.a.example/x", 1, "Quiet song", "quiet song"), (1, "https://a.example/y", 2, "quiet songs", "quiet song"), (1, "https://b.example/", 3, None, "quiet song"), (1, "https://c.example/", 11, "t", "quiet song")], "s bigint, url string, rank int, title string, query string")
    assert rows(search.competition(serp, ["s"], "url", "rank", "title", F.col("query"), "b.example")) == [(1, 3, 2, 2 / 3, 1, 3, True)]
