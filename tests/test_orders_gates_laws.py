"""Orders of result families, comparison gates, report laws, bounds and audits."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanwright.operators import compare, dedup, evidence, samples, selection, terms, validate
from gleanwright.sources import records, texts

LONG = "phrase string, relationship string, metric string, value double, position int"


def test_orders(spark):
    rows = spark.createDataFrame([("b", "r", "m", 5.0, 1), ("b", "r", "m", 9.0, 2), ("A", "r", "m", 7.0, 1), ("c", "r", "m", None, 1), ("d", "r", "n", 1.0, 1), ("e", "r", "m", 7.0, 1), ("e", "r", "m", 7.0, 2)], LONG)
    order = lambda family, **more: [(r.phrase, r.value) for r in evidence.ordered(rows, family, more.pop("metric", "m"), **more).collect()]
    assert order("video") == [("A", 7.0), ("e", 7.0), ("b", None), ("c", None), ("d", None)]
    assert order("short-video") == [("A", 7.0), ("e", 7.0), ("b", 5.0), ("c", None), ("d", None)]
    assert order("search", ascending=True) == [("A", 7.0), ("b", None), ("c", None), ("d", None), ("e", None)]
    assert order("panel") == [("A", 7.0), ("e", 7.0), ("b", 5.0), ("c", None), ("d", None)]
    with pytest.raises(Exception, match="no row has the metric"):
        order("panel", metric="other")
    ranks = spark.createDataFrame([("x", "r", "position", 3.0, 1), ("y", "r", "position", 1.0, 1)], LONG)
    assert [r.phrase for r in evidence.ordered(ranks, "mentions-provider", "position").collect()] == ["y", "x"]
    scores = spark.createDataFrame([("d1", "a", 0.9, 1), ("d1", "b", 0.8, 5), ("d1", "c", 0.7, 9), ("d2", "c", 0.9, 9), ("d2", "a", 0.1, 1)], "document string, phrase string, score double, occurrences int")
    assert [tuple(r) for r in evidence.ranked_phrases(scores, 1, 5).collect()] == [("c", 0.9, 18), ("a", 0.9, 2)]


def test_gates(spark):
    keys = compare.PROFILES["mentions"].keys
    fields = ", ".join([*(f"{k} string" for k in keys), "value double", "observed_at timestamp", "approximate boolean", "report_source string", "report_scope string", "country string", "period string", "analysis_signature string", "output_truncated boolean"])
    row = lambda value, day, sig="s", cut=False, approx=False: (*["x"] * len(keys), value, dt.datetime(2024, 1, day), approx, "a", "b", None, None, sig, cut)
    frame = lambda *rows: spark.createDataFrame(list(rows), fields)
    got = compare.compare_profile("mentions", frame(row(4.0, 1)), frame(row(6.0, 3))).first()
    assert (got.value_change, got.value_percent, got.value_per_day) == (2.0, 50.0, 1.0)
    for after, text in ((row(6.0, 3, sig="t"), "differ in analysis_signature"), (row(6.0, 3, cut=True), "cut off"), (row(6.0, 1), "isn't later")):
        with pytest.raises(Exception, match=text):
            compare.compare_profile("mentions", frame(row(4.0, 1)), frame(after)).collect()
    with pytest.raises(ValueError, match="lacks"):
        compare.compare_profile("mentions", frame(row(4.0, 1)).drop("unit"), frame(row(6.0, 3)))
    assert compare.compare_profile("mentions", frame(row(4.0, 1, approx=True)), frame(row(6.0, 3))).first().state == "added"
    keys = compare.PROFILES["search-observations"].keys
    small = lambda phrase, value, day, approx=False: spark.createDataFrame([(phrase, *["x"] * (len(keys) - 1), value, dt.datetime(2024, 1, day), approx)], ", ".join([*(f"{k} string" for k in keys), "value double", "observed_at timestamp", "approximate boolean"]))
    assert compare.compare_profile("search-observations", small("p", 1.0, 1, True), small("p", 2.0, 5)).first().value_change is None
    with pytest.raises(Exception, match="no identity in common"):
        compare.compare_profile("search-observations", small("p", 1.0, 1), small("q", 2.0, 5)).collect()
    rows = lambda clicks: spark.createDataFrame([("q", clicks, 10, clicks / 10, 3.0)], "query string, clicks int, impressions int, ctr double, position double")
    week = lambda a, b: {"start_date": f"2024-01-{a:02}", "end_date": f"2024-01-{b:02}"}
    got = compare.compare_periods(rows(1), rows(2), ["query"], (week(1, 7), week(8, 14))).first()
    assert (got.presence, round(got.ctr_change, 6), got.clicks_change) == ("both", 10.0, 1)
    for periods in ((week(1, 7), week(7, 13)), (week(1, 7), week(8, 15)), (week(1, 7), {})):
        with pytest.raises(ValueError, match="periods"):
            compare.compare_periods(rows(1), rows(2), ["query"], periods)
    with pytest.raises(ValueError, match="differ in site"):
        compare.compare_periods(rows(1), rows(2), ["query"], (week(1, 7), week(8, 14)), ({"site": 1}, {"site": 2}))
    assert compare.analysis_signature({}) == compare.analysis_signature({"max_words": 3}) != compare.analysis_signature({"max_words": 2})


def test_laws(spark):
    fields = "r int, query string, page string, date date, position_bucket int, clicks int, impressions int, ctr double, position double"
    rows = spark.createDataFrame([(1, "q", "https://a/", None, None, 1, 10, 0.1, 2.0), (2, "q", "https://a/", None, None, 11, 10, None, 2.0), (3, "q", "https://a/", None, None, 1, 10, 0.5, 2.0), (4, "q", None, None, None, None, None, None, None), (4, "q", None, None, None, None, None, None, None), (5, "q", "page", dt.date(2024, 1, 1), None, 1, 2, None, None)], fields)
    told = lambda df: {r.r: r.problem for r in df.collect()}
    assert told(validate.webmaster_report(rows, ["r"])) == {1: None, 2: "clicks-exceed-impressions", 3: "rate-disagrees", 4: "duplicate-row", 5: "date-in-period-total"}
    assert told(validate.webmaster_report(rows.where("r IN (1, 5)"), ["r"], "native-buckets")) == {1: "no-bucket-date", 5: "page-no-address"}
    judged = validate.console_report(rows, ["r"], ["query", "page"])
    assert told(judged) == {1: None, 2: "clicks-exceed-impressions", 3: None, 4: "missing-dimension", 5: None} and {r.r for r in validate.accepted(judged, ["r"]).collect()} == {1, 3, 5}
    pages = spark.createDataFrame([(1, "https://a/", 1), (1, "https://a/", 3), (1, "https://b/", 2), (2, "https://a/", 1), (2, "https://b/", 1), (3, "https://a/", 0), (4, None, 1)], "r int, url string, rank int")
    assert [(r.r, r.rank) for r in validate.result_report(pages, ["r"]).where("problem IS NULL").orderBy("r", "rank").collect()] == [(1, 1), (1, 2)]
    assert told(validate.result_report(pages.where("r > 1"), ["r"], "bing")) == {2: "shared-rank", 3: "no-rank", 4: "no-address"}
    watch = spark.createDataFrame([("a", "s", "p", None, 24.0, 30.0, 1.0, None), ("b", "s", "p", "guess", 24.0, 30.0, 1.0, None), ("c", "s", " ", None, 24.0, 30.0, 1.0, None), ("d", "s", "p", None, 0.5, 30.0, 1.0, None), ("e", "s", "p", None, 24.0, 30.0, -1.0, None)], "id string, subject string, platform string, evidence_kind string, cadence_hours double, freshness_days double, min_absolute_change double, min_percent_change double")
    assert {r.id: r.problem for r in validate.watches(watch, ("unknown",)).collect()} == {"a": None, "b": "unknown-evidence-kind", "c": "missing-label", "d": "cadence-out-of-bounds", "e": "negative-threshold"}


def test_bounds_secrets_and_rows(spark, tmp_path):
    some = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "k string, t string")
    assert texts.bounded(some, "t", 5, 2).count() == 2
    for bounds in ((4, None), (None, 1)):
        with pytest.raises(Exception, match="over their bound"):
            texts.bounded(some, "t", *bounds).collect()
    (tmp_path / "a.json").write_text('[{"x": 1}]')
    (tmp_path / "b.json").write_text('[{"x": 1, "API_Key": "s"}]')
    (tmp_path / "c.json").write_text('[{"x": NaN}]')
    assert records.json_rows(spark, [str(tmp_path / "a.json")], "", "struct<x:int>").first().x == 1
    for name in "bc":
        with pytest.raises(Exception, match="credentials|MALFORMED|malformed|parse"):
            records.json_rows(spark, [str(tmp_path / f"{name}.json")], "", "struct<x:int>").collect()
    caps = spark.createDataFrame([("1", "so #Quiet song"), ("2", "#quieter"), ("3", None), ("4", "x#quiet")], "k string, t string")
    assert [r.k for r in terms.with_tag(caps, "t", "#QUIET").collect()] == ["1"]
    posts = spark.createDataFrame([("a", True, False), ("b", None, True), ("c", False, None)], "k string, adult boolean, pinned boolean")
    assert {r.k for r in dedup.permitted(posts, F.col("adult"), F.col("pinned"), exclude_pinned=True).collect()} == {"c"}
    tied = spark.createDataFrame([("s", "u", 1), ("s", "v", 1)], "s string, u string, r int")
    with pytest.raises(Exception, match="share rank 1"):
        dedup.without_shared_ranks(dedup.best_rank(tied, ["s"], "u", "r"), ["s"], "r").collect()
    spread = {(r.g, r.v): r.share for r in samples.distribution(spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b"), ("g", None)], "g string, v string"), ["g"], F.col("v"), "v").collect()}
    assert spread[("g", "a")] == pytest.approx(2 / 3) and len(spread) == 2
    tags = lambda *xs: spark.createDataFrame([(x,) for x in xs], "tag string")
    day = lambda d: F.lit(dt.date(2024, 1, d))
    assert {tuple(r) for r in selection.copy_audit(tags("#a", "#b"), tags("#a", "#a", "#c"), "tag", 2, day(1), day(2)).collect()} == {("#a", "repeated"), ("#b", "missing"), ("#c", "unplanned"), (None, "over-ceiling"), (None, "plan-expired")}
