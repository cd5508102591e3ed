from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleanwright.sources import connectors, records, sinks, texts
from gleanwright.streaming import ingest


def test_text_files_and_subtitles(spark, tmp_path, rows):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("﻿one\r\ntwo")
    (tmp_path / "d/b.md").write_text("three")
    (tmp_path / "c.bin").write_text("no")
    files = texts.text_files(spark, str(tmp_path))
    assert sorted(r.text for r in files.collect()) == ["one\r\ntwo", "three"]
    with pytest.raises(Exception, match="over 3 characters"):
        texts.text_files(spark, str(tmp_path), max_characters=3).collect()
    cue = "WEBVTT\n\n00:01.000 --> 00:02.500 align:start\n<v Bob>Tom &amp; Ann</v>\n\n00:01.000 --> 00:02.500\nTom & Ann\n\n01:00:03,000 --> 01:00:04,000\nend\n\n00:09.000 --> 00:08.000\nback\n\n00:77.000 --> 00:78.000\nodd\n"
    got = rows(texts.subtitles(spark.createDataFrame([("s", cue)], "source string, text string")))
    assert got == [("s", "s:0", 1.0, 2.5, "Tom & Ann"), ("s", "s:2", 3603.0, 3604.0, "end")]


def test_html(spark, rows):
    page = "<html><head><title>Quiet song</title><script>song</script></head><body><h1>Song list</h1><div class='r top'><a href='/1'>One</a></div><div class='r' hidden><a href='/2'>Two</a></div><p style='display: none'>x</p><ul id=u><li>A<br>song</ul></body></html>"
    assert texts.select(page, "div.r a") == [("One", {"href": "/1"})] and [t for t, _ in texts.select(page, "#u li, h1")] == ["Song list", "Asong"]
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert rows(texts.html_rows(df, "id", "html", "a[href]", "href")) == [(1, 1, "One", "/1")]
    audit = texts.page_audit(df, "id", "html", "song").where("id = 1").first()
    assert (audit.title_matches, audit.h1_matches) == (1, 1) and "Two" not in audit.visible
    with pytest.raises(ValueError):
        texts.select(page, "a:hover")


def test_json_csv_and_exports(spark, tmp_path, rows):
    (tmp_path / "v.json").write_text(json.dumps({"data": {"videos": [{"id": "1", "viewCount": "12"}, {"id": "2", "viewCount": None}]}}))
    found = records.json_rows(spark, [str(tmp_path / "v.json")], "data.videos", "struct<id:string,viewCount:string>")
    assert rows(records.records(found).select("record_id", F.col("views").cast("int"))) == [("1", 12), ("2", None)]
    (tmp_path / "p.csv").write_text('Top queries,Clicks,Impressions,CTR,Position\nquiet song,7,"1,000",0.7%,4.5\n')
    perf = records.csv_rows(spark, [str(tmp_path / "p.csv")], "`Top queries` string, Clicks string, Impressions string, CTR string, Position string")
    assert rows(records.performance_csv(perf)) == [("quiet song", None, 7.0, 1000.0, pytest.approx(0.007), 4.5)]
    export = spark.createDataFrame([("a", "1,200"), ("b", "<10"), ("c", "N/A"), ("d", "10-20"), ("e", "Breakout"), (" ", "5")], "k string, v string")
    got = {r.phrase: (r.value, r.label, r.censored, r.availability) for r in records.native_export(export, "k", "v", {"unit": "count"}).collect()}
    assert got == {"a": (1200.0, None, False, "observed"), "b": (None, "<10", True, "observed"), "c": (None, None, False, "unavailable"), "d": (None, "10-20", True, "observed"), "e": (None, "Breakout", False, "observed")}
    tool = spark.createDataFrame([("k", "0", "N/A")], "Keyword string, Volume string, CPC string")
    assert rows(records.tool_export(tool, "Keyword", {"Volume": ("volume", "count"), "CPC": ("cpc", "USD")}).select("metric", "value")) == [("cpc", None), ("volume", 0.0)]
    dates = spark.createDataFrame([("/Date(1714557600000+0530)/",), ("/Date(-62135596800000)/",), ("x",)], "d string").select(records.native_dates(F.col("d")).alias("x"))
    assert [(r.x.micros, r.x.offset_minutes) if r.x else None for r in dates.collect()] == [(1714557600000000, 330), None, None]


def test_trend_csv(spark, rows):
    text = 'Category: All\n\nWeek,"Song, quiet: (GB)",IsPartial\n2024-01-01,<1,false\n2024-01-08,,false\n2024-01-15,40,true\n'
    points = records.trend_points(records.trend_csv(spark.createDataFrame([("f", text), ("g", None)], "source string, text string")))
    assert rows(points.select("period", "series", "value", "censored", "missing", "partial")) == [("2024-01-01", "song, quiet", None, True, False, False), ("2024-01-08", "song, quiet", None, False, True, False), ("2024-01-15", "song, quiet", 40.0, False, False, True)]


def test_nested_documents(spark, rows):
    tree = [{"kind": "Listing", "data": {"children": [{"kind": "t3", "data": {"id": "p"}}]}}, {"kind": "Listing", "data": {"children": [{"kind": "t1", "data": {"id": "c", "parent_id": "t3_p", "replies": {"kind": "Listing", "data": {"children": [{"kind": "t1", "data": {"id": "d", "parent_id": "t1_c"}}, {"kind": "more", "data": {"children": ["e", "f"]}}]}}}}]}}]
    got = records.listing_things(spark.createDataFrame([(1, json.dumps(tree))], "k int, t string"), "k", "t")
    assert rows(got.select("position", "kind", "id", "depth")) == [(0, "t3", "p", 0), (1, "t1", "c", 0), (2, "t1", "d", 1), (3, "more", "e", 1), (4, "more", "f", 1)]
    saved = {"plugin": "x", "metadata": {"geography": "GB"}, "keywords": [{"phrase": "song", "relationship": "r", "evidence": [{"source": "s", "metric": "m", "value": "12", "unit": "count", "observed_at": "2024-01-01"}]}]}
    found = records.saved_results(spark.createDataFrame([(json.dumps(saved),)], "t string"), "t").first()
    assert (found.phrase, found.value, found.geography) == ("song", 12.0, "GB")
    months = spark.createDataFrame([("k", {"m1": "5", "m1_month": "4", "m1_year": "2024", "m2": "7", "m2_month": "5", "m2_year": "2024", "m60": "1"})], "phrase string, slots map<string,string>")
    assert rows(records.monthly_series(months, "phrase", F.col("slots"), F.lit(dt.date(2024, 5, 20)))) == [("k", dt.date(2024, 4, 1), 5.0, True), ("k", dt.date(2024, 5, 1), 7.0, False)]
    assert records.secret_paths({"a": [{"Api_Key": 1}]}) == ["$.a[0].Api_Key"]


def test_keyword_payloads(spark):
    block = lambda mode, mark="": {"type": "text", "text": mark + json.dumps({"mode": mode, "x": 1})}
    documents = {
        "bare": {"mode": "rising"}, "wrapped": {"content": [block("research", "Keyword data (JSON):\n"), {"type": "text", "text": "hello"}, {"type": "image"}]},
        "structured": {"structuredContent": {"mode": "questions", "x": 2}}, "inner": {"structuredContent": {"content": [block("country_top")]}}, "failed": {"isError": True, "mode": "research"},
        "none": {"content": []}, "two": {"content": [block("rising"), block("research")]}, "other": {"mode": "guess"}, "foreign": {"content": [block("guess"), block("rising")]}, "no array": {"content": "x"}, "list": [1],
    }
    data = [(k, json.dumps(v)) for k, v in documents.items()] + [("text", "no json"), ("null", None)]
    got = {r.k: (r.mode, r.x, r.problem) for r in records.keyword_payloads(spark.createDataFrame(data, "k string, t string"), "k", "t").select("k", "mode", F.try_variant_get("payload", "$.x", "int").alias("x"), "problem").collect()}
    assert got == {
        "bare": ("rising", None, None), "wrapped": ("research", 1, None), "structured": ("questions", 2, None), "inner": ("country_top", 1, None), "failed": (None, None, "failed-call"), "none": (None, None, "not-one-payload"),
        "two": (None, None, "not-one-payload"), "other": (None, None, "unknown-mode"), "foreign": ("rising", 1, None), "no array": (None, None, "content-no-array"), "list": (None, None, "no-object"), "text": (None, None, "no-object"), "null": (None, None, "no-object"),
    }


def test_listings_that_are_none(spark):
    deep = {"kind": "t1", "data": {"id": "z"}}
    for n in range(30):
        deep = {"kind": "t1", "data": {"id": f"n{n}", "replies": {"kind": "Listing", "data": {"children": [deep]}}}}
    data = [(1, json.dumps(deep)), (2, None), (3, '{"kind": "Listing", "data": {"children": []}}'), (4, '{"kind": "t5", "id": "s", "meta": {"a": 1}}')]
    got = records.listing_things(spark.createDataFrame(data, "k int, t string"), "k", "t").orderBy("k", "position").collect()
    assert [(r.k, r.depth) for r in got] == [(1, d) for d in range(31)] + [(4, 0)] and json.loads(got[-1].data)["meta"] == {"a": 1}
    with pytest.raises(Exception, match="neither a listing nor a thing"):
        records.listing_things(spark.createDataFrame([(1, '{"a": [1]}')], "k int, t string"), "k", "t").collect()


def test_connector_replay_and_batch(spark, tmp_path, rows):
    for seed, pages in {"song": [(["a", "b"], "1"), (["c"], None)], "demo": [(["d"], None)]}.items():
        (tmp_path / seed).mkdir()
        for n, (found, following) in enumerate(pages):
            (tmp_path / seed / f"{n}.json").write_text(json.dumps({"rows": found, "next": following}))
    got = connectors.read_pages(spark, ["song", "demo"], folder=str(tmp_path))
    assert rows(got) == [("demo", 0, 0, '"d"'), ("song", 0, 0, '"a"'), ("song", 0, 1, '"b"'), ("song", 1, 0, '"c"')]
    registry = connectors.Registry()
    registry.add("one", "a row", lambda s, n=1: s.range(n).toDF("x"))
    registry.add("one", "ignored", None)
    registry.add("bad", "fails", lambda s: 1 / 0)
    registry.add("late", "fails when read", lambda s: s.range(3).select(F.assert_true(F.col("id") < 2).cast("string").alias("x")))
    found, status = connectors.batch(registry, spark, [{"id": "t1", "operator": "one", "options": {"n": 2}}, {"id": "t2", "operator": "bad"}, {"id": "t3", "operator": "none"}, {"id": "t4", "operator": "late"}, {"id": "t5", "operator": "one"}])
    assert found.count() == 3 and [r.status for r in status.orderBy("task").collect()] == ["ok", "unavailable", "unavailable", "unavailable", "ok"] and registry.describe(spark).count() == 3
    model = connectors.mapped_model(spark.createDataFrame([("a",), ("b",)], "t string"), "t", "answer", lambda: lambda xs: [x.upper() for x in xs])
    assert sorted(r.answer for r in model.collect()) == ["A", "B"]
    answers = spark.createDataFrame([(1, "Keywords: Song, demo\n1. Quiet  clip; x\n- demo"), (2, "related words: STRASSE | straße 2) 'two words.' 3) 4k video, " + "y" * 81), (3, None), (4, "")], "k int, t string")
    got = connectors.phrases_in_answer(answers, "k", "t").orderBy("k", "position").collect()
    assert [(r.k, r.phrase) for r in got] == [(1, "song"), (1, "demo"), (1, "quiet clip"), (2, "strasse"), (2, "two words"), (2, "4k video")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "r", 0.5), ("a", "r", None)], "phrase string, relationship string, score double")
    assert sinks.phrase_list(df, "relationship").first().phrases == '["a","b"]'
    sinks.write_text(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a\tr", "b\tr (0.5)"]
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert [sinks.append_new(ids, str(tmp_path / "s")) for _ in range(2)] == [2, 0]
    more = spark.createDataFrame([(2,), (3,)], "id int")
    assert sinks.append_new(more, str(tmp_path / "s")) == 1 and sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 2, 3]


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    schema = "id int, k string, observed_at timestamp, value double"
    for n, data in enumerate([[(1, "a", t(0), 1.0), (2, "a", t(5), 9.0)], [(2, "a", t(5), 9.0), (3, "a", t(1), 50.0), (4, "a", t(9), 9.5), (5, "b", t(9), None), (6, "a", t(12), 2.0)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{n}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ingest.ingest(read(), str(tmp_path / "store"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2, 3, 4, 5, 6]
    q = ingest.change_alerts(read(), ["k"], "observed_at", "value").writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.before, r.after) for r in spark.table("alerts").collect()) == [(1.0, 9.0), (9.5, 2.0), (50.0, 9.0)]
    w = ingest.windowed(ingest.distinct_within(read(), "id", "observed_at", "1 hour"), "observed_at", ["k"], "10 minutes", delay="1 hour")
    assert w.isStreaming and ingest.sessions(read(), "observed_at", ["k"]).isStreaming


def test_alerts_of_whole_observations_are_comparable_ones(spark, tmp_path):
    from gleanwright.operators import monitor

    day = lambda n: dt.datetime(2024, 5, n)
    fields = "phrase string, value double, observed_at timestamp, approximate boolean"
    rows = [("up", 1.0, day(1), False), ("up", 5.0, day(3), False), ("rough", 1.0, day(1), True), ("rough", 9.0, day(3), True), ("clash", 1.0, day(1), False), ("clash", 2.0, day(1), False), ("clash", 9.0, day(3), False), ("late", 1.0, day(1), False), ("late", 9.0, day(5), False)]
    more = [("late", 4.0, day(3), False), ("up", 5.0, day(3), False)]
    for n, data in enumerate((rows, more)):
        made = spark.createDataFrame(data, fields).select("*", *[F.lit(v).alias(c) for c, v in {"subject": "s", "platform": "p", "source": "x", "metric": "m", "unit": "count", "scope": "web", "window": "week", "geography": "GB", "evidence_kind": "search_volume_estimate", "completeness": "complete"}.items()])
        monitor.validated(made, F.lit(day(20))).drop("dimensions").coalesce(1).write.parquet(str(tmp_path / "in" / f"d{n}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "d0")).schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    alerts = ingest.change_alerts(read, ["phrase"], "observed_at", "value")
    alerts.writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.phrase, r.before, r.after) for r in spark.table("whole").collect()) == [("late", 1.0, 9.0), ("late", 4.0, 9.0), ("up", 1.0, 5.0)]
