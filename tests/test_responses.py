"""Parsers of saved responses on small documents of the services' shapes."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from gleanwright.sources import responses as R

DOCS = "k string, t string"


def docs(spark, **texts):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in texts.items()], DOCS)


def cells(df):
    return sorted(((r.k, r.position, r.phrase, r.metric, r.value, r.label, r.unit) for r in df.where("problem IS NULL").collect()), key=repr)


def problems(df):
    return {r.k: r.problem for r in df.where("problem IS NOT NULL").collect()}


def test_nested_arrays_and_tasks(spark):
    item = {"keyword": " quiet song ", "keyword_info": {"search_volume": 120, "cpc": "0.5", "competition": None}, "keyword_properties": {"keyword_difficulty": 7}}
    answer = lambda code=20000, task=20000: {"status_code": code, "tasks": [{"status_code": task, "result": [{"items": [item]}, {"items": None}]}]}
    got = R.response_rows(docs(spark, a=answer(), b=answer(50000), c=answer(20000, 40501), d="no json", e=None), "k", "t", "dataforseo ideas")
    assert cells(got) == sorted([("a", 1, "quiet song", "cpc", 0.5, None, "USD"), ("a", 1, "quiet song", "estimated_search_volume", 120.0, None, "searches_per_month"), ("a", 1, "quiet song", "organic_keyword_difficulty", 7.0, None, "index_0_100"), ("a", 1, "quiet song", "paid_competition", None, None, "index_0_1")], key=repr)
    assert problems(got) == {"b": "not-successful", "c": "not-successful", "d": "no-json", "e": "no-json"}


def test_order_labels_flags_and_counts(spark):
    got = R.response_rows(docs(spark, a=["q", ["b", "a"]], b=["q"], c=["q", [""]]), "k", "t", "google-autocomplete suggestions")
    assert [x[1:5] for x in cells(got)] == [(1, "b", "suggestion_order", 1.0), (2, "a", "suggestion_order", 2.0)] and problems(got) == {"b": "no-rows", "c": "no-phrase"}
    ads = R.response_rows(docs(spark, a={"results": [{"text": "x", "keywordIdeaMetrics": {"competition": "HIGH", "avgMonthlySearches": "90"}}]}, b={"results": []}), "k", "t", "google-ads ideas")
    assert [(x[3], x[4], x[5]) for x in cells(ads) if x[4] is not None or x[5]] == [("avg_monthly_searches", 90.0, None), ("paid_competition", None, "HIGH")] and problems(ads) == {}
    rank = R.response_rows(docs(spark, a=[{"keyword": "x", "is_data_found": False, "volume": 5}, {"keyword": "y", "volume": 6}]), "k", "t", "seranking metrics")
    assert [(x[2], x[4]) for x in cells(rank) if x[3] == "estimated_monthly_searches"] == [("x", None), ("y", 6.0)]
    songs = R.response_rows(docs(spark, a={"resultCount": 1, "results": [{"trackName": "S", "kind": "song"}]}, b={"resultCount": 2, "results": [{"trackName": "S", "kind": "song"}]}, c={"resultCount": 1, "results": [{"trackName": "S", "kind": "podcast"}]}), "k", "t", "itunes-catalog songs")
    assert [x[:4] for x in cells(songs)] == [("a", 1, "S", None)] and problems(songs) == {"b": "count-differs", "c": "unexpected-kind"}
    error = R.response_rows(docs(spark, a={"error": "no credit", "results": []}, b={"search_metadata": {"status": "Processing"}, "related_questions": []}), "k", "t", "serpapi questions")
    assert problems(error) == {"a": "error", "b": "not-successful"}


@pytest.mark.parametrize("name", sorted(R.RESPONSES))
def test_made_up_responses_read_back(spark, name):
    spec = R.RESPONSES[name]
    metrics = [m for m, _, _ in spec.metrics]
    data = [(1, n, f"p{n}", *[float(n + k) for k in range(len(metrics))]) for n in (1, 2, 3)]
    rows = spark.createDataFrame(data, ", ".join(["k int", "position int", "phrase string", *[f"{m} double" for m in metrics]]))
    got = R.response_rows(R.as_response(rows, "k", name), "k", "text", name)
    want = [(p, m, v) for _, n, p, *values in data for m, v in [*zip(metrics, values), *([(spec.order, float(n))] if spec.order else [])] or [(None, None)]]
    assert sorted(((r.phrase, r.metric, r.value) for r in got.collect()), key=repr) == sorted(want, key=repr) and problems(got) == {}


def test_objects_by_phrase_and_semicolon_reports(spark):
    keyed = R.keyed_metrics(docs(spark, a='{"results": {"zeta": {"volume": 5, "cpc": null}, "alpha": {"string": "Alpha", "volume": "7"}}}'), "k", "t")
    assert sorted((r.position, r.phrase, r.metric, r.value) for r in keyed.where("value IS NOT NULL").collect()) == [(1, "zeta", "estimated_search_volume", 5.0), (1, "zeta", "returned_order", 1.0), (2, "Alpha", "estimated_search_volume", 7.0), (2, "Alpha", "returned_order", 2.0)]
    head = "Keyword;Search Volume;CPC;Competition\r\n"
    got = R.delimited_metrics(docs(spark, a=head + 'one;10;0.5;0.1\r\n"two; three";20;;0.2\r\n', b="ERROR 50 :: NOTHING FOUND", c="ERROR 120 :: WRONG KEY", d="<html>", e=head + "short;1"), "k", "t")
    assert sorted((r.k, r.phrase, r.value) for r in got.where("metric = 'estimated_search_volume'").collect()) == [("a", "one", 10.0), ("a", "two; three", 20.0)]
    assert problems(got) == {"c": "error", "d": "unexpected-header", "e": "malformed-record"}


def test_question_tree(spark):
    tree = {"status": "success", "queries": [{"term": "t", "results": [{"question": "a", "results": [{"question": "b", "results": [{"question": "c"}]}, {"question": "d"}]}, {"question": "e"}]}]}
    got = R.question_tree(docs(spark, a=tree, b=None), "k", "t").orderBy("position").collect()
    assert [(r.question, r.parent, r.depth) for r in got] == [("a", "t", 1), ("b", "a", 2), ("c", "b", 3), ("d", "a", 2), ("e", "t", 1)]
    with pytest.raises(Exception, match="not complete"):
        R.question_tree(docs(spark, a={"status": "pending"}), "k", "t").collect()


def test_result_pages(spark):
    flat = {"organic_results": [{"position": 2, "link": "https://a/", "title": "A"}], "related_searches": [{"query": "r"}], "related_questions": [{"question": "q"}], "ads": [], "search_information": {"total_results": 99}, "ai_overview": {"references": [{"link": "https://s/", "title": "S"}]}, "serpapi_pagination": {"next": "n"}}
    got = R.result_page(docs(spark, a=flat, b={"search_metadata": {"status": "Error"}}, c={"x": 1}, d={"organic_results": [{"link": "u"}]}, e={"search_information": {}}), "k", "t", "flat", 10)
    shown = sorted(((r.part, r.kind, r.position, r.url, r.phrase, r.total, r.more) for r in got.where("k = 'a'").collect()), key=repr)
    assert shown == sorted([("organic", None, 12, "https://a/", None, 99, True), ("feature", "related_questions", None, None, None, 99, True), ("feature", "related_searches", None, None, None, 99, True), ("feature", "ai_overview", None, None, None, 99, True), ("suggestion", "related-search", 1, None, "r", 99, True), ("suggestion", "people-also-ask", 1, None, "q", 99, True), ("reference", None, 1, "https://s/", None, 99, True)], key=repr)
    assert problems(got) == {"b": "not-successful", "c": "no-results", "d": "no-rank"}
    typed = {"se_results_count": 5, "items": [{"type": "organic", "rank_group": 1, "rank_absolute": 3, "url": "u"}, {"type": "related_searches", "items": ["w", {"title": "x"}]}, {"type": "people_also_ask", "items": [{"title": "y"}, {}]}, {"type": "ai_overview", "references": [{"url": "v"}, {}]}]}
    got = R.result_page(docs(spark, a=typed, b={"items_count": 0, "items": None}, c={}), "k", "t", "typed")
    assert sorted(((r.part, r.kind, r.absolute_position, r.url, r.phrase) for r in got.where("k = 'a'").collect()), key=repr) == sorted([("organic", None, 3, "u", None), *[("feature", f, None, None, None) for f in ("related_searches", "people_also_ask", "ai_overview")], ("suggestion", "related-search", None, None, "w"), ("suggestion", "related-search", None, None, "x"), ("suggestion", "people-also-ask", None, None, "y"), ("reference", None, None, "v", None)], key=repr)
    assert problems(got) == {"c": "no-results"}


def test_reports(spark):
    row = {"Query": "https://x/", "Date": "/Date(1714435200000-0700)/", "Position": 3, "Clicks": 2, "Impressions": 9, "AvgImpressionPosition": 4.5}
    got = R.native_performance(docs(spark, a={"d": [row]}, b={"d": None}, c={"ErrorCode": 3}, d={"d": [{"Query": "x", "Date": "/Date(1714435200000)/"}]}, e={"d": [{"Query": "https://x/"}]}), "k", "t", "pages")
    a = got.where("k = 'a'").first()
    assert (a.query, a.page, a.date, a.position_bucket, a.clicks, a.average_impression_position) == (None, "https://x/", dt.date(2024, 4, 29), None, 2, 4.5)
    assert problems(got) == {"b": "no-rows", "c": "error", "d": "no-address", "e": "no-date"}
    assert R.native_performance(docs(spark, a={"d": [row]}), "k", "t", "detail").first().position_bucket == 3
    console = R.console_rows(docs(spark, a={"rows": [{"keys": ["q", "GB"], "clicks": 1, "position": 2.5}]}, b={}, c={"rows": [{"keys": ["q"]}]}), "k", "t", ["query", "country"])
    assert [(r.query, r.country, r.clicks, r.impressions, r.average_position) for r in console.where("k = 'a'").collect()] == [("q", "GB", 1.0, None, 2.5)] and problems(console) == {"c": "unexpected-dimensions"} and console.where("k = 'b'").count() == 0
    names = [{"name": "d"}, {"name": "views"}]
    report = R.column_report(docs(spark, a={"columnHeaders": names, "rows": [["x", 5], ["y", None]]}, b={"columnHeaders": names[:1]}, c={"columnHeaders": names, "rows": [["x"]]}), "k", "t", "d", {"views": ("attributed_views", "count")})
    assert sorted((r.phrase, r.value) for r in report.where("k = 'a' AND value IS NOT NULL").collect()) == [("x", 5.0)] and problems(report) == {"b": "unexpected-columns", "c": "unexpected-rows"}


def test_typed_records(spark):
    got = R.typed_records(docs(spark, a={"items": [{"id": "v", "snippet": {"title": "T", "tags": ["x"]}, "statistics": {"viewCount": "12345678901234567890"}}]}, b={"items": [{"snippet": {}}]}, c={"error": {"code": 403}}, d={}), "k", "t", "youtube videos")
    a = got.where("k = 'a'").first()
    assert (a.id, a.title, a.tags, int(a.views), a.likes) == ("v", "T", ["x"], 12345678901234567890, None) and problems(got) == {"b": "unnamed-record", "c": "error", "d": "no-rows"}
    ok = R.typed_records(docs(spark, a={"data": {"videos": [{"id": 7, "hashtag_names": ["a"], "create_time": 5}]}, "error": {"code": "ok"}}), "k", "t", "tiktok research-videos").first()
    assert (ok.id, ok.tags, ok.created, ok.problem) == ("7", ["a"], 5, None)
