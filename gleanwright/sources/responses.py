"""Saved responses of measurement services into long evidence and typed records.

A response is JSON of any nesting; what to read from it is declared, not coded:
paths of the array of rows, of the phrase and of each metric with its unit.
Reading is JVM-side (``try_parse_json``, ``try_variant_get``).  A document that
fails, lacks its rows or isn't what was asked for gives no rows but one with its
``problem``: nothing partial is accepted.  A missing measurement is null, never
zero; what is no number stays as ``label``.  Null texts give ``no-json``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwright.sources.records import folded_questions, native_dates

ERRORS = ("$.error", "$.errors", "$.ErrorCode")


@dataclass(frozen=True)
class Response:
    """source and relationship label the evidence; rows: paths of arrays, one inside the other;
    phrase: path in a row, ``$`` if the row is the phrase; metrics: (metric, path, unit); order:
    metric of the place in the response; asks: (path, value) that a document must hold; counts:
    path of the number of rows; present: flag that is false in rows without measurements."""

    source: str
    rows: tuple[str, ...]
    phrase: str
    metrics: tuple[tuple[str, str, str], ...] = ()
    order: str | None = None
    relationship: str = "suggestion"
    asks: tuple[tuple[str, str], ...] = ()
    counts: str | None = None
    present: str | None = None
    only: tuple[str, str] | None = None


# Where the services' responses hold phrases and measurements, and in what units.
_LABS = (("$.tasks", "$.result", "$.items"), "$.keyword", (
    ("estimated_search_volume", "$.keyword_info.search_volume", "searches_per_month"), ("cpc", "$.keyword_info.cpc", "USD"),
    ("paid_competition", "$.keyword_info.competition", "index_0_1"), ("organic_keyword_difficulty", "$.keyword_properties.keyword_difficulty", "index_0_100"),
))
_EXPLORER = (("$.keywords",), "$.keyword", (
    ("estimated_search_volume", "$.volume", "searches_per_month"), ("organic_keyword_difficulty", "$.difficulty", "index_0_100"), ("cpc", "$.cpc", "USD_cents"),
))
_RANKING_METRICS = (
    ("estimated_monthly_searches", "$.volume", "searches_per_month"), ("paid_competition", "$.competition", "index_0_1"), ("organic_difficulty", "$.difficulty", "provider_index_0_100"),
    ("cpc", "$.cpc", "provider_currency_unspecified"), ("related_relevance", "$.relevance", "provider_score"),
)
_PLANNER = lambda key: (
    ("avg_monthly_searches", f"$.{key}.avgMonthlySearches", "searches_per_month"), ("paid_competition", f"$.{key}.competition", "enum"), ("paid_competition_index", f"$.{key}.competitionIndex", "index_0_100"),
    ("low_top_of_page_bid", f"$.{key}.lowTopOfPageBidMicros", "account_currency_micros"), ("high_top_of_page_bid", f"$.{key}.highTopOfPageBidMicros", "account_currency_micros"),
)
_DONE = (("$.search_metadata.status", "Success"),)
_TASKED = (("$.status_code", "20000"), ("$.tasks[0].status_code", "20000"))
RESPONSES = {
    "dataforseo ideas": Response("DataForSEO Labs Google", *_LABS, asks=_TASKED, relationship="ideas"),
    "dataforseo suggestions": Response("DataForSEO Labs Google", *_LABS, asks=_TASKED, relationship="suggestions"),
    "dataforseo metrics": Response("DataForSEO Labs Google", *_LABS, asks=_TASKED, relationship="metrics"),
    "ahrefs matching-terms": Response("Ahrefs Keywords Explorer", *_EXPLORER, relationship="matching-terms"),
    "ahrefs questions": Response("Ahrefs Keywords Explorer", *_EXPLORER, relationship="questions"),
    "keywords-everywhere metrics": Response("Keywords Everywhere", ("$.data",), "$.keyword", (("estimated_search_volume", "$.vol", "searches_per_month"), ("cpc", "$.cpc.value", "currency"), ("paid_competition", "$.competition", "index_0_1")), relationship="metrics"),
    "seranking metrics": Response("SE Ranking", ("$",), "$.keyword", _RANKING_METRICS, relationship="metrics", present="$.is_data_found"),
    **{f"seranking {op}": Response("SE Ranking", ("$.keywords",), "$.keyword", _RANKING_METRICS, relationship=op, present="$.is_data_found") for op in ("related", "similar", "questions")},
    "seranking longtail": Response("SE Ranking", ("$.keywords",), "$", relationship="long-tail-suggestion"),
    "google-ads ideas": Response("Google Ads API", ("$.results",), "$.text", _PLANNER("keywordIdeaMetrics"), relationship="ideas"),
    "google-ads metrics": Response("Google Ads API", ("$.results",), "$.text", _PLANNER("keywordMetrics"), relationship="metrics"),
    "search-console queries": Response("Google Search Console", ("$.rows",), "$.keys[0]", (("clicks", "$.clicks", "count"), ("impressions", "$.impressions", "count"), ("ctr", "$.ctr", "fraction_0_1"), ("average_position", "$.position", "position")), relationship="observed-query"),
    "serpapi autocomplete": Response("SerpApi Google", ("$.suggestions",), "$.value", order="returned_order", asks=_DONE, relationship="autocomplete"),
    "serpapi related-searches": Response("SerpApi Google", ("$.related_searches",), "$.query", order="returned_order", asks=_DONE, relationship="related-searches"),
    "serpapi questions": Response("SerpApi Google", ("$.related_questions",), "$.question", order="returned_order", asks=_DONE, relationship="questions"),
    "brave-suggest suggestions": Response("Brave Suggest API", ("$.results",), "$.query", order="suggestion_order"),
    **{f"datamuse {op}": Response("Datamuse", ("$",), "$.word", (("lexical_match_score", "$.score", "provider_rank_score"),), relationship=op) for op in ("related", "synonyms", "suggestions")},
    "wikipedia suggestions": Response("Wikipedia OpenSearch", ("$[1]",), "$", order="suggestion_order", relationship="related-topic"),
    **{f"{name}-autocomplete suggestions": Response(f"{name}-autocomplete", ("$[1]",), "$", order="suggestion_order") for name in ("google", "bing", "duckduckgo")},
    "itunes-catalog songs": Response("Apple iTunes Search", ("$.results",), "$.trackName", relationship="catalogue-title", counts="$.resultCount", only=("$.kind", "song")),
}


def got(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def array_at(document: Column, paths: tuple[str, ...]) -> Column:
    """The rows of arrays one inside the other; null if the outermost is none."""
    inner = lambda path: lambda r: F.coalesce(got(r, path, "array<variant>"), F.array().cast("array<variant>"))
    found = got(document, paths[0], "array<variant>")
    for path in paths[1:]:
        found = F.flatten(F.transform(found, inner(path)))
    return found


def problem_of(document: Column, rows: Column, spec: Response) -> Column:
    failed = F.coalesce(*[F.when(got(document, e, "variant").isNotNull(), True) for e in ERRORS], F.lit(False))
    told = F.when(document.isNull(), "no-json").when(failed & F.lit(spec.rows[0] != "$"), "error")
    for path, value in spec.asks:
        told = told.when(~got(document, path).eqNullSafe(F.lit(value)), "not-successful")
    told = told.when(rows.isNull(), "no-rows")
    if spec.counts:
        told = told.when(~got(document, spec.counts, "bigint").eqNullSafe(F.size(rows).cast("bigint")), "count-differs")
    if spec.only:
        told = told.when(F.exists(rows, lambda r: ~got(r, spec.only[0]).eqNullSafe(F.lit(spec.only[1]))), "unexpected-kind")
    return told.when(F.exists(rows, lambda r: F.coalesce(F.trim(got(r, spec.phrase)), F.lit("")) == ""), "no-phrase")


def response_rows(documents: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, position, phrase, relationship, source, metric, value, label, unit, problem): one row
    for each metric of each phrase, with a null metric where a service gives none."""
    spec = RESPONSES[name]
    read = documents.select(key, F.try_parse_json(text).alias("d"))
    read = read.select(key, "d", array_at(F.col("d"), spec.rows).alias("rows"))
    judged = read.select(key, problem_of(F.col("d"), F.col("rows"), spec).alias("problem"), "rows")
    good = judged.select(key, "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("rows"))).alias("at", "r")).where("problem IS NOT NULL OR at IS NOT NULL")
    row, place = F.col("r"), F.col("at") + 1
    there = F.coalesce(got(row, spec.present, "boolean"), F.lit(True)) if spec.present else F.lit(True)
    cells = [F.struct(F.lit(m).alias("metric"), F.when(there, got(row, path)).alias("raw"), F.lit(unit).alias("unit")) for m, path, unit in spec.metrics]
    if spec.order:
        cells.append(F.struct(F.lit(spec.order).alias("metric"), place.cast("string").alias("raw"), F.lit("ordinal").alias("unit")))
    out = good.select(key, "problem", place.alias("position"), F.trim(got(row, spec.phrase)).alias("phrase"), F.explode_outer(F.when(F.col("problem").isNull(), F.array(*cells)) if cells else F.lit(None).cast("array<struct<metric:string,raw:string,unit:string>>")).alias("m"))
    value = F.col("m.raw").try_cast("double")
    label = F.when(value.isNull(), F.col("m.raw"))
    return out.select(key, "position", "phrase", F.lit(spec.relationship).alias("relationship"), F.lit(spec.source).alias("source"), "m.metric", value.alias("value"), label.alias("label"), "m.unit", "problem")


def as_response(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, text): what a service would send for rows (key, phrase, one column per metric), for
    replay.  The rows of a key are in one document, in the order of ``position``."""
    spec = RESPONSES[name]

    def nested(fields: dict[str, Column]) -> Column:
        tree: dict = {}
        for path, column in fields.items():
            *outer, last = path.removeprefix("$.").split(".")
            node = tree
            for part in outer:
                node = node.setdefault(part, {})
            node[last] = column
        build = lambda node: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])
        return build(tree)

    plain = {f"$.{p.split('[')[0].removeprefix('$.')}": (F.array(c) if "[" in p else c) for p, c in {spec.phrase: F.col("phrase"), **{path: F.col(m) for m, path, _ in spec.metrics}}.items()}
    item = F.col("phrase") if spec.phrase == "$" else nested(plain | ({spec.only[0]: F.lit(spec.only[1])} if spec.only else {}))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("position"), item.alias("i")))).alias("l")).withColumn("l", F.transform("l", lambda x: x["i"]))
    outer, size = F.col("l"), F.size("l")
    if spec.rows == ("$",):
        return gathered.select(key, F.to_json(outer).alias("text"))
    if spec.rows == ("$[1]",):
        return gathered.select(key, F.concat(F.lit('["q",'), F.to_json(outer), F.lit("]")).alias("text"))
    for path in reversed(spec.rows[1:]):
        outer = F.array(F.struct(F.lit("20000").alias("status_code"), outer.alias(path[2:])))
    fields = {spec.rows[0]: outer} | {p: F.lit(v) for p, v in spec.asks if "[" not in p} | ({spec.counts: size} if spec.counts else {})
    return gathered.select(key, F.to_json(nested(fields)).alias("text"))


def keyed_metrics(documents: DataFrame, key: str, text: str, currency: str = "USD") -> DataFrame:
    """(key, position, phrase, metric, value, unit) of responses whose ``results`` are an object by
    phrase, in the order of its fields."""
    results = F.get_json_object(text, "$.results")
    word = documents.select(key, results.alias("o"), F.posexplode(F.json_object_keys(results)).alias("at", "word"))
    row = F.try_element_at(F.try_variant_get(F.try_parse_json("o"), "$", "map<string,variant>"), "word")
    # Metrics of a phrase and their units.
    metrics = (("returned_order", None, "ordinal"), ("estimated_search_volume", "$.volume", "searches_per_month"), ("cpc", "$.cpc", currency), ("paid_competition", "$.cmp", "index_0_1"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), ((F.col("at") + 1).cast("double") if path is None else got(F.col("r"), path).try_cast("double")).alias("value"), F.lit(unit).alias("unit")) for m, path, unit in metrics])
    read = word.withColumn("r", row)
    out = read.select(key, (F.col("at") + 1).alias("position"), F.coalesce(got(F.col("r"), "$.string"), "word").alias("phrase"), F.explode(cells).alias("m"))
    return out.select(key, "position", "phrase", "m.*")


def delimited_metrics(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, phrase, metric, value, unit, problem) of reports by semicolons; an answer
    that there is nothing gives no row, another error or header a problem."""
    # The header, the metrics below it, and the answer without data.
    header, metrics = "Keyword;Search Volume;CPC;Competition", (("estimated_search_volume", "volume", "searches_per_month"), ("cpc", "cpc", "USD"), ("paid_competition", "competition", "index_0_1"))
    trimmed = F.trim(F.regexp_replace(text, r"^﻿", ""))
    lines = F.split(trimmed, r"\r?\n")
    problem = F.when(F.startswith(trimmed, F.lit("ERROR 50")), None).when(trimmed.isNull() | F.startswith(trimmed, F.lit("ERROR")), "error").when(F.regexp_replace(lines[0], '"', "") != header, "unexpected-header")
    empty = F.startswith(trimmed, F.lit("ERROR 50"))
    told = documents.select(key, problem.alias("problem"), F.posexplode_outer(F.when(problem.isNull() & ~empty, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))).alias("at", "line")).where("problem IS NOT NULL OR line <> ''")
    fields = F.from_csv("line", "phrase string, volume string, cpc string, competition string, more string", {"sep": ";"})
    read = told.select(key, "problem", (F.col("at") + 1).alias("position"), fields.alias("f"))
    odd = F.when(F.col("f").isNotNull() & (F.col("f.competition").isNull() | F.col("f.more").isNotNull()), "malformed-record")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"f.{c}").try_cast("double").alias("value"), F.lit(unit).alias("unit")) for m, c, unit in metrics])
    out = read.select(key, "position", "f.phrase", F.coalesce("problem", odd).alias("problem"), F.explode_outer(F.when(F.coalesce("problem", odd).isNull(), cells)).alias("m"))
    return out.select(key, "position", "phrase", "m.metric", "m.value", "m.unit", "problem")


def question_tree(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, question, parent, depth) of nested questions, in the order of the tree."""
    return folded_questions(documents, key, text)


# Parts of a result page that are no organic results.
PAGE_FEATURES = (
    "ads", "shopping_results", "local_results", "knowledge_graph", "answer_box", "inline_videos", "video_results", "news_results", "top_stories",
    "images_results", "related_questions", "related_searches", "ai_overview",
)
PAGE = "struct<part:string,kind:string,position:int,absolute_position:int,url:string,title:string,snippet:string,phrase:string>"


def _parts(name: str, rows: Column, kind: str | None = None, **fields: str) -> Column:
    """Rows of an array as parts of a page; a field is a path, or ``#`` for the place in the array."""
    cast = {"position": "int", "absolute_position": "int"}

    def part(r: Column, at: Column) -> Column:
        told = {"part": F.lit(name), "kind": F.lit(kind)}
        for f in ("position", "absolute_position", "url", "title", "snippet", "phrase"):
            path = fields.get(f)
            told[f] = (at + 1).cast("int") if path == "#" else got(r, path, cast.get(f, "string")) if path else F.lit(None).cast(cast.get(f, "string"))
        return F.struct(*[v.cast("string" if k in ("part", "kind") else cast.get(k, "string")).alias(k) for k, v in told.items()])

    return F.coalesce(F.transform(rows, part), F.array().cast(f"array<{PAGE}>"))


def result_page(documents: DataFrame, key: str, text: str, service: str, offset: int = 0) -> DataFrame:
    """(key, part, kind, position, absolute_position, url, title, snippet, phrase, total, more,
    problem) of result pages.  part: organic, suggestion, feature or reference.

    ``flat`` pages hold one array per part and count positions from the page's beginning, to
    which ``offset`` is added; ``typed`` pages hold one array of typed items."""
    v = F.col("v")
    read = documents.select(key, F.try_parse_json(text).alias("v"))
    if service == "flat":
        status = got(v, "$.search_metadata.status")
        organic = got(v, "$.organic_results", "array<variant>")
        problem = F.when(v.isNull(), "no-json").when(got(v, "$.error", "variant").isNotNull(), "error").when(status.isNotNull() & (status != "Success"), "not-successful")
        problem = problem.when(organic.isNull() & got(v, "$.search_information", "variant").isNull(), "no-results").when(F.exists(organic, lambda r: ~F.coalesce(got(r, "$.position", "int") >= 1, F.lit(False))), "no-rank")
        features = F.filter(F.array(*[F.when(~F.coalesce(F.to_json(got(v, f"$.{f}", "variant")).isin("null", "[]", "{}", "false", '""', "0"), F.lit(True)), F.lit(f)) for f in PAGE_FEATURES]), lambda x: x.isNotNull())
        parts = F.concat(
            _parts("organic", organic, position="$.position", url="$.link", title="$.title", snippet="$.snippet"),
            F.transform(features, lambda x: F.struct(F.lit("feature").alias("part"), x.alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("position", "int"), ("absolute_position", "int"), ("url", "string"), ("title", "string"), ("snippet", "string"), ("phrase", "string"))])),
            _parts("suggestion", got(v, "$.related_searches", "array<variant>"), kind="related-search", position="#", phrase="$.query"),
            _parts("suggestion", got(v, "$.related_questions", "array<variant>"), kind="people-also-ask", position="#", phrase="$.question"),
            _parts("reference", F.filter(got(v, "$.ai_overview.references", "array<variant>"), lambda r: got(r, "$.link").isNotNull()), position="#", url="$.link", title="$.title"),
        )
        total, more = got(v, "$.search_information.total_results", "bigint"), F.coalesce(got(v, "$.serpapi_pagination.next") != "", F.lit(False))
    elif service == "typed":
        items = got(v, "$.items", "array<variant>")
        problem = F.when(v.isNull(), "no-json").when(items.isNull() & ~got(v, "$.items_count", "int").eqNullSafe(F.lit(0)), "no-results")
        of = lambda *kinds: F.filter(items, lambda r: got(r, "$.type").isin(*kinds))
        inner = lambda *kinds: F.flatten(F.transform(of(*kinds), lambda r: F.coalesce(got(r, "$.items", "array<variant>"), F.array().cast("array<variant>"))))
        others = F.filter(items, lambda r: got(r, "$.type") != "organic")
        words, titled = F.filter(inner("related_searches", "people_also_search"), lambda r: got(r, "$.title").isNull()), F.filter(inner("related_searches", "people_also_search"), lambda r: got(r, "$.title").isNotNull())
        references = F.flatten(F.transform(of("ai_overview"), lambda r: F.coalesce(got(r, "$.references", "array<variant>"), F.array().cast("array<variant>"))))
        parts = F.concat(
            _parts("organic", of("organic"), position="$.rank_group", absolute_position="$.rank_absolute", url="$.url", title="$.title", snippet="$.description"),
            F.transform(others, lambda r: F.struct(F.lit("feature").alias("part"), got(r, "$.type").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("position", "int"), ("absolute_position", "int"), ("url", "string"), ("title", "string"), ("snippet", "string"), ("phrase", "string"))])),
            _parts("suggestion", words, kind="related-search", phrase="$"), _parts("suggestion", titled, kind="related-search", phrase="$.title"),
            _parts("suggestion", F.filter(inner("people_also_ask"), lambda r: got(r, "$.title").isNotNull()), kind="people-also-ask", position="#", phrase="$.title"),
            _parts("reference", F.filter(references, lambda r: got(r, "$.url").isNotNull()), position="#", url="$.url", title="$.title"),
        )
        total, more = got(v, "$.se_results_count", "bigint"), F.lit(False)
    else:
        raise ValueError(f"unknown kind of page {service}: flat or typed")
    out = read.select(key, total.alias("total"), more.alias("more"), problem.alias("problem"), F.explode_outer(F.when(problem.isNull(), parts)).alias("p"))
    shift = F.when(F.col("p.part") == "organic", F.lit(offset)).otherwise(0)
    return out.select(key, "p.part", "p.kind", (F.col("p.position") + shift).alias("position"), "p.absolute_position", "p.url", "p.title", "p.snippet", "p.phrase", "total", "more", "problem").where("part IS NOT NULL OR problem IS NOT NULL")


# What a report of the webmaster service is about, by its kind.
QUERY_KINDS, PAGE_KINDS = ("queries", "page-queries"), ("pages", "query-pages")


def native_performance(documents: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, position, query, page, date, position_bucket, clicks, impressions,
    average_click_position, average_impression_position, problem) of native reports in their ``d``
    envelope.  Reports of pages give the page where others give the query."""
    v = F.col("v")
    read = documents.select(key, F.try_parse_json(text).alias("v"))
    rows = got(v, "$.d", "array<variant>")
    problem = F.when(v.isNull(), "no-json").when(got(v, "$.ErrorCode", "variant").isNotNull() | got(v, "$.d.ErrorCode", "variant").isNotNull(), "error").when(rows.isNull(), "no-rows")
    told = read.select(key, problem.alias("p"), F.posexplode_outer(F.when(problem.isNull(), rows)).alias("at", "r")).where("p IS NOT NULL OR at IS NOT NULL")
    r, subject = F.col("r"), got(F.col("r"), "$.Query")
    at = native_dates(got(r, "$.Date"))
    day = F.date_from_unix_date(F.floor((at["micros"] + at["offset_minutes"].cast("bigint") * 60_000_000) / 86_400_000_000).cast("int"))
    wrong = F.when(F.col("r").isNotNull() & day.isNull(), "no-date")
    if kind in PAGE_KINDS:
        wrong = F.coalesce(wrong, F.when(F.col("r").isNotNull() & ~F.coalesce(subject.rlike("(?i)^https?://"), F.lit(False)), "no-address"))
    return told.select(
        key, (F.col("at") + 1).alias("position"), (subject if kind in QUERY_KINDS else F.lit(None).cast("string")).alias("query"), (subject if kind in PAGE_KINDS else F.lit(None).cast("string")).alias("page"), day.alias("date"),
        (got(r, "$.Position", "int") if kind == "detail" else F.lit(None).cast("int")).alias("position_bucket"), got(r, "$.Clicks", "bigint").alias("clicks"), got(r, "$.Impressions", "bigint").alias("impressions"),
        got(r, "$.AvgClickPosition", "double").alias("average_click_position"), got(r, "$.AvgImpressionPosition", "double").alias("average_impression_position"), F.coalesce("p", wrong).alias("problem"),
    )


def console_rows(documents: DataFrame, key: str, text: str, dimensions: list[str]) -> DataFrame:
    """(key, position, *dimensions, clicks, impressions, ctr, average_position, problem) of reports
    whose rows have one key for each dimension asked for."""
    v = F.col("v")
    read = documents.select(key, F.try_parse_json(text).alias("v"))
    rows = F.coalesce(got(v, "$.rows", "array<variant>"), F.when(v.isNotNull(), F.array().cast("array<variant>")))
    keys = lambda r: got(r, "$.keys", "array<string>")
    problem = F.when(v.isNull(), "no-json").when(got(v, "$.error", "variant").isNotNull(), "error").when(F.exists(rows, lambda r: ~F.size(keys(r)).eqNullSafe(F.lit(len(dimensions)))), "unexpected-dimensions")
    told = read.select(key, problem.alias("problem"), F.posexplode_outer(F.when(problem.isNull(), rows)).alias("at", "r")).where("problem IS NOT NULL OR at IS NOT NULL")
    r = F.col("r")
    return told.select(key, (F.col("at") + 1).alias("position"), *[keys(r)[k].alias(d) for k, d in enumerate(dimensions)], *[got(r, f"$.{p}", "double").alias(c) for p, c in (("clicks", "clicks"), ("impressions", "impressions"), ("ctr", "ctr"), ("position", "average_position"))], "problem")


def column_report(documents: DataFrame, key: str, text: str, dimension: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, position, phrase, metric, value, unit, problem) of reports of named columns and rows of
    values; metrics maps a column to (metric, unit)."""
    v = F.col("v")
    read = documents.select(key, F.try_parse_json(text).alias("v"))
    names = F.transform(got(v, "$.columnHeaders", "array<variant>"), lambda c: got(c, "$.name"))
    rows = F.coalesce(got(v, "$.rows", "array<variant>"), F.when(v.isNotNull(), F.array().cast("array<variant>")))
    values = lambda r: got(r, "$", "array<string>")
    asked = F.array(*[F.lit(c) for c in (dimension, *metrics)])
    problem = F.when(v.isNull(), "no-json").when(got(v, "$.error", "variant").isNotNull(), "error").when(names.isNull() | (F.size(F.array_distinct(names)) != F.size(names)) | (F.size(F.array_except(asked, names)) > 0), "unexpected-columns")
    problem = problem.when(F.exists(rows, lambda r: ~F.size(values(r)).eqNullSafe(F.size(names))), "unexpected-rows")
    told = read.select(key, names.alias("names"), problem.alias("problem"), F.posexplode_outer(F.when(problem.isNull(), rows)).alias("at", "r")).where("problem IS NOT NULL OR at IS NOT NULL")
    cell = lambda c: F.try_element_at(values(F.col("r")), F.array_position("names", F.lit(c)).cast("int"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), cell(c).try_cast("double").alias("value"), F.lit(unit).alias("unit")) for c, (m, unit) in metrics.items()])
    phrase = F.when(F.col("problem").isNull(), cell(dimension))
    out = told.select(key, (F.col("at") + 1).alias("position"), F.trim(phrase).alias("phrase"), "problem", F.explode_outer(F.when(F.col("problem").isNull(), cells)).alias("m"))
    return out.select(key, "position", "phrase", "m.metric", "m.value", "m.unit", "problem")


# Where the platforms' records hold their fields; a field is (path, type).
RECORDS = {
    "youtube videos": (("$.items",), {
        "id": ("$.id", "string"), "title": ("$.snippet.title", "string"), "description": ("$.snippet.description", "string"), "channel_id": ("$.snippet.channelId", "string"), "published_at": ("$.snippet.publishedAt", "string"),
        "tags": ("$.snippet.tags", "array<string>"), "views": ("$.statistics.viewCount", "decimal(38,0)"), "likes": ("$.statistics.likeCount", "decimal(38,0)"), "comments": ("$.statistics.commentCount", "decimal(38,0)"), "duration": ("$.contentDetails.duration", "string"),
    }),
    "youtube comments": (("$.items",), {"id": ("$.id", "string"), "video_id": ("$.snippet.videoId", "string"), "text": ("$.snippet.topLevelComment.snippet.textDisplay", "string"), "likes": ("$.snippet.topLevelComment.snippet.likeCount", "decimal(38,0)"), "replies": ("$.snippet.totalReplyCount", "decimal(38,0)")}),
    "tiktok display-videos": (("$.data.videos",), {
        "id": ("$.id", "string"), "text": ("$.video_description", "string"), "title": ("$.title", "string"), "url": ("$.share_url", "string"), "created": ("$.create_time", "bigint"), "duration": ("$.duration", "double"),
        "views": ("$.view_count", "decimal(38,0)"), "likes": ("$.like_count", "decimal(38,0)"), "comments": ("$.comment_count", "decimal(38,0)"), "shares": ("$.share_count", "decimal(38,0)"),
    }),
    "tiktok research-videos": (("$.data.videos",), {
        "id": ("$.id", "string"), "text": ("$.video_description", "string"), "author": ("$.username", "string"), "region": ("$.region_code", "string"), "created": ("$.create_time", "bigint"), "duration": ("$.video_duration", "double"), "tags": ("$.hashtag_names", "array<string>"), "music_id": ("$.music_id", "string"),
        "views": ("$.view_count", "decimal(38,0)"), "likes": ("$.like_count", "decimal(38,0)"), "comments": ("$.comment_count", "decimal(38,0)"), "shares": ("$.share_count", "decimal(38,0)"), "saves": ("$.favorites_count", "decimal(38,0)"),
    }),
    "tiktok research-comments": (("$.data.comments",), {"id": ("$.id", "string"), "video_id": ("$.video_id", "string"), "text": ("$.text", "string"), "likes": ("$.like_count", "decimal(38,0)"), "replies": ("$.reply_count", "decimal(38,0)"), "parent_id": ("$.parent_comment_id", "string"), "created": ("$.create_time", "bigint")}),
    "instagram media": (("$.data",), {
        "id": ("$.id", "string"), "caption": ("$.caption", "string"), "media_type": ("$.media_type", "string"), "product_type": ("$.media_product_type", "string"), "permalink": ("$.permalink", "string"), "timestamp": ("$.timestamp", "string"),
        "likes": ("$.like_count", "decimal(38,0)"), "comments": ("$.comments_count", "decimal(38,0)"),
    }),
    "instagram comments": (("$.data",), {"id": ("$.id", "string"), "text": ("$.text", "string"), "timestamp": ("$.timestamp", "string"), "likes": ("$.like_count", "decimal(38,0)")}),
    "search-console sites": (("$.siteEntry",), {"site": ("$.siteUrl", "string"), "permission": ("$.permissionLevel", "string")}),
    "search-console sitemaps": (("$.sitemap",), {"path": ("$.path", "string"), "errors": ("$.errors", "bigint"), "warnings": ("$.warnings", "bigint"), "submitted": ("$.lastSubmitted", "string"), "downloaded": ("$.lastDownloaded", "string"), "pending": ("$.isPending", "boolean")}),
    "wikimedia-pageviews article": (("$.items",), {"article": ("$.article", "string"), "stamp": ("$.timestamp", "string"), "views": ("$.views", "bigint")}),
    "webmaster sites": (("$.d",), {"url": ("$.Url", "string"), "verified": ("$.IsVerified", "boolean")}),
    "webmaster links": (("$.d.Links",), {"url": ("$.Url", "string"), "links": ("$.Count", "bigint")}),
    "webmaster url-links": (("$.d.Details",), {"url": ("$.Url", "string"), "anchor": ("$.AnchorText", "string")}),
    "webmaster crawl-issues": (("$.d",), {"url": ("$.Url", "string"), "http_code": ("$.HttpCode", "bigint"), "issues": ("$.Issues", "string"), "links": ("$.InLinks", "bigint")}),
    "webmaster crawl": (("$.d",), {"date": ("$.Date", "string"), "crawled": ("$.CrawledPages", "bigint"), "in_index": ("$.InIndex", "bigint"), "links": ("$.InLinks", "bigint"), "errors": ("$.CrawlErrors", "bigint"), "code_2xx": ("$.Code2xx", "bigint"), "code_301": ("$.Code301", "bigint"), "code_302": ("$.Code302", "bigint"), "code_4xx": ("$.Code4xx", "bigint"), "code_5xx": ("$.Code5xx", "bigint"), "other_codes": ("$.AllOtherCodes", "bigint"), "blocked": ("$.BlockedByRobotsTxt", "bigint"), "malware": ("$.ContainsMalware", "bigint")}),
    "webmaster sitemaps": (("$.d",), {"url": ("$.Url", "string"), "compressed": ("$.Compressed", "boolean"), "bytes": ("$.FileSize", "bigint"), "crawled": ("$.LastCrawled", "string"), "submitted": ("$.Submitted", "string"), "status": ("$.Status", "string"), "kind": ("$.Type", "string"), "urls": ("$.UrlCount", "bigint")}),
    "webmaster keywords": (("$.d",), {"phrase": ("$.Query", "string"), "date": ("$.Date", "string"), "keyword_impressions": ("$.Impressions", "bigint"), "broad_keyword_impressions": ("$.BroadImpressions", "bigint")}),
}


def typed_records(documents: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, position, the fields of the family, problem) of responses of records.  A field of
    another type than declared is null; the first field names the record and must be there."""
    rows_at, fields = RECORDS[name]
    v = F.col("v")
    read = documents.select(key, F.try_parse_json(text).alias("v"))
    rows = array_at(v, rows_at)
    first = next(iter(fields.values()))
    problem = F.when(v.isNull(), "no-json").when(F.coalesce(*[F.when(got(v, e, "variant").isNotNull(), True) for e in ERRORS], F.lit(False)) & ~got(v, "$.error.code").eqNullSafe(F.lit("ok")), "error").when(rows.isNull(), "no-rows").when(F.exists(rows, lambda r: got(r, *first).isNull()), "unnamed-record")
    told = read.select(key, problem.alias("problem"), F.posexplode_outer(F.when(problem.isNull(), rows)).alias("at", "r")).where("problem IS NOT NULL OR at IS NOT NULL")
    return told.select(key, (F.col("at") + 1).alias("position"), *[got(F.col("r"), path, kind).alias(f) for f, (path, kind) in fields.items()], "problem")
