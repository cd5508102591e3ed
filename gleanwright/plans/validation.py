"""Queries of the report laws over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.operators import validate
from gleanwright.session import table

SQL: dict[str, str] = {}


def console_reports_judged(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "bwt_before").select("site_id", "observed_at", "delivered_at", "query", "page", "clicks", "impressions", F.col("average_impression_position").alias("position"))
    report = ["site_id", "observed_at", "delivered_at"]
    return validate.verdicts(validate.console_report(rows, report, ["query", "page"]), report).groupBy("problem").agg(F.count("*").alias("reports"), F.sum("rows").alias("rows"), F.sum("broken").alias("broken"))


_CONSOLE = """
WITH s AS (SELECT *, count(*) OVER (PARTITION BY site_id, observed_at, delivered_at, query, page) AS same FROM bwt_before),
j AS (SELECT site_id, observed_at, delivered_at, CASE WHEN query IS NULL OR page IS NULL THEN 'missing-dimension' WHEN same > 1 THEN 'duplicate-row' WHEN clicks < 0 OR impressions < 0 THEN 'negative-measure' WHEN clicks > impressions THEN 'clicks-exceed-impressions' END AS problem FROM s),
v AS (SELECT site_id, observed_at, delivered_at, count(*) AS rows, count(problem) AS broken, min(problem) AS problem FROM j GROUP BY ALL)"""
SQL["console_reports_judged"] = _CONSOLE + " SELECT problem, count(*) AS reports, sum(rows)::BIGINT AS rows, sum(broken)::BIGINT AS broken FROM v GROUP BY problem"


def console_reports_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the reports of one site and day that break no law of dimensions by query."""
    rows = table(spark, folder, "bwt_before").where("query IS NOT NULL AND page IS NOT NULL").select("site_id", "observed_at", "delivered_at", "query", "page", "clicks", "impressions", F.col("average_impression_position").alias("position"))
    report = ["site_id", "observed_at", "delivered_at"]
    kept = validate.accepted(validate.console_report(rows, report, ["query", "page"]), report)
    return kept.select("site_id", "observed_at", "query", "page", "clicks", F.round("ctr", 6).alias("ctr"))


SQL["console_reports_accepted"] = (
    _CONSOLE.replace("FROM bwt_before)", "FROM bwt_before WHERE query IS NOT NULL AND page IS NOT NULL)")
    + " SELECT s.site_id, s.observed_at, s.query, s.page, s.clicks, round(CASE WHEN s.impressions <> 0 THEN s.clicks / s.impressions END, 6) AS ctr FROM s JOIN v ON v.problem IS NULL AND s.site_id = v.site_id AND s.observed_at = v.observed_at AND s.delivered_at IS NOT DISTINCT FROM v.delivered_at"
)


def webmaster_reports_judged(spark: SparkSession, folder: str) -> DataFrame:
    """Native buckets: each row has the day of its report."""
    rows = table(spark, folder, "bwt_before").select("site_id", "observed_at", "delivered_at", "query", "page", F.col("start_date").alias("date"), F.lit(None).cast("int").alias("position_bucket"), "clicks", "impressions")
    report = ["site_id", "observed_at", "delivered_at"]
    return validate.webmaster_report(rows, report, "native-buckets").groupBy("problem").agg(F.count("*").alias("rows"), F.round(F.sum("ctr"), 6).alias("rates"))


SQL["webmaster_reports_judged"] = r"""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY site_id, observed_at, delivered_at, query, page, start_date) AS same, CASE WHEN impressions <> 0 THEN clicks / impressions END AS ctr FROM bwt_before)
SELECT CASE WHEN start_date IS NULL THEN 'no-bucket-date' WHEN trim(query) = '' THEN 'blank-query' WHEN page IS NOT NULL AND NOT regexp_matches(page, '(?i)^https?://[^/\s]+') THEN 'page-no-address' WHEN same > 1 THEN 'duplicate-row' WHEN clicks < 0 OR impressions < 0 THEN 'negative-measure' WHEN clicks > impressions THEN 'clicks-exceed-impressions' END AS problem,
  count(*) AS rows, round(sum(ctr), 6) AS rates FROM s GROUP BY 1"""


def result_reports_judged(spark: SparkSession, folder: str) -> DataFrame:
    report = ["serp_id", "observed_at", "delivered_at"]
    judged = validate.result_report(table(spark, folder, "serp_after").select(*report, "url", "rank"), report)
    return judged.groupBy("problem").agg(F.count("*").alias("rows"), F.sum("rank").alias("ranks"))


SQL["result_reports_judged"] = r"""
WITH b AS (SELECT * FROM serp_after QUALIFY url IS NULL OR row_number() OVER (PARTITION BY serp_id, observed_at, delivered_at, url ORDER BY rank NULLS FIRST) = 1),
s AS (SELECT *, count(*) OVER (PARTITION BY serp_id, observed_at, delivered_at, rank) AS same FROM b)
SELECT CASE WHEN url IS NULL OR NOT regexp_matches(url, '(?i)^https?://[^/\s]+') THEN 'no-address' WHEN rank IS NULL OR rank < 1 THEN 'no-rank' WHEN same > 1 THEN 'shared-rank' END AS problem, count(*) AS rows, sum(rank)::BIGINT AS ranks FROM s GROUP BY 1"""


def measurements_judged(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observations_after")
    judged = validate.measurements(rows, ["phrase", "source", "scope", "metric", "unit", "geography", "observed_at", "period_start", "period_end"])
    return judged.groupBy("metric", "problem").agg(F.count("*").alias("rows"), F.max("value").alias("largest"))


SQL["measurements_judged"] = """
WITH s AS (SELECT *, count(*) OVER (PARTITION BY phrase, source, scope, metric, unit, geography, observed_at, period_start, period_end) AS same FROM observations_after),
u AS (SELECT * FROM (VALUES ('estimated_search_volume', 'searches_per_month', NULL), ('last_month_search_volume', 'searches_last_month', NULL), ('keyword_impressions', 'impressions_in_reported_period', NULL), ('broad_keyword_impressions', 'broad_impressions_in_reported_period', NULL),
  ('organic_difficulty', 'provider_index_0_100', 100), ('paid_competition', 'provider_index_0_1', 1), ('trend_interest', 'provider_relative_index', NULL), ('referring_domains', 'count', NULL), ('backlinks', 'count', NULL)) v(metric, right_unit, high))
SELECT s.metric, CASE WHEN coalesce(trim(phrase), '') = '' OR coalesce(trim(source), '') = '' OR coalesce(trim(scope), '') = '' OR coalesce(trim(s.metric), '') = '' OR coalesce(trim(unit), '') = '' THEN 'missing-label' WHEN observed_at IS NULL THEN 'missing-capture-time' WHEN (period_start IS NULL) <> (period_end IS NULL) THEN 'half-period'
  WHEN period_start > period_end THEN 'period-out-of-order' WHEN unit <> right_unit THEN 'other-unit' WHEN value < 0 THEN 'negative-value' WHEN value > high THEN 'over-range' WHEN same > 1 THEN 'duplicate-identity' END AS problem, count(*) AS rows, max(value) AS largest FROM s LEFT JOIN u ON u.metric = s.metric GROUP BY ALL"""

QUERIES = [console_reports_judged, console_reports_accepted, webmaster_reports_judged, result_reports_judged, measurements_judged]
