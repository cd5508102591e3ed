"""Queries of comparisons, search reports, trends, the monitor, selection, event timing and
embeddings, each with its SQL where SQL can say it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.functions.text import normal
from gleanwright.operators import compare, embeddings, event_cycles, evidence, intervals, monitor, samples, search, selection, trends
from gleanwright.session import table

SQL: dict[str, str] = {}


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- comparison of snapshots


def _panel(spark: SparkSession, folder: str, year: int) -> DataFrame:
    rows = table(spark, folder, "observations_after").where(F.year("observed_at") == year)
    keys = ["phrase", "source", "scope", "metric", "unit", "geography"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct("value", "observed_at"), F.struct("observed_at", "obs_id", "value")).alias("v")).select(*keys, "v.*")


def compare_observations(spark: SparkSession, folder: str) -> DataFrame:
    found = compare.compare_profile("panel-observations", _panel(spark, folder, 2021), _panel(spark, folder, 2022))
    kept = found.drop("observed_at_before", "observed_at_after", "at_before", "at_after")
    return _rounded(kept, "days", "value_percent", "value_per_day", "value_change")


_PANEL = "SELECT phrase, source, scope, metric, unit, geography, arg_max({{'value': value, 'at': observed_at}}, row(observed_at, obs_id, value)) AS v FROM observations_after WHERE year(observed_at AT TIME ZONE 'UTC') = {0} GROUP BY ALL"
SQL["compare_observations"] = f"""
WITH a AS ({_PANEL.format(2021)}), b AS ({_PANEL.format(2022)}),
j AS (SELECT coalesce(b.phrase, a.phrase) AS phrase, coalesce(b.source, a.source) AS source, coalesce(b.scope, a.scope) AS scope, coalesce(b.metric, a.metric) AS metric, coalesce(b.unit, a.unit) AS unit, coalesce(b.geography, a.geography) AS geography,
  CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN b.v IS NOT NULL THEN 'added' ELSE 'removed' END AS state, a.v.value AS value_before, b.v.value AS value_after, (epoch_us(b.v.at) - epoch_us(a.v.at)) / 86400000000.0 AS days
  FROM a FULL JOIN b ON a.phrase IS NOT DISTINCT FROM b.phrase AND a.source IS NOT DISTINCT FROM b.source AND a.scope IS NOT DISTINCT FROM b.scope AND a.metric IS NOT DISTINCT FROM b.metric AND a.unit IS NOT DISTINCT FROM b.unit AND a.geography IS NOT DISTINCT FROM b.geography)
SELECT phrase, source, scope, metric, unit, geography, state, value_before, value_after, round(days, 6) AS days, CASE WHEN state = 'both' AND days > 0 THEN round(value_after - value_before, 6) END AS value_change,
  CASE WHEN state = 'both' AND days > 0 AND value_before <> 0 THEN round((value_after - value_before) * 100 / value_before, 6) END AS value_percent, CASE WHEN state = 'both' AND days > 0 THEN round((value_after - value_before) / days, 6) END AS value_per_day FROM j"""


def compare_inner_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals by priority and status in two years, only what both years have."""
    orders = table(spark, folder, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("orders"), F.sum("o_totalprice").alias("total"))
    found = compare.compare(year(1996), year(1997), ["o_orderpriority", "o_orderstatus"], ["orders", "total"], "inner")
    return _rounded(found, "total_before", "total_after", "total_change", "total_percent", "orders_percent", places=2)


SQL["compare_inner_orders"] = """
WITH t AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, count(*)::DOUBLE AS orders, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT a.o_orderpriority, a.o_orderstatus, 'both' AS state, a.orders AS orders_before, round(a.total, 2) AS total_before, b.orders AS orders_after, round(b.total, 2) AS total_after, b.orders - a.orders AS orders_change, round((b.orders - a.orders) * 100 / a.orders, 2) AS orders_percent,
  round(b.total - a.total, 2) AS total_change, round((b.total - a.total) * 100 / a.total, 2) AS total_percent
FROM t a JOIN t b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus WHERE a.y = 1996 AND b.y = 1997"""


def _ends(rows: DataFrame, stream: str) -> tuple[DataFrame, DataFrame]:
    bounds = rows.groupBy(F.col(stream).alias("_s")).agg(F.min("observed_at").alias("_lo"), F.max("observed_at").alias("_hi"))
    both = rows.join(bounds, rows[stream] == F.col("_s"))
    return both.where("observed_at = _lo").drop("_s", "_lo", "_hi"), both.where("observed_at = _hi").drop("_s", "_lo", "_hi")


def compare_performance(spark: SparkSession, folder: str) -> DataFrame:
    """First and last report of each site by query and page; rows repeated under one spelling are conflicts."""
    before, after = _ends(table(spark, folder, "bwt_before").dropDuplicates(), "site_id")
    found = compare.compare(before, after, ["site_id", "query", "page"], ["clicks", "impressions"], "full_outer")
    return _rounded(found, "clicks_percent", "impressions_percent")


SQL["compare_performance"] = """
WITH d AS (SELECT DISTINCT * FROM bwt_before), e AS (SELECT *, min(observed_at) OVER (PARTITION BY site_id) AS lo, max(observed_at) OVER (PARTITION BY site_id) AS hi FROM d),
a AS (SELECT site_id, query, page, count(*) AS n, max(clicks) AS clicks, max(impressions) AS impressions FROM e WHERE observed_at = lo GROUP BY ALL),
b AS (SELECT site_id, query, page, count(*) AS n, max(clicks) AS clicks, max(impressions) AS impressions FROM e WHERE observed_at = hi GROUP BY ALL),
j AS (SELECT coalesce(b.site_id, a.site_id) AS site_id, coalesce(b.query, a.query) AS query, coalesce(b.page, a.page) AS page,
  CASE WHEN a.n > 1 OR b.n > 1 THEN 'conflict' WHEN a.n = 1 AND b.n = 1 THEN 'both' WHEN b.n = 1 THEN 'added' ELSE 'removed' END AS state,
  a.clicks AS clicks_before, b.clicks AS clicks_after, a.impressions AS impressions_before, b.impressions AS impressions_after
  FROM a FULL JOIN b ON a.site_id IS NOT DISTINCT FROM b.site_id AND a.query IS NOT DISTINCT FROM b.query AND a.page IS NOT DISTINCT FROM b.page)
SELECT *, CASE WHEN state = 'both' THEN clicks_after - clicks_before END AS clicks_change, CASE WHEN state = 'both' AND clicks_before <> 0 THEN round((clicks_after - clicks_before) * 100.0 / clicks_before, 6) END AS clicks_percent,
  CASE WHEN state = 'both' THEN impressions_after - impressions_before END AS impressions_change, CASE WHEN state = 'both' AND impressions_before <> 0 THEN round((impressions_after - impressions_before) * 100.0 / impressions_before, 6) END AS impressions_percent FROM j"""


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    return compare.rank_changes(*_ends(table(spark, folder, "serp_after"), "serp_id"), ["serp_id"], "url", "rank")


def compare_rankings(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder)


_RANKS = """
WITH e AS (SELECT *, min(observed_at) OVER (PARTITION BY serp_id) AS lo, max(observed_at) OVER (PARTITION BY serp_id) AS hi FROM serp_after),
a AS (SELECT serp_id, url, min(rank) AS rank_before FROM e WHERE observed_at = lo AND url IS NOT NULL GROUP BY ALL), b AS (SELECT serp_id, url, min(rank) AS rank_after FROM e WHERE observed_at = hi AND url IS NOT NULL GROUP BY ALL),
r AS (SELECT serp_id, url, rank_before, rank_after, CASE WHEN rank_before IS NULL THEN 'entered' WHEN rank_after IS NULL THEN 'left' ELSE 'stayed' END AS state, rank_before - rank_after AS moved_up FROM a FULL JOIN b USING (serp_id, url))"""
SQL["compare_rankings"] = _RANKS + " SELECT * FROM r"


def ranking_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(compare.set_overlap(_ranks(spark, folder), ["serp_id"]), "jaccard", places=9)


SQL["ranking_overlap"] = _RANKS + " SELECT serp_id, count(*) FILTER (WHERE state = 'stayed') AS shared, count(*) AS either, round(count(*) FILTER (WHERE state = 'stayed') / count(*), 9) AS jaccard FROM r GROUP BY serp_id"


def copies_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Multiset difference of the queries of first and last reports, both ways."""
    before, after = (x.select("site_id", "query") for x in _ends(table(spark, folder, "bwt_before"), "site_id"))
    gone, new = compare.net_difference(before, after)
    return gone.withColumn("side", F.lit("before")).unionAll(new.withColumn("side", F.lit("after"))).groupBy("side", "site_id", "query").agg(F.count("*").alias("copies"))


SQL["copies_missing"] = """
WITH e AS (SELECT *, min(observed_at) OVER (PARTITION BY site_id) AS lo, max(observed_at) OVER (PARTITION BY site_id) AS hi FROM bwt_before), a AS (SELECT site_id, query FROM e WHERE observed_at = lo), b AS (SELECT site_id, query FROM e WHERE observed_at = hi)
SELECT side, site_id, query, count(*) AS copies FROM (SELECT 'before' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'after', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL"""


# --- evidence


def _long(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "bwt_before")
    label = evidence.fallback_label(F.col("query"), F.col("page"), F.lit(""), F.col("site_url"))
    metrics = {"clicks": ("clicks", "count"), "impressions": ("impressions", "count"), "average_impression_position": ("average_position", "position")}
    return evidence.from_wide(rows, label, metrics, F.col("scope"), ["site_id", "observed_at"])


def report_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return _long(spark, folder).groupBy("phrase", "metric", "unit").agg(F.count("*").alias("rows"), F.count("value").alias("measured"), F.max("value").alias("largest"))


SQL["report_evidence"] = """
WITH t AS (SELECT coalesce(nullif(query, ''), nullif(page, ''), site_url) AS phrase, clicks::DOUBLE AS clicks, impressions::DOUBLE AS impressions, average_impression_position AS p FROM bwt_before),
u AS (SELECT phrase, 'clicks' AS metric, 'count' AS unit, clicks AS value FROM t UNION ALL SELECT phrase, 'impressions', 'count', impressions FROM t UNION ALL SELECT phrase, 'average_position', 'position', p FROM t)
SELECT phrase, metric, unit, count(*) AS rows, count(value) AS measured, max(value) AS largest FROM u WHERE phrase <> '' GROUP BY ALL"""


def evidence_order(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases by their impressions; those with conflicting values last. First hundred."""
    return evidence.ordered_by_metric(_long(spark, folder), "impressions").limit(100)


SQL["evidence_order"] = """
WITH t AS (SELECT coalesce(nullif(query, ''), nullif(page, ''), site_url) AS phrase, impressions::DOUBLE AS v FROM bwt_before)
SELECT phrase, CASE WHEN min(v) = max(v) THEN min(v) END AS value FROM t WHERE phrase <> '' GROUP BY phrase ORDER BY value DESC NULLS LAST, lower(phrase), phrase LIMIT 100"""


def keyword_gap(spark: SparkSession, folder: str) -> DataFrame:
    norm = lambda t: table(spark, folder, t).where("phrase IS NOT NULL").select(normal("phrase").alias("identity")).distinct()
    return evidence.gap(norm("observations_after"), norm("observed_evidence"), "identity")


FOLDED = "replace(replace(replace(lower(nfc_normalize(trim(phrase))), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"
SQL["keyword_gap"] = f"SELECT {FOLDED} AS identity FROM observed_evidence WHERE phrase IS NOT NULL EXCEPT SELECT {FOLDED} FROM observations_after WHERE phrase IS NOT NULL"


def evidence_merged(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "observed_evidence").select("phrase", "source", "metric", "unit", "value", F.col("evidence_id").alias("ord"), F.lit(1).alias("side"))
    b = table(spark, folder, "observations_after").select("phrase", "source", "metric", "unit", F.col("value").cast("bigint").cast("string").alias("value"), F.col("obs_id").alias("ord"), F.lit(2).alias("side"))
    both = evidence.union(a, b).where("phrase IS NOT NULL")
    found = evidence.merged(both, normal("phrase"), F.struct("side", "ord", "phrase"))
    return found


SQL["evidence_merged"] = f"""
WITH t AS (SELECT phrase, source, metric, unit, value, evidence_id AS ord, 1 AS side FROM observed_evidence UNION ALL SELECT phrase, source, metric, unit, trunc(value)::BIGINT::VARCHAR, obs_id, 2 FROM observations_after)
SELECT {FOLDED} AS identity, arg_min(phrase, row(side, ord, phrase)) AS phrase, count(DISTINCT source) AS sources, count(DISTINCT row(source, metric, unit, value)) AS pieces FROM t WHERE phrase IS NOT NULL GROUP BY 1"""


# --- search performance


def search_opportunities(spark: SparkSession, folder: str) -> DataFrame:
    found = search.opportunities(table(spark, folder, "bwt_before"), "impressions", "clicks", "average_impression_position", 100, 4, 20, 0.05, 0.1)
    keep = ["site_id", "observed_at", "query", "page", "clicks", "impressions", "ctr", "scenario_clicks"]
    return _rounded(found.select(*keep), "ctr", "scenario_clicks")


SQL["search_opportunities"] = """
SELECT site_id, observed_at, query, page, clicks, impressions, round(clicks / impressions, 6) AS ctr, round(greatest(0, (0.1 - clicks / impressions) * impressions), 6) AS scenario_clicks
FROM bwt_before WHERE impressions >= 100 AND average_impression_position BETWEEN 4 AND 20 AND clicks / impressions <= 0.05"""


def query_page_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.page_overlap(table(spark, folder, "bwt_before"), ["site_id", "query"], "page", "impressions"), "largest_share", places=9)


SQL["query_page_overlap"] = """
WITH p AS (SELECT site_id, query, page, sum(impressions) AS i, count(*) FILTER (WHERE impressions IS NULL) AS gone FROM bwt_before WHERE page IS NOT NULL GROUP BY ALL)
SELECT site_id, query, count(*) AS pages, CASE WHEN sum(gone) = 0 THEN sum(i)::BIGINT END AS impressions, round(CASE WHEN sum(gone) = 0 AND sum(i) > 0 THEN max(i) / sum(i) END, 9) AS largest_share FROM p GROUP BY ALL HAVING count(*) > 1"""


def bulk_weighted_position(spark: SparkSession, folder: str) -> DataFrame:
    columns = {"clicks": "clicks", "impressions": "impressions", "position": "average_impression_position", "day": "observed_at"}
    found = search.bulk_totals(spark, table(spark, folder, "bwt_before"), ["query", "page"], columns, date(2024, 1, 1), date(2024, 12, 31), F.expr("query IS NOT NULL AND page IS NOT NULL"), 0)
    return _rounded(found, "ctr", "average_position")


SQL["bulk_weighted_position"] = """
SELECT query, page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, round(CASE WHEN sum(impressions) <> 0 THEN sum(clicks) / sum(impressions) END, 6) AS ctr, round(CASE WHEN sum(impressions) <> 0 THEN sum(average_impression_position * impressions) / sum(impressions) END, 6) AS average_position
FROM bwt_before WHERE observed_at BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND query IS NOT NULL AND page IS NOT NULL GROUP BY ALL"""


def serp_competition(spark: SparkSession, folder: str) -> DataFrame:
    found = search.competition(table(spark, folder, "serp_after"), ["serp_id", "observed_at"], "url", "rank", "title", F.col("query"), "gastey.example")
    return _rounded(found, "largest_host_share", places=9)


SQL["serp_competition"] = r"""
WITH b AS (SELECT serp_id, observed_at, url, min(rank) AS r, lower(max(title)) AS t, lower(max(query)) AS q FROM serp_after WHERE url IS NOT NULL GROUP BY ALL),
w AS (SELECT *, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS h, regexp_matches(t, '(^|[^\p{L}\p{N}_])' || q || '($|[^\p{L}\p{N}_])') AS m FROM b WHERE r <= 10),
g AS (SELECT serp_id, observed_at, h, count(*) AS n, count(*) FILTER (WHERE m) AS m, min(r) FILTER (WHERE h = 'gastey.example' OR h LIKE '%.gastey.example') AS best, count(DISTINCT r) AS d, max(r) AS last FROM w GROUP BY ALL)
SELECT serp_id, observed_at, sum(n)::BIGINT AS results, count(h) AS hosts, round(max(n) / sum(n), 9) AS largest_host_share, sum(m)::BIGINT AS title_matches, min(best) AS target_rank, max(last) = sum(d) AS all_ranks_observed FROM g GROUP BY ALL"""


def supplier_share_of_top(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    found = search.share_of_top(lines, ["l_returnflag", "l_linestatus"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 1000, "l_suppkey")
    return _rounded(found, "share", places=9)


SQL["supplier_share_of_top"] = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)
SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag, l_linestatus), 9) AS share FROM (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM t WHERE n <= 1000 GROUP BY l_returnflag, l_linestatus, l_suppkey)"""


def page_phrase_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "serp_after").select("serp_id", "observed_at", "rank", "url", "query", "title", "snippet")
    word = F.regexp_extract(F.lower("query"), r"[\p{L}\p{N}]+$", 0)
    found = search.page_coverage(rows.withColumn("word", word).where("word <> ''"), F.col("word"), ["title", "snippet"])
    return found.select("serp_id", "observed_at", "rank", "url", "title_matches", "snippet_matches")


_HITS = "CASE WHEN {0} IS NULL THEN 0 ELSE len(string_split(lower({0}), w)) - 1 END AS {0}_matches"
SQL["page_phrase_coverage"] = rf"WITH t AS (SELECT *, regexp_extract(lower(query), '[\p{{L}}\p{{N}}]+$') AS w FROM serp_after) SELECT serp_id, observed_at, rank, url, {_HITS.format('title')}, {_HITS.format('snippet')} FROM t WHERE w <> ''"


# --- trends


def _interest(spark: SparkSession, folder: str) -> DataFrame:
    """A weekly export, wide and as text: each type's events per week against its largest week."""
    events = table(spark, folder, "events")
    weeks = events.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.sum("value").alias("v"))
    top = weeks.groupBy("event_type").agg(F.max("v").alias("top"))
    index = weeks.join(top, "event_type").withColumn("index", F.floor(F.col("v") * 100 / F.col("top")))
    text = F.when(F.col("index") < 40, "<1").otherwise(F.col("index").cast("string"))
    return index.withColumn("cell", text).groupBy("week").pivot("event_type", ["click", "purchase", "signup", "view", "error"]).agg(F.max("cell"))


def _series(spark: SparkSession, folder: str) -> DataFrame:
    return trends.long_series(_interest(spark, folder), "week", ["click", "purchase", "signup", "view", "error"])


def trend_summary(spark: SparkSession, folder: str) -> DataFrame:
    end = trends.period_end(F.col("period"), "week")
    ranked = trends.cohort_rank(trends.summary(_series(spark, folder), "series", "value", eligible_when=trends.eligible(end, F.lit("2024-01-29").cast("date"), F.col("partial"))).withColumn("export", F.lit(1)), ["export"])
    return ranked.drop("export")


SQL["trend_summary"] = """
WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, sum(value) AS v FROM events GROUP BY ALL), i AS (SELECT week, event_type, floor(v * 100 / max(v) OVER (PARTITION BY event_type)) AS x FROM w),
n AS (SELECT unnest(['click', 'purchase', 'signup', 'view', 'error']) AS series), k AS (SELECT DISTINCT week FROM w),
q AS (SELECT n.series, k.week AS period, CASE WHEN i.x >= 40 THEN i.x END AS value, coalesce(i.x < 40, false) AS censored FROM n CROSS JOIN k LEFT JOIN i ON i.week = k.week AND i.event_type = n.series WHERE k.week + 6 < DATE '2024-01-29'),
s AS (SELECT series, count(*) AS points, CASE WHEN count(value) = count(*) THEN round_even(avg(value), 4) END AS mean, CASE WHEN count(value) = count(*) THEN max(value) END AS peak,
  CASE WHEN count(*) FILTER (WHERE value IS NULL AND NOT censored) = 0 THEN floor(sum(coalesce(value, 0)) / count(*) * 10000) / 10000 END AS lower, CASE WHEN count(*) FILTER (WHERE value IS NULL AND NOT censored) = 0 THEN ceil((sum(coalesce(value, 0)) + count(*) FILTER (WHERE censored)) / count(*) * 10000) / 10000 END AS upper,
  count(*) FILTER (WHERE value > 0) AS positive_periods, count(*) FILTER (WHERE value = 0) AS zero_periods, count(*) FILTER (WHERE value IS NULL) AS unknown_periods, min(period) AS first_period, max(period) AS last_period FROM q GROUP BY series)
SELECT *, count(*) OVER () > 1 AND min(first_period) OVER () = max(first_period) OVER () AND min(last_period) OVER () = max(last_period) OVER () AS comparable, CASE WHEN mean IS NOT NULL AND count(*) OVER () > 1 THEN dense_rank() OVER (ORDER BY mean DESC NULLS LAST) END AS cohort_rank FROM s"""


def event_recency(spark: SparkSession, folder: str) -> DataFrame:
    events, now = table(spark, folder, "events"), F.lit("2024-01-30 00:00:00").cast("timestamp")
    at = F.col("ts").cast("timestamp")
    return events.groupBy("user_id").agg(*[samples.recent(at, now, d).alias(f"last_{d}d") for d in (1, 7, 30)])


SQL["event_recency"] = "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-30' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL {d} DAY) AS last_{d}d" for d in (1, 7, 30)) + " FROM events GROUP BY user_id"


def view_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Daily series per user and type: sum, days returned and expected, complete or not."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return samples.daily_completeness(events, ["user_id", "event_type"], "day", F.count("*"))


SQL["view_completeness"] = """
WITH d AS (SELECT user_id, event_type, ts::DATE AS day, count(*) AS views FROM events GROUP BY ALL)
SELECT user_id, event_type, sum(views)::BIGINT AS views, count(*) AS days, date_diff('day', min(day), max(day)) + 1 AS expected, count(*) = date_diff('day', min(day), max(day)) + 1 AS complete FROM d GROUP BY ALL"""


def quota_ledger(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "events").select(F.col("user_id").alias("account"), F.col("ts").alias("started_at"), F.floor("value").cast("bigint").alias("requests"))
    return monitor.quota_use(runs)


SQL["quota_ledger"] = "SELECT user_id AS account, ts::DATE AS day, count(*) AS runs, sum(floor(value)::BIGINT)::BIGINT AS requests FROM events GROUP BY ALL"


# --- monitor

MONITOR_NOW = "2022-06-30 00:00:00"


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observations_after").select(
        "phrase", "source", "metric", "unit", "geography", "scope", F.lit("series").alias("subject"), F.lit("panel").alias("platform"), "value", "observed_at", "period_start", "period_end",
        F.lit("platform_search_interest").alias("evidence_kind"), F.lit(False).alias("approximate"), F.lit("complete").alias("completeness"), F.lit("weekly").alias("window"), F.lit("n1").alias("normalization_id"),
        F.when(F.col("value").isNull(), "no-data").otherwise("observed").alias("availability"),
    )
    return monitor.validated(rows, F.lit("2030-01-01").cast("timestamp"))


def _watches(spark: SparkSession, folder: str) -> DataFrame:
    """One watch per source and metric, any phrase; and one per phrase, any source."""
    rows = table(spark, folder, "observations_after")
    a = rows.where("source IS NOT NULL AND metric IS NOT NULL").select(F.concat_ws("/", "source", "metric").alias("id"), "source", "metric", F.lit(None).cast("string").alias("phrase")).distinct()
    b = rows.where("phrase IS NOT NULL").select(F.concat(F.lit("p:"), "phrase").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("metric"), "phrase").distinct()
    return a.unionAll(b).select(
        "*", F.lit("Series ").alias("subject"), F.lit("panel").alias("platform"), F.lit(168.0).alias("cadence_hours"), F.lit(60.0).alias("freshness_days"), F.lit(1.0).alias("min_absolute_change"), F.lit(None).cast("double").alias("min_percent_change"),
    )


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Error events stand for attempts at the watches of phrases, matched by phrase length."""
    events = table(spark, folder, "events").where("event_type = 'error'")
    phrases = table(spark, folder, "observations_after").where("phrase IS NOT NULL").select("phrase").distinct()
    return phrases.select(F.concat(F.lit("p:"), "phrase").alias("watch_id"), (F.length("phrase") % 10).cast("bigint").alias("user_id")).join(
        events.select("user_id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - 86_400_000_000 * 600).alias("started_at"), F.when(F.col("value") > 50, "error").otherwise("done").alias("state")), "user_id"
    )


def monitor_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _observations(spark, folder).groupBy("problem").agg(F.count("*").alias("rows"))


_RULES = """CASE WHEN coalesce(trim(phrase), '') = '' OR coalesce(trim(source), '') = '' OR coalesce(trim(metric), '') = '' THEN 'missing-label' WHEN observed_at IS NULL THEN 'missing-capture-time'
  WHEN (period_start IS NULL) <> (period_end IS NULL) THEN 'half-period' WHEN period_start > period_end THEN 'period-out-of-order' WHEN period_end::TIMESTAMP > (observed_at AT TIME ZONE 'UTC') THEN 'period-after-capture' END"""
SQL["monitor_rejects"] = f"SELECT {_RULES} AS problem, count(*) AS rows FROM observations_after GROUP BY 1"


def monitor_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observations_after")
    return monitor.latest(rows, ["series_id"], F.struct("observed_at", "obs_id", "value")).select("series_id", "obs_id", "phrase", "value")


SQL["monitor_latest"] = "SELECT series_id, obs_id, phrase, value FROM observations_after QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC NULLS LAST, obs_id DESC, value DESC NULLS LAST) = 1"


def monitor_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of one identity and quarter, as if they had been taken at its first day."""
    ok = _observations(spark, folder).where("problem IS NULL").withColumn("observed_at", F.date_trunc("quarter", "observed_at"))
    found = monitor.conflicts(ok, ["phrase", "source", "scope", "metric", "unit", "geography"])
    return found.groupBy("phrase", "source", "metric").agg(F.count("*").alias("groups"), F.max("signatures").alias("signatures"))


_OK = f"(SELECT * FROM (SELECT *, {_RULES} AS problem FROM observations_after) WHERE problem IS NULL)"
_SIGNATURE = "coalesce(value::VARCHAR, 'n') || '|' || coalesce(period_start::VARCHAR, 'n') || '|' || coalesce(period_end::VARCHAR, 'n')"
SQL["monitor_conflicts"] = f"""
WITH g AS (SELECT phrase, source, scope, metric, unit, geography, date_trunc('quarter', observed_at AT TIME ZONE 'UTC') AS q, count(DISTINCT {_SIGNATURE}) AS s FROM {_OK} GROUP BY ALL HAVING s > 1)
SELECT phrase, source, metric, count(*) AS groups, max(s) AS signatures FROM g GROUP BY ALL"""


def watch_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = monitor.watched(_watches(spark, folder), _observations(spark, folder).where("problem IS NULL"))
    return found.groupBy("watch_id").agg(F.count("*").alias("observations"), F.max("value").alias("largest"))


_W = """w AS (SELECT DISTINCT source || '/' || metric AS watch_id, source, metric, NULL AS phrase FROM observations_after WHERE source IS NOT NULL AND metric IS NOT NULL UNION ALL SELECT DISTINCT 'p:' || phrase, NULL, NULL, phrase FROM observations_after WHERE phrase IS NOT NULL)"""
_ON = "(w.source IS NULL OR lower(trim(w.source)) = lower(trim(o.source))) AND (w.metric IS NULL OR lower(trim(w.metric)) = lower(trim(o.metric))) AND (w.phrase IS NULL OR lower(trim(w.phrase)) = lower(trim(o.phrase)))"
SQL["watch_matches"] = f"WITH {_W} SELECT watch_id, count(*) AS observations, max(o.value) AS largest FROM w JOIN {_OK} o ON {_ON} GROUP BY watch_id"


def monitor_coverage(spark: SparkSession, folder: str) -> DataFrame:
    ok = _observations(spark, folder).where("problem IS NULL")
    return monitor.coverage(_watches(spark, folder), ok, _attempts(spark, folder), F.lit(MONITOR_NOW).cast("timestamp"))


_COMMON = f"""
WITH {_W}, o AS (SELECT *, (observed_at AT TIME ZONE 'UTC') AS t FROM {_OK} WHERE (observed_at AT TIME ZONE 'UTC') <= TIMESTAMP '{MONITOR_NOW}'),
m AS (SELECT w.watch_id, o.* FROM w JOIN o ON {_ON}),
tr AS (SELECT 'p:' || phrase AS watch_id, e.ts - INTERVAL 600 DAY AS started_at, CASE WHEN e.value > 50 THEN 'error' ELSE 'done' END AS state FROM (SELECT DISTINCT phrase FROM observations_after WHERE phrase IS NOT NULL) p JOIN events e ON e.user_id = length(p.phrase) % 10 WHERE e.event_type = 'error' AND e.ts - INTERVAL 600 DAY <= TIMESTAMP '{MONITOR_NOW}')"""
SQL["monitor_coverage"] = (
    _COMMON
    + f""",
c AS (SELECT watch_id, count(*) AS n FROM (SELECT watch_id, lower(trim(phrase)), lower(trim(source)), lower(trim(coalesce(scope, 'unspecified'))), lower(trim(metric)), lower(trim(coalesce(unit, 'unspecified'))), lower(trim(coalesce(geography, 'unspecified'))), t FROM m GROUP BY ALL
  HAVING count(DISTINCT coalesce(value::VARCHAR, 'n') || '|' || coalesce(period_start::VARCHAR, 'n') || '|' || coalesce(period_end::VARCHAR, 'n')) > 1) GROUP BY watch_id),
l AS (SELECT watch_id, count(*) AS n, max(t) AS last_t, arg_max({{'v': value}}, t) AS last, max(t) FILTER (WHERE value IS NOT NULL) AS good_t, arg_max({{'e': period_end}}, t) FILTER (WHERE value IS NOT NULL) AS good FROM m GROUP BY watch_id),
a AS (SELECT watch_id, max(started_at) AS began, arg_max(state, started_at) AS state FROM tr GROUP BY watch_id),
j AS (SELECT w.watch_id, coalesce(l.n, 0) AS observations, (epoch_us(TIMESTAMP '{MONITOR_NOW}') - epoch_us(good_t)) / 86400000000.0 AS capture_age, (epoch_us(TIMESTAMP '{MONITOR_NOW}') - epoch_us(good.e::TIMESTAMP)) / 86400000000.0 AS report_age, good_t IS NOT NULL AS has_demand_signal, coalesce(c.n, 0) AS conflict_groups, last_t, last, a.began, a.state
  FROM w LEFT JOIN l USING (watch_id) LEFT JOIN c USING (watch_id) LEFT JOIN a USING (watch_id))
SELECT watch_id, observations, round(capture_age, 2) AS capture_age_days, round(report_age, 2) AS report_age_days, has_demand_signal, conflict_groups,
  CASE WHEN conflict_groups > 0 THEN 'conflicting-captures' WHEN state = 'error' AND (last_t IS NULL OR began > last_t) THEN 'error' WHEN last_t IS NULL THEN 'missing' WHEN last.v IS NULL THEN 'no-data' WHEN greatest(capture_age, coalesce(report_age, 0)) > 60 THEN 'stale' ELSE 'current' END AS status FROM j"""
)


def monitor_coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return monitor_coverage(spark, folder).groupBy("status").agg(F.count("*").alias("watches"))


SQL["monitor_coverage_counts"] = f"SELECT status, count(*) AS watches FROM ({SQL['monitor_coverage']}) GROUP BY status"


def monitor_evidence_counts(spark: SparkSession, folder: str) -> DataFrame:
    ok = _observations(spark, folder).where("problem IS NULL")
    return monitor.evidence_counts(_watches(spark, folder), ok, F.lit(MONITOR_NOW).cast("timestamp"))


SQL["monitor_evidence_counts"] = _COMMON + " SELECT watch_id, 'platform_search_interest' AS evidence_kind, count(*) AS observations FROM m GROUP BY watch_id"


def monitor_alerts(spark: SparkSession, folder: str) -> DataFrame:
    ok = _observations(spark, folder).where("problem IS NULL")
    found = monitor.alerts(_watches(spark, folder), ok, F.lit(MONITOR_NOW).cast("timestamp"))
    return _rounded(found.select("watch_id", "reason", "before", "after", "delta", "percent"), "delta", "percent")


_KEY = "watch_id, p, s, sc, me, u, g"
SQL["monitor_alerts"] = (
    _COMMON
    + f""",
k AS (SELECT watch_id, lower(trim(phrase)) AS p, lower(trim(source)) AS s, lower(trim(coalesce(scope, 'unspecified'))) AS sc, lower(trim(metric)) AS me, lower(trim(coalesce(unit, 'unspecified'))) AS u, lower(trim(coalesce(geography, 'unspecified'))) AS g, t,
  any_value(value) AS value, any_value(period_start) AS ps, any_value(period_end) AS pe, min({_SIGNATURE}) <> max({_SIGNATURE}) AS clash FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, bool_or(clash) OVER (PARTITION BY {_KEY}) AS clashes, first_value({{'v': value, 'ps': ps, 'pe': pe}}) OVER w AS a FROM k WINDOW w AS (PARTITION BY {_KEY} ORDER BY t DESC)),
j AS (SELECT *, CASE WHEN value IS NULL THEN 'unavailable-or-failed' WHEN 'unspecified' IN (sc, u, g) THEN 'missing-comparison-context' WHEN a.v IS NULL THEN 'unavailable-or-failed' WHEN (ps IS NULL) <> (a.ps IS NULL) THEN 'reporting-period-missing'
  WHEN pe >= a.ps THEN 'reporting-periods-overlap-or-are-revisions' WHEN pe - ps <> a.pe - a.ps THEN 'reporting-period-length-changed' END AS why FROM r),
c AS (SELECT {_KEY}, any_value(a.v) AS after, max(n) AS rows, bool_or(clashes) AS clashes, max(why) FILTER (WHERE n = 2) AS second_why, max(value) FILTER (WHERE n = 2) AS second, min(n) FILTER (WHERE n > 1 AND why IS NULL) AS older_n, arg_min(value, n) FILTER (WHERE n > 1 AND why IS NULL) AS older FROM j GROUP BY ALL),
f AS (SELECT watch_id, after, CASE WHEN second_why = 'reporting-periods-overlap-or-are-revisions' AND older_n IS NOT NULL THEN older ELSE second END AS before,
  CASE WHEN clashes THEN 'conflicting-capture-timestamps' WHEN rows < 2 THEN 'needs-two-observations' WHEN second_why = 'reporting-periods-overlap-or-are-revisions' AND older_n IS NOT NULL THEN NULL ELSE second_why END AS reason FROM c)
SELECT watch_id, reason, before, after, CASE WHEN reason IS NULL THEN round(after - before, 6) END AS delta, CASE WHEN reason IS NULL AND before <> 0 THEN round((after - before) * 100.0 / abs(before), 6) END AS percent
FROM f WHERE reason IS NOT NULL OR abs(after - before) >= 1"""
)


def monitor_due(spark: SparkSession, folder: str) -> DataFrame:
    ok = _observations(spark, folder).where("problem IS NULL")
    return monitor.due(_watches(spark, folder), ok, _attempts(spark, folder), F.lit(MONITOR_NOW).cast("timestamp")).select("watch_id", F.unix_micros("due_at").alias("due_micros"))


SQL["monitor_due"] = (
    _COMMON
    + f""",
s AS (SELECT watch_id, max(t) AS at FROM (SELECT watch_id, t FROM m UNION ALL SELECT watch_id, started_at FROM tr) GROUP BY watch_id)
SELECT w.watch_id, epoch_us(coalesce(s.at + INTERVAL 168 HOUR, TIMESTAMP '{MONITOR_NOW}')) AS due_micros FROM w LEFT JOIN s USING (watch_id) WHERE coalesce(s.at + INTERVAL 168 HOUR, TIMESTAMP '{MONITOR_NOW}') <= TIMESTAMP '{MONITOR_NOW}'"""
)


def snapshot_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Stored digests against recomputed ones; documents of other languages than English have
    lost their last character since."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL")
    stored = rows.select(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.expr("left(text, char_length(text) - 1)")).alias("content"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    return monitor.verified(stored, "content", "digest")


SQL["snapshot_integrity"] = "SELECT count(*) AS rows, count(*) FILTER (WHERE lang IS DISTINCT FROM 'en' AND length(text) > 0) AS damaged FROM documents WHERE text IS NOT NULL"


# --- selection


def _reviewed(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.concat_ws("#", "p_name", "p_partkey").alias("phrase"), F.col("p_brand").alias("group"), (F.col("p_partkey") % 97 + 1).alias("priority"),
        F.element_at(F.array(*map(F.lit, ("direct", "adjacent", "reject"))), (F.col("p_size") % 3 + 1).cast("int")).alias("fit"), F.when(F.col("p_size") % 5 == 0, "mixed").otherwise("listening").alias("intent"),
        F.when(F.col("p_size") % 7 == 0, "awkward").otherwise("natural").alias("clarity"),
    )


def shortlist_capped(spark: SparkSession, folder: str) -> DataFrame:
    found = selection.shortlist(_reviewed(spark, folder), "phrase", "group", "priority", "fit", "intent", "clarity", limit=20)
    return found.select("phrase", "group", "reason")


SQL["shortlist_capped"] = """
WITH p AS (SELECT p_name || '#' || p_partkey AS phrase, p_brand AS "group", p_partkey % 97 + 1 AS priority, CASE WHEN p_size % 3 <> 0 THEN 'fit_ineligible' WHEN p_size % 5 = 0 THEN 'different_intent' WHEN p_size % 7 = 0 THEN 'awkward_wording' END AS f FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY priority, phrase) AS rg FROM p WHERE f IS NULL), k AS (SELECT *, row_number() OVER (ORDER BY priority, phrase) AS ro FROM g WHERE rg <= 2), c AS (SELECT phrase, "group" FROM k WHERE ro <= 20), n AS (SELECT "group", count(*) AS n FROM c GROUP BY 1)
SELECT phrase, p."group", coalesce(f, CASE WHEN c.phrase IS NULL THEN CASE WHEN n.n >= 2 THEN 'intent_group_cap' ELSE 'outside_shortlist_limit' END END) AS reason FROM p LEFT JOIN c USING (phrase) LEFT JOIN n ON n."group" = p."group" """


def focus_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "serp_after").where("title IS NOT NULL").select("serp_id", "rank", "title").distinct()
    found = selection.focused(rows, "title", "rank", "the quiet song", include=("song", "record", "query"), exclude=("broken",), groups=(("quiet", "golden", "early", "song"),))
    return found.select("serp_id", "rank", "title", F.col("overlap").cast("bigint").alias("overlap"), "reason", "is_seed")


SQL["focus_reasons"] = r"""
WITH t AS (SELECT DISTINCT serp_id, rank, title FROM serp_after WHERE title IS NOT NULL), w AS (SELECT *, regexp_extract_all(lower(title), '[\p{L}\p{N}\p{M}‌‍''’]+') AS w FROM t), o AS (SELECT *, len(list_intersect(list_distinct(w), ['quiet', 'song'])) AS overlap FROM w)
SELECT serp_id, rank, title, overlap, CASE WHEN list_contains(w, 'broken') THEN 'excluded_phrase' WHEN NOT list_has_any(w, ['song', 'record', 'query']) THEN 'required_context_absent' WHEN NOT list_has_any(w, ['quiet', 'golden', 'early', 'song']) THEN 'required_context_group_absent' WHEN overlap < 1 THEN 'insufficient_seed_overlap' END AS reason,
  lower(trim(title)) = 'the quiet song' AS is_seed FROM o"""


def hashtag_plan(spark: SparkSession, folder: str) -> DataFrame:
    videos = table(spark, folder, "videos").select("id", F.to_date("captured_at").alias("day"), F.explode("tags").alias("t")).select("id", "day", F.concat(F.lit("#"), F.lower(F.trim(F.ltrim(F.trim("t"), F.lit("#"))))).alias("tag"))
    tags = videos.where("tag <> '#'").groupBy("tag").agg(F.count_distinct("id").alias("n"), F.max("day").alias("freshest"))
    rows = tags.select(
        "tag", F.when(F.col("n") % 2 == 0, "direct").otherwise("adjacent").alias("fit"), F.when(F.col("n") % 11 == 0, "hold").otherwise("clear").alias("safety"),
        F.element_at(F.array(*map(F.lit, ("brand", "niche", "topic", "format", "trend"))), (F.length("tag") % 5 + 1).cast("int")).alias("role"), (F.lit(5000) - F.least("n", F.lit(4999))).cast("int").alias("priority"), "freshest", F.lit(None).cast("date").alias("trend_at"), F.lit(False).alias("local"),
    )
    return selection.hashtag_plan(rows, "tiktok", F.lit("2026-02-20").cast("date"), F.lit("2026-02-18").cast("date"), F.lit("2026-02-19").cast("date")).select("tag", "role", "priority", "reason")


SQL["hashtag_plan"] = """
WITH v AS (SELECT id, (captured_at AT TIME ZONE 'UTC')::DATE AS day, '#' || lower(trim(ltrim(trim(t), '#'))) AS tag FROM (SELECT id, captured_at, unnest(tags) AS t FROM videos) WHERE t IS NOT NULL),
r AS (SELECT tag, count(DISTINCT id) AS n, max(day) AS freshest, (['brand', 'niche', 'topic', 'format', 'trend'])[length(tag) % 5 + 1] AS role, (5000 - least(count(DISTINCT id), 4999))::INT AS priority FROM v WHERE tag <> '#' GROUP BY tag),
f AS (SELECT *, CASE WHEN n % 2 <> 0 THEN 'not_directly_relevant' WHEN n % 11 = 0 THEN 'safety_hold_or_rejection' WHEN tag IN ('#fyp', '#foryou', '#foryoupage', '#viral', '#trending', '#explorepage') THEN 'generic_reach_bait' WHEN role = 'trend' THEN 'trend_needs_recent_native_evidence' WHEN freshest IS NULL OR date_diff('day', freshest, DATE '2026-02-20') > 30 THEN 'discovery_evidence_missing_or_stale' END AS reason FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY priority, tag) AS rg FROM f WHERE reason IS NULL), k AS (SELECT *, row_number() OVER (ORDER BY priority, tag) AS ro FROM g WHERE rg <= CASE WHEN role IN ('brand', 'format', 'trend') THEN 1 ELSE 2 END),
c AS (SELECT tag, priority FROM k WHERE ro <= 5), l AS (SELECT CASE WHEN count(*) >= 5 THEN max(row(priority, tag)) END AS last FROM c)
SELECT f.tag, role, f.priority, coalesce(reason, CASE WHEN c.tag IS NULL THEN CASE WHEN row(f.priority, f.tag) > (SELECT last FROM l) THEN 'editorial_ceiling' ELSE 'role_cap' END END) AS reason FROM f LEFT JOIN c USING (tag)"""


def copy_audits(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of the first customers' market segments as planned, with those of all as published."""
    tag = F.concat(F.lit("#"), F.lower("c_mktsegment")).alias("tag")
    customers = table(spark, folder, "customer")
    planned = customers.where("c_nationkey < 12").select(tag).distinct()
    published = customers.select("c_nationkey", tag).distinct().where("c_nationkey IN (3, 20)").select("tag")
    return selection.copy_audit(planned, published, "tag", 5, F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))


SQL["copy_audits"] = """
WITH p AS (SELECT DISTINCT '#' || lower(c_mktsegment) AS tag FROM customer WHERE c_nationkey < 12), q AS (SELECT tag, count(*) AS n FROM (SELECT DISTINCT c_nationkey, '#' || lower(c_mktsegment) AS tag FROM customer WHERE c_nationkey IN (3, 20)) GROUP BY tag)
SELECT coalesce(p.tag, q.tag) AS tag, CASE WHEN q.tag IS NULL THEN 'missing' WHEN p.tag IS NULL THEN 'unplanned' ELSE 'repeated' END AS issue FROM p FULL JOIN q ON p.tag = q.tag WHERE q.tag IS NULL OR p.tag IS NULL OR q.n > 1
UNION ALL SELECT NULL, 'over-ceiling' WHERE (SELECT sum(n) FROM q) > 5 UNION ALL SELECT NULL, 'plan-expired'"""


# --- event timing


def _bins(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Daily bins per event type against events on three days of every type."""
    events = table(spark, folder, "events")
    daily = events.groupBy(F.col("event_type").alias("phrase"), F.to_date("ts").alias("start")).agg(F.count("*").cast("double").alias("n"))
    top = daily.groupBy("phrase").agg(F.max("n").alias("top"))
    bins = daily.join(top, "phrase").select("phrase", "start", F.col("start").alias("end"), F.floor(F.col("n") * 100 / F.col("top")).cast("double").alias("value"), F.lit(False).alias("censored"), F.lit(True).alias("eligible"))
    dates = daily.select("phrase").distinct().select("phrase", F.explode(F.array(*[F.lit(d).cast("date") for d in ("2024-01-06", "2024-01-15", "2024-01-24")])).alias("event_date"))
    return bins, dates


def _cycles(spark: SparkSession, folder: str) -> DataFrame:
    return event_cycles.aligned(*_bins(spark, folder), ["phrase"], (-4, 4))


def event_cycle_alignment(spark: SparkSession, folder: str) -> DataFrame:
    show = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["lo"], p["hi"])), ",").alias(c)
    return _cycles(spark, folder).select("phrase", "event_date", "covered_days", "peak", "positive_bins", "zero_bins", show("peaks"), show("high"), F.array_join("issues", ",").alias("issues"))


_BINS = """
WITH d AS (SELECT event_type AS phrase, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL), b AS (SELECT phrase, day, floor(n * 100 / max(n) OVER (PARTITION BY phrase)) AS value FROM d),
e AS (SELECT unnest([DATE '2024-01-06', DATE '2024-01-15', DATE '2024-01-24']) AS event_date), u AS (SELECT phrase, event_date, date_diff('day', event_date, day) AS lo, value FROM b, e WHERE date_diff('day', event_date, day) BETWEEN -4 AND 4),
p AS (SELECT *, max(value) OVER (PARTITION BY phrase, event_date) AS peak FROM u)"""
SQL["event_cycle_alignment"] = (
    _BINS
    + """,
g AS (SELECT phrase, event_date, count(DISTINCT lo) AS covered_days, max(peak) AS peak, count(*) FILTER (WHERE value > 0) AS positive_bins, count(*) FILTER (WHERE value = 0) AS zero_bins, string_agg(lo || ':' || lo, ',' ORDER BY lo) FILTER (WHERE value = peak AND value > 0) AS peaks, string_agg(lo || ':' || lo, ',' ORDER BY lo) FILTER (WHERE value >= 0.75 * peak AND value > 0) AS high FROM p GROUP BY ALL)
SELECT *, concat_ws(',', CASE WHEN covered_days < 9 THEN 'incomplete_alignment_window' END, CASE WHEN positive_bins = 0 THEN 'threshold_zero_or_censored_only' WHEN positive_bins < 4 THEN 'sparse_exact_positive_bins' END, CASE WHEN peak > 0 AND peak < 10 THEN 'low_original_scale_resolution' END) AS issues FROM g"""
)


def event_majority_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return event_cycles.majority_intervals(_cycles(spark, folder), ["phrase"], "high")


SQL["event_majority_intervals"] = (
    _BINS
    + """,
h AS (SELECT DISTINCT phrase, event_date, lo AS day FROM p WHERE value >= 0.75 * peak AND value > 0), m AS (SELECT phrase, day FROM h GROUP BY ALL HAVING count(*) * 2 > 3), r AS (SELECT phrase, day, day - row_number() OVER (PARTITION BY phrase ORDER BY day) AS run FROM m)
SELECT phrase, min(day) AS lo, max(day) AS hi FROM r GROUP BY phrase, run"""
)


def event_holdouts(spark: SparkSession, folder: str) -> DataFrame:
    return event_cycles.holdouts(event_cycles.independent(_cycles(spark, folder), ["phrase"], 8), ["phrase"])


SQL["event_holdouts"] = (
    _BINS
    + """,
k AS (SELECT phrase, event_date, lo FROM p WHERE value = peak AND value > 0), c AS (SELECT phrase, event_date, min(lo) AS lo, max(lo) AS hi FROM k GROUP BY ALL),
t AS (SELECT *, (row_number() OVER w - 1)::INT AS training, min(lo) OVER past AS a, max(hi) OVER past AS b FROM c WINDOW w AS (PARTITION BY phrase ORDER BY event_date), past AS (PARTITION BY phrase ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT phrase, event_date, training, CASE WHEN b - a < 14 THEN a END AS predicted_lo, CASE WHEN b - a < 14 THEN b END AS predicted_hi, CASE WHEN b - a < 14 THEN EXISTS (SELECT 1 FROM k WHERE k.phrase = t.phrase AND k.event_date = t.event_date AND k.lo BETWEEN a AND b) END AS hit FROM t WHERE training >= 2"""
)

# --- embeddings


def embedding_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the vectors whose id a hundred divides, against all."""
    vectors = table(spark, folder, "embeddings")
    found = embeddings.query_top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


SQL["embedding_top_k"] = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(e, embedding::DOUBLE[]) AS s FROM q JOIN embeddings ON vec_id <> query_id)
SELECT query_id, vec_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10"""


def embedding_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.centroid_ranking(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 10).select("label", "vec_id", "similarity")


SQL["embedding_centroids"] = """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, list(s ORDER BY i) AS mean FROM (SELECT label, i, sum(v) AS s FROM x GROUP BY ALL) GROUP BY label), s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS s FROM embeddings JOIN m USING (label))
SELECT label, vec_id, s AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC NULLS LAST, vec_id) <= 10"""


def embedding_mmr(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.mmr(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 10)


def embedding_max_sum(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.max_sum(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 5)


# --- trees


def tree_depths(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of every node of region, nation and customer as one tree."""
    region = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    customer = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return spark.sql(
        """WITH RECURSIVE tree(node, parent, depth) MAX RECURSION LEVEL 12 AS (
             SELECT node, parent, 0 FROM {nodes} WHERE parent IS NULL
             UNION ALL SELECT n.node, n.parent, t.depth + 1 FROM tree t JOIN {nodes} n ON n.parent = t.node)
           SELECT depth, count(*) AS nodes, count(DISTINCT parent) AS parents FROM tree GROUP BY depth""",
        nodes=region.unionAll(nation).unionAll(customer),
    )


SQL["tree_depths"] = """
WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
t AS (SELECT node, parent, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.node, n.parent, t.depth + 1 FROM t JOIN n ON n.parent = t.node)
SELECT depth, count(*) AS nodes, count(DISTINCT parent) AS parents FROM t GROUP BY depth"""


def covered_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Periods in which each supplier's lines are under way, a line being three days long."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), 2).alias("e"))
    return intervals.covered_periods(lines, "l_suppkey", "s", "e")


SQL["covered_bins"] = """
WITH u AS (SELECT DISTINCT l_suppkey, l_shipdate::DATE AS s FROM lineitem), i AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY l_suppkey ORDER BY s) + 3 THEN 0 ELSE 1 END AS new FROM u), g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM i),
p AS (SELECT l_suppkey, k, min(s) AS s, max(s) + 2 AS e FROM g GROUP BY ALL), x AS (SELECT *, lead(s) OVER (PARTITION BY l_suppkey ORDER BY s) AS f FROM p)
SELECT l_suppkey, 'period' AS kind, s AS start_date, e AS end_date FROM p UNION ALL SELECT l_suppkey, 'gap', e + 1, f - 1 FROM x WHERE f IS NOT NULL"""

QUERIES = [
    compare_observations, compare_inner_orders, compare_performance, compare_rankings, ranking_overlap, copies_missing, report_evidence, evidence_order, keyword_gap, evidence_merged,
    search_opportunities, query_page_overlap, bulk_weighted_position, serp_competition, supplier_share_of_top, page_phrase_coverage, trend_summary, event_recency, view_completeness, quota_ledger,
    monitor_rejects, monitor_latest, monitor_conflicts, watch_matches, monitor_coverage, monitor_coverage_counts, monitor_evidence_counts, monitor_alerts, monitor_due, snapshot_integrity, shortlist_capped, focus_reasons, hashtag_plan, copy_audits,
    event_cycle_alignment, event_majority_intervals, event_holdouts, embedding_top_k, embedding_centroids, embedding_mmr, embedding_max_sum, tree_depths, covered_bins,
]
