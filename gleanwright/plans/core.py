"""Queries of the general data problems: periods and gaps, times, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.functions.text import query_form
from gleanwright.functions.urls import normal_url
from gleanwright.operators import intervals, snapshots, timestamps
from gleanwright.session import table

SQL: dict[str, str] = {}
TIMES = (("posts", "id", "created_at"), ("media", "id", "timestamp"), ("videos", "id", "published_at"), ("observed_evidence", "evidence_id", "observed_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = intervals.covered_periods(table(spark, folder, "observations_after"), "series_id", "period_start", "period_end")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("series_id", "kind", day("start_date"), day("end_date"))


SQL["p2_found"] = """
WITH u AS (SELECT DISTINCT series_id, period_start AS s, period_end AS e FROM observations_after WHERE series_id IS NOT NULL AND period_start <= period_end),
m AS (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM u),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT series_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
g AS (SELECT series_id, s, e, lead(s) OVER (PARTITION BY series_id ORDER BY s) AS following FROM p)
SELECT series_id, 'period' AS kind, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date FROM p
UNION ALL SELECT series_id, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(following - 1, '%Y-%m-%d') FROM g WHERE following IS NOT NULL"""


def time_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, t).select(F.struct(F.lit(t).alias("tbl"), F.col(key).cast("string").alias("id")).alias("id"), F.col(c).alias("written"), "feed", "captured_at")
        for t, key, c in TIMES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = timestamps.normalised(time_rows(spark, folder), table(spark, folder, "feeds"))
    return found.where("id.id IS NOT NULL").select("id.tbl", "id.id", "utc_micros")


def p4_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone that each feed's own rows speak for, without its declared zone."""
    feeds = table(spark, folder, "feeds")
    return timestamps.chosen_zones(timestamps.parsed_rows(time_rows(spark, folder), feeds), timestamps.all_zones(feeds))


def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables as (tbl, stream_id, observed_at, delivered_at, item, a, b); of repeated rows of
    an item the greatest a and b count, so the best rank is the greatest of its negatives."""
    bwt, serp = table(spark, folder, "bwt_before"), table(spark, folder, "serp_after")
    query, page = F.nullif(query_form(F.col("query")), F.lit("")), F.coalesce(normal_url(F.col("page")), F.lit(""))
    common = ["observed_at", "delivered_at"]
    pages = bwt.select(F.lit("bwt_before").alias("tbl"), F.col("site_id").alias("stream_id"), *common, F.concat(query, F.lit("|"), page).alias("item"), F.col("clicks").alias("a"), F.col("impressions").alias("b"))
    rank, none = (-F.col("rank")).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")
    return pages.unionAll(serp.select(F.lit("serp_after").alias("tbl"), F.col("serp_id").alias("stream_id"), *common, F.nullif(normal_url(F.col("url")), F.lit("")).alias("item"), rank, none))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot_rows(spark, folder)
    found = snapshots.snapshot_changes(rows, ["tbl", "stream_id"], "observed_at", "delivered_at", "item", {"a": F.max("a"), "b": F.max("b")})
    return found.select("tbl", "stream_id", F.date_format("observed_on", "yyyy-MM-dd").alias("observed_on"), "item", "change_kind")


_ADDRESS = r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q'])"
_WRITTEN = "lower({0}.s) || '://' || lower({0}.h) || CASE WHEN {0}.p = '' THEN '/' ELSE {0}.p END || {0}.q"


def _changes(name: str, source: str, stream: str, item: str, value: str) -> str:
    return f"""
{name}_l AS (SELECT * FROM {source} QUALIFY delivered_at IS NOT DISTINCT FROM max(delivered_at) OVER (PARTITION BY {stream}, observed_at)),
{name}_d AS (SELECT DISTINCT {stream} AS stream_id, observed_at FROM {name}_l),
{name}_n AS (SELECT *, lead(observed_at) OVER (PARTITION BY stream_id ORDER BY observed_at) AS next_on, lag(observed_at) OVER (PARTITION BY stream_id ORDER BY observed_at) AS prior_on FROM {name}_d),
{name}_x AS (SELECT {stream} AS stream_id, observed_at, {item} AS item, {value} AS v FROM {name}_l GROUP BY ALL HAVING item IS NOT NULL),
{name} AS (
  SELECT a.stream_id, n.observed_at AS observed_on, a.item, CASE WHEN b.item IS NULL THEN 'added' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change_kind
  FROM {name}_x a JOIN {name}_n n ON n.stream_id = a.stream_id AND n.observed_at = a.observed_at LEFT JOIN {name}_x b ON b.stream_id = a.stream_id AND b.observed_at = n.prior_on AND b.item = a.item WHERE n.prior_on IS NOT NULL
  UNION ALL SELECT b.stream_id, n.next_on, b.item, 'removed' FROM {name}_x b JOIN {name}_n n ON n.stream_id = b.stream_id AND n.observed_at = b.observed_at
  LEFT JOIN {name}_x a ON a.stream_id = b.stream_id AND a.observed_at = n.next_on AND a.item = b.item WHERE n.next_on IS NOT NULL AND a.item IS NULL)"""


_BWT = f"(SELECT *, {_ADDRESS.format('page')} AS a FROM bwt_before)"
_SERP = f"(SELECT *, {_ADDRESS.format('url')} AS a FROM serp_after)"
_QUERY = r"nullif(trim(regexp_replace(lower(nfc_normalize(query)), '\s+', ' ', 'g')), '')"
SQL["p6_found"] = (
    "WITH"
    + _changes("b", _BWT, "site_id", f"{_QUERY} || '|' || CASE WHEN page IS NULL THEN '' ELSE {_WRITTEN.format('a')} END", "{'c': max(clicks), 'i': max(impressions)}").replace("GROUP BY ALL", "GROUP BY site_id, observed_at, item")
    + ","
    + _changes("s", _SERP, "serp_id", f"CASE WHEN url IS NOT NULL THEN {_WRITTEN.format('a')} END", "min(rank)").replace("GROUP BY ALL", "GROUP BY serp_id, observed_at, item")
    + """
SELECT 'bwt_before' AS tbl, stream_id, strftime(observed_on, '%Y-%m-%d') AS observed_on, item, change_kind FROM b WHERE change_kind IS NOT NULL
UNION ALL SELECT 'serp_after', stream_id, strftime(observed_on, '%Y-%m-%d'), item, change_kind FROM s WHERE change_kind IS NOT NULL"""
)

QUERIES = [p2_found, p4_found, p4_zones, p6_found]
