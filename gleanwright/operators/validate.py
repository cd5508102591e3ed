"""Laws of reports: what a row or a whole report must be before it is evidence.

Every validator returns the rows with ``problem``, the first broken law or null.
Nothing is repaired or cut: a report with a problem is refused as a whole by
``accepted``.  Reports are told apart by the columns named ``report``; a null in
a measure is missing and breaks no law by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds and units of the report families.
MOST_ROWS = 50_000
MOST_RESULTS = {"google": 1_000, "bing": 2_000}
MEASURE_UNITS = {
    "estimated_search_volume": "searches_per_month", "last_month_search_volume": "searches_last_month", "keyword_impressions": "impressions_in_reported_period",
    "broad_keyword_impressions": "broad_impressions_in_reported_period", "organic_difficulty": "provider_index_0_100", "paid_competition": "provider_index_0_1",
    "trend_interest": "provider_relative_index", "referring_domains": "count", "backlinks": "count",
}
HIGHEST = {"organic_difficulty": 100.0, "paid_competition": 1.0}
TOLERANCE = 1e-4


def first_of(rules: dict[str, Column]) -> Column:
    """The name of the first rule that is broken; a rule of unknown outcome is not broken."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()])


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def copies(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds how many rows have the same keys, nulls being equal; counted before the shuffle."""
    counted = rows.groupBy(*[F.col(k).alias(f"_{name}_{n}") for n, k in enumerate(keys)]).agg(F.count("*").alias(name))
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{name}_{n}"))
    return rows.join(counted, on).drop(*[f"_{name}_{n}" for n in range(len(keys))])


def derived_rate(clicks: str = "clicks", impressions: str = "impressions") -> Column:
    return F.try_divide(F.col(clicks).cast("double"), F.col(impressions))


def console_report(rows: DataFrame, report: list[str], dimensions: list[str]) -> DataFrame:
    """Reports of dimensions: each row has every dimension and is there once; a rate is a fraction
    and is derived where none is given (a given one is kept)."""
    sized = copies(copies(rows, [*report, *dimensions], "_same"), report, "_rows")
    given = F.col("ctr") if "ctr" in rows.columns else F.lit(None).cast("double")
    out = sized.withColumn("ctr", F.coalesce(given, derived_rate()))
    rules = {
        "missing-dimension": F.exists(F.array(*[F.col(d).isNull() for d in dimensions]), lambda x: x), "duplicate-row": F.col("_same") > 1,
        "negative-measure": (F.col("clicks") < 0) | (F.col("impressions") < 0) | (F.col("position") < 0), "clicks-exceed-impressions": F.col("clicks") > F.col("impressions"),
        "rate-no-fraction": ~F.col("ctr").between(0, 1), "too-many-rows": F.col("_rows") > MOST_ROWS,
    }
    return out.withColumn("problem", first_of(rules)).drop("_same", "_rows")


def webmaster_report(rows: DataFrame, report: list[str], granularity: str = "period") -> DataFrame:
    """Reports by query, page, date and position bucket.  ``period`` rows have no date of their own,
    ``native-buckets`` rows must have one; a given rate must agree with clicks and impressions."""
    if granularity not in ("period", "native-buckets"):
        raise ValueError(f"unknown granularity {granularity}")
    keys = ["query", "page", "date", "position_bucket"]
    sized = copies(copies(rows, [*report, *keys], "_same"), report, "_rows")
    rate = derived_rate()
    given = F.col("ctr") if "ctr" in rows.columns else F.lit(None).cast("double")
    rules = {
        "no-bucket-date": F.col("date").isNull() & F.lit(granularity == "native-buckets"), "date-in-period-total": F.col("date").isNotNull() & F.lit(granularity == "period"), "blank-query": F.col("query").isNotNull() & blank("query"),
        "page-no-address": F.col("page").isNotNull() & ~F.col("page").rlike(r"(?i)^https?://[^/\s]+"), "duplicate-row": F.col("_same") > 1, "negative-measure": (F.col("clicks") < 0) | (F.col("impressions") < 0),
        "clicks-exceed-impressions": F.col("clicks") > F.col("impressions"), "rate-disagrees": F.abs(given - rate) > TOLERANCE, "rate-no-fraction": ~given.between(0, 1), "too-many-rows": F.col("_rows") > MOST_ROWS,
    }
    return sized.withColumn("problem", first_of(rules)).withColumn("ctr", F.coalesce(rate, given)).drop("_same", "_rows")


def result_report(rows: DataFrame, report: list[str], engine: str = "google") -> DataFrame:
    """Result pages: ranks are positive whole numbers and no rank has two addresses; of an address
    met again only the best rank stays.  rows: (report, url, rank, other columns)."""
    counted = copies(rows, report, "_rows")
    best = counted.withColumn("_n", F.row_number().over(Window.partitionBy(*report, "url").orderBy(F.col("rank").asc_nulls_first()))).where((F.col("_n") == 1) | F.col("url").isNull())
    shared = copies(best, [*report, "rank"], "_same")
    rules = {
        "no-address": ~F.coalesce(F.col("url").rlike(r"(?i)^https?://[^/\s]+"), F.lit(False)), "no-rank": F.col("rank").isNull() | (F.col("rank") < 1) | (F.col("rank") != F.floor("rank")),
        "shared-rank": F.col("_same") > 1, "too-many-results": F.col("_rows") > MOST_RESULTS[engine],
    }
    return shared.withColumn("problem", first_of(rules)).drop("_n", "_same", "_rows")


def measurements(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Measurements: labelled, with both bounds of a period or none, in the documented unit of their
    metric and within its range, each identity once.  rows: phrase, source, scope, metric, unit,
    observed_at, period_start, period_end, value and the columns of ``identity``."""
    sized = copies(rows, identity, "_same")
    unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in MEASURE_UNITS.items() for x in pair]), F.col("metric"))
    high = F.try_element_at(F.create_map(*[F.lit(x) for pair in HIGHEST.items() for x in pair]), F.col("metric"))
    rules = {
        "missing-label": blank("phrase") | blank("source") | blank("scope") | blank("metric") | blank("unit"), "missing-capture-time": F.col("observed_at").isNull(),
        "half-period": F.col("period_start").isNull() != F.col("period_end").isNull(), "period-out-of-order": F.col("period_start") > F.col("period_end"), "other-unit": F.col("unit") != unit,
        "negative-value": F.col("value") < 0, "over-range": F.col("value") > high, "duplicate-identity": F.col("_same") > 1,
    }
    return sized.withColumn("problem", first_of(rules)).drop("_same")


def watches(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Watches: named, with a known kind, cadence and freshness within bounds and thresholds that
    aren't negative.  rows: id, subject, platform, evidence_kind, cadence_hours, freshness_days,
    min_absolute_change, min_percent_change."""
    rules = {
        "missing-label": blank("id") | blank("subject") | blank("platform"), "unknown-evidence-kind": ~F.col("evidence_kind").isin(*kinds), "cadence-out-of-bounds": ~F.col("cadence_hours").between(1, 87_600),
        "freshness-out-of-bounds": ~F.col("freshness_days").between(1, 3_650), "negative-threshold": (F.col("min_absolute_change") < 0) | (F.col("min_percent_change") < 0),
    }
    return rows.withColumn("problem", first_of(rules))


def verdicts(judged: DataFrame, report: list[str]) -> DataFrame:
    """(report, rows, broken, problem): for each report its number of rows, of rows with a problem,
    and the problem that comes first in the alphabet."""
    return judged.groupBy(*report).agg(F.count("*").alias("rows"), F.count("problem").alias("broken"), F.min("problem").alias("problem"))


def accepted(judged: DataFrame, report: list[str]) -> DataFrame:
    """The rows of reports without a problem."""
    whole = verdicts(judged, report).where("problem IS NULL").select(*[F.col(c).alias(f"_{c}") for c in report])
    on = F.lit(True)
    for c in report:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return judged.join(whole, on, "left_semi").drop("problem")
