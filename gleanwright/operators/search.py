"""Search performance and result pages: opportunities, overlap, period totals, competition."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwright.functions.urls import host


def opportunities(rows: DataFrame, impressions: str, clicks: str, position: str, min_impressions: float = 100, low: float = 4, high: float = 20, max_ctr: float = 1, target_ctr: float | None = None) -> DataFrame:
    """Rows with many impressions, a middling position and a low click rate; with ``target_ctr``
    the clicks that rate would add, never below zero.  A missing measure excludes the row."""
    ctr = F.try_divide(F.col(clicks), F.col(impressions))
    found = rows.withColumn("ctr", ctr).where((F.col(impressions) >= min_impressions) & F.col(position).between(low, high) & (F.col("ctr") <= max_ctr))
    if target_ctr is None:
        return found
    return found.withColumn("scenario_clicks", F.greatest(F.lit(0.0), (F.lit(float(target_ctr)) - F.col("ctr")) * F.col(impressions)))


def page_overlap(rows: DataFrame, group: list[str], page: str, impressions: str) -> DataFrame:
    """Groups shown with several pages: pages, total impressions (null if any is missing) and
    the share of the page with most."""
    by_page = rows.where(F.col(page).isNotNull()).groupBy(*group, page).agg(F.sum(impressions).alias("i"), F.count_if(F.col(impressions).isNull()).alias("gone"))
    total = F.when(F.sum("gone") == 0, F.sum("i"))
    return by_page.groupBy(*group).agg(F.count("*").alias("pages"), total.alias("impressions"), F.try_divide(F.max("i"), total).alias("largest_share")).where("pages > 1")


BULK_SQL = """
SELECT {dims}, sum({clicks}) AS clicks, sum({impressions}) AS impressions,
       try_divide(sum({clicks}), sum({impressions})) AS ctr,
       try_divide(sum({position} * {impressions}), sum({impressions})) + {offset} AS average_position
FROM {table}
WHERE {day} BETWEEN :start AND :end
GROUP BY ALL ORDER BY impressions DESC, {dims}
"""


def bulk_totals(spark: SparkSession, rows: DataFrame, dims: list[str], columns: dict[str, str], start: date, end: date, condition: Column | None = None, offset: int = 1) -> DataFrame:
    """Totals of a period, one row for every group, with the position weighted by impressions
    (stored from zero).  Values go to the statement as parameters; names are quoted."""
    name = lambda c: "`" + c.replace("`", "``") + "`"
    text = BULK_SQL.format(dims=", ".join(map(name, dims)), table="{rows}", offset=int(offset), **{k: name(v) for k, v in columns.items()})
    return spark.sql(text, args={"start": start, "end": end}, rows=rows if condition is None else rows.where(condition))


def competition(results: DataFrame, group: list[str], url: str, rank: str, title: str, phrase: Column, target: str | None = None, top: int = 10, strip_www: bool = True) -> DataFrame:
    """First ``top`` results of each page: results, distinct hosts, largest host's share, titles
    with the phrase, best rank of the target host, and whether all ranks were observed.

    Counts go by host first, so a page of one host is a few rows."""
    best = results.where(F.col(url).isNotNull()).groupBy(*group, url).agg(F.min(rank).alias("r"), F.max(title).alias("t"), F.max(phrase).alias("q"))
    within = best.where(F.col("r") <= top).withColumn("h", host(F.col(url), strip_www))
    literal = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.lit("\\Q"), F.lower("q"), F.lit("\\E"), F.lit(r"(?![\p{L}\p{N}_])"))
    named = F.regexp(F.lower("t"), literal)
    own = (F.col("h") == target) | F.endswith("h", F.lit(f".{target}")) if target else F.lit(False)
    by_host = within.groupBy(*group, "h").agg(F.count("*").alias("n"), F.count_if(named).alias("m"), F.min(F.when(own, F.col("r"))).alias("best"), F.count_distinct("r").alias("d"), F.max("r").alias("last"))
    return by_host.groupBy(*group).agg(
        F.sum("n").alias("results"), F.count("h").alias("hosts"), (F.max("n") / F.sum("n")).alias("largest_host_share"),
        F.sum("m").alias("title_matches"), F.min("best").alias("target_rank"), (F.max("last") == F.sum("d")).alias("all_ranks_observed"),
    )


def ctr_consistent(clicks: Column, impressions: Column, ctr: Column, tolerance: float = 1e-4) -> Column:
    """Clicks do not exceed impressions and a supplied rate agrees with them; null if unknown."""
    return (clicks <= impressions) & (ctr.isNull() | (F.abs(ctr - F.try_divide(clicks, impressions)) <= tolerance))


def page_coverage(pages: DataFrame, phrase: Column, fields: list[str]) -> DataFrame:
    """How often a phrase stands in each field of a page, without regard to case."""
    literal = F.concat(F.lit("\\Q"), F.lower(phrase), F.lit("\\E"))
    return pages.select("*", *[F.coalesce(F.regexp_count(F.lower(f), literal), F.lit(0)).cast("bigint").alias(f"{f}_matches") for f in fields])


def share_of_top(rows: DataFrame, group: list[str], order: list[Column], top: int, by: str) -> DataFrame:
    """Among each group's first ``top`` rows the share of each value of ``by``."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= top)
    counted = first.groupBy(*group, by).agg(F.count("*").alias("n"))
    return counted.select(*group, by, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(*group))).alias("share"))
