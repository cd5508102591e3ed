"""Relative-interest series: long form, completed periods, summaries, bounds, ranks, sections.

An index is relative to its export; missing (empty), censored (``<1``) and zero
are three states.  A mean is given only if every eligible point is a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwright.functions.counts import measured


def clean_series(name: Column) -> Column:
    """Series name without a trailing ``: (region)``."""
    return F.trim(F.regexp_replace(name, r"\s*:\s*\([^)]*\)\s*$", ""))


def long_series(wide: DataFrame, period: str, terms: list[str], partial: str | None = None) -> DataFrame:
    """(period, series, raw, value, censored, missing, partial) from one text column per term."""
    cells = F.explode(F.array(*[F.struct(clean_series(F.lit(t)).alias("series"), F.trim(F.col(f"`{t}`")).alias("raw")) for t in terms]))
    flag = F.coalesce(F.lower(partial) == "true", F.lit(False)) if partial else F.lit(False)
    rows = wide.select(F.col(period).alias("period"), flag.alias("partial"), cells.alias("c")).select("period", "partial", "c.*")
    return rows.select("period", "series", "raw", measured(F.col("raw")).alias("value"), (F.coalesce(F.col("raw"), F.lit("")) == "<1").alias("censored"), F.coalesce("raw", F.lit("")).isin("", "-").alias("missing"), "partial")


def period_end(start: Column, granularity: str) -> Column:
    return {"day": start, "week": F.date_add(start, 6), "month": F.last_day(start)}[granularity]


def eligible(end: Column, captured: Column, partial: Column) -> Column:
    """Only periods over before the capture count."""
    return (end < captured) & ~partial


def summary(points: DataFrame, series: str, value: str, censored: str = "censored", eligible_when: Column | None = None) -> DataFrame:
    """Per series: points, mean and peak (null unless all are numbers), bounds of the mean with
    ``<1`` taken as [0, 1) (null if a point is missing), and counts of the states."""
    used = points if eligible_when is None else points.where(eligible_when)
    v, c = F.col(value), F.col(censored)
    all_known, no_gap = F.count(v) == F.count("*"), F.count_if(v.isNull() & ~c) == 0
    total, n = F.sum(F.coalesce(v, F.lit(0.0))), F.count("*")
    return used.groupBy(series).agg(
        n.alias("points"), F.when(all_known, F.bround(F.avg(v), 4)).alias("mean"), F.when(all_known, F.max(v)).alias("peak"),
        F.when(no_gap, F.floor(total / n * 10000) / 10000).alias("lower"), F.when(no_gap, F.ceil((total + F.count_if(c)) / n * 10000) / 10000).alias("upper"),
        F.count_if(v > 0).alias("positive_periods"), F.count_if(v == 0).alias("zero_periods"), F.count_if(v.isNull()).alias("unknown_periods"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
    )


def cohort_rank(summaries: DataFrame, cohort: list[str]) -> DataFrame:
    """Dense rank by mean within series of one export that share the summary window; null for a
    series alone and for a missing mean.  A cohort is the series of one export, so it is small."""
    by = Window.partitionBy(*cohort)
    same = (F.count("*").over(by) > 1) & (F.min("first_period").over(by) == F.max("first_period").over(by)) & (F.min("last_period").over(by) == F.max("last_period").over(by))
    rank = F.dense_rank().over(by.orderBy(F.col("mean").desc_nulls_last()))
    return summaries.withColumn("comparable", same).withColumn("cohort_rank", F.when(F.col("comparable") & F.col("mean").isNotNull(), rank))


def related_rows(lines: DataFrame, export: str, line: str, cells: str) -> DataFrame:
    """(export, section, phrase, metric, value, raw) from parsed lines of a related export.
    The section heading is carried forward; conflicting repeats are reported."""
    first, second = F.trim(F.col(cells)[0]), F.trim(F.try_element_at(F.col(cells), F.lit(2)))
    heading = F.when(F.lower(first).isin("top", "rising") & (F.coalesce(second, F.lit("")) == ""), F.lower(first))
    order = Window.partitionBy(export).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    told = lines.select(export, line, first.alias("phrase"), second.alias("raw"), heading.alias("h")).withColumn("section", F.last("h", ignorenulls=True).over(order))
    data = told.where("h IS NULL AND section IS NOT NULL AND phrase <> '' AND raw IS NOT NULL AND lower(raw) NOT IN ('value', 'score', 'interest')")
    breakout = F.lower("raw") == "breakout"
    metric = F.when(F.col("section") == "top", "related_top").when(breakout, "related_rising_breakout").otherwise("related_rising")
    rows = data.select(export, "section", F.lower("phrase").alias("phrase"), metric.alias("metric"), F.when(~breakout, measured(F.col("raw"))).alias("value"), "raw")
    return rows.groupBy(export, "section", "phrase").agg(F.min("metric").alias("metric"), F.min("value").alias("value"), F.min("raw").alias("raw"), (F.count_distinct("raw") > 1).alias("conflict"))
