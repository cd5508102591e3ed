"""Comparison of two snapshots of measurements, one operator with nine profiles.

``inner`` profiles report only what both sides measured; ``full`` profiles also
report rows that appeared or disappeared.  Approximate and unavailable rows give
no change.  A repeated identity on a side can't be compared; it is reported as
``conflict`` and not resolved.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwright.functions.counts import percent_change


@dataclass(frozen=True)
class Profile:
    """keys: what rows are joined on; same: columns that must have one value over both sides;
    without: flags whose rows take no part; blank: flags whose rows give no change."""

    keys: tuple[str, ...]
    how: str = "inner"
    base: str = "signed"
    only: tuple[str, ...] = ()
    without_prefix: tuple[str, ...] = ()
    whole_days: bool = False
    same: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    blank: tuple[str, ...] = ()
    whole: bool = False
    some: bool = False
    skips: bool = False


# What the comparisons of the nine report families join on and ask for.
PROFILES = {
    "video-observations": Profile(("phrase", "kind", "source", "scope", "geography", "window", "metric", "unit", "definition"), without_prefix=("sample_", "occurrences"), without=("approximate",)),
    "short-video-observations": Profile(("phrase", "source", "metric", "unit", "geography", "scope", "window"), only=("reported_post_count", "reported_view_count", "estimated_search_volume"), without=("approximate",), some=True),
    "tag-statistics": Profile(("phrase", "source", "metric", "unit", "geography"), same=("comparison_scope",), without=("approximate",)),
    "mentions": Profile(("phrase", "relationship", "metric", "unit", "source", "geography"), "full", "positive", same=("report_source", "report_scope", "country", "period", "analysis_signature"), without=("approximate",), whole=True),
    "search-observations": Profile(("phrase", "metric", "unit", "source", "scope", "country", "language", "device", "window"), whole_days=True, blank=("approximate",), some=True),
    "panel-observations": Profile(("phrase", "source", "scope", "metric", "unit", "geography"), "full"),
    "panel-measurements": Profile(("phrase", "source", "scope", "metric", "unit", "geography", "period_start", "period_end"), "full", blank=("approximate",), skips=True),
    "search-performance": Profile(("query", "page"), "full"),
    "search-performance-buckets": Profile(("query", "page", "bucket"), "full"),
    "ranking": Profile(("url",), "full"),
}


def _usable(rows: DataFrame, profile: Profile) -> DataFrame:
    if profile.only:
        rows = rows.where(F.col("metric").isin(list(profile.only)))
    for prefix in profile.without_prefix:
        rows = rows.where(~F.startswith("metric", F.lit(prefix)))
    return rows


def _side(rows: DataFrame, keys: list[str], values: list[str], at: str | None, name: str) -> DataFrame:
    times = [F.max(at).alias(f"at_{name}")] if at else []
    return rows.groupBy(*[F.col(k).alias(f"_{name}_{k}") for k in keys]).agg(
        F.count("*").alias(f"rows_{name}"), *[F.max(v).alias(f"{v}_{name}") for v in values], *times
    )


def compare(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], how: str = "inner", at: str | None = None, base: str = "signed", whole_days: bool = False) -> DataFrame:
    """keys, state (both | added | removed | conflict), and for each value its before, after,
    change and percent; with ``at`` also days and change per day.  Null keys equal null."""
    a, b = _side(before, keys, values, at, "before"), _side(after, keys, values, at, "after")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_before_{k}").eqNullSafe(F.col(f"_after_{k}"))
    joined = a.join(b, on, "inner" if how == "inner" else "full_outer")
    there, then = F.col("rows_after").isNotNull(), F.col("rows_before").isNotNull()
    conflict = (F.coalesce("rows_after", F.lit(0)) > 1) | (F.coalesce("rows_before", F.lit(0)) > 1)
    state = F.when(conflict, "conflict").when(then & there, "both").when(there, "added").otherwise("removed")
    out = joined.select(*[F.coalesce(f"_after_{k}", f"_before_{k}").alias(k) for k in keys], state.alias("state"), *[c for c in joined.columns if not c.startswith(("_", "rows_"))])
    can = F.col("state") == "both"
    days = None
    if at:
        days = F.date_diff("at_after", "at_before").cast("double") if whole_days else (F.unix_micros("at_after") - F.unix_micros("at_before")) / F.lit(86_400_000_000)
        out = out.withColumn("days", days)
        can = can & (F.col("days") > 0)
    for v in values:
        x, y = F.col(f"{v}_before"), F.col(f"{v}_after")
        out = out.withColumn(f"{v}_change", F.when(can, y - x)).withColumn(f"{v}_percent", F.when(can, percent_change(x, y, base)))
        if at:
            out = out.withColumn(f"{v}_per_day", F.when(can, F.try_divide(y - x, F.col("days"))))
    return out


def analysis_signature(options: dict[str, object]) -> str:
    """Digest of the settings that decide what an analysis counts, absent ones by their default."""
    # The settings and their defaults.
    defaults = {
        "include_keywords": True, "include_hashtags": True, "include_flair": True, "include_nsfw": False, "exclude_stickied": False,
        "min_words": 1, "max_words": 3, "min_occurrences": 1, "max_candidates": 10000, "stopwords": "",
    }
    return hashlib.sha256(json.dumps({k: options.get(k, v) for k, v in defaults.items()}, sort_keys=True).encode()).hexdigest()


def _needed(name: str, rows: DataFrame, columns: tuple[str, ...]) -> None:
    if lacking := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{name} lacks {', '.join(lacking)}")


def _refused(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """The rows; reading them raises when a test (an aggregate of one row) holds."""
    problem = F.coalesce(*[F.when(test, F.lit(text)) for text, test in tests.items()])
    return rows.where(F.when(problem.isNull(), True).otherwise(F.raise_error(problem).cast("boolean")))


def compare_profile(name: str, before: DataFrame, after: DataFrame, value: str = "value", at: str | None = "observed_at", checked: bool = True) -> DataFrame:
    """Rows compared by the identity of their family.  A side that lacks a part of it can't be
    compared at all, and raises; so do, when the result is read, sides that differ in what they
    must have in common, sides cut off by a limit (``output_truncated``), sides not in the order of
    time, and for some families sides without any identity in common.  ``checked`` False leaves
    out the tests that need columns of the whole report.

    Families with skipped rows have ``reason`` instead of a change where there is none."""
    p = PROFILES[name]
    asked = (*p.same, *(("output_truncated",) if p.whole else ())) if checked else ()
    for side, rows in (("before", before), ("after", after)):
        _needed(f"{name}: {side}", rows, (*p.keys, *p.without, *p.blank, *asked))
    keep = lambda rows: _usable(rows, p).where(reduce(and_, [~F.coalesce(F.col(c), F.lit(False)) for c in p.without], F.lit(True)))
    blank = lambda rows: rows.withColumn(value, F.when(reduce(and_, [~F.coalesce(F.col(c), F.lit(False)) for c in p.blank], F.lit(True)), F.col(value)))
    found = compare(blank(keep(before)), blank(keep(after)), list(p.keys), [value], p.how, at, p.base, p.whole_days)
    tests: dict[str, Column] = {}
    if asked:
        of = lambda rows, c: (rows.agg(F.min(c).alias("x")).scalar(), rows.agg(F.max(c).alias("x")).scalar())
        for c in p.same:
            (a, b), (x, y) = of(before, c), of(after, c)
            tests[f"{name}: the sides differ in {c}"] = ~(a.eqNullSafe(b) & b.eqNullSafe(x) & x.eqNullSafe(y))
        if p.whole:
            tests[f"{name}: a side is cut off by its limit"] = F.coalesce(of(before, "output_truncated")[1], F.lit(False)) | F.coalesce(of(after, "output_truncated")[1], F.lit(False))
    if at and checked:
        latest, first = before.agg(F.max(at).alias("x")).scalar(), after.agg(F.min(at).alias("x")).scalar()
        tests[f"{name}: the second side isn't later than the first"] = F.coalesce(latest >= first, F.lit(False))
    if p.some and checked:
        tests[f"{name}: no identity in common"] = found.limit(1).agg(F.count("*").alias("x")).scalar() == 0
    if p.skips:
        gone = F.col(f"{value}_before").isNull() | F.col(f"{value}_after").isNull()
        found = found.withColumn("reason", F.when(gone, "missing, differently scoped or approximate"))
    if not tests:
        return found
    # The tests stand on a row of their own, since a comparison without rows would never read them.
    judge = _refused(before.sparkSession.range(1), tests).where("id < 0")
    return found.unionByName(judge.select(*[F.lit(None).cast(k).alias(c) for c, k in found.dtypes]))


def period_problem(before: dict[str, str], after: dict[str, str]) -> str | None:
    """Why two reporting periods (start_date, end_date) can't be compared, or None."""
    try:
        a, b, c, d = (date.fromisoformat(x[k]) for x in (before, after) for k in ("start_date", "end_date"))
    except (KeyError, TypeError, ValueError):
        return "periods need valid start and end dates"
    return None if a <= b < c <= d and b - a == d - c else "periods must follow each other and be equally long"


def compare_periods(before: DataFrame, after: DataFrame, keys: list[str], periods: tuple[dict[str, str], dict[str, str]], context: tuple[dict, dict] = ({}, {})) -> DataFrame:
    """Clicks, impressions, rate and position of two reports of equal periods and one context; the
    change of a rate is in percentage points.  Keys of dates or hours can't be compared."""
    if problem := period_problem(*periods):
        raise ValueError(problem)
    if context[0] != context[1]:
        raise ValueError("reports differ in " + ", ".join(sorted(k for k in context[0] | context[1] if context[0].get(k) != context[1].get(k))))
    if dated := {"date", "hour"} & set(keys):
        raise ValueError(f"keys {', '.join(sorted(dated))} differ between periods by nature")
    found = compare(before, after, keys, ["clicks", "impressions", "ctr", "position"], "full")
    presence = F.when(F.col("state") == "added", "only_after").when(F.col("state") == "removed", "only_before").otherwise(F.col("state"))
    points = F.col("ctr_change") * 100
    return found.withColumn("presence", presence).withColumn("ctr_change", points).drop("state", *[f"{c}_percent" for c in ("clicks", "impressions", "ctr", "position")])


def rank_changes(before: DataFrame, after: DataFrame, group: list[str], url: str, rank: str, top: int | None = None) -> DataFrame:
    """Full outer comparison of two rankings by url, within the first ``top`` ranks: rank before
    and after, and change (positive: moved up)."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        best = rows.where(F.col(url).isNotNull()).groupBy(*group, url).agg(F.min(rank).alias(f"rank_{name}"))
        return best.where(F.col(f"rank_{name}") <= top) if top else best

    joined = side(before, "before").join(side(after, "after"), [*group, url], "full_outer")
    state = F.when(F.col("rank_before").isNull(), "entered").when(F.col("rank_after").isNull(), "left").otherwise("stayed")
    return joined.select(*group, url, "rank_before", "rank_after", state.alias("state"), (F.col("rank_before") - F.col("rank_after")).alias("moved_up"))


def set_overlap(changes: DataFrame, group: list[str]) -> DataFrame:
    """Jaccard of the url sets of a ranking comparison."""
    stayed = F.count_if(F.col("state") == "stayed")
    return changes.groupBy(*group).agg(stayed.alias("shared"), F.count("*").alias("either"), (stayed / F.count("*")).alias("jaccard"))


def net_difference(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multiset difference both ways."""
    return before.exceptAll(after), after.exceptAll(before)


def with_conflicts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Identities whose rows disagree."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("signatures")).where("signatures > 1")
