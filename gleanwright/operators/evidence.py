"""The long evidence table: one row per phrase, source and metric.

A row's value is one of number, exact decimal or text; metrics of different
sources are unioned, never added or averaged.  Ordering by a metric takes a
phrase's value only if all its values of that metric agree; conflicting and
missing values come last in both directions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwright.operators.terms import folded

COLUMNS = ("phrase", "relationship", "source", "metric", "value", "label", "unit", "observed_at", "geography", "scope")


def from_wide(rows: DataFrame, phrase: Column, metrics: dict[str, tuple[str, str]], source: Column, keep: list[str]) -> DataFrame:
    """One evidence row per metric: metrics maps a column to (metric name, unit).  Rows without
    a phrase give none; a missing measurement stays a row with a null value."""
    parts = [F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit")) for c, (name, unit) in metrics.items()]
    return rows.select(phrase.alias("phrase"), source.alias("source"), *keep, F.explode(F.array(*parts)).alias("m")).where("phrase IS NOT NULL AND phrase <> ''").select(
        "phrase", "source", *keep, "m.metric", "m.value", "m.unit"
    )


def fallback_label(query: Column, page: Column, rest: Column, site: Column) -> Column:
    """Query, else page, else the joined dimensions, else the site."""
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(page, F.lit("")), F.nullif(rest, F.lit("")), site)


def union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def merged(evidence: DataFrame, identity: Column, order: Column, distinct: bool = True) -> DataFrame:
    """(identity, phrase, sources, pieces): one row per identity with its first spelling and the
    number of its sources and measurements, repeats once if ``distinct``.  The measurements
    themselves stay rows of the long table; no identity's are gathered in one row."""
    piece = ["source", "metric", "unit", "value"]
    by_piece = evidence.select(identity.alias("identity"), order.alias("_o"), "phrase", *piece).groupBy("identity", *piece).agg(
        F.min("_o").alias("_o"), F.min_by("phrase", "_o").alias("phrase"), F.lit(1).cast("bigint").alias("n") if distinct else F.count("*").alias("n")
    )
    by_source = by_piece.groupBy("identity", "source").agg(F.min("_o").alias("_o"), F.min_by("phrase", "_o").alias("phrase"), F.sum("n").alias("n"))
    return by_source.groupBy("identity").agg(F.min_by("phrase", "_o").alias("phrase"), F.count("source").alias("sources"), F.sum("n").alias("pieces"))


def gap(ours: DataFrame, theirs: DataFrame, identity: str) -> DataFrame:
    """Rows of ``theirs`` whose identity ours lacks."""
    return theirs.join(ours.select(identity).distinct(), identity, "left_anti")


@dataclass(frozen=True)
class Ordering:
    """How a family of results puts its phrases in order.

    pick: of several values of the metric ``agreed`` takes the one they all have, ``single`` the
    only one and ``first`` the one given first; without such a value a phrase comes last.
    keys: what decides between equal values."""

    pick: str
    keys: tuple[str, ...]
    ascending_ends: tuple[str, ...] = ()
    must_exist: bool = False


# The orders of the result families.
ORDERINGS = {
    "video": Ordering("agreed", ("folded", "phrase")), "short-video": Ordering("first", ("phrase",)), "tag": Ordering("agreed", ("phrase",)),
    "search": Ordering("single", ("folded", "phrase"), must_exist=True), "panel": Ordering("first", ("phrase",), must_exist=True),
    "mentions": Ordering("first", ("phrase", "relationship")), "mentions-provider": Ordering("first", ("phrase",), ("position",), True),
}


def ordered(evidence: DataFrame, family: str, metric: str, position: str = "position", ascending: bool = False) -> DataFrame:
    """(phrase, relationship, value) in the order of a family; phrases without a value last.
    evidence: (phrase, relationship, metric, value, ``position`` of a measurement in its phrase).

    ``must_exist`` families refuse a metric that no row has."""
    o = ORDERINGS[family]
    of_metric = F.when((F.col("metric") == metric) & F.col("value").isNotNull(), F.col("value"))
    least, most = F.min(of_metric), F.max(of_metric)
    picked = {"agreed": F.when(least == most, least), "single": F.when(F.count(of_metric) == 1, least), "first": F.min_by(of_metric, F.when(of_metric.isNotNull(), F.col(position)))}[o.pick]
    found = evidence.groupBy("phrase", "relationship").agg(picked.alias("value"), F.max(F.col("metric") == metric).alias("_has")).withColumn("folded", folded(F.col("phrase")))
    if o.must_exist:
        known = F.coalesce(found.agg(F.max("_has").alias("k")).scalar(), F.lit(True))
        found = found.where(F.when(known, True).otherwise(F.raise_error(F.lit(f"no row has the metric {metric}")).cast("boolean")))
    up = ascending or metric.endswith(o.ascending_ends) if o.ascending_ends else ascending
    by = F.col("value").asc_nulls_last() if up else F.col("value").desc_nulls_last()
    return found.orderBy(by, *o.keys).select("phrase", "relationship", "value")


def ordered_by_metric(evidence: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """(phrase, value): a phrase's value of the metric, null if it is missing or in conflict."""
    of_metric = F.when(F.col("metric") == metric, F.col("value"))
    found = evidence.groupBy("phrase").agg(F.min(of_metric).alias("lo"), F.max(of_metric).alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    ranked = found.select("phrase", value.alias("value"))
    return ranked.orderBy(F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last(), F.lower("phrase"), "phrase")


def ranked_phrases(scores: DataFrame, per_document: int, limit: int) -> DataFrame:
    """(phrase, score, occurrences) from (document, phrase, score, occurrences): each document's
    best ``per_document`` phrases, then the best ``limit`` of all by their greatest score, their
    occurrences in the documents that chose them, and the phrase."""
    within = Window.partitionBy("document").orderBy(F.col("score").desc(), "phrase")
    chosen = scores.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_document)
    total = scores.groupBy("phrase").agg(F.sum("occurrences").alias("occurrences"))
    best = chosen.groupBy("phrase").agg(F.max("score").alias("score")).join(total, "phrase")
    return best.select("phrase", "score", "occurrences").orderBy(F.col("score").desc(), F.col("occurrences").desc(), "phrase").limit(limit)


def limited(ordered: DataFrame, limit: int) -> DataFrame:
    """The first rows with ``output_truncated``: whether more were there."""
    more = ordered.limit(limit + 1).agg((F.count("*") > limit).alias("output_truncated"))
    return ordered.limit(limit).withColumn("output_truncated", more.scalar())


def candidates(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The nested form at the edge: one row per candidate with its evidence."""
    rest = [c for c in evidence.columns if c not in keys]
    return evidence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("evidence"))


def in_returned_order(rows: DataFrame, array: str, keys: list[str], identity=None) -> DataFrame:
    """Suggestions with their returned order; with ``identity`` only the first of each."""
    out = rows.select(*keys, F.posexplode(array).alias("at", "phrase")).withColumn("position", F.col("at") + 1).drop("at")
    if identity is None:
        return out
    first = Window.partitionBy(*keys, identity(F.col("phrase"))).orderBy("position")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def enriched(requested: DataFrame, details: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requested rows with their details, and the requested keys that have none."""
    return requested.join(details, key, "left"), requested.join(details.select(key), key, "left_anti").select(key)


def unreturned(asked: DataFrame, returned: DataFrame, identity) -> DataFrame:
    """Asked phrases that the answer lacks, by identity."""
    back = returned.select(identity(F.col("phrase")).alias("_i")).distinct()
    return asked.withColumn("_i", identity(F.col("phrase"))).join(back, "_i", "left_anti").drop("_i")


def actor_rows(rows: DataFrame, kind_column: str, kind: str, renamed: dict[str, str], advert: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of one kind without adverts under our names, and how many others were skipped."""
    wanted = F.coalesce(F.col(kind_column) == kind, F.lit(False))
    if advert is not None:
        wanted = wanted & ~F.coalesce(F.col(advert), F.lit(False))
    kept = rows.where(wanted).select(*[F.col(theirs).alias(ours) for theirs, ours in renamed.items()])
    return kept, rows.agg(F.count_if(~wanted).alias("skipped"))
