"""Repeated records: first wins, first non-null, removed copies, best rank.

Each takes an explicit order; ties beyond it are the caller's to exclude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_row(rows: DataFrame, key: str, order: list[str]) -> Column:
    """The row with the least ``order``; ties go by a digest of the row, so the result is one for
    any order of delivery.  Combines before the shuffle."""
    digest = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
    return F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order, digest)).alias("_r")


def keep_first(rows: DataFrame, key: str, order: list[str], compared: list[str]) -> DataFrame:
    """The first row of each key, with ``copies`` and ``conflicting`` (a later copy differs)."""
    digest = F.sha2(F.to_json(F.struct(*compared)), 256)
    summed = rows.groupBy(key).agg(_first_row(rows, key, order), F.count("*").alias("copies"), (F.min(digest) != F.max(digest)).alias("conflicting"))
    return summed.select(key, "_r.*", "copies", "conflicting")


def first_non_null(rows: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """One row per key: each field's first non-null value by ``order`` (ties: the least), and ``conflicts``, the
    number of fields with more than one non-null value.  Combines before the shuffle."""
    picked = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order, F.col(c)))).alias(c) for c in fields]
    low = [F.min(c).alias(f"_lo_{c}") for c in fields]
    high = [F.max(c).alias(f"_hi_{c}") for c in fields]
    merged = rows.groupBy(key).agg(F.count("*").alias("copies"), *picked, *low, *high)
    conflicts = sum((F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), 1).otherwise(0) for c in fields), F.lit(0))
    return merged.select(key, "copies", *fields, conflicts.cast("bigint").alias("conflicts"))


def without_removed(rows: DataFrame, key: str, removed: Column, order: list[str]) -> DataFrame:
    """The first copy of each key of which no copy, earlier or later, is removed."""
    summed = rows.groupBy(key).agg(_first_row(rows, key, order), F.max(F.coalesce(removed, F.lit(False))).alias("_gone"))
    return summed.where("NOT _gone").select(key, "_r.*")


def permitted(rows: DataFrame, adult: Column | None = None, pinned: Column | None = None, include_adult: bool = False, exclude_pinned: bool = False) -> DataFrame:
    """Rows that a sample may hold: adult ones only if asked for, pinned ones unless excluded; a
    row that doesn't say is neither."""
    out = rows
    if adult is not None and not include_adult:
        out = out.where(~F.coalesce(adult, F.lit(False)))
    if pinned is not None and exclude_pinned:
        out = out.where(~F.coalesce(pinned, F.lit(False)))
    return out


def merged_tags(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, tags): the tags of all copies of a record, each once, sorted."""
    single = rows.select(key, F.explode(tags).alias("t")).where("t IS NOT NULL").distinct()
    return single.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias(tags))


def without_shared_ranks(ranked: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """``best_rank`` rows; reading a page on which two addresses share a rank raises."""
    told = F.concat_ws(" ", F.lit("two results share rank"), F.col(rank).cast("string"), F.lit("of"), *[F.col(k).cast("string") for k in keys])
    return ranked.where(F.when(~F.col("tied"), True).otherwise(F.raise_error(told).cast("boolean"))).drop("tied")


def best_rank(rows: DataFrame, keys: list[str], url: str, rank: str) -> DataFrame:
    """Best rank of each url within the keys, with ``tied``: another url has that rank."""
    best = rows.where(F.col(url).isNotNull()).groupBy(*keys, url).agg(F.min(rank).alias(rank))
    return best.withColumn("tied", F.count("*").over(Window.partitionBy(*keys, rank)) > 1)


def ordered_distinct(rows: DataFrame, identity: Column, order: Column, value: str) -> DataFrame:
    """First spelling of each identity, with the number of rows."""
    return rows.groupBy(identity.alias("identity")).agg(F.min_by(value, order).alias("first_spelling"), F.count("*").alias("rows"))
