"""Sample statistics of terms, attention and communities, recency, co-occurrence.

Counters are summed only where present: an aggregate without a measured value is
null, never zero.  Ratios use complete rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_stats(counters: list[str], prefix: str = "sample_") -> list[Column]:
    """available, sum, mean and median of each counter."""
    out = []
    for c in counters:
        out += [
            F.count(c).alias(f"{prefix}{c}_available"), F.sum(c).alias(f"{prefix}{c}_sum"),
            F.avg(c).alias(f"{prefix}{c}_mean"), F.median(c).alias(f"{prefix}{c}_median"),
        ]
    return out


def complete_ratio(over: list[str], under: str, name: str) -> list[Column]:
    """Sum of ``over`` per sum of ``under`` over rows where all are present and under > 0."""
    complete = F.col(under) > 0
    for c in over:
        complete = complete & F.col(c).isNotNull()
    top = sum((F.col(c) for c in over[1:]), F.col(over[0]))
    ratio = F.try_divide(F.sum(F.when(complete, top)), F.sum(F.when(complete, F.col(under))))
    return [ratio.cast("double").alias(name), F.count_if(complete).alias(f"{name}_records")]


def recent(at: Column, now: Column, days: int, inclusive: bool = True) -> Column:
    """Records of the last ``days`` days; null if no record has a time."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000)
    inside = (age >= 0) & (age <= days if inclusive else age < days)
    return F.when(F.count(at) > 0, F.count_if(inside))


def term_stats(members: DataFrame, records: DataFrame, key: str, term: str, counters: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Statistics of each term over the records that hold it.  members: (key, term)."""
    pairs = members.select(key, term).distinct().join(records, key)
    return pairs.groupBy(term).agg(F.count("*").alias("records"), *counter_stats(counters), *(extra or []))


def cooccurrence(members: DataFrame, key: str, term: str, records: int, keep: int | None = None) -> DataFrame:
    """(term, other, shared, conditional, jaccard, lift) of terms met in the same record; with
    ``keep`` only each term's first ``keep`` others by shared records, then by name.

    Each unordered pair is counted once and mirrored."""
    items = members.where(F.col(key).isNotNull() & F.col(term).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(term)).alias("t"))
    single = items.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counted = (
        items.select(F.posexplode("t").alias("at", "a"), "t").select("a", F.explode(F.expr("slice(t, at + 2, size(t))")).alias("b"))
        .groupBy("a", "b").agg(F.count("*").alias("shared"))
    )
    both = counted.select(F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("other")), F.struct(F.col("b").alias("term"), F.col("a").alias("other")))).alias("p"), "shared").select("p.*", "shared")
    sized = both.join(single, "term").join(single.select(F.col("term").alias("other"), F.col("n").alias("m")), "other")
    shared = F.col("shared").cast("double")
    out = sized.select(
        "term", "other", "shared", (shared / F.col("n")).alias("conditional"), (shared / (F.col("n") + F.col("m") - F.col("shared"))).alias("jaccard"),
        (shared * records / (F.col("n").cast("double") * F.col("m"))).alias("lift"),
    )
    if keep is None:
        return out
    order = Window.partitionBy("term").orderBy(F.col("shared").desc(), "other")
    return out.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep).drop("at")


def attention(posts: DataFrame, group: str, score: str, comments: str) -> DataFrame:
    """Matching posts, medians of score and comments, and each group's share of all posts."""
    by = posts.groupBy(group).agg(F.count("*").alias("posts"), F.median(score).alias("median_score"), F.median(comments).alias("median_comments"))
    total = posts.agg(F.count("*").alias("total"))
    return by.select(group, "posts", "median_score", "median_comments", (F.col("posts") / total.scalar()).alias("share"))


def first_k(rows: DataFrame, group: str, order: list[Column], keep: int) -> DataFrame:
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("at") <= keep)


def distribution(rows: DataFrame, group: list[str], by: Column, name: str) -> DataFrame:
    """(group, name, records, share): how the rows of each group spread over a value; rows without
    the value count in no share."""
    counted = rows.select(*group, by.alias(name)).where(F.col(name).isNotNull()).groupBy(*group, name).agg(F.count("*").alias("records"))
    return counted.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy(*group)))


def daily_completeness(rows: DataFrame, series: list[str], day: str, views: Column) -> DataFrame:
    """(series, views, days, expected, complete) of daily counts: whether every day from the first
    to the last has a row.  A missing day is unknown and never zero."""
    daily = rows.groupBy(*series, day).agg(views.alias("views"))
    out = daily.groupBy(*series).agg(F.sum("views").alias("views"), F.count("*").alias("days"), (F.date_diff(F.max(day), F.min(day)) + 1).cast("bigint").alias("expected"))
    return out.withColumn("complete", F.col("days") == F.col("expected"))
