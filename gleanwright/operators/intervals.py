"""Continuous covered periods and the gaps between them, by sweep line.

Every interval is a plus event on its first day and a minus event on the day
after its last.  Events are first summed per entity and day with map-side
combining, so an entity holds at most one row per calendar day before the
shuffle, however many intervals it has; the running sum then gives the number
of intervals active from each event day on.  A period is a maximal run of
positive counts, a gap a zero count between two periods.

Rows without entity or bound, or ending before they start, take no part;
repeated, nested, touching and overlapping rows merge; an empty table gives no
row.  A null entity is no entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep_events(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, day, delta): net change of active intervals per day; ``day`` counts from 1970-01-01."""
    usable = intervals.select(F.col(key).alias("key"), F.unix_date(start).alias("lo"), F.unix_date(end).alias("hi")).where("key IS NOT NULL AND lo <= hi")
    events = usable.select("key", F.explode(F.array(F.struct(F.col("lo").alias("day"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("day"), F.lit(-1).alias("d")))).alias("e"))
    return events.groupBy("key", "e.day").agg(F.sum("e.d").alias("delta"))


def covered_periods(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, kind, start_date, end_date), kind ``period`` or ``gap``, dates inclusive."""
    by_day = Window.partitionBy("key").orderBy("day")
    changes = (
        sweep_events(intervals, key, start, end).where("delta <> 0")
        .withColumn("active", F.sum("delta").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.coalesce(F.lag("active").over(by_day), F.lit(0)))
        .where("active = 0 OR before = 0")
    )
    spans = changes.withColumn("next_day", F.lead("day").over(by_day)).where("next_day IS NOT NULL")
    kind = F.when(F.col("active") > 0, "period").otherwise("gap")
    return spans.select(F.col("key").alias(key), kind.alias("kind"), F.date_from_unix_date("day").alias("start_date"), F.date_from_unix_date(F.col("next_day") - 1).alias("end_date"))
