"""Event timing: bins around event days, peaks, majority intervals, hold-outs.

Bins keep their whole interval; a weekly bin gets no invented day.  Everything
is grouped by (phrase, cycle); windows are at most 733 days wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the timing policy.
MIN_POSITIVE_BINS, MIN_PEAK, MAX_ENVELOPE, HIGH_SHARE = 4, 10, 14, 0.75


def placed_bins(bins: DataFrame, events: DataFrame, keys: list[str], window: tuple[int, int]) -> DataFrame:
    """Bins (keys, start, end, value, censored, eligible) that touch the window of an event
    (keys, event_date): adds event_date, lo and hi, days from the event."""
    both = bins.join(events, keys)
    lo, hi = F.date_diff("start", "event_date"), F.date_diff("end", "event_date")
    return both.withColumn("lo", lo).withColumn("hi", hi).where((F.col("hi") >= window[0]) & (F.col("lo") <= window[1]))


def aligned(bins: DataFrame, events: DataFrame, keys: list[str], window: tuple[int, int]) -> DataFrame:
    """Per cycle: covered days, bin counts by state, peak, peak and high intervals (arrays of
    structs lo, hi) and the quality issues that bar it from timing."""
    cycle = [*keys, "event_date"]
    used = placed_bins(bins, events, keys, window)
    days = F.sequence(F.greatest("lo", F.lit(window[0])), F.least("hi", F.lit(window[1])))
    covered = used.where("eligible").select(*cycle, F.explode(days).alias("d")).groupBy(*cycle).agg(F.count_distinct("d").alias("covered_days"))
    peak = used.withColumn("peak", F.max(F.when(F.col("eligible"), F.col("value"))).over(Window.partitionBy(*cycle)))
    v, ok = F.col("value"), F.col("eligible")
    spot = F.struct("lo", "hi")
    summed = peak.groupBy(*cycle).agg(
        F.max("peak").alias("peak"), F.count_if(ok & (v > 0)).alias("positive_bins"), F.count_if(ok & (v == 0)).alias("zero_bins"), F.count_if(ok & F.col("censored")).alias("censored_bins"),
        F.count_if(ok & v.isNull() & ~F.col("censored")).alias("missing_bins"), F.count_if(~ok).alias("incomplete_bins"),
        F.array_sort(F.collect_list(F.when(ok & (v == F.col("peak")) & (v > 0), spot))).alias("peaks"), F.array_sort(F.collect_list(F.when(ok & (v >= F.col("peak") * HIGH_SHARE) & (v > 0), spot))).alias("high"),
    )
    wide = F.array_max(F.transform("peaks", lambda p: p["hi"])) - F.array_min(F.transform("peaks", lambda p: p["lo"])) + 1
    issues = F.filter(F.array(
        F.when(F.coalesce("covered_days", F.lit(0)) < window[1] - window[0] + 1, "incomplete_alignment_window"), F.when(F.col("missing_bins") > 0, "missing_values"),
        F.when(F.col("positive_bins") == 0, "threshold_zero_or_censored_only").when(F.col("positive_bins") < MIN_POSITIVE_BINS, "sparse_exact_positive_bins"),
        F.when((F.col("peak") > 0) & (F.col("peak") < MIN_PEAK), "low_original_scale_resolution"), F.when(wide > MAX_ENVELOPE, "flat_or_wide_peak"),
    ), lambda x: x.isNotNull())
    return summed.join(covered, cycle, "left").withColumn("issues", issues).withColumn("covered_days", F.coalesce("covered_days", F.lit(0)))


def independent(cycles: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Cycles without a neighbour within ``width`` days; both of an overlapping pair go."""
    by = Window.partitionBy(*keys).orderBy("event_date")
    no = F.lit(False)
    before = F.coalesce(F.date_diff("event_date", F.lag("event_date").over(by)) <= width, no)
    after = F.coalesce(F.date_diff(F.lead("event_date").over(by), "event_date") <= width, no)
    return cycles.withColumn("_near", before | after).where("NOT _near").drop("_near")


def islands(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(keys, lo, hi): runs of neighbouring whole numbers."""
    distinct = days.select(*keys, F.col(day).alias("d")).distinct()
    run = F.col("d") - F.row_number().over(Window.partitionBy(*keys).orderBy("d"))
    return distinct.withColumn("run", run).groupBy(*keys, "run").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).drop("run")


def majority_intervals(cycles: DataFrame, keys: list[str], intervals: str) -> DataFrame:
    """Intervals of days that lie in the given intervals of more than half of the cycles."""
    total = cycles.groupBy(*keys).agg(F.count("*").alias("cycles"))
    days = cycles.select(*keys, "event_date", F.explode(intervals).alias("i")).select(*keys, "event_date", F.explode(F.sequence("i.lo", "i.hi")).alias("day")).distinct()
    often = days.groupBy(*keys, "day").agg(F.count("*").alias("n")).join(total, keys).where("n * 2 > cycles")
    return islands(often, keys, "day")


def envelope(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """First and last peak day over the cycles, null if wider than the policy allows."""
    lo, hi = F.min(F.array_min(F.transform("peaks", lambda p: p["lo"]))), F.max(F.array_max(F.transform("peaks", lambda p: p["hi"])))
    out = cycles.groupBy(*keys).agg(F.count("*").alias("cycles"), lo.alias("lo"), hi.alias("hi"))
    fits = (F.col("hi") - F.col("lo") + 1 <= MAX_ENVELOPE) & (F.col("cycles") >= 2)
    return out.select(*keys, "cycles", F.when(fits, F.col("lo")).alias("envelope_lo"), F.when(fits, F.col("hi")).alias("envelope_hi"))


def holdouts(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Each cycle from the third on against the envelope of the cycles before it: hit or not."""
    by = Window.partitionBy(*keys).orderBy("event_date")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = cycles.withColumn("lo", F.array_min(F.transform("peaks", lambda p: p["lo"]))).withColumn("hi", F.array_max(F.transform("peaks", lambda p: p["hi"])))
    told = marked.withColumn("training", F.row_number().over(by) - 1).withColumn("p_lo", F.min("lo").over(past)).withColumn("p_hi", F.max("hi").over(past)).where("training >= 2")
    fits = F.col("p_hi") - F.col("p_lo") + 1 <= MAX_ENVELOPE
    hit = F.exists("peaks", lambda p: (p["lo"] <= F.col("p_hi")) & (p["hi"] >= F.col("p_lo")))
    return told.select(*keys, "event_date", "training", F.when(fits, F.col("p_lo")).alias("predicted_lo"), F.when(fits, F.col("p_hi")).alias("predicted_hi"), F.when(fits, hit).alias("hit"))


def proposed_days(envelopes: DataFrame, keys: list[str], next_date: Column, lead_days: int, first: Column, last: Column, planned: Column, blocked: list[str]) -> DataFrame:
    days = envelopes.where("envelope_lo IS NOT NULL").select(*keys, F.explode(F.sequence("envelope_lo", "envelope_hi")).alias("v"))
    dated = days.select(*keys, F.date_add(next_date, F.col("v") - lead_days).alias("day"))
    free = ~F.date_format("day", "yyyy-MM-dd").isin(*blocked) if blocked else F.lit(True)
    return dated.where((F.col("day") >= first) & (F.col("day") <= last) & (F.col("day") > planned) & free)
