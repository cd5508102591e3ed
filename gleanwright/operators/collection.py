"""Planned collection for the monitor: reviewed plans, quotas reserved before a call, upkeep.

A plan is reviewed as bytes; its digest is what is approved.  Quotas count the
worst case before a call and are never given back.  The number of runs of one
invocation is bounded, so plans, reservations and results are small; what the
runs return goes through the same validation as any other observation.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwright.operators import monitor

# Bounds of an invocation, and the reads that may be planned.
MOST_RUNS, MOST_REQUESTS, MOST_QUOTA = 100, 20, 100_000
DEFAULT_RUNS, DEFAULT_REQUESTS, DAILY_RUNS, DAILY_REQUESTS = 5, 5, 20, 100
READ_OPERATIONS = {
    "search-console": ("queries",), "youtube": ("analytics-search", "analytics-hashtags"),
    "bing-search": ("bwt-queries", "bwt-query-pages", "bwt-keyword", "bwt-related", "bwt-keyword-history"),
}
PERIOD_DAYS, SETTLE_DAYS = (28, 366), (3, 90)
EXACT_FIELDS = ("phrase", "source", "metric", "unit", "geography", "scope", "window", "evidence_kind")
FINAL_STATES = ("success", "no-data", "error", "interrupted")


def plan_bytes(plan: dict) -> bytes:
    """What is reviewed and hashed: indented JSON with a line end."""
    return (json.dumps(plan, ensure_ascii=False, indent=2) + "\n").encode("utf-8")


def new_store(spark: SparkSession, path: str) -> str:
    """Makes the table that names a store, once; gives the store's identifier."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/store")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([(str(uuid.uuid4()),)], "store_id string").coalesce(1).write.parquet(f"{path}/store")
    return spark.read.parquet(f"{path}/store").first().store_id


def resolved_options(options: Column, dimensions: Column, day: Column) -> Column:
    """A collector's options (map) with the placeholders of its period filled in: ``period_days``
    days, the last of them ``settle_lag_days`` before the day; either out of bounds raises."""

    def bounded(name: str, default: int, most: int) -> Column:
        n = F.coalesce(F.try_element_at(dimensions, F.lit(name)), F.lit(str(default))).try_cast("int")
        return F.when(n.between(1, most), n).otherwise(F.raise_error(F.lit(f"{name} must be a whole number from 1 to {most}")).cast("int"))

    last = F.date_sub(day, bounded("settle_lag_days", *SETTLE_DAYS))
    first = F.date_sub(last, bounded("period_days", *PERIOD_DAYS) - 1)
    shown = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.transform_values(options, lambda k, v: F.when(v == "{period_start}", shown(first)).when(v == "{period_end}", shown(last)).otherwise(v))


def watch_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def entry_problems(entries: DataFrame, watches: DataFrame, created: Column) -> DataFrame:
    """(position, watch_id, problem) of plan entries (position, watch_id, watch_sha256, plugin,
    operation, options) against the watches they were made from (with plugin, operation, options
    and dimensions).  problem: unknown-watch, repeated-watch, watch-changed, collector-changed,
    unsupported-read or inexact-watch."""
    named = [f for f in EXACT_FIELDS if f in watches.columns]
    exact = F.forall(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in named]), lambda v: ~v.isin("", "unspecified"))
    now = watches.select(
        F.col("id").alias("watch_id"), watch_digest(watches.columns).alias("_sha"), F.col("plugin").alias("_plugin"), F.col("operation").alias("_operation"),
        resolved_options(F.col("options"), F.col("dimensions"), F.to_date(created)).alias("_options"), exact.alias("_exact"), F.lit(True).alias("_there"),
    )
    times = entries.groupBy("watch_id").agg(F.count("*").alias("_times"))
    joined = entries.join(now, "watch_id", "left").join(times, "watch_id")
    same = lambda a, b: F.to_json(F.array_sort(F.map_entries(a))).eqNullSafe(F.to_json(F.array_sort(F.map_entries(b))))
    reads = F.concat_ws("/", "plugin", "operation").isin([f"{p}/{o}" for p, ops in READ_OPERATIONS.items() for o in ops])
    problem = (
        F.when(F.col("_there").isNull(), "unknown-watch").when(F.col("_times") > 1, "repeated-watch").when(~F.col("watch_sha256").eqNullSafe(F.col("_sha")), "watch-changed")
        .when(~(F.col("plugin").eqNullSafe(F.col("_plugin")) & F.col("operation").eqNullSafe(F.col("_operation")) & same("options", "_options")), "collector-changed")
        .when(~F.coalesce(reads, F.lit(False)), "unsupported-read").when(~F.col("_exact"), "inexact-watch")
    )
    return joined.select("position", "watch_id", problem.alias("problem"))


def plan_problem(raw: bytes, plan: dict, approved_sha256: str, store_id: str, now: str, max_runs: int = DEFAULT_RUNS) -> str | None:
    """Why a plan as a whole can't be run, or None.  now: ISO time."""
    if not 1 <= max_runs <= MOST_RUNS:
        return "max_runs out of bounds"
    if hashlib.sha256(raw).hexdigest() != approved_sha256:
        return "not the plan that was reviewed"
    if plan.get("store_id") != store_id:
        return "plan of another store"
    created = plan.get("created_at")
    if not isinstance(created, str) or created > now or created[:10] < now[:10] and (_day(now) - _day(created)) > 1:
        return "plan is not fresh"
    return None if 1 <= len(plan.get("entries") or []) <= max_runs else "number of entries out of bounds"


def _day(stamp: str) -> int:
    import datetime

    return datetime.date.fromisoformat(stamp[:10]).toordinal()


def quotas(attempts: DataFrame) -> DataFrame:
    """(account, day, runs, requests, run_cap, request_cap) of the attempts so far; the lowest cap
    that a day's reservations named holds for the whole day."""
    return attempts.groupBy("account", F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("runs"), F.sum("reserved_requests").alias("requests"), F.min("daily_runs").alias("run_cap"), F.min("daily_requests").alias("request_cap")
    )


def reservations(entries: DataFrame, attempts: DataFrame, plan_sha: str, account: str, now: Column, requests: int = DEFAULT_REQUESTS, daily_runs: int = DAILY_RUNS, daily_requests: int = DAILY_REQUESTS) -> DataFrame:
    """(position, watch_id, state, reason) of entries in their order: ``reserved``, or ``blocked`` and
    after that ``not-run``.  An entry is blocked when its watch is running, when this very plan
    has tried it, or when the account's day would pass the lower of its caps.

    attempts: (watch_id, account, started_at, state, reserved_requests, daily_runs,
    daily_requests, plan_sha).  Entries are at most ``MOST_RUNS`` rows."""
    for value in (requests, daily_runs, daily_requests):
        if not 1 <= value <= MOST_QUOTA:
            raise ValueError("quota bounds must be positive whole numbers")
    used = quotas(attempts).where((F.col("account") == account) & (F.col("day") == F.to_date(now)))
    one = lambda c, default: F.coalesce(used.agg(F.max(c).alias("x")).scalar(), F.lit(default))
    per_watch = attempts.groupBy("watch_id").agg(F.max(F.col("state") == "running").alias("running"), F.max(F.col("plan_sha") == plan_sha).alias("tried"))
    order = Window.orderBy("position")
    joined = entries.join(per_watch, "watch_id", "left").withColumn("n", F.row_number().over(order))
    full = (one("runs", 0) + F.col("n") > F.least(one("run_cap", daily_runs), F.lit(daily_runs))) | (one("requests", 0) + F.col("n") * requests > F.least(one("request_cap", daily_requests), F.lit(daily_requests)))
    reason = F.when(F.col("tried"), "already-attempted").when(F.col("running"), "already-running").when(full, "quota-exhausted")
    judged = joined.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.col("n"))).over(Window.partitionBy())
    state = F.when(F.col("n") == first, "blocked").when(F.col("n") > first, "not-run").otherwise("reserved")
    return judged.withColumn("state", state).select("position", "watch_id", "state", F.when(F.col("state") == "blocked", F.col("reason")).alias("reason"))


def collected(result: DataFrame, watch: dict, defaults: dict) -> DataFrame:
    """The observations that a run's evidence (phrase, source, metric, unit, value) gives for a
    watch; without any, one row that says there was no data."""
    mine = monitor.folded_fields(F.array("phrase", F.lit(watch["phrase"])))
    rows = result.where((mine[0] == mine[1]) & (F.col("source") == watch["source"]) & (F.col("metric") == watch["metric"]) & (F.col("unit") == watch["unit"])).select("phrase", "source", "metric", "unit", F.col("value").cast("double").alias("value"), F.lit("observed").alias("availability"))
    spark = result.sparkSession
    none = spark.range(1).select(*[F.lit(watch[c]).alias(c) for c in ("phrase", "source", "metric", "unit")], F.lit(None).cast("double").alias("value"), F.lit("no-data").alias("availability"))
    some = rows.agg((F.count("*") > 0).alias("x")).scalar()
    out = rows.unionAll(none.where(~some))
    for name, value in defaults.items():
        out = out.withColumn(name, F.lit(value))
    return out


def collect(spark: SparkSession, entries: list[dict], watches: dict[str, dict], run: Callable[[SparkSession, dict], DataFrame], save: Callable[[DataFrame], int], defaults: dict) -> DataFrame:
    """Runs reserved entries in order, a failed one stopping no other: (watch_id, state, rows,
    error_kind).  Only the kind of an error is kept, since its text may hold an address."""
    out = []
    for entry in entries:
        watch = watches[entry["watch_id"]]
        try:
            rows = collected(run(spark, entry), watch, defaults)
            n = save(rows)
            state = "no-data" if rows.where("availability = 'observed'").isEmpty() else "success"
            out.append((entry["watch_id"], state, n, None))
        except Exception as e:  # noqa: BLE001 - reported by its kind
            out.append((entry["watch_id"], "error", 0, type(e).__name__))
    return spark.createDataFrame(out, "watch_id string, state string, rows int, error_kind string")


def pruned(observations: DataFrame, snapshots: DataFrame, cutoff: Column, platform: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of observations (snapshot_id) and snapshots (id, raw), and (observations_deleted,
    snapshots_redacted, snapshots_deleted).  A snapshot that lost rows keeps no raw text; one
    without any row left goes."""
    kept = monitor.pruned(observations, cutoff, platform)
    before, after = (x.groupBy("snapshot_id").agg(F.count("*").alias("n")) for x in (observations, kept))
    left = snapshots.join(before.select(F.col("snapshot_id").alias("id"), F.col("n").alias("_b")), "id", "left").join(after.select(F.col("snapshot_id").alias("id"), F.col("n").alias("_a")), "id", "left")
    touched = F.col("_b") > F.coalesce("_a", F.lit(0))
    counts = left.agg(F.coalesce(F.sum(F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))), F.lit(0)).alias("observations_deleted"), F.count_if(touched).alias("snapshots_redacted"), F.count_if(F.col("_a").isNull()).alias("snapshots_deleted"))
    stays = left.where("_a IS NOT NULL").withColumn("raw", F.when(~touched, F.col("raw"))).select(*snapshots.columns)
    return kept, stays, counts


def health(attempts: DataFrame) -> DataFrame:
    """(account, day, runs, requests, caps, running, failed) of each account and day."""
    states = attempts.groupBy("account", F.to_date("started_at").alias("day")).agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state").isin("error", "interrupted")).alias("failed"))
    return quotas(attempts).join(states, ["account", "day"])
