"""Plans, reservations, collection and pruning."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from gleanwright.operators import collection

DAY = dt.date(2024, 5, 20)
WATCH = "id string, phrase string, source string, metric string, unit string, geography string, scope string, window string, evidence_kind string, plugin string, operation string, options map<string,string>, dimensions map<string,string>"
OPTIONS = {"start_date": "{period_start}", "end_date": "{period_end}", "site": "s"}
ATTEMPT = "watch_id string, account string, started_at timestamp, state string, reserved_requests int, daily_runs int, daily_requests int, plan_sha string"


def watch(name, operation="queries", **more):
    row = dict(id=name, phrase="song", source="Google Search Console", metric="clicks", unit="count", geography="GB", scope="site", window="week", evidence_kind="property_performance", plugin="search-console", operation=operation, options=OPTIONS, dimensions={"period_days": "7"}) | more
    return tuple(row[c.split()[0]] for c in WATCH.replace("map<string,string>", "m").split(", "))


def test_plan_entries(spark):
    watches = spark.createDataFrame([watch("a"), watch("b"), watch("c", "write"), watch("d", geography="unspecified"), watch("e")], WATCH)
    made = watches.select(F.col("id").alias("watch_id"), collection.watch_digest(watches.columns).alias("watch_sha256"), "plugin", "operation", collection.resolved_options(F.col("options"), F.col("dimensions"), F.lit(DAY)).alias("options"))
    first = made.where("watch_id = 'a'").first()
    assert first.options == {"start_date": "2024-05-11", "end_date": "2024-05-17", "site": "s"}
    rows = {r.watch_id: r for r in made.collect()}
    entry = lambda n, k, **more: (n, k, more.get("sha", rows[k].watch_sha256 if k in rows else ""), rows.get(k, rows["a"]).plugin, rows.get(k, rows["a"]).operation, more.get("options", rows.get(k, rows["a"]).options))
    data = [entry(1, "a"), entry(2, "b", sha="0"), entry(3, "c"), entry(4, "d"), entry(5, "e", options={"site": "other"}), entry(6, "x")]
    entries = spark.createDataFrame(data, "position int, watch_id string, watch_sha256 string, plugin string, operation string, options map<string,string>")
    got = {r.watch_id: r.problem for r in collection.entry_problems(entries, watches, F.lit("2024-05-20 10:00:00").cast("timestamp")).collect()}
    assert got == {"a": None, "b": "watch-changed", "c": "unsupported-read", "d": "inexact-watch", "e": "collector-changed", "x": "unknown-watch"}
    assert {r.problem for r in collection.entry_problems(entries.where("position = 1").unionAll(entries.where("position = 1")), watches, F.lit("2024-05-20").cast("timestamp")).collect()} == {"repeated-watch"}
    with pytest.raises(Exception, match="period_days"):
        watches.select(collection.resolved_options(F.col("options"), F.create_map(F.lit("period_days"), F.lit("0")), F.lit(DAY))).collect()


def test_whole_plans():
    plan = {"store_id": "s", "created_at": "2024-05-20T08:00:00", "entries": [{}]}
    raw = collection.plan_bytes(plan)
    sha, now = hashlib.sha256(raw).hexdigest(), "2024-05-21T09:00:00"
    judge = lambda p=plan, h=None, store="s", at=now, **more: collection.plan_problem(collection.plan_bytes(p), p, h or hashlib.sha256(collection.plan_bytes(p)).hexdigest(), store, at, **more)
    assert raw.endswith(b"\n") and judge() is None and collection.plan_problem(raw, plan, sha, "s", now) is None
    assert judge(h="0") == "not the plan that was reviewed" and judge(store="t") == "plan of another store" and judge(at="2024-05-22T00:00:00") == "plan is not fresh" and judge(at="2024-05-20T07:00:00") == "plan is not fresh"
    assert judge(p=plan | {"entries": []}) == judge(p=plan | {"entries": [{}] * 6}) == "number of entries out of bounds" and judge(max_runs=101) == "max_runs out of bounds"


def test_reservations(spark):
    now = F.lit("2024-05-20 12:00:00").cast("timestamp")
    entries = spark.createDataFrame([(n, f"w{n}") for n in range(1, 6)], "position int, watch_id string")
    at = dt.datetime(2024, 5, 20, 9)
    tried = lambda *rows: spark.createDataFrame([(w, a, at, s, 5, 20, cap, p) for w, a, s, cap, p in rows], ATTEMPT)
    states = lambda attempts, **more: [(r.state, r.reason) for r in collection.reservations(entries, attempts, "p", "acc", now, **more).orderBy("position").collect()]
    assert states(tried().limit(0) if False else tried(("x", "other", "done", 100, "q"))) == [("reserved", None)] * 5
    # 3 attempts of 5 requests and a cap of 30 that an earlier reservation named leave room for three more.
    assert states(tried(*[("x", "acc", "done", 30, "q")] * 3)) == [("reserved", None)] * 3 + [("blocked", "quota-exhausted"), ("not-run", None)]
    assert states(tried(("w2", "acc", "running", 100, "q"))) == [("reserved", None), ("blocked", "already-running")] + [("not-run", None)] * 3
    assert states(tried(("w1", "other", "error", 100, "p"))) == [("blocked", "already-attempted")] + [("not-run", None)] * 4
    assert states(tried(("x", "acc", "done", 100, "q")), daily_runs=2)[:2] == [("reserved", None), ("blocked", "quota-exhausted")]
    got = collection.health(tried(("a", "acc", "running", 30, "q"), ("b", "acc", "error", 50, "q"))).first()
    assert (got.runs, got.requests, got.request_cap, got.running, got.failed) == (2, 10, 30, 1, 1)


def test_collect_and_prune(spark, tmp_path):
    watches = {k: dict(phrase="Song", source="s", metric="m", unit="u") for k in ("a", "b", "c")}
    answers = {"a": [("song", "s", "m", "u", 3.0), ("other", "s", "m", "u", 9.0)], "b": [("song", "s", "x", "u", 1.0)]}
    saved = []
    run = lambda s, e: s.createDataFrame(answers[e["watch_id"]], "phrase string, source string, metric string, unit string, value double")
    save = lambda df: saved.extend((r.phrase, r.value, r.availability, r.subject) for r in df.collect()) or 1
    got = collection.collect(spark, [{"watch_id": k} for k in "abc"], watches, run, save, {"subject": "band"})
    assert [(r.watch_id, r.state, r.error_kind) for r in got.collect()] == [("a", "success", None), ("b", "no-data", None), ("c", "error", "KeyError")]
    assert saved == [("song", 3.0, "observed", "band"), ("Song", None, "no-data", "band")]
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)
    o = spark.createDataFrame([("s1", old, "video"), ("s1", new, "video"), ("s2", old, "video"), ("s3", new, "video"), ("s4", old, "audio")], "snapshot_id string, observed_at timestamp, platform string")
    snaps = spark.createDataFrame([(f"s{n}", f"raw{n}") for n in range(1, 5)], "id string, raw string")
    kept, left, counts = collection.pruned(o, snaps, F.lit(dt.datetime(2024, 3, 1)), "Video")
    assert kept.count() == 3 and {(r.id, r.raw) for r in left.collect()} == {("s1", None), ("s3", "raw3"), ("s4", "raw4")} and tuple(counts.first()) == (2, 2, 1)
    assert collection.new_store(spark, str(tmp_path)) == collection.new_store(spark, str(tmp_path))
