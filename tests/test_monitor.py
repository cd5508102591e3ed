from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanwright.operators import monitor

NOW = dt.datetime(2024, 6, 1)
OBS = "phrase string, value double, observed_at timestamp, period_start date, period_end date, availability string, completeness string, source string, metric string, unit string, scope string, window string, geography string, subject string, platform string, evidence_kind string, approximate boolean, normalization_id string"
WATCH = "id string, subject string, platform string, phrase string, source string, metric string, cadence_hours double, freshness_days double, min_absolute_change double, min_percent_change double"


def obs(phrase, value, day, **more):
    base = dict(phrase=phrase, value=value, observed_at=dt.datetime(2024, 5, day), period_start=None, period_end=None, availability="observed", completeness="complete", source="s", metric="m", unit="count", scope="web", window="week", geography="GB", subject="Band", platform="video", evidence_kind="search_volume_estimate", approximate=False, normalization_id=None)
    return tuple((base | more)[c.split()[0]] for c in OBS.split(", "))


def watch(name, phrase, **more):
    base = dict(id=name, subject="band ", platform="VIDEO", phrase=phrase, source=None, metric=None, cadence_hours=24.0, freshness_days=10.0, min_absolute_change=1.0, min_percent_change=None)
    return tuple((base | more)[c.split()[0]] for c in WATCH.split(", "))


DATA = [
    obs("rise", 10.0, 28), obs("rise", 20.0, 30), obs("same", 5.0, 28), obs("same", 5.0, 30), obs("old", 1.0, 2), obs("gone", None, 30, availability="unavailable"), obs("part", 3.0, 30, completeness="partial"),
    obs("clash", 1.0, 30), obs("clash", 2.0, 30), obs("one", 4.0, 30), obs("rough", 1.0, 28, approximate=True), obs("rough", 9.0, 30, approximate=True),
    obs("over", 1.0, 20, period_start=dt.date(2024, 5, 1), period_end=dt.date(2024, 5, 7)), obs("over", 2.0, 24, period_start=dt.date(2024, 5, 10), period_end=dt.date(2024, 5, 16)), obs("over", 6.0, 28, period_start=dt.date(2024, 5, 12), period_end=dt.date(2024, 5, 18)),
    obs("index", 1.0, 28, evidence_kind="relative_interest"), obs("index", 2.0, 30, evidence_kind="relative_interest"), obs("rise", 99.0, 30, subject="Other"), obs("void", None, 30),
]


@pytest.fixture(scope="module")
def stored(spark):
    return monitor.validated(spark.createDataFrame(DATA, OBS), F.lit(NOW)).where("problem IS NULL").cache()


@pytest.fixture(scope="module")
def watches(spark):
    names = ["rise", "same", "old", "gone", "part", "clash", "one", "rough", "over", "index", "void", "never"]
    return spark.createDataFrame([watch(n, n) for n in names] + [watch("all", None)], WATCH)


ATTEMPTS = "watch_id string, started_at timestamp, state string"


def test_rejects(spark):
    bad = [obs("", 1.0, 1), obs("a", 1.0, 1, observed_at=dt.datetime(2025, 1, 1)), obs("a", 1.0, 1, evidence_kind="guess"), obs("a", 0.0, 1, availability="unavailable"), obs("a", float("nan"), 1), obs("a", 1.0, 1, period_start=dt.date(2024, 1, 1)),
           obs("a", 1.0, 1, period_start=dt.date(2024, 5, 2), period_end=dt.date(2024, 5, 1)), obs("a", 1.0, 1, period_start=dt.date(2024, 4, 2), period_end=dt.date(2024, 5, 9)), obs("a", 1.0, 1, observed_at=None), obs("a", 1.0, 1)]
    got = [r.problem for r in monitor.validated(spark.createDataFrame(bad, OBS), F.lit(NOW)).collect()]
    assert got == ["missing-label", "future-capture", "unknown-evidence-kind", "value-of-unavailable", "not-a-number", "half-period", "period-out-of-order", "period-after-capture", "missing-capture-time", None]


def test_identity_ignores_case_and_append_is_idempotent(spark):
    v = monitor.validated(spark.createDataFrame([obs("rise ", 1.0, 1), obs("rise", 1.0, 1), obs("Rise", 2.0, 1)], OBS), F.lit(NOW))
    assert v.select("identity").distinct().count() == 1 and v.select("id").distinct().count() == 2
    assert monitor.new_rows(v.limit(0), v).count() == 2 and monitor.new_rows(v, v).count() == 0


def test_identity_and_id_are_digests_of_canonical_json(spark):
    import hashlib
    import json

    when, (a, b) = dt.datetime(2024, 5, 3, 4, 5, 6, 70), (dt.date(2024, 5, 1), dt.date(2024, 5, 2))
    made = [obs(' Stra\u00dfe "x" ', 12.0, 1, observed_at=when, period_start=a, period_end=b), obs("Cafe\u0301", 0.25, 1, normalization_id="N1"), obs("c", None, 1, availability="no-data")]
    frame = monitor.validated(spark.createDataFrame(made, OBS).withColumn("dimensions", F.create_map(F.lit("Lang"), F.lit("DE"), F.lit("a"), F.lit("b"))), F.lit(NOW))
    folded = ["strasse \"x\"", "caf\u00e9", "c"]
    text = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    sha = lambda x: hashlib.sha256(text(x).encode()).hexdigest()
    for r, phrase in zip(frame.collect(), folded, strict=True):
        names = {f: r[f] for f in monitor.IDENTITY_FIELDS if f not in ("phrase", "dimensions")}
        identity = sha({f: v.casefold() if v else v for f, v in names.items()} | {"phrase": phrase, "dimensions": {"Lang": "DE", "a": "b"}})
        assert r.identity == identity
        at = r.observed_at.replace(tzinfo=dt.timezone.utc).isoformat()
        whole = names | {"phrase": r.phrase.strip(), "dimensions": {"Lang": "DE", "a": "b"}, "observed_at": at, "identity": identity, "availability": r.availability, "approximate": r.approximate, "censored": r.censored, "completeness": r.completeness}
        whole |= {f: str(r[f]) if r[f] else None for f in ("period_start", "period_end")} | dict.fromkeys(("notes", "source_url", "capture_file", "capture_sha256", "target_surface"))
        assert r.id == sha(whole | {"value": int(r.value) if r.value == 12 else r.value})


def test_watches_of_all_patterns_match_brute_force(spark, stored):
    import itertools
    import random

    rng = random.Random(3)
    kept = [r.asDict() for r in stored.collect()]
    fields = ("phrase", "source", "metric", "unit", "evidence_kind")
    made = [(f"w{n}", "Band", "video", *[rng.choice([r[f].upper() for r in kept] + ["x"]) if use else None for f, use in zip(fields, pick, strict=True)]) for n, pick in enumerate(itertools.product((0, 1), repeat=5))]
    frame = spark.createDataFrame(made, "id string, subject string, platform string, " + ", ".join(f"{f} string" for f in fields))
    fold = lambda v: v.strip().casefold()
    want = sorted((w[0], r["id"]) for w in made for r in kept if fold(w[1]) == fold(r["subject"]) and fold(w[2]) == fold(r["platform"]) and all(v is None or fold(v) == fold(r[f]) for f, v in zip(fields, w[3:], strict=True)))
    found = monitor.watched(frame, stored)
    assert sorted((r.watch_id, r.id) for r in found.select("watch_id", "id").collect()) == want and len(want) > 40
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_coverage(spark, stored, watches):
    attempts = spark.createDataFrame([("one", dt.datetime(2024, 5, 31), "error"), ("never", dt.datetime(2024, 5, 1), "running"), ("rise", dt.datetime(2024, 5, 1), "error"), ("same", dt.datetime(2024, 7, 1), "error")], ATTEMPTS)
    got = {r.watch_id: r for r in monitor.coverage(watches, stored, attempts, F.lit(NOW)).collect()}
    assert {k: r.status for k, r in got.items()} == {"rise": "current", "same": "current", "old": "stale", "gone": "unavailable", "part": "partial", "clash": "conflicting-captures", "one": "error", "rough": "current", "over": "stale", "index": "current", "void": "missing-value", "never": "running", "all": "conflicting-captures"}
    assert got["never"].observations == 0 and got["rise"].capture_age_days == 2.0 and got["over"].report_age_days == 14.0 and not got["gone"].has_demand_signal


def test_alerts(spark, stored, watches):
    got = {r.watch_id: r for r in monitor.alerts(watches.where("id <> 'all'"), stored, F.lit(NOW)).collect()}
    assert (got["rise"].reason, got["rise"].delta, got["rise"].percent) == (None, 10.0, 100.0)
    assert (got["over"].reason, got["over"].before, got["over"].after) == (None, 1.0, 6.0)
    want = {"old": "needs-two-observations", "gone": "needs-two-observations", "part": "needs-two-observations", "clash": "conflicting-capture-timestamps", "one": "needs-two-observations", "rough": "approximate-or-censored", "index": "relative-index-needs-shared-normalization", "void": "needs-two-observations"}
    assert {k: r.reason for k, r in got.items() if r.reason} == want and "same" not in got
    known = spark.createDataFrame([(got["rise"].alert_id,)], "alert_id string")
    assert "rise" not in {r.watch_id for r in monitor.alerts(watches, stored, F.lit(NOW), known).where("watch_id <> 'all'").collect()}
    strict = watches.where("id = 'rise'").withColumn("min_percent_change", F.lit(150.0))
    assert monitor.alerts(strict, stored, F.lit(NOW)).collect() == []


def test_due_history_and_upkeep(spark, stored, watches):
    attempts = spark.createDataFrame([("rise", dt.datetime(2024, 5, 31, 12), "done"), ("same", dt.datetime(2024, 5, 1), "running")], ATTEMPTS)
    got = {r.watch_id: r.due_at for r in monitor.due(watches, stored, attempts, F.lit(NOW)).collect()}
    assert "rise" not in got and "same" not in got and got["never"] == NOW and got["old"] == dt.datetime(2024, 5, 3)
    assert [r.value for r in monitor.history(watches.where("id = 'rise'"), stored, F.lit(NOW), 1).collect()] == [20.0]
    assert monitor.pruned(stored, F.lit(dt.datetime(2024, 5, 25))).where("phrase = 'old'").count() == 0
    assert monitor.pruned(stored, F.lit(dt.datetime(2024, 5, 25)), "audio").count() == stored.count()
    snaps = spark.createDataFrame([("a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("b", "00")], "raw string, sha string")
    assert tuple(monitor.verified(snaps, "raw", "sha").first()) == (2, 1)


def test_watch_versions(spark):
    first = watch("a", "x")
    stored = spark.createDataFrame([(*first, True, 1)], WATCH + ", active boolean, version int")
    incoming = spark.createDataFrame([(*first, True), (*watch("b", "y"), True)], WATCH + ", active boolean")
    assert [(r.id, r.version) for r in monitor.watch_versions(stored, incoming).collect()] == [("b", 1)]
    changed = spark.createDataFrame([(*watch("a", "z"), False)], WATCH + ", active boolean")
    fresh = monitor.watch_versions(stored, changed)
    assert [(r.id, r.version) for r in fresh.collect()] == [("a", 2)]
    assert monitor.current_watches(stored.unionByName(fresh.withColumn("version", F.col("version").cast("int")))).count() == 0


def test_attempts_finish_once(spark):
    a = spark.createDataFrame([("1", "running"), ("2", "done")], "attempt_id string, state string")
    r = spark.createDataFrame([("1", "error"), ("2", "error")], "attempt_id string, state string")
    assert {x.attempt_id: x.state for x in monitor.finished(a, r).collect()} == {"1": "error", "2": "done"}


def test_html(spark):
    assert "&lt;b&gt;" in monitor.coverage_html(spark.createDataFrame([("<b>", None)], "watch_id string, status string"))
