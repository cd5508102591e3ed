"""The monitor: observations, watches, coverage, alerts, due dates, upkeep.

Observations are append-only and identified by content; reads are as of a time.
A watch's null field is a wildcard.  Watches fall into patterns by the fields
that they name, at most 256; an observation has one key for each pattern that
occurs, and watches meet observations by one hash join on pattern and key.  Rule
lists are ordered: the first that holds names the row.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed sets of the observation schema.
KINDS = (
    "search_volume_estimate", "relative_interest", "property_performance", "channel_referral", "platform_search_interest",
    "content_supply", "sampled_engagement", "language_suggestion", "text_salience", "proposal", "unknown",
)
DEMAND_KINDS = ("search_volume_estimate", "relative_interest", "platform_search_interest")
AVAILABILITY = ("observed", "unavailable", "error", "suppressed", "no-data")
COMPLETENESS = ("complete", "partial", "unknown")
IDENTITY_FIELDS = ("subject", "platform", "phrase", "source", "metric", "unit", "geography", "scope", "window", "evidence_kind", "dimensions", "normalization_id")
DEFAULTS = {"subject": "", "platform": "", "scope": "unspecified", "window": "unspecified", "geography": "unspecified", "unit": "unspecified", "evidence_kind": "unknown", "availability": "observed", "completeness": "unknown"}
WATCH_FIELDS = ("phrase", "source", "metric", "unit", "scope", "window", "geography", "evidence_kind")
SIGNATURE = ("value", "availability", "period_start", "period_end", "approximate", "censored", "completeness")


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_fields(rows: pd.Series) -> pd.Series:
    """Each text composed, trimmed and case-folded; nulls stay."""
    known: dict[str, str] = {}

    def one(v: str | None) -> str | None:
        if v is not None and v not in known:
            known[v] = unicodedata.normalize("NFC", v.strip()).casefold()
        return None if v is None else known[v]

    return pd.Series([None if r is None else [one(v) for v in r] for r in rows], dtype=object)


def canonical(fields: dict[str, Column]) -> Column:
    """The fields as JSON without blanks, by name, nulls written: one text for one content."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def plain_number(value: Column) -> Column:
    """A number as JSON writes it, whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def iso_stamp(at: Column) -> Column:
    """Time in UTC with its offset, a fraction only where there is one."""
    form = lambda pattern: F.date_format(F.to_utc_timestamp(at, F.current_timezone()), pattern)
    return F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(at) % 1_000_000 != 0, form(".SSSSSS")).otherwise(""), F.lit("+00:00"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """The whole observation schema, absent columns and nulls filled with their defaults."""
    out = rows
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    for name, kind in (("value", "double"), ("period_start", "date"), ("period_end", "date"), ("normalization_id", "string"), ("censored", "boolean"), ("approximate", "boolean"), ("phrase", "string"), ("source", "string"), ("metric", "string"), ("observed_at", "timestamp")):
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    if "dimensions" not in rows.columns:
        out = out.withColumn("dimensions", F.create_map().cast("map<string,string>"))
    kind = F.col("evidence_kind") == "search_volume_estimate"
    return out.withColumn("approximate", F.coalesce("approximate", kind)).withColumn("censored", F.coalesce("censored", F.lit(False)))


def validated(rows: DataFrame, now: Column) -> DataFrame:
    """Adds ``problem`` (the first broken rule, or null), ``identity`` and ``id``."""
    r = with_defaults(rows)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    odd = lambda c: (F.length(c) > 4000) | F.col(c).rlike(r"[\x00-\x1f]")
    labels = [F.coalesce(odd(c), F.lit(False)) for c in ("subject", "platform", "phrase", "source", "metric", "unit", "scope", "window", "geography", "normalization_id")]
    rules = [
        (blank("phrase") | blank("source") | blank("metric"), "missing-label"),
        (reduce(or_, labels), "overlong-or-control-label"),
        (F.col("observed_at").isNull(), "missing-capture-time"),
        (F.col("observed_at") > now, "future-capture"),
        (~F.col("evidence_kind").isin(*KINDS), "unknown-evidence-kind"),
        (~F.col("availability").isin(*AVAILABILITY), "unknown-availability"),
        (~F.col("completeness").isin(*COMPLETENESS), "unknown-completeness"),
        ((F.col("availability") != "observed") & F.col("value").isNotNull(), "value-of-unavailable"),
        (F.isnan("value"), "not-a-number"),
        (F.col("period_start").isNull() != F.col("period_end").isNull(), "half-period"),
        (F.col("period_start") > F.col("period_end"), "period-out-of-order"),
        (F.col("period_end").cast("timestamp") > F.col("observed_at"), "period-after-capture"),
    ]
    problem = F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in rules])
    dims = F.map_from_entries(F.array_sort(F.map_entries("dimensions")))
    texts = sorted(set(IDENTITY_FIELDS) - {"dimensions"})
    out = r.withColumn("problem", problem).withColumn("_f", folded_fields(F.array(*texts)))
    out = out.withColumn("identity", F.sha2(canonical({"dimensions": dims} | {f: F.col("_f")[k] for k, f in enumerate(texts)}), 256)).drop("_f")
    return out.withColumn("id", F.sha2(observation_text(out, dims), 256))


def observation_text(rows: DataFrame, dims: Column) -> Column:
    """The canonical JSON of an observation, of which its id is the digest.  ``value`` is a number
    or, in a column of texts, what was displayed."""
    fields = {f: F.trim(f) for f in IDENTITY_FIELDS if f not in ("dimensions", "evidence_kind")} | {f: F.col(f) for f in ("evidence_kind", "availability", "approximate", "censored", "completeness", "identity")}
    fields |= {f: F.date_format(f, "yyyy-MM-dd") for f in ("period_start", "period_end")} | {"dimensions": dims, "observed_at": iso_stamp(F.col("observed_at"))}
    fields |= {f: F.col(f) if f in rows.columns else F.lit(None).cast("string") for f in ("notes", "source_url", "capture_file", "capture_sha256", "target_surface")}
    if dict(rows.dtypes)["value"] == "string":
        return canonical(fields | {"value": F.col("value")})
    before, after = {k: v for k, v in fields.items() if k < "value"}, {k: v for k, v in fields.items() if k > "value"}
    number = F.coalesce(plain_number(F.col("value")), F.lit("null"))
    return F.concat(F.regexp_replace(canonical(before), r"\}$", ""), F.lit(',"value":'), number, F.lit(","), F.substr(canonical(after), F.lit(2)))


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("problem IS NULL"), rows.where("problem IS NOT NULL")


def new_rows(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows not yet stored; repeated delivery of a snapshot adds nothing."""
    return incoming.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti")


def as_of(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("observed_at") <= now)


def current_watches(versions: DataFrame) -> DataFrame:
    """The latest version of each watch, if active."""
    return latest(versions, ["id"], F.col("version")).where("active").select(*versions.columns)


def watch_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions to append: watches whose content differs from their latest version."""
    content = [c for c in incoming.columns if c != "version"]
    digest = F.sha2(F.to_json(F.struct(*sorted(content))), 256)
    latest = stored.groupBy("id").agg(F.max_by(digest, "version").alias("_d"), F.max("version").alias("_v"))
    fresh = incoming.select(*content).withColumn("_new", digest).join(latest, "id", "left").where("_d IS NULL OR _d <> _new")
    return fresh.select(*content, (F.coalesce("_v", F.lit(0)) + 1).alias("version"))


def watched(watches: DataFrame, observations: DataFrame) -> DataFrame:
    """(watch_id, w_*, observation columns): every watch with the observations it matches."""
    w = watches.select(*[F.col(c).alias(f"w_{c}") for c in watches.columns]).withColumnRenamed("w_id", "watch_id")
    named = [f for f in WATCH_FIELDS if f in watches.columns and f in observations.columns]
    fields = ["subject", "platform", *named]
    pattern = sum((F.when(F.col(f"w_{f}").isNotNull(), 1 << k).otherwise(0) for k, f in enumerate(fields)), F.lit(0)).cast("int")
    w = w.withColumn("_pattern", pattern).withColumn("_key", F.to_json(folded_fields(F.array(*[f"w_{f}" for f in fields]))))
    # At most as many rows as there are patterns; what the array holds doesn't grow with the data.
    patterns = w.select("_pattern").distinct().agg(F.sort_array(F.collect_list("_pattern")).alias("p"))
    named_by = lambda x, k: F.when(F.bit_get(F.col("_pattern"), k) == 1, x)
    o = observations.withColumn("_f", folded_fields(F.array(*fields))).withColumn("_pattern", F.explode(patterns.scalar()))
    o = o.withColumn("_key", F.to_json(F.transform("_f", named_by))).drop("_f")
    joined = w.join(o, ["_pattern", "_key"]).drop("_pattern", "_key")
    if "w_dimensions" in w.columns and "dimensions" in observations.columns:
        joined = joined.where(F.forall(F.map_entries("w_dimensions"), lambda e: F.try_element_at("dimensions", e["key"]).eqNullSafe(e["value"])))
    return joined


def signature(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in SIGNATURE if c in rows.columns]), {"ignoreNullFields": "false"})


def conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Captures of one identity and time with several signatures."""
    return rows.groupBy(*keys, "observed_at").agg(F.count_distinct(signature(rows)).alias("signatures")).where("signatures > 1")


def latest(rows: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """The row of each key with the greatest ``newest``; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), newest).alias("_r")).select(*keys, "_r.*")


def coverage(watches: DataFrame, observations: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """(watch_id, status, ages in days, counts) of every watch.

    Status: missing; availability; missing-value; partial; current; stale from current or
    partial; a failed or running attempt newer than the latest row; conflicts override all.
    Captures in conflict give no demand signal."""
    o = watched(watches, as_of(observations, now))
    order = F.struct("observed_at", "id")
    usable = (F.col("availability") == "observed") & F.col("value").isNotNull()
    sig = signature(o)
    times = o.groupBy("watch_id", "identity", "observed_at").agg(
        F.count("*").alias("n"), F.max(order).alias("at"), F.max_by(F.struct("availability", "value", "completeness", "observed_at"), order).alias("last"),
        F.max(F.when(usable, order)).alias("good_at"), F.max_by(F.struct("observed_at", "period_end", "evidence_kind"), F.when(usable, order)).alias("good"),
        F.max(F.when(usable & F.col("evidence_kind").isin(*DEMAND_KINDS), F.col("observed_at"))).alias("demand"), (F.min(sig) != F.max(sig)).alias("clash"),
    )
    per = times.groupBy("watch_id").agg(
        F.sum("n").alias("observations"), F.max_by("last", "at").alias("last"), F.max_by("good", "good_at").alias("good"),
        F.max(F.when(~F.col("clash"), F.col("demand"))).alias("last_demand_at"), F.count_if("clash").alias("conflict_groups"),
    )
    tried = attempts.where(F.col("started_at") <= now).groupBy("watch_id").agg(F.max_by(F.struct("started_at", "state"), "started_at").alias("attempt"))
    days = lambda t: (F.unix_micros(now) - F.unix_micros(t)) / F.lit(86_400_000_000)
    joined = watches.select(F.col("id").alias("watch_id"), "freshness_days").join(per, "watch_id", "left").join(tried, "watch_id", "left")
    aged = joined.withColumn("capture_age", days(F.col("good.observed_at"))).withColumn("report_age", days(F.col("good.period_end").cast("timestamp")))
    state = (
        F.when(F.col("last").isNull(), "missing").when(F.col("last.availability") != "observed", F.col("last.availability"))
        .when(F.col("last.value").isNull(), "missing-value").when(F.col("last.completeness") == "partial", "partial").otherwise("current")
    )
    stale = state.isin("current", "partial") & (F.greatest("capture_age", F.coalesce("report_age", F.lit(0.0))) > F.col("freshness_days"))
    newer = F.col("attempt.state").isin("error", "interrupted", "running") & (F.col("last").isNull() | (F.col("attempt.started_at") > F.col("last.observed_at")))
    status = F.when(F.col("conflict_groups") > 0, "conflicting-captures").when(F.coalesce(newer, F.lit(False)), F.col("attempt.state")).when(F.coalesce(stale, F.lit(False)), "stale").otherwise(state)
    return aged.select(
        "watch_id", status.alias("status"), F.coalesce("observations", F.lit(0)).alias("observations"), F.round("capture_age", 2).alias("capture_age_days"),
        F.round("report_age", 2).alias("report_age_days"), F.col("last_demand_at").isNotNull().alias("has_demand_signal"), F.coalesce("conflict_groups", F.lit(0)).alias("conflict_groups"),
    )


def evidence_counts(watches: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """(watch_id, evidence_kind, observations) of the observations that each watch has."""
    return watched(watches, as_of(observations, now)).groupBy("watch_id", "evidence_kind").agg(F.count("*").alias("observations"))


def comparable_reason(a: str, b: str) -> Column:
    """Why two observations (struct columns a before b) can't be compared, or null."""
    x = lambda f: F.col(f"{a}.{f}")
    y = lambda f: F.col(f"{b}.{f}")

    def either(test) -> Column:
        return F.coalesce(test(x), F.lit(False)) | F.coalesce(test(y), F.lit(False))

    def first(name, test):
        return [(F.coalesce(test, F.lit(False)), name)]

    context = lambda s: (s("scope") == "unspecified") | (s("window") == "unspecified") | (s("unit") == "unspecified") | (s("geography") == "unspecified")
    per_row = []
    for s in (x, y):
        per_row += [
            (s("availability") != "observed", "unavailable-or-failed"), (s("value").isNull(), "non-numeric-or-missing"),
            (s("approximate") | s("censored"), "approximate-or-censored"), (s("completeness") != "complete", "partial-or-unknown-completeness"),
            (context(s), "missing-comparison-context"),
            (s("evidence_kind").isin("proposal", "text_salience", "language_suggestion", "unknown"), "not-a-comparable-demand-or-performance-measurement"),
        ]
    relative = y("evidence_kind").isin("relative_interest", "platform_search_interest") | F.contains(F.lower(y("unit")), F.lit("index"))
    rules = [
        (x("identity") != y("identity"), "source-or-dimensions-changed"), (x("observed_at") >= y("observed_at"), "capture-not-chronological"), *per_row,
        (relative & either(lambda s: F.coalesce(s("normalization_id"), F.lit("")) == ""), "relative-index-needs-shared-normalization"),
        (x("period_start").isNull() != y("period_start").isNull(), "reporting-period-missing"),
        (x("period_end") >= y("period_start"), "reporting-periods-overlap-or-are-revisions"),
        (F.date_diff(x("period_end"), x("period_start")) != F.date_diff(y("period_end"), y("period_start")), "reporting-period-length-changed"),
        (x("period_start").isNull() & y("evidence_kind").isin("property_performance", "channel_referral"), "performance-needs-reporting-periods"),
    ]
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])


def alerts(watches: DataFrame, observations: DataFrame, now: Column, acknowledged: DataFrame | None = None) -> DataFrame:
    """(watch_id, identity, reason, before, after, delta, percent, alert_id): per watch and
    identity the last change (reason null) or why there is none.

    The row before is the previous capture; only if their periods overlap, the newest earlier
    row that can be compared."""
    o = watched(watches, as_of(observations, now))
    fields = ("identity", "observed_at", "id", "value", "availability", "approximate", "censored", "completeness", "scope", "window", "unit", "geography", "evidence_kind", "normalization_id", "period_start", "period_end")
    keys, sig = ["watch_id", "identity"], signature(o)
    # The last copy of each capture time, and whether its copies differ.
    once = o.groupBy(*keys, "observed_at").agg(
        F.max_by(F.struct(*fields), "id").alias("row"), (F.min(sig) != F.max(sig)).alias("clash"), F.first("w_min_absolute_change").alias("w_min_absolute_change"), F.first("w_min_percent_change").alias("w_min_percent_change")
    )
    newest = Window.partitionBy(*keys).orderBy(F.col("observed_at").desc())
    ranked = once.withColumn("n", F.row_number().over(newest)).withColumn("after", F.first("row").over(newest))
    paired = ranked.withColumn("pair", F.when(F.col("n") > 1, F.struct(F.col("row").alias("before"), comparable_reason("row", "after").alias("reason"))))
    overlap = "reporting-periods-overlap-or-are-revisions"
    chosen = paired.groupBy(*keys).agg(
        F.first("after").alias("after"), F.first("w_min_absolute_change").alias("w_min_absolute_change"), F.first("w_min_percent_change").alias("w_min_percent_change"),
        F.max("clash").alias("clash"), F.max_by("pair", F.when(F.col("n") == 2, 1)).alias("second"),
        F.min_by("pair", F.when((F.col("n") > 1) & F.col("pair.reason").isNull(), F.col("n"))).alias("older"),
    )
    picked = F.when((F.col("second.reason") == overlap) & F.col("older").isNotNull(), F.col("older")).otherwise(F.col("second"))
    full = chosen.withColumn("p", picked)
    before, now_ = F.col("p.before.value"), F.col("after.value")
    delta = now_ - before
    percent = F.try_divide(delta * 100.0, F.abs(before))
    reason = F.when(F.col("clash"), "conflicting-capture-timestamps").when(F.col("p").isNull(), "needs-two-observations").otherwise(F.col("p.reason"))
    small = (F.coalesce(delta, F.lit(0.0)) == 0) | F.coalesce(F.abs(delta) < F.col("w_min_absolute_change"), F.lit(False)) | (
        F.col("w_min_percent_change").isNotNull() & (percent.isNull() | (F.abs(percent) < F.col("w_min_percent_change")))
    )
    out = full.select(
        *keys, reason.alias("reason"), before.alias("before"), now_.alias("after"), F.when(reason.isNull(), delta).alias("delta"),
        F.when(reason.isNull(), percent).alias("percent"), small.alias("small"), F.sha2(canonical({"watch_id": F.col("watch_id"), "before": F.col("p.before.id"), "after": F.col("after.id")}), 256).alias("alert_id"),
    ).where("reason IS NOT NULL OR NOT small").drop("small")
    return out.join(acknowledged.select("alert_id"), "alert_id", "left_anti") if acknowledged is not None else out


def due(watches: DataFrame, observations: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """(watch_id, due_at) of watches whose cadence is over and that aren't running."""
    seen = watched(watches, as_of(observations, now)).groupBy("watch_id").agg(F.max("observed_at").alias("o"))
    tried = attempts.where(F.col("started_at") <= now).groupBy("watch_id").agg(F.max("started_at").alias("a"), F.bool_or(F.col("state") == "running").alias("running"))
    joined = watches.select(F.col("id").alias("watch_id"), "cadence_hours").join(seen, "watch_id", "left").join(tried, "watch_id", "left")
    last = F.greatest("o", "a")
    at = F.coalesce(F.timestamp_micros(F.unix_micros(last) + (F.col("cadence_hours") * 3_600_000_000).cast("bigint")), now)
    return joined.where("NOT coalesce(running, false)").select("watch_id", at.alias("due_at")).where(F.col("due_at") <= now).orderBy("watch_id")


def history(watches: DataFrame, observations: DataFrame, now: Column, limit: int) -> DataFrame:
    o = watched(watches, as_of(observations, now))
    return o.orderBy(F.col("observed_at").desc(), F.col("id").desc()).limit(limit).orderBy("observed_at", "id")


def acknowledged(known: DataFrame, current: DataFrame, wanted: list[str]) -> DataFrame:
    """Acknowledgements to append; ids that are no current alert raise when read."""
    asked = current.sparkSession.createDataFrame([(x,) for x in wanted], "alert_id string")
    judged = asked.join(current.select("alert_id", F.lit(True).alias("there")), "alert_id", "left")
    checked = F.when(F.col("there"), F.col("alert_id")).otherwise(F.raise_error(F.concat(F.lit("unknown alert "), F.col("alert_id"))).cast("string"))
    return judged.select(checked.alias("alert_id")).join(known, "alert_id", "left_anti")


def verified(snapshots: DataFrame, content: str, digest: str) -> DataFrame:
    """(rows, damaged): stored digests against recomputed ones."""
    return snapshots.agg(F.count("*").alias("rows"), F.count_if(F.sha2(content, 256) != F.col(digest)).alias("damaged"))


def pruned(rows: DataFrame, cutoff: Column, platform: str | None = None) -> DataFrame:
    """What stays after deleting rows before the cutoff (of one platform)."""
    gone = F.col("observed_at") < cutoff
    if platform is not None:
        gone = gone & (folded_fields(F.array("platform"))[0] == unicodedata.normalize("NFC", platform.strip()).casefold())
    return rows.where(~F.coalesce(gone, F.lit(False)))


def quota_use(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("account", F.to_date("started_at").alias("day")).agg(F.count("*").alias("runs"), F.sum("requests").alias("requests"))


def finished(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Running attempts take their terminal state once; others stay as they are."""
    r = results.select("attempt_id", F.col("state").alias("_state"))
    state = F.when((F.col("state") == "running") & F.col("_state").isin("done", "error", "interrupted"), F.col("_state")).otherwise(F.col("state"))
    return attempts.join(r, "attempt_id", "left").withColumn("state", state).drop("_state")


def coverage_html(report: DataFrame, limit: int = 10_000) -> str:
    """A small table for people; refuses more than ``limit`` watches instead of cutting."""
    import html

    rows = report.orderBy("watch_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: summarise first")
    cells = lambda r: "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in report.columns)
    return f"<table><tr>{head}</tr>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows) + "</table>"


# Older names of evidence kinds.
OLDER_KINDS = {"native-autocomplete": "language_suggestion", "native-caption-language": "language_suggestion", "native-search-sample": "language_suggestion", "third-party-estimate": "search_volume_estimate"}


def adapted(rows: DataFrame) -> DataFrame:
    """Reviewed rows of older files under today's names.  rows: evidence_kind, availability,
    value STRING and any other columns.

    Older kinds are renamed; an estimate of a third party is approximate, and censored where
    its display has ``<`` or ``>`` before a digit.  Language from a sample is observed; an
    unavailable measurement has no value.  Captures given as ``unavailable`` are none.  What
    was changed is told in ``notes``; a ``seed_keyword`` becomes a dimension."""
    has = lambda c: c in rows.columns
    text = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    kind, state, shown = F.col("evidence_kind"), F.coalesce("availability", F.lit("observed")), F.col("value")
    newer = F.try_element_at(F.create_map(*[F.lit(x) for pair in OLDER_KINDS.items() for x in pair]), kind)
    sampled, gone, estimate = state == "sampled-language", state.isin("unavailable", "error", "suppressed", "no-data"), F.coalesce(kind == "third-party-estimate", F.lit(False))
    captures = {c: F.when(F.col(c) == "unavailable", None).otherwise(F.col(c)) for c in ("capture_file", "capture_sha256") if has(c)}
    remarks = [
        F.nullif(text("notes"), F.lit("")), F.when(newer.isNotNull(), F.concat(F.lit("Imported reviewed evidence kind: "), kind, F.lit("."))),
        F.when(sampled, F.lit("Original availability: sampled-language; no measured demand implied.")), F.when(gone & shown.isNotNull(), F.concat(F.lit("Original unavailable display: "), shown)),
        *[F.when(F.col(c) == "unavailable", F.lit(f"Original {c}: unavailable.")) for c in captures], F.nullif(text("limitations"), F.lit("")),
    ]
    changed = {
        "evidence_kind": F.coalesce(newer, kind), "availability": F.when(sampled, "observed").otherwise(state), "value": F.when(~gone, shown), **captures, "notes": F.nullif(F.concat_ws(" ", *remarks), F.lit("")),
        "approximate": estimate | (F.coalesce("approximate", F.lit(False)) if has("approximate") else F.lit(False)),
        "censored": (estimate & ~gone & F.coalesce(shown.rlike(r"[<>]\s*\d"), F.lit(False))) | (F.coalesce("censored", F.lit(False)) if has("censored") else F.lit(False)),
    }
    if has("seed_keyword"):
        seed = F.when(F.coalesce("seed_keyword", F.lit("")) != "", F.create_map(F.lit("seed_keyword"), F.col("seed_keyword")))
        own = F.col("dimensions") if has("dimensions") else F.create_map().cast("map<string,string>")
        changed["dimensions"] = F.map_zip_with(F.coalesce(own, F.create_map().cast("map<string,string>")), F.coalesce(seed, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
    return rows.select(*[F.col(c) for c in rows.columns if c not in changed], *[v.alias(k) for k, v in changed.items()])


def in_context(rows: DataFrame, defaults: dict[str, str], scope_fields: tuple[str, ...] = ()) -> DataFrame:
    """Row values over defaults; scope columns moved into the dimensions map."""
    out = rows
    for k, v in defaults.items():
        out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v))
    if scope_fields:
        own = F.map_filter(F.create_map(*[x for f in scope_fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda _, v: v.isNotNull())
        out = out.withColumn("dimensions", F.map_concat("dimensions", own) if "dimensions" in rows.columns else own).drop(*scope_fields)
    return out


def runnable(plan: DataFrame, watches: DataFrame) -> DataFrame:
    """(watch_id, problem): plan entries against the watches they were made from."""
    now = watches.select(F.col("id").alias("watch_id"), F.sha2(F.to_json(F.struct(*sorted(watches.columns))), 256).alias("_now"))
    problem = F.when(F.col("_now").isNull(), "unknown-watch").when(F.col("_now") != F.col("watch_sha256"), "watch-changed")
    return plan.join(now, "watch_id", "left").select("watch_id", problem.alias("problem"))


def capture_status(references: DataFrame, files: DataFrame) -> DataFrame:
    """(status, captures) of distinct references (file, sha256) against files (file, content)."""
    there = files.select("file", F.sha2("content", 256).alias("_sha"))
    judged = references.where("file IS NOT NULL").select("file", F.lower("sha256").alias("sha256")).distinct().join(there, "file", "left")
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unhashed").when(F.col("_sha") != F.col("sha256"), "changed").otherwise("verified")
    return judged.groupBy(status.alias("status")).agg(F.count("*").alias("captures"))
