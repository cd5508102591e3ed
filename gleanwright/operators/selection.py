"""Editorial selection: focus, shortlist, hashtag plan, copy audit.

Greedy choices with a cap per group and a limit over all equal two windows: the
first ``cap`` rows of each group, then the first ``limit`` of those.  Every
rejected row keeps the first reason that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwright.functions.text import title_form

# Fixed values.
FOCUS_STOPWORDS = ("a", "an", "the", "about", "for", "of", "to", "in", "and", "with")
GENERIC_TAGS = ("#fyp", "#foryou", "#foryoupage", "#viral", "#trending", "#explorepage")
PROFILES = {
    "youtube": (3, "description"), "tiktok": (5, "caption"), "instagram": (5, "caption"), "facebook": (2, "caption"), "x": (2, "post"), "bluesky": (2, "post"),
    "mastodon": (3, "post"), "linkedin": (3, "post"), "threads": (0, "native_topic"), "pinterest": (0, "keywords_and_topics"), "reddit": (0, "community_title_and_flair"),
    "wordpress": (0, "natural_copy_and_taxonomy"), "spotify": (0, "native_metadata"), "amazon-music": (0, "native_metadata"), "apple-music": (0, "native_metadata"),
    "bandcamp": (0, "native_tags"), "soundcloud": (0, "native_tags"),
}
SINGLE_ROLES = ("brand", "format", "trend")


def contains_words(words: Column, needle: Column) -> Column:
    """Whether the words of ``needle`` stand next to each other in ``words``."""
    k = F.size(needle)
    last = F.size(words) - k + 1
    return F.when((k == 0) | (last < 1), F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(words, i, k) == needle))


def _literal(phrase: str) -> Column:
    return title_form(F.lit(phrase))


def focused(rows: DataFrame, phrase: str, order: str, seed: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), groups: tuple[tuple[str, ...], ...] = (), all_seed_terms: bool = False, min_overlap: int = 1, subject: str | None = None) -> DataFrame:
    """Adds ``overlap`` and ``reason`` (null: kept): subject, exclusions, inclusions, required
    groups, seed terms, overlap, in this order."""
    words = title_form(F.col(phrase))
    seed_words = F.array_except(F.array_distinct(_literal(seed)), F.array(*[F.lit(w) for w in FOCUS_STOPWORDS]))
    w = rows.withColumn("_w", words).withColumn("_s", seed_words).withColumn("overlap", F.size(F.array_intersect("_w", "_s")))
    any_of = lambda phrases: F.coalesce(*[F.when(contains_words(F.col("_w"), _literal(p)), True) for p in phrases], F.lit(False)) if phrases else F.lit(False)
    rules = []
    if subject is not None:
        rules.append((~F.col("subject").eqNullSafe(F.lit(subject)), "different_subject"))
    if exclude:
        rules.append((any_of(exclude), "excluded_phrase"))
    if include:
        rules.append((~any_of(include), "required_context_absent"))
    for group in groups:
        rules.append((~any_of(group), "required_context_group_absent"))
    if all_seed_terms:
        rules.append((F.size(F.array_except("_s", "_w")) > 0, "missing_seed_terms"))
    rules.append((F.col("overlap") < min_overlap, "insufficient_seed_overlap"))
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules])
    return w.withColumn("reason", reason).withColumn("is_seed", F.lower(F.trim(phrase)) == seed.lower().strip()).drop("_w", "_s")


def focus_order() -> list[Column]:
    return [F.col("is_seed").desc(), F.col("overlap").desc()]


def capped(rows: DataFrame, group: str, order: list[Column], cap: Column | int, limit: int) -> DataFrame:
    """Adds ``selected`` and ``group_place``: first ``cap`` of each group, first ``limit`` of all.

    At most cap rows of each group meet in the last ordering, and of them only the first
    ``limit`` are taken by a top-k, so no task orders the whole table."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    placed = rows.withColumn("group_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.where(F.col("group_place") <= cap).orderBy(*order).limit(limit)


def shortlist(rows: DataFrame, key: str, group: str, priority: str, fit: str, intent: str, clarity: str, wanted: str = "listening", adjacent: bool = False, per_group: int = 2, limit: int = 5) -> DataFrame:
    """Adds ``reason`` (null: selected)."""
    fits = (F.col(fit) == "direct") | (F.col(fit) == "adjacent") if adjacent else F.col(fit) == "direct"
    first = F.when(F.col(fit).isNull(), "unreviewed").when(~fits, "fit_ineligible").when(F.col(intent) != wanted, "different_intent").when(F.col(clarity) != "natural", "awkward_wording")
    judged = rows.withColumn("_first", first)
    chosen = capped(judged.where("_first IS NULL"), group, [F.col(priority), F.col(key)], per_group, limit)
    full = chosen.groupBy(group).agg(F.count("*").alias("_taken"))
    marked = judged.join(chosen.select(key, F.lit(True).alias("_in")), key, "left").join(full, group, "left")
    reason = F.coalesce("_first", F.when(F.col("_in").isNull(), F.when(F.col("_taken") >= per_group, "intent_group_cap").otherwise("outside_shortlist_limit")))
    return marked.withColumn("reason", reason).drop("_first", "_in", "_taken")


def hashtag_plan(rows: DataFrame, platform: str, planned: Column, reviewed: Column, native_checked: Column | None) -> DataFrame:
    """rows: tag, fit, safety, role, priority, freshest (date), trend_at (date), local BOOLEAN.
    Adds ``reason`` (null: selected), by eligibility, then ceiling, then role cap."""
    age = lambda d: F.date_diff(planned, d)
    checked = native_checked if native_checked is not None else F.lit(None).cast("date")
    trend = (F.col("role") == "trend") & (checked.isNull() | (age(checked) > 7) | F.col("trend_at").isNull() | (age(F.col("trend_at")) > 7) | F.col("local"))
    first = (
        F.when(F.col("fit") != "direct", "not_directly_relevant").when(F.col("safety") != "clear", "safety_hold_or_rejection").when(F.col("tag").isin(*GENERIC_TAGS), "generic_reach_bait")
        .when(age(reviewed) > 14, "review_expires_before_planned_use").when(F.coalesce(trend, F.lit(False)), "trend_needs_recent_native_evidence")
        .when(~F.col("local") & (F.col("freshest").isNull() | (age(F.col("freshest")) > 30)), "discovery_evidence_missing_or_stale")
    )
    ceiling, _ = PROFILES[platform]
    judged = rows.withColumn("_first", first)
    cap = F.when(F.col("role").isin(*SINGLE_ROLES), 1).otherwise(2)
    order = [F.col("priority"), F.col("tag")]
    chosen = capped(judged.where("_first IS NULL"), "role", order, cap, ceiling) if ceiling else judged.where("false")
    last = chosen.agg(F.when(F.count("*") >= ceiling, F.max(F.struct("priority", "tag"))).alias("_last"))
    marked = judged.join(chosen.select("tag", F.lit(True).alias("_in")), "tag", "left").withColumn("_last", last.scalar())
    beyond = F.coalesce(F.struct("priority", "tag") > F.col("_last"), F.lit(False))
    rest = F.when(F.lit(ceiling == 0), "native_surface_instead_of_hashtags").when(beyond, "editorial_ceiling").otherwise("role_cap")
    return marked.withColumn("reason", F.coalesce("_first", F.when(F.col("_in").isNull(), rest))).drop("_first", "_in", "_last")


def copy_issues(planned: DataFrame, published: DataFrame, tag: str) -> DataFrame:
    """(tag, issue): tags missing from, added to or repeated in the published copy."""
    n = lambda rows, name: rows.groupBy(tag).agg(F.count("*").alias(name))
    both = n(planned, "p").join(n(published, "q"), tag, "full_outer")
    issue = F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "unplanned").when(F.col("q") > F.col("p"), "repeated")
    return both.select(tag, issue.alias("issue")).where("issue IS NOT NULL")


def copy_audit(planned: DataFrame, published: DataFrame, tag: str, ceiling: int, expires: Column, on: Column) -> DataFrame:
    """(tag, issue): ``copy_issues``, and with a null tag ``over-ceiling`` if the copy has more tags
    than its platform takes, and ``plan-expired`` if it is published after the plan's last day."""
    tags = published.agg(F.when(F.count("*") > ceiling, F.lit("over-ceiling")).alias("issue"))
    late = published.agg(F.when(on > expires, F.lit("plan-expired")).alias("issue"))
    whole = tags.unionAll(late).where("issue IS NOT NULL").select(F.lit(None).cast(dict(planned.dtypes)[tag]).alias(tag), "issue")
    return copy_issues(planned, published, tag).unionAll(whole)


def discovered(records: DataFrame, key: str, tags: str, order: str) -> DataFrame:
    """(tag, records, display): record counts and the first seen spelling of each tag."""
    seen = records.select(key, order, F.posexplode(tags).alias("tag_place", "spelling")).withColumn("tag", F.lower("spelling"))
    return seen.groupBy("tag").agg(F.count_distinct(key).alias("records"), F.min_by("spelling", F.struct(order, "tag_place")).alias("display"))


def profiles(spark) -> DataFrame:
    """(platform, ceiling, surface) of the editorial profiles."""
    return spark.createDataFrame([(k, *v) for k, v in sorted(PROFILES.items())], "platform string, ceiling int, surface string")


def reviewed(pool: DataFrame, review: DataFrame, key: str) -> DataFrame:
    """The pool with its review; a repeated or orphan decision raises when read."""
    counted = review.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    joined = pool.withColumn("_p", F.lit(True)).join(counted, key, "full_outer")
    bad = F.when(F.col("_p").isNull(), F.lit("orphan decision ")).when(F.col("_n") > 1, F.lit("repeated decision "))
    checked = F.when(bad.isNull(), F.col(key)).otherwise(F.raise_error(F.concat(bad, F.col(key))).cast(dict(pool.dtypes)[key]))
    return joined.withColumn(key, checked).drop("_p", "_n")
